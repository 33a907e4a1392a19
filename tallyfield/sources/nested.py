"""Un-nesting of provider documents: line-ups, statistics, events, standings, rankings.

A document is one row; parts that a provider sends as an object or as a list are both read
as a list.  Statistics are [{type or name, value}] with an open set of names, so they become
a map; `stat(map, name)` picks one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions.paths import resolve


def many(df: DataFrame, path: str) -> tuple[Column, T.DataType] | None:
    """(array column, element type) of a part that is an object or a list; None where it is missing."""
    found = resolve(df.schema, path)
    if found is None:
        return None
    col, kind = found
    if isinstance(kind, T.ArrayType):
        return col, kind.elementType
    return (F.when(col.isNotNull(), F.array(col)), kind) if isinstance(kind, T.StructType) else None


def _field(item: Column, kind: T.DataType, name: str) -> Column:
    return item.getField(name) if isinstance(kind, T.StructType) and name in kind.fieldNames() else F.lit(None)


def flatten_stats(stats: Column, kind: T.DataType, key: str = "type") -> Column:
    """Map of a list of {key, value}; entries without a key are left out, the last of equal keys stays."""
    item = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(item, T.StructType) or key not in item.fieldNames():
        return F.create_map().cast("map<string,string>")
    named = F.filter(stats, lambda s: s[key].isNotNull())
    entries = F.transform(named, lambda s: F.struct(s[key].alias("k"), (s["value"] if "value" in item.fieldNames() else F.lit(None)).cast("string").alias("v")))
    last = F.aggregate(entries, F.array().cast("array<struct<k:string,v:string>>"), lambda a, e: F.concat(F.filter(a, lambda x: x["k"] != e["k"]), F.array(e)))
    keys = F.transform(named, lambda s: s[key])
    # the walk over all entries for each is for lists that name one twice
    once = F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last)
    return F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,string>"))


def stat(stats: Column, name: str, number: bool = True) -> Column:
    value = F.try_element_at(stats, F.lit(name))
    return value.try_cast("double") if number else value


def _has_stats(item: Column, kind: T.DataType, key: str) -> Column:
    """Whether _stats_of has an entry, told without making it."""
    if not isinstance(kind, T.StructType) or "stat" not in kind.fieldNames():
        return F.lit(False)
    own, col = kind["stat"].dataType, item.getField("stat")
    one = own.elementType if isinstance(own, T.ArrayType) else own
    if not isinstance(one, T.StructType) or key not in one.fieldNames():
        return F.lit(False)
    return F.exists(col, lambda s: s[key].isNotNull()) if isinstance(own, T.ArrayType) else col[key].isNotNull()


def _stats_of(item: Column, kind: T.DataType, key: str) -> Column:
    if isinstance(kind, T.StructType) and "stat" in kind.fieldNames():
        own = kind["stat"].dataType
        col = item.getField("stat")
        return flatten_stats(col if isinstance(own, T.ArrayType) else F.array(col), own, key)
    return F.create_map().cast("map<string,string>")


def _plain(item: Column, kind: T.DataType, *without: str) -> list[Column]:
    return [item.getField(f).alias(f) for f in kind.fieldNames() if f not in without] if isinstance(kind, T.StructType) else []


def _info(df: DataFrame, path: str, name: str) -> Column:
    found = resolve(df.schema, path)
    return (found[0] if found else F.lit(None).cast("string")).alias(name)


def player_stats(df: DataFrame) -> DataFrame:
    """A row for each player of the line-ups that has statistics (map `stats`)."""
    teams, team_kind = many(df, "liveData.lineUp") or (None, None)
    if teams is None:
        raise ValueError("no liveData.lineUp")
    rows = df.select(_info(df, "matchInfo.id", "_match_uuid"), _info(df, "matchInfo", "_match_info"), F.explode(teams).alias("_team"))
    players, kind = many(rows, "_team.player") or (None, None)
    if players is None:
        raise ValueError("no players in the line-ups")
    rows = rows.select("_match_uuid", "_match_info", _field(F.col("_team"), team_kind, "contestantId").alias("_contestant_id"), F.explode(players).alias("_p"))
    rows = rows.filter(_has_stats(F.col("_p"), kind, "type"))
    return rows.select(*_plain(F.col("_p"), kind, "stat"), _stats_of(F.col("_p"), kind, "type").alias("stats"), "_match_uuid", "_contestant_id", "_match_info")


def team_stats(df: DataFrame) -> DataFrame:
    """A row for each side of the line-ups that has statistics."""
    teams, kind = many(df, "liveData.lineUp") or (None, None)
    if teams is None:
        raise ValueError("no liveData.lineUp")
    rows = df.select(_info(df, "matchInfo.id", "_match_uuid"), _info(df, "matchInfo", "_match_info"), F.explode(teams).alias("_t"))
    rows = rows.filter(_has_stats(F.col("_t"), kind, "type"))
    return rows.select(_field(F.col("_t"), kind, "contestantId").alias("contestantId"), _stats_of(F.col("_t"), kind, "type").alias("stats"), "_match_uuid", "_match_info")


def match_events(df: DataFrame) -> DataFrame:
    """A row for each event, wherever the document holds the list."""
    places = [m for p in ("liveData.event", "liveData.events.event") if (m := many(df, p))]
    if not places:
        raise ValueError("no events")
    events = reduce(lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b), [m[0] for m in places])
    return df.select(F.explode(events).alias("_e"), _info(df, "matchInfo", "_match_info"), _info(df, "liveData.matchDetails", "_match_details")).select("_e.*", "_match_info", "_match_details")


def season_player_stats(df: DataFrame) -> DataFrame:
    """A row for each player of a season, with statistics or without."""
    players, kind = many(df, "player") or (None, None)
    if players is None:
        raise ValueError("no players")
    rows = df.select(F.explode(players).alias("_p"), _info(df, "competition", "_competition"), _info(df, "tournamentCalendar", "_tournament_calendar"))
    return rows.select(*_plain(F.col("_p"), kind, "stat"), _stats_of(F.col("_p"), kind, "name").alias("stats"), "_competition", "_tournament_calendar")


def season_team_stats(df: DataFrame) -> DataFrame:
    """The season's team, without its players."""
    teams, kind = many(df, "contestant") or (None, None)
    if teams is None:
        raise ValueError("no contestant")
    rows = df.select(F.explode(teams).alias("_t"), _info(df, "competition", "_competition"), _info(df, "tournamentCalendar", "_tournament_calendar"))
    return rows.select(*_plain(F.col("_t"), kind, "stat", "player"), _stats_of(F.col("_t"), kind, "name").alias("stats"), "_competition", "_tournament_calendar")


def tournament_schedule(df: DataFrame) -> DataFrame:
    """A row for each match of each day of a schedule."""
    days, kind = many(df, "matchDate") or (None, None)
    if days is None:
        raise ValueError("no matchDate")
    rows = df.select(F.explode(days).alias("_d"))
    matches, _ = many(rows, "_d.match") or (None, None)
    return rows.select(_field(F.col("_d"), kind, "date").alias("_date"), F.explode(matches).alias("_m")).select("_m.*", "_date")


def match_basic(df: DataFrame, include_players: bool = False) -> DataFrame:
    """Matches of a response that holds one or a list; with include_players their players."""
    for path in ("match", "matchStats"):
        if found := many(df, path):
            rows = df.select(F.explode(found[0]).alias("_m")).select("_m.*")
            break
    else:
        rows = df
    return player_stats(rows) if include_players else rows


def items(df: DataFrame, name: str, otherwise_document: bool = True) -> DataFrame:
    """Rows of a part that is a list or an object; the document itself where it has none (persons, referees, transfers)."""
    found = many(df, name)
    if found is None:
        if not otherwise_document:
            raise ValueError(f"no {name}")
        return df
    return df.select(F.explode(found[0]).alias("_x")).select("_x.*")


def player_careers(df: DataFrame) -> DataFrame:
    return items(df, "person")


def referees(df: DataFrame) -> DataFrame:
    """Referees of a document, or of its stages."""
    if many(df, "stage") is not None:
        df = items(df, "stage")
    return items(df, "referee")


def injuries(df: DataFrame) -> DataFrame:
    return items(df, "person", otherwise_document="injury" in df.columns or "injuries" in df.columns)


def transfers(df: DataFrame) -> DataFrame:
    return items(df, "person")


def participation(df: DataFrame) -> DataFrame:
    return items(df, "competition")


def rankings(df: DataFrame) -> DataFrame:
    """Matches, players and teams of a ranking in one table, told apart by _record_type."""
    context = [_info(df, "competition", "_competition"), _info(df, "tournamentCalendar", "_tournament_calendar")]
    parts = []
    if found := many(df, "matchData"):
        rows = df.select(*context, F.explode(found[0]).alias("_x"))
        team = many(rows, "_x.teamData")
        side = lambda s: F.get(F.filter(team[0], lambda t: t["side"] == s), F.lit(0))["id"] if team else F.lit(None).cast("string")
        parts.append(rows.select(*_plain(F.col("_x"), found[1], "stat"), _stats_of(F.col("_x"), found[1], "type").alias("stats"), "_competition", "_tournament_calendar", F.lit("match").alias("_record_type"), side("Home").alias("_home_team_id"), side("Away").alias("_away_team_id")))
    if found := many(df, "team"):
        rows = df.select(*context, F.explode(found[0]).alias("_x"))
        if players := many(rows, "_x.player"):
            inner = rows.select("_competition", "_tournament_calendar", _field(F.col("_x"), found[1], "id").alias("_team_id"), F.explode(players[0]).alias("_p"))
            parts.append(inner.select(*_plain(F.col("_p"), players[1], "stat"), _stats_of(F.col("_p"), players[1], "type").alias("stats"), "_competition", "_tournament_calendar", F.lit("player").alias("_record_type"), "_team_id"))
        parts.append(rows.select(*_plain(F.col("_x"), found[1], "stat", "player"), _stats_of(F.col("_x"), found[1], "type").alias("stats"), "_competition", "_tournament_calendar", F.lit("team").alias("_record_type")))
    if not parts:
        raise ValueError("no rankings")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _merged(df: DataFrame, *parts: tuple[str, str]) -> DataFrame:
    """One row: each part kept whole under a name, and its fields at the top, those of later parts over earlier ones."""
    columns: dict[str, Column] = {}
    for path, name in parts:
        found = resolve(df.schema, path)
        columns[name] = found[0] if found else F.lit(None).cast("string")
    for path, _ in parts:
        found = resolve(df.schema, path)
        if found and isinstance(found[1], T.StructType):
            columns |= {f: found[0].getField(f) for f in found[1].fieldNames()}
    return df.select(*[c.alias(n) for n, c in columns.items()])


def pass_matrix(df: DataFrame) -> DataFrame:
    return _merged(df, ("passMatrix", "_pass_matrix"), ("matchInfo", "_match_info"), ("liveData", "_live_data"))


def possession(df: DataFrame) -> DataFrame:
    return _merged(df, ("possession", "_possession"), ("possessionTerritory", "_possession_territory"), ("matchInfo", "_match_info"), ("liveData", "_live_data"))
