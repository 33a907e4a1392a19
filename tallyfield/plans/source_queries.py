"""Queries of sources: provider feeds and their pages, un-nesting of documents, records, files, feed adapters."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfield.flow import Flow
from tallyfield.functions import text
from tallyfield.functions.predicates import where_coded_event, where_in, where_qualifier
from tallyfield.plans.registry import flow, query, table
from tallyfield.sources import adapters, nested, pages, polls, providers

# --- requests and pages


def requests(k: int) -> dict[str, providers.Request]:
    """A request of every feed, with ids of k."""
    r, s = providers.Requests("K"), providers.StatsBomb.request
    return {
        "tournament_calendars": r.tournament_calendars("active", competition_uuid=f"c1-{k}", include_stages=True),
        "venues": r.venues(tournament_calendar_uuid=f"t1-{k}", use_opta_names=True),
        "areas": r.areas(),
        "area": r.areas(f"a1-{k}"),
        "tournament_schedule": r.tournament_schedule(f"t1-{k}", coverage_level=[1, 15]),
        "matches": r.matches(fixture_uuids=[f"f1-{k}", f"f2-{k}"], competition_uuids=[f"c1-{k}"], date_from="2024-01-01", date_to="2024-01-31", lineups=True),
        "match": r.match(f"f1-{k}", live=True),
        "match_stats_player": r.match_stats_player([f"f1-{k}", f"f2-{k}"]),
        "match_stats_team": r.match_stats_team(f"f1-{k}", use_opta_names=True),
        "events": r.events(f"f1-{k}", contestant_uuid=f"k1-{k}", event_types=[1, 13]),
        "pass_matrix": r.pass_matrix(f"f1-{k}"),
        "possession": r.possession(f"f1-{k}"),
        "player_career": r.player_career(person_uuid=f"p1-{k}"),
        "player_career_team": r.player_career(contestant_uuid=f"k1-{k}", active=False),
        "referees": r.referees(stage_uuid=f"s1-{k}"),
        "referee": r.referees(person_uuid=f"p1-{k}"),
        "rankings": r.rankings(f"t1-{k}"),
        "injuries": r.injuries(tournament_calendar_uuid=f"t1-{k}", contestant_uuid=f"k1-{k}"),
        "injuries_person": r.injuries(person_uuid=f"p1-{k}"),
        "transfers": r.transfers(competition_uuid=f"c1-{k}", start_date="2024-01-01", end_date="2024-02-01"),
        "teams": r.teams(tournament_calendar_uuid=f"t1-{k}", series_uuid=f"z1-{k}"),
        "team_standings": r.team_standings(f"t1-{k}", type="home"),
        "squads": r.squads(contestant_uuid=f"k1-{k}"),
        "player_season_stats": r.player_season_stats(f"t1-{k}", f"k1-{k}"),
        "team_season_stats": r.team_season_stats(f"t1-{k}", detailed=False),
        "contestant_participation": r.contestant_participation(f"k1-{k}", active=True),
        "sb_competitions": s("competitions"),
        "sb_matches": s("matches", competition_id=k, season_id=44),
        "sb_events": s("events", match_id=k, include_360_metrics=True),
        "sb_lineups": s("lineups", match_id=k),
        "sb_player_match_stats": s("player_match_stats", match_id=k),
        "sb_player_season_stats": s("player_season_stats", competition_id=k, season_id=44),
        "sb_team_match_stats": s("team_match_stats", match_id=k),
        "sb_team_season_stats": s("team_season_stats", competition_id=k, season_id=44),
    }


@query("provider_requests", """SELECT feed, replace(path, '#', CAST(s_suppkey AS VARCHAR)) AS path, replace(params, '#', CAST(s_suppkey AS VARCHAR)) AS params, paged, s_suppkey AS k FROM supplier CROSS JOIN (VALUES
('tournament_calendars', '/tournamentcalendar/K/active', '_fmt=json&comp=c1-#&stages=yes', TRUE), ('venues', '/venues/K', '_fmt=json&_lcl=en-op&tmcl=t1-#', TRUE), ('areas', '/areas/K', '_fmt=json', TRUE), ('area', '/areas/K/a1-#', '_fmt=json', FALSE),
('tournament_schedule', '/tournamentschedule/K/t1-#', '_fmt=json&cvlv=1,15', FALSE), ('matches', '/match/K', '_fmt=json&comp=c1-#&fx=f1-#,f2-#&lineups=yes&live=yes&mt.mDt=[2024-01-01T00:00:00Z TO 2024-01-31T00:00:00Z]', TRUE), ('match', '/match/K/f1-#', '_fmt=json&lineups=no&live=yes', FALSE),
('match_stats_player', '/matchstats/K', '_fmt=json&fx=f1-#,f2-#', FALSE), ('match_stats_team', '/matchstats/K', '_fmt=json&_lcl=en-op&fx=f1-#', FALSE), ('events', '/matchevent/K/f1-#', '_fmt=json&ctst=k1-#&type=1,13', FALSE), ('pass_matrix', '/passmatrix/K/f1-#', '_fmt=json', FALSE), ('possession', '/possession/K/f1-#', '_fmt=json', FALSE),
('player_career', '/playercareer/K/p1-#', '_fmt=json&prsn=p1-#', FALSE), ('player_career_team', '/playercareer/K', '_fmt=json&active=no&ctst=k1-#', TRUE), ('referees', '/referees/K', '_fmt=json&stg=s1-#', TRUE), ('referee', '/referees/K', '_fmt=json&prsn=p1-#', FALSE), ('rankings', '/rankings/K', '_fmt=json&tmcl=t1-#', FALSE),
('injuries', '/injuries/K', '_fmt=json&ctst=k1-#&tmcl=t1-#', TRUE), ('injuries_person', '/injuries/K/p1-#', '_fmt=json&prsn=p1-#', FALSE), ('transfers', '/transfers/K', '_fmt=json&comp=c1-#&endDt=2024-02-01&strtDt=2024-01-01', TRUE), ('teams', '/team/K', '_fmt=json&srs=z1-#&tmcl=t1-#', TRUE),
('team_standings', '/standings/K', '_fmt=json&live=no&tmcl=t1-#&type=home', FALSE), ('squads', '/squads/K', '_fmt=json&ctst=k1-#', TRUE), ('player_season_stats', '/seasonstats/K', '_fmt=json&ctst=k1-#&detailed=yes&tmcl=t1-#', FALSE), ('team_season_stats', '/seasonstats/K', '_fmt=json&detailed=no&tmcl=t1-#', FALSE), ('contestant_participation', '/contestantparticipation/K', '_fmt=json&active=yes&ctst=k1-#', FALSE),
('sb_competitions', '/competitions', '', FALSE), ('sb_matches', '/matches', 'competition_id=#&season_id=44', FALSE), ('sb_events', '/events', 'include_360_metrics=true&match_id=#', FALSE), ('sb_lineups', '/lineups', 'match_id=#', FALSE), ('sb_player_match_stats', '/player_match_stats', 'match_id=#', FALSE),
('sb_player_season_stats', '/player_season_stats', 'competition_id=#&season_id=44', FALSE), ('sb_team_match_stats', '/team_match_stats', 'match_id=#', FALSE), ('sb_team_season_stats', '/team_season_stats', 'competition_id=#&season_id=44', FALSE)) v(feed, path, params, paged)""")
def provider_requests(spark, d):
    """A request of every feed for each supplier."""

    def run(batches):
        for pdf in batches:
            rows = [(name, r.path, "&".join(f"{c}={v}" for c, v in sorted(r.params.items())), r.paged, k) for k in pdf["k"] for name, r in requests(int(k)).items()]
            yield pd.DataFrame(rows, columns=["feed", "path", "params", "paged", "k"])

    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).mapInPandas(run, "feed string, path string, params string, paged boolean, k long")


def _saved(pages_: DataFrame, root: str, endpoint: str) -> None:
    """Documents (page, value) as the saved pages of an endpoint."""
    pages_.select("page", "value").repartition("page").write.partitionBy("page").text(f"{root}/{endpoint}")


def saved_document(endpoint: str, options: Mapping[str, str], page: int) -> str | None:
    """The one document of a saved page: `fetch` of the queries below.  The fantasy feeds page within one document."""
    from pyarrow import fs

    system, root = polls.file_system(options["root"])
    found = system.get_file_info(fs.FileSelector(f"{root}/{endpoint}/page={page}", allow_not_found=True))
    for info in found:
        if info.is_file and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as f:
                return f.read().decode()
    return None


def is_saved(endpoint: str, options: Mapping[str, str], page: int) -> bool:
    from pyarrow import fs

    system, root = polls.file_system(options["root"])
    return system.get_file_info(f"{root}/{endpoint}/page={page}").type == fs.FileType.Directory


@query("provider_pages", "SELECT 'teams' AS feed, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'events', n_nationkey, n_name FROM nation UNION ALL SELECT 'referees', n_nationkey, n_name FROM nation")
def provider_pages(spark, d):
    """Teams in pages of a hundred customers, whose number is found by asking; events and referees in one document of all nations."""
    root, kind = scratch(spark), "id long, name string"
    record = lambda k, n: F.struct(F.col(k).alias("id"), F.col(n).alias("name"))
    teams = table(spark, d, "customer").groupBy((F.floor(F.col("c_custkey") / 100) + 1).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(record("c_custkey", "c_name")).alias("contestant")).alias("contestants"))).alias("value"))
    nations = F.collect_list(record("n_nationkey", "n_name"))
    one = table(spark, d, "nation").groupBy(F.lit(1).alias("page"))
    _saved(teams, root, "teams")
    _saved(one.agg(F.to_json(nations).alias("value")), root, "events")
    halves = [F.struct(F.filter(nations, lambda r: r["id"] % 2 == h).alias("referee")) for h in (0, 1)]
    _saved(one.agg(F.to_json(F.struct(F.array(*halves).alias("stage"))).alias("value")), root, "referees")
    options = {"root": root, "page_size": 100, "probe": f"{__name__}:is_saved"}
    opta, other = providers.Opta(spark, f"{__name__}:saved_document", **options), providers.StatsBomb(spark, f"{__name__}:saved_document", **options)
    parts = {"teams": opta.teams(tournament_calendar_uuid="t", schema=kind), "events": other.events(7, schema=kind), "referees": opta.referees(person_uuid="p", schema="stage array<struct<referee:array<struct<id:bigint,name:string>>>>")}
    rows = [f.df.select(F.lit(name).alias("feed"), "id", "name") for name, f in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("fantasy_feeds", """SELECT feed, CAST(n_nationkey + 1 AS INTEGER) AS id FROM nation CROSS JOIN (SELECT unnest(['weeks', 'players', 'names', 'history', 'rankings', 'picks', 'transfers']) AS feed)
UNION ALL SELECT 'current', CAST(max(n_nationkey) + 1 AS INTEGER) FROM nation""")
def fantasy_feeds(spark, d):
    """Every feed of the fantasy game as a document of all nations."""
    root, kind = scratch(spark), "id int"
    n = table(spark, d, "nation")
    last = n.agg(F.max("n_nationkey").alias("last"))
    record = F.struct((F.col("n_nationkey") + 1).alias("id"), (F.col("n_nationkey") == F.col("last")).alias("is_current"), F.col("n_name").alias("first_name"), F.col("n_name").alias("second_name"), F.col("n_name").alias("web_name"))
    rows = n.crossJoin(F.broadcast(last)).groupBy(F.lit(1).alias("page")).agg(F.collect_list(record).alias("r"))  # one row on the right
    r = F.col("r")
    ways = {"gameweek_info": F.struct(r.alias("events")), "player_data": F.struct(r.alias("elements")), "player_history": F.struct(r.alias("history")), "rankings": F.struct(F.struct(r.alias("results")).alias("standings")), "entry_picks": F.struct(r.alias("picks")), "entry_transfers": r}
    for endpoint, document in ways.items():
        _saved(rows.select("page", F.to_json(document).alias("value")), root, endpoint)
    f = providers.FPL(spark, f"{__name__}:saved_document", root=root)
    feeds = {"weeks": f.gameweek_info(kind), "current": f.current_gameweek(), "players": f.player_data(kind), "names": f.player_id_mappings(), "history": f.player_history(3, kind), "rankings": f.rankings(schema=kind), "picks": f.entry_picks(5, 2, kind), "transfers": f.entry_transfers(5, kind)}
    out = None
    for name, flow_ in feeds.items():
        got = flow_.df.select(F.lit(name).alias("feed"), "id")
        out = got if out is None else out.union(got)
    return out


# --- un-nesting


def _texts(**values) -> F.Column:
    """Statistics as a provider states them: a list of names and values."""
    return F.array(*[F.struct(F.lit(k).alias("type"), v.cast("string").alias("value")) for k, v in values.items()])


def _named(stats: F.Column) -> F.Column:
    return F.transform(stats, lambda s: F.struct(s["type"].alias("name"), s["value"].alias("value")))


def _documents(spark, d) -> DataFrame:
    """A document an order: two sides of line items as players, with statistics but for every third item; events at one place or the other."""
    li = table(spark, d, "lineitem").withColumn("side", F.col("l_linenumber") % 2)
    none = F.array().cast("array<struct<type:string,value:string>>")
    own = F.when(F.col("l_linenumber") % 3 != 0, _texts(qty=F.col("l_quantity"), disc=F.col("l_discount"))).otherwise(none)
    player = F.struct(F.col("l_partkey").alias("playerId"), F.col("l_linenumber").alias("shirt"), own.alias("stat"))
    event = F.struct(F.col("l_linenumber").alias("id"), F.col("l_suppkey").alias("typeId"))
    # frames over one sort: aggregates that make lists would sort at each of two levels, before and after a shuffle
    of_side, of_order = W.partitionBy("l_orderkey", "side").orderBy("l_linenumber"), W.partitionBy("l_orderkey").orderBy("side")
    whole = lambda c, w: c.over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # sorted as plain columns, which are narrower than the structs made of them
    sides = li.repartition("l_orderkey").sortWithinPartitions("l_orderkey", "side", "l_linenumber").select("l_orderkey", "side", F.row_number().over(of_side).alias("_k"), whole(F.collect_list(player), of_side).alias("player"), whole(F.collect_list(event), of_side).alias("event"), whole(F.count("*"), of_side).alias("n"), whole(F.sum("l_quantity"), of_side).alias("q")).filter("_k = 1")
    side = F.struct(F.concat(F.lit("c"), "side").alias("contestantId"), F.when(F.col("n") > 1, _texts(total=F.col("q"))).otherwise(none).alias("stat"), "player")
    both = sides.select("l_orderkey", F.row_number().over(of_order).alias("_k"), whole(F.collect_list(side), of_order).alias("lineUp"), F.flatten(whole(F.collect_list("event"), of_order)).alias("event")).filter("_k = 1")
    empty = F.lit(None).cast("array<struct<id:int,typeId:bigint>>")
    first = F.col("l_orderkey") % 2 == 0
    live = F.struct("lineUp", F.when(first, F.col("event")).otherwise(empty).alias("event"), F.struct(F.when(~first, F.col("event")).otherwise(empty).alias("event")).alias("events"), F.struct(F.lit("Played").alias("state")).alias("matchDetails"))
    return both.select(F.struct(F.col("l_orderkey").alias("id")).alias("matchInfo"), live.alias("liveData"))


@query("nested_player_stats", "SELECT l_orderkey AS match, 'c' || l_linenumber % 2 AS side, l_partkey AS player, l_linenumber AS shirt, l_quantity AS qty, l_discount AS disc FROM lineitem WHERE l_linenumber % 3 <> 0")
def nested_player_stats(spark, d):
    p = nested.player_stats(_documents(spark, d))
    return p.select(F.col("_match_uuid").alias("match"), F.col("_contestant_id").alias("side"), F.col("playerId").alias("player"), F.col("shirt"), nested.stat(F.col("stats"), "qty").alias("qty"), nested.stat(F.col("stats"), "disc").alias("disc"))


@query("nested_team_stats", "SELECT l_orderkey AS match, 'c' || l_linenumber % 2 AS side, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey, l_linenumber % 2 HAVING count(*) > 1")
def nested_team_stats(spark, d):
    t = nested.team_stats(_documents(spark, d))
    return t.select(F.col("_match_uuid").alias("match"), F.col("contestantId").alias("side"), nested.stat(F.col("stats"), "total").alias("total"))


@query("nested_match_events", "SELECT l_orderkey AS match, l_linenumber AS id, l_suppkey AS type, 'Played' AS state FROM lineitem")
def nested_match_events(spark, d):
    return nested.match_events(_documents(spark, d)).select(F.col("_match_info.id").alias("match"), "id", F.col("typeId").alias("type"), F.col("_match_details.state").alias("state"))


@query("nested_match_basic", "SELECT 'list' AS kind, l_orderkey AS match, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey UNION ALL SELECT 'one', l_orderkey, count(*) FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey")
def nested_match_basic(spark, d):
    docs = _documents(spark, d)
    many = docs.groupBy((F.col("matchInfo.id") % 50).alias("page")).agg(F.collect_list(F.struct("matchInfo", "liveData")).alias("matchStats"))
    count = lambda df, kind: nested.match_basic(df, include_players=True).groupBy(F.lit(kind).alias("kind"), F.col("_match_uuid").alias("match")).agg(F.count("*").alias("n"))
    return count(many, "list").union(count(docs, "one"))


@query("nested_flatten_stats", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS qty, l_discount AS disc, NULL::VARCHAR AS missing FROM lineitem")
def nested_flatten_stats(spark, d):
    li = table(spark, d, "lineitem").withColumn("stat", F.concat(_texts(qty=F.lit("old"), disc=F.col("l_discount")), F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit("x").alias("value"))), _texts(qty=F.col("l_quantity"))))
    m = nested.flatten_stats(F.col("stat"), li.schema["stat"].dataType)
    return li.select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", nested.stat(F.col("m"), "qty", number=False).alias("qty"), nested.stat(F.col("m"), "disc").alias("disc"), nested.stat(F.col("m"), "missing", number=False).alias("missing"))


def _seasons(spark, d) -> DataFrame:
    """A document a customer: orders as players, every fourth without statistics."""
    o = table(spark, d, "orders")
    stats = F.when(F.col("o_orderkey") % 4 != 0, _named(_texts(price=F.col("o_totalprice"))))
    player = F.struct(F.col("o_orderkey").alias("id"), stats.alias("stat"))
    by = o.groupBy("o_custkey").agg(F.collect_list(player).alias("player"), F.count("*").alias("n"))
    team = F.struct(F.col("o_custkey").alias("id"), _named(_texts(games=F.col("n"))).alias("stat"), F.array(F.struct(F.lit(1).alias("id"))).alias("player"))
    return by.select("player", team.alias("contestant"), F.struct(F.lit("cup").alias("name")).alias("competition"), F.struct((F.col("o_custkey") % 3).alias("id")).alias("tournamentCalendar"))


@query("nested_season_players", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, 'cup' AS competition, o_custkey % 3 AS season FROM orders")
def nested_season_players(spark, d):
    return nested.season_player_stats(_seasons(spark, d)).select("id", nested.stat(F.col("stats"), "price").alias("price"), F.col("_competition.name").alias("competition"), F.col("_tournament_calendar.id").alias("season"))


@query("nested_season_teams", "SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS games, FALSE AS has_players FROM orders GROUP BY o_custkey")
def nested_season_teams(spark, d):
    out = nested.season_team_stats(_seasons(spark, d))
    return out.select("id", nested.stat(F.col("stats"), "games").alias("games"), F.lit("player" in out.columns).alias("has_players"))


@query("nested_schedule", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS id, o_custkey AS home FROM orders")
def nested_schedule(spark, d):
    o = table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    days = o.groupBy("date").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("home"))).alias("match"))
    docs = days.groupBy(F.year("date").alias("y")).agg(F.collect_list(F.struct("date", "match")).alias("matchDate"))
    return nested.tournament_schedule(docs).select(F.col("_date").alias("day"), "id", "home")


@query("nested_people", """SELECT 'career' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'one', c_custkey, c_name FROM customer UNION ALL SELECT 'document', c_custkey, c_name FROM customer
UNION ALL SELECT 'injury', c_custkey, c_name FROM customer UNION ALL SELECT 'transfer', c_custkey, c_name FROM customer UNION ALL SELECT 'referee', c_custkey, c_name FROM customer UNION ALL SELECT 'part', c_custkey, c_name FROM customer""")
def nested_people(spark, d):
    """Careers, injuries, transfers, referees and participations, as lists, single objects and whole documents."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    person = F.struct("id", "name")
    many = lambda name: c.groupBy("c_nationkey").agg(F.collect_list(person).alias(name)).drop("c_nationkey")
    staged = many("referee").select(F.array(F.struct("referee")).alias("stage"))
    parts = {"career": nested.player_careers(many("person")), "one": nested.player_careers(c.select(person.alias("person"))), "document": nested.player_careers(c.select("id", "name")), "injury": nested.injuries(many("person")), "transfer": nested.transfers(many("person")), "referee": nested.referees(staged), "part": nested.participation(many("competition"))}
    out = None
    for kind, df in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), "id", "name")
        out = rows if out is None else out.union(rows)
    return out


@query("nested_rankings", """
SELECT 'match' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS home, CAST(o_custkey + 1 AS VARCHAR) AS away, NULL::VARCHAR AS team, o_totalprice AS score FROM orders
UNION ALL SELECT 'team', CAST(o_custkey AS VARCHAR), NULL, NULL, NULL, CAST(count(*) AS DOUBLE) FROM orders GROUP BY o_custkey
UNION ALL SELECT 'player', CAST(o_orderkey AS VARCHAR), NULL, NULL, CAST(o_custkey AS VARCHAR), o_totalprice / 2 FROM orders""")
def nested_rankings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("home"), (F.col("o_custkey") + 1).cast("string").alias("away"), "o_totalprice")
    side = lambda c, s: F.struct(F.col(c).alias("id"), F.lit(s).alias("side"))
    match = F.struct("id", _texts(score=F.col("o_totalprice")).alias("stat"), F.array(side("away", "Away"), side("home", "Home")).alias("teamData"))
    player = F.struct("id", _texts(score=F.col("o_totalprice") / 2).alias("stat"))
    teams = o.groupBy("home").agg(F.collect_list(match).alias("matchData"), F.collect_list(player).alias("p"), F.count("*").alias("n"))
    docs = teams.select("matchData", F.array(F.struct(F.col("home").alias("id"), _texts(score=F.col("n")).alias("stat"), F.col("p").alias("player"))).alias("team"))
    r = nested.rankings(docs)
    return r.select(F.col("_record_type").alias("kind"), "id", F.col("_home_team_id").alias("home"), F.col("_away_team_id").alias("away"), F.col("_team_id").alias("team"), nested.stat(F.col("stats"), "score").alias("score"))


@query("nested_merged", "SELECT o_orderkey AS id, o_custkey AS z, o_totalprice AS home, 5 AS q, o_orderkey % 7 AS kept, 'm' AS kind FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 5, o_orderkey % 7, 'p' FROM orders")
def nested_merged(spark, d):
    """Pass matrices and possessions: one record, parts kept whole and merged on top."""
    o = table(spark, d, "orders")
    own = F.struct(F.col("o_totalprice").alias("home"), (F.col("o_orderkey") % 7).alias("z"))
    base = o.select(F.struct(F.col("o_orderkey").alias("id"), F.lit(1).alias("q"), F.col("o_custkey").alias("z")).alias("matchInfo"), F.struct(F.lit(5).alias("q")).alias("liveData"), own.alias("x"))
    matrix = nested.pass_matrix(base.withColumnRenamed("x", "passMatrix")).select("id", "z", "home", "q", F.col("_pass_matrix.z").alias("kept"), F.lit("m").alias("kind"))
    return matrix.union(nested.possession(base.withColumnRenamed("x", "possession")).select("id", "z", "home", "q", F.col("_possession.z").alias("kept"), F.lit("p").alias("kind")))


# --- records, files, actions


@query("records_concat", "SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 0.5::DOUBLE END AS xg, CASE WHEN n_nationkey % 2 = 1 THEN 'odd' END AS tag FROM nation UNION ALL SELECT CAST(r_regionkey AS INTEGER), r_name, NULL, 'region' FROM region")
def records_concat(spark, d):
    """Python records of two small tables, of differing keys, put one after the other."""
    nations = [{"id": r["n_nationkey"], "name": r["n_name"]} | ({"tag": "odd"} if r["n_nationkey"] % 2 else {"xg": r["n_nationkey"] * 0.5}) for r in table(spark, d, "nation").collect()]
    regions = [{"id": r["r_regionkey"], "name": r["r_name"], "tag": "region"} for r in table(spark, d, "region").collect()]
    return Flow.from_concat(Flow.from_records(spark, nations), Flow.from_list(spark, regions)).cast(id="int").df


@query("flow_actions", "SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM nation) AS length, FALSE AS empty, TRUE AS none, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)) AS head, (SELECT count(*) FROM nation) AS iterated, 4 AS keys")
def flow_actions(spark, d):
    f = flow(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name", "n_regionkey").assign(x=F.lit(1)).cache()
    row = (f.count(), len(f), f.is_empty(), f.filter(where_in("n_name", [])).is_empty(), ",".join(r["n_name"] for r in f.head(3)), sum(1 for _ in f), len(f.keys()))
    return spark.createDataFrame([row], "n long, length long, empty boolean, none boolean, head string, iterated long, keys int")


def scratch(spark) -> str:
    """A new folder below the one that driver and executors share; a temporary one where none is set and all run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scratch-")
    return os.path.join(shared, f"files-{uuid.uuid4().hex}")


def _as_file(spark, folder: str, name: str) -> None:
    """Move the one part file of a folder to a name."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(name).getParent())
    fs.rename(part, path(name))


@query("json_files", """
WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation), c AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS name FROM customer), s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name FROM supplier)
SELECT 'json' AS way, * FROM n UNION ALL SELECT 'jsonl', * FROM c UNION ALL SELECT 'folder', * FROM n UNION ALL SELECT 'folder', * FROM c UNION ALL SELECT 'glob', * FROM c UNION ALL SELECT 'deep', * FROM n UNION ALL SELECT 'deep', * FROM c UNION ALL SELECT 'deep', * FROM s UNION ALL SELECT 'lines', * FROM s""")
def json_files(spark, d):
    """A list in one file, lines in others (one of them deeper), and lines of the distributed sink, read in every way."""
    root, kind = scratch(spark), "k long, name string"
    rows = lambda t, k, name: table(spark, d, t).select(F.col(k).alias("k"), F.col(name).alias("name"))
    n, c, s = rows("nation", "n_nationkey", "n_name"), rows("customer", "c_custkey", "c_name"), rows("supplier", "s_suppkey", "s_name")
    line = F.to_json(F.struct("k", "name")).alias("value")
    n.agg(F.to_json(F.collect_list(F.struct("k", "name"))).alias("value")).coalesce(1).write.text(f"{root}/a")
    c.select(line).coalesce(1).write.text(f"{root}/b")
    s.select(line).coalesce(1).write.text(f"{root}/c")
    for part, name in (("a", "f/nations.json"), ("b", "f/customers.jsonl"), ("c", "f/below/suppliers.jsonl")):
        _as_file(spark, f"{root}/{part}", f"{root}/{name}")
    Flow(s).to_jsonl(f"{root}/lines")
    ways = {"json": Flow.from_json(spark, f"{root}/f/nations.json", kind), "jsonl": Flow.from_jsonl(spark, f"{root}/f/customers.jsonl", kind), "folder": Flow.from_folder(spark, f"{root}/f", kind), "glob": Flow.from_glob(spark, f"{root}/f/*.jsonl", kind), "deep": Flow.from_glob(spark, f"{root}/f/**", kind), "lines": Flow.from_jsonl(spark, f"{root}/lines", kind)}
    out = None
    for name, f in ways.items():
        got = f.df.select(F.lit(name).alias("way"), "k", "name")
        out = got if out is None else out.union(got)
    return out


@query("bronze_round_trip", "SELECT 's' AS source, CAST(o_orderkey AS VARCHAR) AS source_id, o_orderpriority AS competition, CAST(year(o_orderdate) AS VARCHAR) AS season FROM orders")
def bronze_round_trip(spark, d):
    from tallyfield.warehouse import versions

    rows = table(spark, d, "orders").select(F.lit("s").alias("source"), F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("competition"), F.year("o_orderdate").alias("season"))
    root = scratch(spark)
    versions.write_bronze(rows, root, "r1")
    return versions.read_bronze(spark, root).select("source", "source_id", "competition", "season")


# --- adapters


@query("results_csv_adapter", """
WITH g AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t FROM orders)
SELECT strftime(t, '%Y-%m-%d') AS match_date, 'H' || c AS home_name_raw, 'A' || k AS away_name_raw, CAST(k % 4 AS VARCHAR) AS goals_home, NULLIF(CASE WHEN k % 5 = 0 THEN '' ELSE CAST(k % 3 AS VARCHAR) END, '') AS goals_away, CASE WHEN k % 2 = 0 THEN 'LOCAL_APPROX' ELSE 'DATE_ONLY' END AS kickoff_precision,
  strftime(t, '%Y-%m-%d') || CASE WHEN k % 2 = 0 THEN 'T17:30:00+00:00' ELSE 'T15:00:00+00:00' END AS kickoff_utc, CASE WHEN k % 3 = 0 THEN 2 ELSE 3 END AS quotes FROM g""")
def results_csv_adapter(spark, d):
    k = F.col("o_orderkey")
    wide = table(spark, d, "orders").select(F.lit("E0").alias("Div"), F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yy")).alias("Date"), F.when(k % 2 == 0, "17:30").alias("Time"), F.concat(F.lit("H"), "o_custkey").alias("HomeTeam"), F.concat(F.lit("A"), k).alias("AwayTeam"), (k % 4).cast("string").alias("FTHG"), F.when(k % 5 == 0, "").otherwise((k % 3).cast("string")).alias("FTAG"), F.lit("H").alias("FTR"), F.lit("2.1").alias("PSH"), F.when(k % 3 == 0, "1.0").otherwise("3.3").alias("PSCD"), F.lit("4.0").alias("MaxCA"))
    out = adapters.results_to_bronze(wide)
    n = F.size(F.from_json("odds_json", "array<struct<bookmaker:string>>"))
    return out.select("match_date", "home_name_raw", "away_name_raw", "goals_home", "goals_away", "kickoff_precision", "kickoff_utc", n.alias("quotes"))


@query("fixtures_json_adapter", """
SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS match_date, CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 3 THEN '4' END AS goals_home, CASE o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 3 THEN '3' END AS goals_away, CASE o_orderkey % 5 WHEN 0 THEN '1' END AS goals_home_ht FROM orders""")
def fixtures_json_adapter(spark, d):
    """The five shapes of a score: ft and ht, ft alone, an empty object, a bare list, none."""
    k = F.col("o_orderkey")
    score = F.when(k % 5 == 0, '{"ft":[2,1],"ht":[1,0]}').when(k % 5 == 1, '{"ft":[1,0]}').when(k % 5 == 2, "{}").when(k % 5 == 3, "[4,3]").otherwise("null")
    one = F.concat(F.lit('{"round":"r","date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","team1":"a","team2":"'), k, F.lit('","score":'), score, F.lit("}"))
    lists = table(spark, d, "orders").groupBy(F.floor(k / 5000).alias("y")).agg(F.concat(F.lit('{"name":"n","matches":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("value"))
    root = scratch(spark)
    lists.select("value", "y").repartition("y").write.partitionBy("y").text(root)
    out = adapters.read_fixtures_json(spark, f"{root}/*/*", "C", "S")
    return out.select(F.col("away_name_raw").cast("long").alias("k"), "match_date", "goals_home", "goals_away", "goals_home_ht")


@query("price_series_adapter", "SELECT CAST(event_id AS VARCHAR) AS match_source_id, CAST(user_id AS VARCHAR) AS bookmaker_id, CASE event_id % 4 WHEN 1 THEN 'HOME' WHEN 2 THEN 'DRAW' ELSE 'AWAY' END AS selection, value AS price FROM events WHERE event_id % 4 > 0 AND value > 1")
def price_series_adapter(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("event_id").alias("ID"), F.col("user_id").alias("bookmaker"), (F.col("event_id") % 4).alias("result"), F.col("value").cast("string").alias("odds"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("odds_datetime"), F.lit(None).cast("string").alias("disabled_date"))
    return adapters.price_series(raw).select("match_source_id", "bookmaker_id", "selection", F.col("price_decimal").alias("price"))


@query("upcoming_quotes_adapter", "SELECT 'E0|d|h' || event_id || '|a' AS match_key, 'pinnacle' AS bookmaker, 1.5 + value / 50 AS home, 3.0::DOUBLE AS draw, 4.0::DOUBLE AS away FROM events WHERE event_id % 6 <> 0 UNION ALL SELECT 'E0|d|h' || event_id || '|a', 'market_max', 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE FROM events")
def upcoming_quotes_adapter(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    wide = e.select(F.lit("E0").alias("Div"), F.lit("d").alias("Date"), F.concat(F.lit("h"), k).alias("HomeTeam"), F.lit("a").alias("AwayTeam"), F.when(k % 6 != 0, F.lit(1.5) + F.col("value") / 50).alias("PSH"), F.lit("3").alias("PSD"), F.lit("4").alias("PSA"), F.lit("2").alias("MaxH"), F.lit("3").alias("MaxD"), F.lit("4").alias("MaxA"), F.lit("9").alias("AvgH"))
    return adapters.upcoming_quotes(wide)


@query("game_ids", "SELECT o_orderkey, CAST(epoch(o_orderdate)::BIGINT AS VARCHAR) || '---' || lower(replace(o_orderpriority, ' ', '_')) || '---' || lower(o_orderstatus) AS id, 'f_t_h_g' AS snake FROM orders")
def game_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.game_id(F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("id"), F.lit(text.snake_case("f t-h.g")).alias("snake"))


CODES = {"Pass": 1, "Goal": 16, "Foul": 4}


@query("coded_events", "SELECT event_id, event_id % 5 = 1 AS by_code, event_id % 3 = 2 AS by_qualifier FROM events WHERE event_id % 5 = 1 OR event_id % 3 = 2")
def coded_events(spark, d):
    e = table(spark, d, "events").withColumns({"typeId": F.when(F.col("event_id") % 5 == 1, 16).otherwise(1), "qualifier": F.array(F.struct((F.col("event_id") % 3).alias("qualifierId"), F.lit("yes").alias("value")), F.struct(F.lit(77).cast("long").alias("qualifierId"), F.lit("no").alias("value")))})
    f = Flow(e)
    hit = f.filter(where_coded_event("goal", CODES) | where_qualifier("Head", {"head": 2}, "yes"))
    return hit.df.select("event_id", (F.col("typeId") == 16).alias("by_code"), (F.col("event_id") % 3 == 2).alias("by_qualifier"))


# --- saved pages


@query("club_ratings", "SELECT c_name AS team, CAST(c_nationkey AS VARCHAR) AS country, c_custkey::INTEGER AS rank, round(1500 + c_acctbal / 100, 6) AS elo, DATE '2024-01-01' AS since FROM customer")
def club_ratings(spark, d):
    c = table(spark, d, "customer")
    text_rows = c.select(F.col("c_custkey").cast("string").alias("Rank"), F.col("c_name").alias("Club"), F.col("c_nationkey").cast("string").alias("Country"), F.lit("1").alias("Level"), (1500 + F.col("c_acctbal") / 100).cast("string").alias("Elo"), F.lit("2024-01-01").alias("From"), F.lit("2024-01-07").alias("To"))
    return pages.club_ratings(text_rows).select("team", "country", "rank", F.round("elo", 6).alias("elo"), F.col("from").alias("since"))


@query("league_documents", """SELECT 'fixture' AS kind, CAST(o_orderkey AS VARCHAR) AS id, 'h' || o_custkey AS home, CAST(o_orderkey % 4 AS DOUBLE) AS value, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT 'shot', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'a' END, l_discount, DATE '2024-01-02' FROM lineitem""")
def league_documents(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    two = lambda h, a: F.struct(h.cast("string").alias("h"), a.cast("string").alias("a"))
    date = F.struct(k.cast("string").alias("id"), (F.col("o_orderstatus") != "O").alias("isResult"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.struct(F.concat(F.lit("h"), "o_custkey").alias("title")).alias("h"), F.struct(F.lit("x").alias("title")).alias("a"), two(k % 4, k % 3).alias("goals"), two(k % 4, k % 3).alias("xG"), F.struct(F.lit("0.5").alias("w"), F.lit("0.3").alias("d"), F.lit("0.2").alias("l")).alias("forecast"))
    league = o.groupBy("o_orderpriority", F.floor(k / 5000)).agg(F.to_json(F.struct(F.collect_list(date).alias("dates"))).alias("document"))
    li = table(spark, d, "lineitem")
    shot = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_discount").cast("string").alias("xG"), F.lit("2024-01-02 20:00:00").alias("date"), F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("a").alias("h_a"))
    side = lambda s, n: F.collect_list(F.when(F.col("l_linenumber") % 2 == n, shot)).alias(s)
    shots = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(side("h", 0), side("a", 1)).alias("shots"))).alias("document"))
    fixtures = pages.league_fixtures(league).select(F.lit("fixture").alias("kind"), F.col("source_id").alias("id"), F.col("team_home").alias("home"), F.col("xg_home").alias("value"), F.col("date").alias("day"))
    return fixtures.union(pages.match_shots(shots).select(F.lit("shot"), "shot_id", "side", "xg", F.to_date("datetime")))


@query("html_statistics", """SELECT n_name AS squad, CAST(s_suppkey AS VARCHAR) AS player, (s_suppkey * 1000.5)::DOUBLE AS goals, round(s_acctbal, 2) AS per_90 FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT n_name, 'squad', count(*)::DOUBLE, NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""")
def html_statistics(spark, d):
    """Statistics pages of each nation: a table of the squad, an empty one, and one of players in a comment, with group headers and a repeated header row."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    row = F.concat(F.lit("<tr><th>"), F.col("s_suppkey"), F.lit("</th><td>"), F.format_number(F.col("s_suppkey") * 1000.5, 1), F.lit("</td><td> "), F.col("s_acctbal").cast("string"), F.lit(" </td></tr>"))
    head = "<tr><th></th><th colspan='2'>Performance</th></tr><tr><th>Player</th><th>Gls</th><th>Per 90</th></tr>"
    body = F.array_join(F.collect_list(row), "<tr><th>Player</th><th>Gls</th><th>Per 90</th></tr>")
    html = F.concat(F.lit("<p>x</p><table id='a'><thead><tr><th>Squad</th><th>N</th></tr></thead><tbody><tr><td>"), F.col("n_name"), F.lit("</td><td>"), F.count("*"), F.lit(f"</td></tr></tbody></table><table id='b'></table><!-- <table id='c'><thead>{head}</thead>"), body, F.lit("</table> -->"))
    docs = s.groupBy("n_name").agg(html.alias("html"))
    got = pages.season_statistics(docs, "n_name")
    players = got["players"].select(F.col("n_name").alias("squad"), pages.cell("player", number=False).alias("player"), pages.cell("performance_gls").alias("goals"), F.round(pages.cell("performance_per_90"), 2).alias("per_90"))
    return players.union(got["squad_for"].select(pages.cell("squad", number=False), F.lit("squad"), pages.cell("n"), F.lit(None).cast("double")))


# --- streams


@query("late_events", """
WITH e AS (SELECT event_id % 2 AS batch, event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, ts FROM events),
m AS (SELECT max(ts) FILTER (WHERE batch = 0) - INTERVAL 48 HOUR AS first, max(ts) - INTERVAL 48 HOUR AS final FROM e)
SELECT event_type, start, count(*) AS n FROM e CROSS JOIN m WHERE start + INTERVAL 6 HOUR <= final AND (batch = 0 OR start + INTERVAL 6 HOUR > first) GROUP BY event_type, start""")
def late_events(spark, d):
    """A stream of two batches: rows of the second that come after the watermark of the first are left out, and windows come out once it has passed them."""
    from tallyfield.streaming import folds

    root = scratch(spark)
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    name = f"late_{uuid.uuid4().hex}"
    for batch in (0, 1):
        e.filter(F.col("event_id") % 2 == batch).write.parquet(f"{root}/in/b{batch}")
        rows = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{root}/in")
        counted = folds.tumbling(rows, "ts", "6 hours", ["event_type"], "48 hours", n=F.count("*")).select("event_type", F.col("window.start").alias("start"), "n")
        stream = counted.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").queryName(f"{name}_{batch}").trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema("event_type string, start timestamp, n long").parquet(f"{root}/out")
