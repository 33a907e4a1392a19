"""Bronze to silver as set operations: each table is one query over all new rows and what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfield.warehouse.identity import proposals, resolve
from tallyfield.warehouse.schema import conform
from tallyfield.warehouse.views import Warehouse

BRONZE = "source string, source_id string, competition string, season string, match_date string, kickoff_utc string, home_name_raw string, away_name_raw string, goals_home string, goals_away string, goals_home_ht string, goals_away_ht string, home_source_id string, away_source_id string, neutral_venue string, result_settled_at string, ingested_at string, kickoff_precision string, odds_json string"


def key(*parts: Column) -> Column:
    """A deterministic surrogate id."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def kickoff(text: Column, day: Column) -> Column:
    """The stated instant, else 15:00 of the day."""
    return F.coalesce(F.try_to_timestamp(F.nullif(text, F.lit(""))), F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + 15 * 3600))


def settle_instant(at: Column, day: Column, precision: Column) -> Column:
    """When a result can be known: two hours after an exact kickoff, else four hours after the day's last minute."""
    exact = F.timestamp_seconds(F.unix_timestamp(at) + 2 * 3600)
    late = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + (23 * 60 + 59) * 60 + 4 * 3600)
    return F.when(precision == "EXACT", exact).when(precision.isin("LOCAL_APPROX", "DATE_ONLY"), late).otherwise(F.raise_error(F.concat(F.lit("unknown kickoff precision "), precision)).cast("timestamp"))


def _present(text: Column) -> Column:
    return F.nullif(F.nullif(text, F.lit("")), F.lit("None"))


def transform(bronze: DataFrame, w: Warehouse, countries: DataFrame, run_id: str = "run") -> dict[str, DataFrame]:
    """New rows of the silver tables out of bronze rows.

    Names are resolved once each.  A match is that of competition, season, day and teams;
    the first row of it in (source, source_id) order writes it, rows that state another
    kickoff become revisions, and rows with an unapproved side go to quarantine.
    `countries` has (competition, country).
    """
    raw = bronze.withColumns({"day": F.to_date("match_date"), "at": kickoff(F.col("kickoff_utc"), F.to_date("match_date"))}).join(F.broadcast(countries), "competition", "left")  # a row a competition
    raw = raw.withColumn("country", F.coalesce("country", F.raise_error(F.concat(F.lit("no country for competition "), F.col("competition")))))
    named = raw.select("source", "country", F.explode(F.array("home_name_raw", "away_name_raw")).alias("raw_name")).distinct()
    known = resolve(named, w)
    for side in ("home", "away"):
        s = known.select("source", "country", F.col("raw_name").alias(f"{side}_name_raw"), F.col("team_id").alias(f"{side}_team_id"), F.col("method").alias(f"{side}_method"))
        raw = raw.join(s, ["source", "country", f"{side}_name_raw"], "left")
    good = raw.filter("home_team_id IS NOT NULL AND away_team_id IS NOT NULL")
    bad = raw.filter("home_team_id IS NULL OR away_team_id IS NULL")
    reason = F.concat_ws("; ", F.when(F.col("home_team_id").isNull(), F.concat(F.lit("home: "), F.col("home_method"))), F.when(F.col("away_team_id").isNull(), F.concat(F.lit("away: "), F.col("away_method"))))
    quarantine = bad.select("source", "source_id", reason.alias("reason"), F.to_json(F.struct("home_name_raw", "away_name_raw", "competition", "season", "match_date")).alias("payload")).dropDuplicates(["source", "source_id"])

    merged = w["match_merges"].select(F.col("merged_match_id").alias("match_id"), "surviving_match_id")
    good = good.withColumn("match_id", key(F.col("competition"), F.col("season"), F.col("day").cast("string"), F.col("home_team_id"), F.col("away_team_id"))).join(merged, "match_id", "left").withColumn("match_id", F.coalesce("surviving_match_id", "match_id")).drop("surviving_match_id")
    have = w["matches"].select("match_id", F.col("kickoff_utc").alias("_known"))
    order = W.partitionBy("match_id").orderBy("source", "source_id")
    seen = good.join(have, "match_id", "left").withColumn("_n", F.row_number().over(order)).withColumn("_first", F.coalesce("_known", F.first("at").over(order)))
    matches = seen.filter("_n = 1 AND _known IS NULL").select("match_id", F.col("competition").alias("competition_id"), F.col("season").alias("season_id"), F.col("day").alias("match_date_utc"), F.col("at").alias("kickoff_utc"), "home_team_id", "away_team_id", F.lower(F.coalesce("neutral_venue", F.lit(""))).isin("1", "true", "yes").alias("neutral_venue"), F.when(_present(F.col("goals_home")).isNotNull(), "FINISHED").otherwise("SCHEDULED").alias("status"), F.coalesce("kickoff_precision", F.lit("EXACT")).alias("kickoff_precision"), F.lit(run_id).alias("ingestion_run_id"))
    revisions = seen.filter(F.col("at") != F.col("_first")).select("match_id", F.col("at").alias("kickoff_utc"), F.coalesce(F.try_to_timestamp("ingested_at"), F.col("at")).alias("observed_at"), "source").distinct()
    sources = good.filter("source_id IS NOT NULL AND source_id <> ''").select("source", "source_id", "match_id").dropDuplicates(["source", "source_id"]).join(w["match_source_ids"].select("source", "source_id"), ["source", "source_id"], "left_anti")
    sides = good.select("source", F.col("competition").alias("competition_id"), F.col("season").alias("season_id"), F.explode(F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_source_id").alias("source_id")) for s in ("home", "away")])).alias("x")).select("source", "competition_id", "season_id", "x.*")
    membership = sides.select("team_id", "competition_id", "season_id").distinct().join(w["team_season_membership"], ["team_id", "competition_id", "season_id"], "left_anti")
    ids = sides.filter("source_id IS NOT NULL AND source_id <> ''").groupBy("source", "source_id").agg(F.min("team_id").alias("team_id"), F.count_distinct("team_id").alias("_n"))
    ids = ids.withColumn("team_id", F.when(F.col("_n") == 1, F.col("team_id")).otherwise(F.raise_error(F.concat(F.lit("source id collision: "), F.col("source"), F.lit(":"), F.col("source_id"))))).drop("_n").join(w["team_source_ids"].select("source", "source_id"), ["source", "source_id"], "left_anti")
    settled = F.coalesce(F.try_to_timestamp(_present(F.col("result_settled_at"))), settle_instant(F.col("at"), F.col("day"), F.coalesce("kickoff_precision", F.lit("EXACT"))))
    number = lambda c: _present(F.col(c)).cast("int").alias(c)
    results = good.filter(_present(F.col("goals_home")).isNotNull()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("match_id", number("goals_home"), number("goals_away"), number("goals_home_ht"), number("goals_away_ht"), settled.alias("settled_at"), "source").join(w["match_results"].select("match_id"), "match_id", "left_anti")
    open_names = known.filter("team_id IS NULL").select("source", "raw_name", "country")
    asked = proposals(open_names, w["teams"]).select(key(F.col("source"), F.col("raw_name"), F.col("team_id")).alias("proposal_id"), "source", F.col("raw_name").alias("alias_raw"), F.col("team_id").alias("candidate_team_id"), "score", F.lit("PROPOSED").alias("status")).join(w["team_alias_proposals"].select("proposal_id"), "proposal_id", "left_anti")
    out = {"matches": matches, "match_kickoff_revisions": revisions, "match_source_ids": sources, "team_season_membership": membership, "team_source_ids": ids, "match_results": results, "match_quarantine": quarantine, "team_alias_proposals": asked}
    return {name: conform(df, name) for name, df in out.items()}


def snapshot_digest(df: DataFrame) -> DataFrame:
    """(n, digest): one fingerprint of a table's rows in any order, by a sum of row hashes.

    Sums need no sort, so any number of rows is one aggregation; equal tables have equal
    digests on any cluster.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    parts = F.md5(text.cast("binary"))
    piece = lambda k: F.conv(F.substring(parts, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")
    return df.select(*[piece(k).alias(f"p{k}") for k in range(4)]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).alias(f"s{k}") for k in range(4)]).select("n", F.concat_ws("-", *[F.col(f"s{k}").cast("string") for k in range(4)]).alias("digest"))
