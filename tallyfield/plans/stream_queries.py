"""Queries that run streams: event-time folds of poll logs, over two micro-batches and a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.plans.registry import query, table
from tallyfield.plans.source_queries import scratch
from tallyfield.sources import polls
from tallyfield.streaming import ordered


def in_two_runs(root: str, add: Callable[[int], None], stream: Callable[[], DataFrame]) -> DataFrame:
    """What a stream writes when it is started, ended, given more input and started again from its checkpoint.  Each run goes on until nothing is left to do, the batch that only moves the watermark included."""
    for run in (0, 1):
        add(run)
        out = stream()
        query_ = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(processingTime="0 seconds").start()
        try:
            query_.processAllAvailable()
        finally:
            query_.stop()
    return out.sparkSession.read.schema(out.schema).parquet(f"{root}/out")


#: Rows of two runs that come out: not behind the first run's watermark, and before the last one's.
TAKEN = """e AS (SELECT *, {later} AS later, epoch_us(ts) AS us FROM events),
m AS (SELECT (epoch_ms(max(ts) FILTER (WHERE NOT later)) - {late}) * 1000 AS first, (epoch_ms(max(ts)) - {late}) * 1000 AS final FROM e),
taken AS (SELECT e.* FROM e CROSS JOIN m WHERE us < final AND (NOT later OR us > first) AND {seen}),
timed AS (SELECT *, CAST(user_id AS VARCHAR) AS match_key, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS quiet FROM taken),
runs AS (SELECT *, sum(CASE WHEN quiet > {expire} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM timed)"""


@query("streamed_prices", f"""WITH {TAKEN.format(later="event_id % 4 = 3", seen="TRUE", late=6 * 3_600_000, expire=60 * 3_600_000_000)},
c AS (SELECT match_key, CAST(event_id % 2 AS VARCHAR) AS bookmaker, round(value / 25) AS home, ts AS observed_at, us,
  lag(round(value / 25)) OVER w AS before, row_number() OVER w AS k,
  max(CASE WHEN event_id % 9 <> 0 THEN us END) OVER (PARTITION BY user_id, run ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS looked
  FROM runs WINDOW w AS (PARTITION BY user_id, run, event_id % 2 ORDER BY us))
SELECT match_key, bookmaker, home, observed_at, (us - looked) / 1e6 AS since_previous_poll_seconds, k = 1 AS is_first_sighting FROM c WHERE k = 1 OR home IS DISTINCT FROM before""")
def streamed_prices(spark, d):
    """Price changes of a poll log as a stream: a quarter of the polls comes in a second run, out of order and partly late; matches quiet for 60 hours start anew."""
    root, log = scratch(spark), _numbered_polls(spark, d)
    schema = log.drop("later").schema
    add = lambda run: log.filter(F.col("later") == bool(run)).drop("later").write.parquet(f"{root}/in/run={run}")
    stream = lambda: ordered.stream_price_changes(spark.readStream.schema(schema).parquet(f"{root}/in/*"), "6 hours", "60 hours")
    return in_two_runs(root, add, stream).select("match_key", "bookmaker", "home", "observed_at", "since_previous_poll_seconds", "is_first_sighting")


def _numbered_polls(spark, d) -> DataFrame:
    """Polls made of events, and whether each comes in the second run."""
    e = table(spark, d, "events")
    match = F.col("user_id").cast("string")
    quote = F.struct(match.alias("match_key"), (F.col("event_id") % 2).cast("string").alias("bookmaker"), F.round(F.col("value") / 25).alias("home"), F.lit(3.0).alias("draw"), F.lit(4.0).alias("away"))
    return e.select(F.lit("s").alias("source"), F.col("ts").cast("timestamp").alias("observed_at"), F.array(match).alias("scope"), F.when(F.col("event_id") % 9 == 0, "down").alias("error"), F.array(quote).alias("quotes"), (F.col("event_id") % 4 == 3).alias("later"))


@query("lineup_feed", f"""WITH {TAKEN.format(later="day(ts) > 15", seen="event_id % 9 <> 0", late=3_600_000, expire=60 * 3_600_000_000)},
seen AS (SELECT *, CAST(event_id % 2 AS VARCHAR) AS team, event_id % 3 AS eleven, event_id % 5 <> 0 AS confirmed, max(us) OVER (PARTITION BY user_id, run ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS looked FROM runs),
ranked AS (SELECT *, row_number() OVER w AS k, first_value(eleven) OVER w AS first_eleven FROM seen WHERE confirmed WINDOW w AS (PARTITION BY user_id, run, team ORDER BY us))
SELECT CAST(user_id + 1 AS VARCHAR) AS match_key, team, ts AS observed_at, CASE WHEN k = 1 THEN (us - looked) / 1e6 END AS known_at_uncertainty_seconds, k > 1 AS is_revision, 11 + CAST(eleven = 0 AS INTEGER) AS starters FROM ranked WHERE k = 1 OR eleven <> first_eleven""")
def lineup_feed(spark, d):
    """Lineups polled from a feed: a page a day, days 1 to 15 in a first run and the others in a second one; failed looks, elevens not whole, revisions."""
    root, e = scratch(spark), table(spark, d, "events")
    k = F.col("event_id")
    # every third eleven has a substitute among the starters, every fifth look has ten starters only; others on the sheet do not count
    size = F.when(k % 5 == 0, 10).when(k % 3 == 0, 12).otherwise(11)
    player = lambda i, kind: F.struct(F.lit(kind).cast("long").alias("type_id"), (k % 2).alias("team_id"), F.when(i > 0, i.cast("long") + k % 3 * 100).alias("player_id"), F.concat(F.lit("p"), i).alias("player_name"))
    sheet = F.concat(F.transform(F.sequence(F.lit(0), size - 1), lambda i: player(i, polls.STARTER)), F.array(player(F.lit(50), 12)))
    record = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("observed_at"), F.when(k % 9 == 0, "down").alias("error"), F.array(F.struct((F.col("user_id") + 1).alias("id"), sheet.alias("lineups"))).alias("data"))
    days = e.withColumn("ts", F.col("ts").cast("timestamp")).select(F.dayofmonth("ts").alias("page"), F.to_json(record).alias("value"))
    add = lambda run: days.filter((F.col("page") > 15) == bool(run)).repartition("page").write.mode("append").partitionBy("page").text(f"{root}/feed/lineups")
    read = lambda: polls.read(spark, "lineups", polls.LINEUP_FEED, True, root=f"{root}/feed")
    stream = lambda: ordered.stream_lineups(polls.lineup_polls(read(), "feed"), "1 hour", "60 hours")
    out = in_two_runs(root, add, stream)
    return out.select("match_key", "team", "observed_at", "known_at_uncertainty_seconds", "is_revision", F.size("players").alias("starters"))
