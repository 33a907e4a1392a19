"""Stateful folds over poll logs: price changes and first lineups, in batch and as streams.

A poll is (source, observed_at, scope, error, quotes | lineups).  A failed poll closes no
gap: the time since the last look counts successful polls that covered the match.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

ODDS_POLL = "source string, observed_at timestamp, scope array<string>, error string, quotes array<struct<match_key:string,bookmaker:string,home:double,draw:double,away:double>>"
LINEUP_POLL = "source string, observed_at timestamp, scope array<string>, error string, lineups array<struct<match_key:string,team:string,status:string,players:array<string>>>"
CONFIRMED = "CONFIRMED"


def _covered(polls: DataFrame, seen: str | None = None) -> DataFrame:
    """(match_key, at): successful polls by the matches they covered."""
    scope = F.col("scope") if seen is None else F.array_union(F.coalesce("scope", F.array()), F.col(seen))
    return polls.filter("error IS NULL").select(F.explode(scope).alias("match_key"), F.col("observed_at").alias("at")).distinct()


def _gap(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """rows (match_key, observed_at, ...) with the time of the last covering poll before, by one sorted pass over both."""
    body = F.struct(*[F.col(c) for c in rows.columns])
    left = rows.select("match_key", F.col("observed_at").alias("t"), body.alias("row"), F.lit(None).cast("timestamp").alias("p"), F.lit(0).alias("turn"))
    right = covered.select("match_key", F.col("at").alias("t"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col("at").alias("p"), F.lit(1).alias("turn"))
    before = W.partitionBy("match_key").orderBy("t", "turn").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("previous", F.last("p", ignorenulls=True).over(before)).filter("row IS NOT NULL")
    return both.select("row.*", (F.unix_micros("row.observed_at") - F.unix_micros("previous")).cast("double").alias("us")).withColumn("since_previous_poll_seconds", F.col("us") / 1e6).drop("us")


def fold_prices(polls: DataFrame) -> DataFrame:
    """The moments at which a bookmaker's prices of a match changed; unchanged polls only close gaps."""
    quotes = polls.select("source", "observed_at", F.explode("quotes").alias("q")).select("source", "observed_at", "q.*")
    order = W.partitionBy("match_key", "bookmaker").orderBy("observed_at", "source")
    price = F.struct("home", "draw", "away")
    changed = quotes.withColumn("_before", F.lag(price).over(order)).withColumn("_n", F.row_number().over(order))
    changed = changed.filter(~F.col("_before").eqNullSafe(price)).withColumn("is_first_sighting", F.col("_n") == 1).drop("_before", "_n")
    return _gap(changed, _covered(polls))


def fold_sightings(polls: DataFrame) -> DataFrame:
    """The first confirmed lineup of each (match, team), how surely its instant is known, and later revisions."""
    confirmed = polls.select("source", "observed_at", F.explode("lineups").alias("l")).select("source", "observed_at", "l.*").filter(F.col("status") == CONFIRMED)
    digest = F.sha2(F.concat_ws("|", F.sort_array("players")), 256)
    order = W.partitionBy("match_key", "team").orderBy("observed_at", "source")
    rows = confirmed.withColumns({"digest": digest, "_n": F.row_number().over(order)})
    first = rows.filter("_n = 1").drop("_n", "status")
    later = rows.filter("_n > 1").select("match_key", "team", F.col("observed_at").alias("_at"), F.col("digest").alias("_d"), F.col("players").alias("_p"))
    base = first.select("match_key", "team", F.col("digest").alias("_first"))
    revised = later.join(base, ["match_key", "team"]).filter("_d <> _first").groupBy("match_key", "team").agg(F.sort_array(F.collect_list(F.struct(F.col("_at").alias("observed_at"), F.col("_d").alias("digest"), F.col("_p").alias("players")))).alias("superseded_by"))
    seen = polls.withColumn("_seen", F.transform(F.filter(F.coalesce("lineups", F.array().cast(polls.schema["lineups"].dataType)), lambda x: x["status"] == CONFIRMED), lambda x: x["match_key"]))
    out = _gap(first, _covered(seen, "_seen")).withColumnsRenamed({"observed_at": "known_at", "since_previous_poll_seconds": "known_at_uncertainty_seconds"})
    return out.join(revised, ["match_key", "team"], "left")


PRICES = "match_key string, bookmaker string, home double, draw double, away double, source string, observed_at timestamp, since_previous_poll_seconds double, is_first_sighting boolean"


class PriceChanges(StatefulProcessor):
    """Per match: the last price of each bookmaker and the last successful covering poll.

    Rows of a batch are taken in order of observed_at; rows older than the state's clock still
    count, since a late poll can only shorten what is known, never rewrite what was emitted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prices = handle.getMapState("prices", "bookmaker string", "home double, draw double, away double")
        self.looked = handle.getValueState("looked", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values(["observed_at", "source", "bookmaker"], na_position="last", kind="stable")
        out = []
        for at, poll in polls.groupby("observed_at", sort=True):
            last = self.looked.get()[0] if self.looked.exists() else None
            for r in poll.itertuples(index=False):
                if r.bookmaker is None or pd.isna(r.bookmaker):
                    continue
                price, known = (float(r.home), float(r.draw), float(r.away)), self.prices.containsKey((r.bookmaker,))
                if known and tuple(self.prices.getValue((r.bookmaker,))) == price:
                    continue
                gap = None if last is None else (at - pd.Timestamp(last)).total_seconds()
                out.append((key[0], r.bookmaker, *price, r.source, at, gap, not known))
                self.prices.updateValue((r.bookmaker,), price)
            if bool(poll["covers"].any()):
                self.looked.update((at.to_pydatetime(),))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in PRICES.split(", ")])

    def close(self) -> None:
        pass


def by_match(polls: DataFrame) -> DataFrame:
    """A row for each match a poll covers or quotes, and bookmaker: the input of PriceChanges."""
    quoted = F.transform(F.coalesce("quotes", F.array().cast(polls.schema["quotes"].dataType)), lambda q: F.struct(q["match_key"].alias("match_key"), q["bookmaker"].alias("bookmaker"), q["home"].alias("home"), q["draw"].alias("draw"), q["away"].alias("away"), F.lit(False).alias("covers")))
    null = lambda t: F.lit(None).cast(t)
    covered = F.when(F.col("error").isNull(), F.transform(F.coalesce("scope", F.array().cast("array<string>")), lambda m: F.struct(m.alias("match_key"), null("string").alias("bookmaker"), null("double").alias("home"), null("double").alias("draw"), null("double").alias("away"), F.lit(True).alias("covers")))).otherwise(F.array().cast("array<struct<match_key:string,bookmaker:string,home:double,draw:double,away:double,covers:boolean>>"))
    return polls.select("source", "observed_at", F.explode(F.concat(quoted, covered)).alias("x")).select("source", "observed_at", "x.*")


def stream_prices(polls: DataFrame) -> DataFrame:
    """The price fold as a stream; needs the RocksDB state store."""
    return by_match(polls).groupBy("match_key").transformWithStateInPandas(PriceChanges(), T._parse_datatype_string(PRICES), "Append", "None")


def read_polls(spark, path: str, schema: str = ODDS_POLL) -> DataFrame:
    """A folder of JSON-lines polls as a stream."""
    return spark.readStream.schema(schema).json(path)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour", **aggregates) -> DataFrame:
    """Aggregates of event-time windows with a watermark; works on streams and batches."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def sliding(events: DataFrame, time: str, width: str, step: str, keys: list[str], late: str = "1 hour", **aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour", **aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*[v.alias(k) for k, v in aggregates.items()])
