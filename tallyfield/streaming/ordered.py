"""Folds of poll logs as streams in event time: polls may come out of order, state goes when a match falls quiet.

A poll's rows wait in a state until the watermark has passed them; then they
are folded match by match by their instants, whatever order and micro-batch they came in.  Timers bring back
matches whose rows wait, and those that were quiet for `expire`: what is known of them is removed, and a poll
after so long a silence starts the match anew even where both were folded at once, so results
do not depend on how the log was cut into batches.  Polls behind the watermark of the batch
before are late and left out; rows after the last watermark are not out yet.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfield.streaming.folds import CONFIRMED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of matches that share a state; a checkpoint keeps to the number it was started with.
BUCKETS = 2_048
#: Rows of a page that waits.
PAGE = 1_000


def micros(span: str) -> int:
    """Microseconds of a span like "36 hours"."""
    n, unit = span.split()
    return round(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")] * 1_000_000)


class Ordered(StatefulProcessor):
    """Rows of a bucket of matches, each match's in order of time.

    A call to the state and a row that Spark makes for Python cost more than its fold, so matches share the
    state of their bucket, and rows come in pandas batches as (match_key, us, body): their instant in microseconds,
    and as JSON all columns, since pandas has no nulls among numbers; what is given is JSON too.  Rows wait
    in pages (pickled, one list entry a page), and all that is remembered of the bucket's matches is one
    value, read once when rows are due and written once after them.  A subclass names the columns it takes
    and gives, and folds the rows of one match and instant in `step`."""

    takes: str
    gives: str

    def __init__(self, expire_us: int):
        self.expire_us = expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = dict(x.split() for x in self.takes.split(", "))
        self.fields, self.doubles = list(kinds), [x for x, kind in kinds.items() if kind == "double"]
        self.row = Row(*self.fields)
        self.waiting = handle.getListState("waiting", "page binary")
        self.known = handle.getValueState("known", "matches binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(None if pd.isna(m) else m, int(us), body) for pdf in rows for m, us, body in zip(pdf["match_key"], pdf["us"], pdf["body"], strict=True)]
        yield from self._pages(self._drain(timerValues.getCurrentWatermarkInMs(), new))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._pages(self._drain(timerValues.getCurrentWatermarkInMs(), []))

    @staticmethod
    def _pages(rows: Iterator[Row]) -> Iterator[pd.DataFrame]:
        while page := [json.dumps(r.asDict()) for r in islice(rows, PAGE)]:
            yield pd.DataFrame({"row": page})

    def _read(self, body: str) -> Row:
        values = json.loads(body)
        for f in self.doubles:
            if isinstance(values.get(f), str):  # "NaN", "Infinity"
                values[f] = float(values[f])
        return self.row(*[values.get(f) for f in self.fields])

    def _wait(self, rows: list[tuple]) -> None:
        self.waiting.appendList([(pickle.dumps(rows[k : k + PAGE]),) for k in range(0, len(rows), PAGE)])

    def _drain(self, watermark_ms: int, new: list[tuple]) -> Iterator[Row]:
        bound = watermark_ms * 1000
        if new and min(us for _, us, _ in new) >= bound:  # nothing is due before what a timer was set for
            self._wait(new)
            self.handle.registerTimer(min(us for _, us, _ in new) // 1000)
            return
        held = [r for (page,) in self.waiting.get() for r in pickle.loads(page)]  # noqa: S301  rows of our own
        due, rest = [], []
        for match, us, body in (*held, *new):
            if us < bound:
                due.append((match is not None, match, us, self._read(body)))
            else:
                rest.append((match, us, body))
        stored = self.known.get()
        known = {} if stored is None else pickle.loads(stored[0])  # noqa: S301  match: (seen, looked, memory)
        due.sort(key=lambda r: (*r[:3], *((x is not None, x) for x in r[3])))
        for match, own in groupby(due, key=itemgetter(1)):
            seen, self.looked, self.memory = known.get(match, (None, None, {}))
            for at, polls in groupby(own, key=itemgetter(2)):
                if seen is not None and at - seen > self.expire_us:
                    self.looked, self.memory = None, {}
                rows = [r for *_, r in polls]
                yield from self.step(match, at, rows)
                if any(r["covers"] for r in rows):
                    self.looked = at
                seen = at
            known[match] = (seen, self.looked, self.memory)
        if due:
            if held:
                self.waiting.clear()
            if rest:
                self._wait(rest)
        waits = {match for match, _, _ in rest}  # quiet matches whose rows wait are kept: the rows tell whether the silence was too long
        quiet = [m for m, (seen, _, _) in known.items() if m not in waits and bound > seen + self.expire_us]
        for m in quiet:
            del known[m]
        if known and (due or quiet):
            self.known.update((pickle.dumps(known),))
        elif quiet and stored is not None:
            self.known.clear()
        later = [min(us for _, us, _ in rest)] if rest else []
        later += [seen + self.expire_us for m, (seen, _, _) in known.items() if m not in waits]
        if later:
            self.handle.registerTimer(min(later) // 1000)

    def recall(self, name: str) -> tuple | None:
        return self.memory.get(name)

    def remember(self, name: str, value: tuple) -> None:
        self.memory[name] = value

    def gap(self, at: int) -> float | None:
        """Seconds since the last successful poll before that covered the match."""
        return None if self.looked is None else (at - self.looked) / 1e6

    def step(self, key: str, at: int, rows: list[Row]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Prices(Ordered):
    """The moments at which a bookmaker's prices changed."""

    takes = "source string, bookmaker string, home double, draw double, away double, covers boolean"
    gives = "match_key string, bookmaker string, home double, draw double, away double, source string, us long, since_previous_poll_seconds double, is_first_sighting boolean"

    def step(self, key: str, at: int, rows: list[Row]) -> Iterator[Row]:
        for r in rows:
            price = (r["home"], r["draw"], r["away"])
            known = None if r["bookmaker"] is None else self.recall(r["bookmaker"])
            if r["bookmaker"] is None or known == price:
                continue
            self.remember(r["bookmaker"], price)
            yield Row(match_key=key, bookmaker=r["bookmaker"], home=price[0], draw=price[1], away=price[2], source=r["source"], us=at, since_previous_poll_seconds=self.gap(at), is_first_sighting=known is None)


class Lineups(Ordered):
    """The first confirmed lineup of each team, and a row for each later one that differs from it."""

    takes = "source string, team string, digest string, players array<string>, covers boolean"
    gives = "match_key string, team string, source string, us long, known_at_uncertainty_seconds double, digest string, players array<string>, is_revision boolean"

    def step(self, key: str, at: int, rows: list[Row]) -> Iterator[Row]:
        for r in rows:
            first = None if r["team"] is None else self.recall(r["team"])
            if r["team"] is None or first == (r["digest"],):
                continue
            if first is None:
                self.remember(r["team"], (r["digest"],))
            yield Row(match_key=key, team=r["team"], source=r["source"], us=at, known_at_uncertainty_seconds=None if first else self.gap(at), digest=r["digest"], players=r["players"], is_revision=first is not None)


def _array(c: str | Column, polls: DataFrame, name: str) -> Column:
    return F.coalesce(c, F.array().cast(polls.schema[name].dataType))


def _covers(polls: DataFrame, matches: Column, nulls: dict[str, str]) -> Column:
    """A row for each match that a successful poll covered."""
    of = F.transform(matches, lambda m: F.struct(m.alias("match_key"), *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()], F.lit(True).alias("covers")))
    return F.when(F.col("error").isNull(), of).otherwise(F.slice(of, 1, 0))


def _fold(rows: DataFrame, processor: Ordered) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # keeps lists, maps and timers
    fields = [x.split()[0] for x in processor.takes.split(", ")]
    rows = rows.select(F.pmod(F.xxhash64("match_key"), F.lit(BUCKETS)).alias("bucket"), "observed_at", "match_key", F.unix_micros("observed_at").alias("us"), F.to_json(F.struct(*fields)).alias("body"))
    out = rows.groupBy("bucket").transformWithStateInPandas(processor, "row string", "Append", "EventTime")
    return out.select(F.from_json("row", processor.gives).alias("r")).select("r.*").withColumn("observed_at", F.timestamp_micros("us")).drop("us")


def stream_price_changes(polls: DataFrame, late: str = "1 hour", expire: str = "7 days") -> DataFrame:
    """The price changes of a stream of polls (source, observed_at, scope, error, quotes), in event time."""
    polls = polls.withWatermark("observed_at", late)
    kinds = {"bookmaker": "string", "home": "double", "draw": "double", "away": "double"}
    quoted = F.transform(_array("quotes", polls, "quotes"), lambda q: F.struct(q["match_key"].alias("match_key"), *[q[c].alias(c) for c in kinds], F.lit(False).alias("covers")))
    rows = polls.select("source", "observed_at", F.explode(F.concat(quoted, _covers(polls, _array("scope", polls, "scope"), kinds))).alias("x")).select("source", "observed_at", "x.*")
    return _fold(rows, Prices(micros(expire)))


def stream_lineups(polls: DataFrame, late: str = "1 hour", expire: str = "7 days") -> DataFrame:
    """First confirmed lineups and their revisions of a stream of polls (source, observed_at, scope, error, lineups), in event time."""
    polls = polls.withWatermark("observed_at", late)
    confirmed = F.filter(_array("lineups", polls, "lineups"), lambda x: x["status"] == CONFIRMED)
    digest = lambda x: F.sha2(F.concat_ws("|", F.sort_array(x["players"])), 256)
    found = F.transform(confirmed, lambda x: F.struct(x["match_key"].alias("match_key"), x["team"].alias("team"), digest(x).alias("digest"), x["players"].alias("players"), F.lit(False).alias("covers")))
    seen = F.array_union(_array("scope", polls, "scope"), F.transform(confirmed, lambda x: x["match_key"]))
    rows = polls.select("source", "observed_at", F.explode(F.concat(found, _covers(polls, seen, {"team": "string", "digest": "string", "players": "array<string>"}))).alias("x")).select("source", "observed_at", "x.*")
    return _fold(rows, Lineups(micros(expire)))
