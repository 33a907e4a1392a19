"""Folds in batch against their definition, and the price fold as a stream with a restart."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyfield.streaming import folds

T0 = dt.datetime(2024, 1, 1)


def poll(minute, quotes=(), scope=("m",), error=None, source="s"):
    return {"source": source, "observed_at": (T0 + dt.timedelta(minutes=minute)).isoformat(), "scope": list(scope), "error": error, "quotes": [dict(match_key=m, bookmaker=b, home=h, draw=3.0, away=4.0) for m, b, h in quotes]}


POLLS = [
    poll(0, [("m", "b", 2.0)]),
    poll(30, [("m", "b", 2.0)]),
    poll(45, error="down"),
    poll(60, [("m", "b", 2.1), ("m", "c", 2.0)]),
    poll(90, [("m", "b", 2.0)]),
    poll(100, [("n", "b", 5.0)], scope=("n",)),
    poll(110, [("n", "b", 6.0)], scope=()),
]
WANT = {("m", "b", 0, 2.0, None, True), ("m", "b", 60, 2.1, 1800.0, False), ("m", "c", 60, 2.0, 1800.0, True), ("m", "b", 90, 2.0, 1800.0, False), ("n", "b", 100, 5.0, None, True), ("n", "b", 110, 6.0, 600.0, False)}


def plain(rows):
    return {(r["match_key"], r["bookmaker"], int((r["observed_at"] - T0).total_seconds() // 60), r["home"], r["since_previous_poll_seconds"], r["is_first_sighting"]) for r in rows}


def write(folder, name, polls):
    (folder / name).write_text("".join(json.dumps(p) + "\n" for p in polls))


def test_prices_in_batch(spark, tmp_path):
    write(tmp_path, "a.json", POLLS)
    assert plain(folds.fold_prices(spark.read.schema(folds.ODDS_POLL).json(str(tmp_path))).collect()) == WANT


def test_prices_as_a_stream(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    for name, polls in (("1.json", POLLS[:3]), ("2.json", POLLS[3:])):  # the second run starts from the first one's checkpoint
        write(source, name, polls)
        query = folds.stream_prices(folds.read_polls(spark, str(source))).writeStream.format("parquet").option("checkpointLocation", str(state)).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert plain(spark.read.parquet(str(out)).collect()) == WANT


def test_first_lineups(spark, tmp_path):
    def look(minute, status, players, error=None, team="t"):
        return {"source": "s", "observed_at": (T0 + dt.timedelta(minutes=minute)).isoformat(), "scope": ["m"], "error": error, "lineups": [{"match_key": "m", "team": team, "status": status, "players": players}] if players else []}

    polls = [look(0, None, None), look(10, "PREDICTED", ["a"]), look(15, None, None, "down"), look(20, "CONFIRMED", ["a", "b"]), look(25, "CONFIRMED", ["b", "a"]), look(30, "CONFIRMED", ["a", "c"])]
    write(tmp_path, "a.json", polls)
    (r,) = folds.fold_sightings(spark.read.schema(folds.LINEUP_POLL).json(str(tmp_path))).collect()
    assert r["known_at"] == T0 + dt.timedelta(minutes=20) and r["known_at_uncertainty_seconds"] == 600 and r["players"] == ["a", "b"]
    assert [x["players"] for x in r["superseded_by"]] == [["a", "c"]]


def test_windows_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "a.json", [{"k": 1, "at": (T0 + dt.timedelta(minutes=m)).isoformat(), "v": m} for m in (0, 4, 6, 40)])
    stream = spark.readStream.schema("k int, at timestamp, v int").json(str(source))
    for name, df in (("tumbling", folds.tumbling(stream, "at", "5 minutes", ["k"], "10 minutes", n=F.count("*"))), ("sliding", folds.sliding(stream, "at", "10 minutes", "5 minutes", ["k"], "10 minutes", n=F.count("*"))), ("sessions", folds.sessions(stream, "at", "5 minutes", ["k"], "10 minutes", n=F.count("*")))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("tumbling").collect()) == [1, 2]
    assert [r["n"] for r in spark.table("sessions").collect()] == [3]
    assert spark.table("sliding").count() == 3


def test_matches_of_a_bucket_share_calls_to_the_state():
    """Each call to the state goes to the JVM and back: many matches in a bucket are a few calls, nulls and NaN come through."""
    import pandas as pd

    from tallyfield.streaming.ordered import Prices

    calls, waiting, known, timers = [], [], [], []

    class State:
        def __init__(self, held):
            self.held = held

        def get(self):
            calls.append("get")
            return iter(self.held) if self.held is waiting else self.held[-1] if self.held else None

        def clear(self):
            calls.append("clear")
            self.held = waiting if self.held is waiting else known
            self.held.clear()

        def appendList(self, rows):  # noqa: N802
            calls.append("append")
            self.held.extend(rows)

        def update(self, value):
            calls.append("update")
            self.held[:] = [value]

    class Handle:
        getListState = staticmethod(lambda name, schema: State(waiting))  # noqa: N815
        getValueState = staticmethod(lambda name, schema: State(known))  # noqa: N815
        registerTimer = staticmethod(lambda at: (calls.append("timer"), timers.append(at)))  # noqa: N815

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    prices = Prices(1_000_000_000)
    prices.init(Handle)
    body = lambda home, covers: json.dumps({"source": "s", "bookmaker": "b", "home": home, "draw": 3.0, "covers": covers})
    pdf = pd.DataFrame([(f"m{m}", us, body(home, True)) for m in range(500) for us, home in ((3_000, "NaN"), (1_000, 2.0), (2_000, 2.0), (9_000, 4.0))], columns=["match_key", "us", "body"])
    assert not list(prices.handleInputRows((7,), iter([pdf]), Now(0)))
    assert calls == ["append", "timer"] and timers == [1]
    calls.clear()
    out = [json.loads(r) for p in prices.handleExpiredTimer((7,), Now(5), None) for r in p["row"]]
    assert len(calls) <= 6 and len(waiting) == 1 and timers[-1] == 9
    assert len(out) == 1000 and [(r["us"], r["home"], r["away"], r["is_first_sighting"], r["since_previous_poll_seconds"]) for r in out[:1]] == [(1_000, 2.0, None, True, None)]
    assert out[1]["us"] == 3_000 and out[1]["home"] != out[1]["home"] and out[1]["since_previous_poll_seconds"] == 0.001
    assert [json.loads(r)["us"] for p in prices.handleExpiredTimer((7,), Now(10), None) for r in p["row"]] == [9_000] * 500
    assert not waiting and not list(prices.handleExpiredTimer((7,), Now(2_000_000), None)) and not known
