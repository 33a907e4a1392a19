"""Poll feeds read in increments and folded in event time, whatever order polls come in."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tallyfield.plans.stream_queries import in_two_runs
from tallyfield.sources import polls
from tallyfield.streaming import folds, ordered

T0 = dt.datetime(2024, 1, 1)


def page(folder, k, records, name="part-0.txt"):
    (folder / "f" / f"page={k}").mkdir(parents=True, exist_ok=True)
    (folder / "f" / f"page={k}" / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def look(minute, quotes=(), error=None):
    return {"source": "s", "observed_at": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z", "scope": ["m"], "error": error, "quotes": [dict(match_key="m", bookmaker=b, home=h, draw=3.0, away=4.0) for b, h in quotes]}


def test_a_feed_in_batch_with_its_own_schema(spark, tmp_path):
    page(tmp_path, 1, [{"id": 1, "x": {"y": 2.5}}, {"id": 2, "x": None}])
    page(tmp_path, 2, [{"id": 3}])
    page(tmp_path, 4, [{"id": 9}])  # page 3 is not there yet
    df = polls.read(spark, "f", root=str(tmp_path))
    assert sorted((r["page"], r["id"], r["x"] and r["x"]["y"]) for r in df.collect()) == [(1, 1, 2.5), (1, 2, None), (2, 3, None)]
    assert df.rdd.getNumPartitions() == 2


def test_increments_start_after_the_last_page(spark, tmp_path):
    def add(run):
        for k in (1, 2) if run == 0 else (3,):
            page(tmp_path, k, [{"id": 10 * k}, {"id": 10 * k + 1}])

    out = in_two_runs(str(tmp_path / "work"), add, lambda: polls.read(spark, "f", "id int", True, root=str(tmp_path)))
    assert sorted((r["page"], r["id"]) for r in out.collect()) == [(1, 10), (1, 11), (2, 20), (2, 21), (3, 30), (3, 31)]


def test_the_number_of_pages_is_found_by_halving():
    for n in range(40):
        asked = []
        assert polls.last_page(lambda k: asked.append(k) or k <= n) == n and len(asked) <= 12  # noqa: B023


def test_an_unknown_scheme_is_named():
    with pytest.raises(RuntimeError, match="nowhere"):
        polls.file_system("nowhere://x/y")
    assert polls.file_system("file:///a/b")[1] == "/a/b" and polls.file_system("/a/b")[1] == "/a/b"


def test_prices_out_of_order_late_and_after_a_silence(spark, tmp_path):
    """Second run: one poll in between, one behind the watermark (left out); a silence of over ten hours starts anew; what the watermark has not passed stays."""
    first = [look(0, [("b", 2.0)]), look(60, [("b", 2.0)]), look(90, error="down"), look(120, [("b", 2.5)]), look(240)]
    second = [look(150, [("b", 2.0)]), look(200, [("c", 9.0)]), look(1000, [("b", 2.0)]), look(1100, [("b", 2.0)]), look(2000, [("b", 7.0)])]
    late = [look(30, [("b", 5.0)])]

    def add(run):
        folder = tmp_path / "in" / str(run)
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("".join(json.dumps(r) + "\n" for r in (first if run == 0 else late + second[::-1])))

    stream = lambda: ordered.stream_price_changes(spark.readStream.schema(folds.ODDS_POLL).json(str(tmp_path / "in" / "*")), "2 hours", "10 hours")
    got = {(r["bookmaker"], int((r["observed_at"] - T0).total_seconds() // 60), r["home"], r["since_previous_poll_seconds"], r["is_first_sighting"]) for r in in_two_runs(str(tmp_path / "work"), add, stream).collect()}
    assert got == {("b", 0, 2.0, None, True), ("b", 120, 2.5, 3600.0, False), ("b", 150, 2.0, 1800.0, False), ("c", 200, 9.0, 3000.0, True), ("b", 1000, 2.0, None, True)}


def test_elevens_of_a_feed(spark):
    def row(kind, team, player, name="n"):
        return {"type_id": kind, "team_id": team, "player_id": player, "player_name": name}

    full = [row(11, 7, k) for k in range(11)]  # player 0 is one
    fixtures = [{"id": 5, "lineups": full + [row(12, 7, 99)] + [row(11, 8, k) for k in range(10)]}, {"id": 0, "lineups": []}, {"id": 6, "lineups": [row(11, 9, None, f"p{k}") for k in range(11)] + [row(11, None, 3)]}, {"id": 7, "lineups": None}]
    df = spark.createDataFrame([(T0, None, fixtures), (T0, "down", None)], polls.LINEUP_FEED)
    good, bad = sorted(polls.lineup_polls(df, "s").collect(), key=lambda r: r["error"] is not None)
    assert [(x["match_key"], x["team"], len(x["players"])) for x in good["lineups"]] == [("5", "7", 11), ("6", "9", 11)]
    assert good["scope"] == ["5", "6", "7"] and bad["scope"] == [] and bad["lineups"] == []


def test_a_page_is_read_record_by_record(tmp_path):
    page(tmp_path, 1, [{"id": k, "x": "é" * 30} for k in range(50)])
    asked = []

    class Stream:
        def __init__(self):
            self.body = (tmp_path / "f" / "page=1" / "part-0.txt").read_bytes()

        def read(self, size):
            asked.append(size)
            out, self.body = self.body[:size], self.body[size:]
            return out

    read = polls.lines(Stream(), 64)
    assert json.loads(next(read)) == {"id": 0, "x": "é" * 30} and len(asked) < 8  # the rest is still to be read
    assert [json.loads(x)["id"] for x in read if x] == list(range(1, 50))
    rows = polls._Batch({"endpoint": "f", "root": str(tmp_path)}).read(polls._Page(1))
    assert iter(rows) is rows and [json.loads(text)["id"] for _, text in rows] == list(range(50))
    assert not isinstance(polls.saved_page("f", {"root": str(tmp_path)}, 1), str)
    with pytest.raises(ValueError):
        list(polls.texts(iter(["{"])))
    assert list(polls.texts('[{"a": 1}, 2]')) == ['{"a": 1}', "2"] and list(polls.texts('{"a": 1}')) == ['{"a": 1}']


def test_many_pages_are_few_tasks():
    from tallyfield.sources import api

    for n in (1, 2, api.TASKS, api.TASKS + 1, 54_000):
        runs = api._runs(n)
        assert len(runs) <= api.TASKS and [k for r in runs for k in range(r.first, r.last + 1)] == list(range(1, n + 1))
