"""Quantile summaries against exact order statistics."""

from __future__ import annotations

import zlib
from collections import defaultdict
from math import floor

import pytest

from tallyfield.llm import quantile_summaries as qs


def exact(rows):
    """(stream, grp, batch) -> sorted x, the whole as batch -1."""
    out = defaultdict(list)
    for stream, grp, key, money in rows:
        if grp is None or money is None:
            continue
        batch = zlib.crc32(("" if key is None else str(key)).encode()) % qs.BATCHES
        x = floor(100 * money + 0.5) + 1000 * batch
        out[stream, grp, batch].append(x)
        out[stream, grp, qs.WHOLE].append(x)
    return {k: sorted(v) for k, v in out.items()}


def check(got, groups):
    want = {(*k, i) for k, v in groups.items() if len(v) >= qs.MIN_ROWS for i in range(1, qs.PARTS)}
    assert {(r["stream"], r["grp"], r["batch"], r["i"]) for r in got} == want and len(got) == len(want)
    last = {}
    for r in sorted(got, key=lambda r: (r["stream"], r["grp"], r["batch"], r["i"])):
        x = groups[r["stream"], r["grp"], r["batch"]]
        target = -(-r["i"] * len(x) // qs.PARTS)
        below, upto = sum(v < r["answer"] for v in x), sum(v <= r["answer"] for v in x)
        assert (r["n"], r["target"], r["exact_x"], r["n_below"], r["n_upto"]) == (len(x), target, x[target - 1], below, upto)
        assert r["rank_error"] == max(0, below + 1 - target, target - upto) and r["within"] == (1000 * r["rank_error"] <= qs.ERROR * len(x))
        assert min(10, len(set(x))) <= r["points"] <= min(len(x), 1000)
        assert x[0] <= r["answer"] <= x[-1] and r["answer"] >= last.get((r["stream"], r["grp"], r["batch"]), r["answer"])
        last[r["stream"], r["grp"], r["batch"]] = r["answer"]
        if len(x) <= qs.K:  # nothing was compacted
            assert r["rank_error"] == 0 and r["answer"] == r["exact_x"]
        assert r["within"]


def test_given_tables(spark, data):
    clicks = {r["click_id"]: r for r in spark.read.parquet(f"{data}/clicks.parquet").select("click_id", "client_id", "value").collect()}
    items = {r["item_id"]: r for r in spark.read.parquet(f"{data}/items.parquet").collect()}
    rows = [("value", None if r["client_id"] is None else str(r["client_id"]), r["click_id"], r["value"]) for r in clicks.values()]
    for r in spark.read.parquet(f"{data}/sale_lines.parquet").select("item_id", "vendor_id").collect():
        if item := items.get(r["item_id"]):
            rows.append(("price", item["brand"], r["vendor_id"], item["price"]))
    check(qs.op12_quantile_summaries(spark, data).collect(), exact(rows))


@pytest.fixture(scope="module")
def odd():
    """A group with most rows, ties, negative and huge money, null ids, groups too small to answer."""
    rows = [("value", "hot", k, float(k * 7919 % 5003) / 7) for k in range(6000)]
    rows += [("value", "tie", k, 1.0) for k in range(50)] + [("value", "low", k, -k / 3) for k in range(90)] + [("value", "big", k, 1e12 + k) for k in range(40)]
    rows += [("price", "hot", None, 2.5)] * 30 + [("price", "few", 1, 3.0)] * 19 + [("price", None, 1, 3.0), ("price", "hot", 1, None)]
    return rows


def test_odd_rows(spark, odd):
    df = spark.createDataFrame(odd, "stream string, grp string, id long, money double")
    sketches, cells = qs.summarised(df)
    out = qs.ranked(cells, qs.answers(sketches))
    error = out.selectExpr("*", "greatest(0L, n_below + 1 - target, target - n_upto) AS rank_error").selectExpr("*", f"1000 * rank_error <= {qs.ERROR} * n AS within")
    check(error.collect(), exact(odd))


def test_an_empty_table(spark):
    sketches, cells = qs.summarised(spark.createDataFrame([], "stream string, grp string, id long, money double"))
    assert qs.ranked(cells, qs.answers(sketches)).collect() == []


def test_the_whole_reads_summaries_only(spark, odd):
    sketches, _ = qs.summarised(spark.createDataFrame(odd, "stream string, grp string, id long, money double"))
    n = {(r["stream"], r["grp"], r["batch"]): r["n"] for r in sketches.selectExpr("stream", "grp", "batch", "kll_sketch_get_n_bigint(sketch) AS n").collect()}
    for (stream, grp, batch), total in n.items():
        if batch == qs.WHOLE:
            assert total == sum(v for k, v in n.items() if k[:2] == (stream, grp) and k[2] != qs.WHOLE)


def test_points_stay_bounded():
    """Capacities of the levels of a sketch of 1e13 rows."""
    levels, size = 40, 0
    for depth in range(levels):
        size += max(8, round(qs.K * (2 / 3) ** depth))
    assert qs.K * 2 ** (levels - 2) > 1e13 and size < 1000
