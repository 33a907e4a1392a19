"""Operators for hot keys against plain versions: spans, quantiles, permutations, diagnostics."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import diagnostics
from tallyfield.operators.joins import interval_join, span_join
from tallyfield.operators.quantiles import exact_quantiles
from tallyfield.warehouse import research

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spans_of_all_lengths(spark, how):
    pick = random.Random(2)
    spans = [(i, pick.choice(["a", "b", None]), s := pick.choice([None, pick.randrange(2000)]), None if s is None else s + pick.choice([0, 1, 2, 64, 700, 10**6, -5])) for i in range(120)]
    spans += [spans[0], spans[0]]  # repeated rows
    points = [(k, pick.choice(["a", "b", None]), pick.choice([None, pick.randrange(2100)])) for k in range(150)] + [(999, "a", 64)]
    left = spark.createDataFrame([(i, k, at(s), at(e)) for i, k, s, e in spans], "id int, k string, s timestamp, e timestamp")
    right = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "id int, k string, t timestamp")
    got = sorted((r["id"], r["right_id"] or -1) for r in span_join(left, right, "k", "s", "e", "t", how=how).collect())
    want = []
    for i, k, s, e in spans:
        hits = [p for p, k2, t in points if k is not None and k == k2 and None not in (s, e, t) and s <= t <= e]
        want += [(i, p or -1) for p in hits] or ([(i, -1)] if how == "left" else [])
    assert got == sorted(want)


def test_an_interval_join_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(500)), (2, "a", at(500)), (3, None, at(0)), (4, "a", None)], "id int, k string, t timestamp")
    right = spark.createDataFrame([("a", at(5), 7), ("a", at(8), 8)], "k string, t timestamp, v int")
    got = interval_join(left, right, "k", "t", "t", 60, 600, how="left")
    assert sorted((r["id"], r["right_v"] or 0) for r in got.collect()) == [(1, 7), (1, 8), (2, 0), (2, 0), (3, 0), (4, 0)]


def test_quantiles_of_hot_and_odd_groups(spark):
    rows = [("hot", float(k * 7919 % 1009)) for k in range(3000)] + [("tie", 5.0)] * 40 + [("one", -1.5)] + [(None, float(k)) for k in range(10)] + [("none", None), ("hot", None), ("hot", float("nan"))]
    probs = [0, 0.1, 0.5, 0.77, 1]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None and v == v] for g in {g for g, _ in rows}}
    want = {(g, float(p)): float(np.quantile(v, p)) for g, v in groups.items() if v for p in probs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    whole = {r["prob"]: r["quantile"] for r in exact_quantiles(df, [], "v", [0.5]).collect()}
    assert abs(whole[0.5] - np.median([v for _, v in rows if v is not None and v == v])) < 1e-9
    assert exact_quantiles(df.limit(0), ["g"], "v", probs).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "v", [1.5])


def test_permutations_keep_group_sizes():
    totals, sizes = np.array([5, 0, 9, 14, 3, 2, 7]), np.array([11, 20, 9])
    parts = np.stack([research._share(3, b, totals, sizes, 200) for b in range(len(totals))])
    assert (parts.sum(2).T == totals).all() and (parts.sum(0) == sizes).all() and (parts >= 0).all()
    assert abs(parts[3].mean(0) - 14 * sizes / 40).max() < 0.5


def test_p_value_against_all_permutations(spark):
    values, groups = [1.0, 2.0, 2.0, 4.0, 5.0, 7.0, 7.0, 9.0], list("aaabbbbb")

    def spread(order):
        means = [np.mean([v for v, g in zip(order, groups, strict=True) if g == x]) for x in "ab"]
        n, grand = [3, 5], np.mean(order)
        return sum(k * (m - grand) ** 2 for k, m in zip(n, means, strict=True)) / 8

    observed = spread(values)
    picks = list(itertools.combinations(range(8), 3))
    exact = np.mean([spread([values[i] for i in pick] + [values[i] for i in range(8) if i not in pick]) >= observed - 1e-12 for pick in picks])
    df = spark.createDataFrame(list(zip(groups, values, strict=True)), "g string, v double")
    r = research.permutation_test(df, "g", "v", 4000).first()
    assert abs(r["observed"] - observed) < 1e-9 and abs(r["p_value"] - exact) < 4 * (exact * (1 - exact) / 4000) ** 0.5 + 1 / 4000


def test_diagnostics_against_arrays(spark):
    rng = np.random.default_rng(5)
    chains = np.zeros((3, 160))
    for t in range(1, 160):
        chains[:, t] = 0.7 * chains[:, t - 1] + rng.normal(0, 1, 3)
    chains[2] += 0.4
    rows = [("p", c, t, float(chains[c, t])) for c in range(3) for t in range(160)] + [("flat", c, t, 1.0) for c in range(2) for t in range(8)] + [("alone", 0, t, float(t % 3)) for t in range(9)]
    df = spark.createDataFrame(rows, "parameter string, chain int, draw int, value double")

    def scale(x):
        n = x.shape[1]
        return np.sqrt(((n - 1) / n * x.var(1, ddof=1).mean() + x.mean(1).var(ddof=1)) / x.var(1, ddof=1).mean())

    got = {r["parameter"]: r["r_hat"] for r in diagnostics.r_hat(df).collect()}
    assert abs(got["p"] - scale(chains)) < 1e-9 and got["flat"] is None and got["alone"] is None
    half = {r["parameter"]: r["r_hat"] for r in diagnostics.r_hat(df, burn=20, thin=2, split=True).collect()}
    kept = chains[:, 20::2]
    assert abs(half["p"] - scale(np.concatenate([kept[:, :35], kept[:, 35:]]))) < 1e-9

    centred = chains - chains.mean(1, keepdims=True)
    rho = [np.mean([(x[: 160 - k] * x[k:]).sum() / (x * x).sum() for x in centred]) for k in range(161)]
    cut = next(k for k in range(1, 160) if rho[k] < 0.05)
    r = next(r for r in diagnostics.effective_size(df, most=50).collect() if r["parameter"] == "p")
    assert r["cutoff"] == cut and abs(r["ess"] - 480 / (1 + 2 * sum(rho[1:cut]))) < 1e-6


def test_the_left_side_is_not_numbered(spark):
    plan = span_join(spark.createDataFrame([(1, "a", at(0), at(9))], "id int, k string, s timestamp, e timestamp"), spark.createDataFrame([("a", at(1))], "k string, t timestamp"), "k", "s", "e", "t", how="left").select(F.count("*"))._jdf.queryExecution().toString()
    assert "monotonically" not in plan and "CartesianProduct" not in plan


def test_rolling_order_statistics(spark):
    from tallyfield.operators.frames import rolling_order

    pick = random.Random(6)
    rows = [(g, k, pick.choice([None, float("nan"), float(pick.randrange(12)), pick.random()]), "x") for g, n in (("a", 95), ("b", 3), (None, 20)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v double, _v string").repartition(3)
    for size in (1, 7, 200):
        got = {(r["g"], r["k"]): r for r in rolling_order(df, ["g"], ["k"], "v", size, middle="median", p=0.2, n="count", u="nunique", w="range").collect()}
        assert len(got) == len(rows)
        for g, k, _, _ in rows:
            frame = [v for h, j, v, _ in rows if h == g and k - size < j <= k and v is not None and v == v]
            r = got[g, k]
            assert (r["n"], r["u"], r["_v"]) == (len(frame), len(set(frame)), "x")
            want = (np.median(frame), np.quantile(frame, 0.2), max(frame) - min(frame)) if frame else (None, None, None)
            assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip((r["middle"], r["p"], r["w"]), want, strict=True))
    assert rolling_order(df.limit(0), ["g"], ["k"], "v", 5, m="median").collect() == []
    for bad in ("mean", 1.5):
        with pytest.raises(ValueError):
            rolling_order(df, ["g"], ["k"], "v", 5, m=bad)


def test_merged_aggregates(spark):
    from tallyfield.operators.merged import merge_aggregate

    rows = [(g, k, v) for g, k, v in itertools.product(["a", "b", None], [1, None], range(40)) if not (g == "b" and k is None)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(7)
    bits = lambda s, rows: (s or 0) | sum(1 << int(v) for v in set(rows["v"]))
    got = {(r["g"], None if r["k"] is None else int(r["k"])): r["mask"] for r in merge_aggregate(df, ["g", "k"], ["v"], "mask", "long", bits, lambda a, b: a | b, lambda s: s).collect()}
    assert got == {(g, k): (1 << 40) - 1 for g, k in {(g, k) for g, k, _ in rows}}
    (whole,) = merge_aggregate(df, [], ["v"], "n", "long", lambda s, rows: (s or 0) + len(rows), lambda a, b: a + b, lambda s: s).collect()
    assert whole["n"] == len(rows)
    assert merge_aggregate(df.limit(0), ["g"], ["v"], "n", "long", bits, max, int).collect() == []


def test_a_group_is_added_once_a_batch(spark):
    from tallyfield.operators.merged import merge_aggregate

    df = spark.range(20_000).select((F.col("id") % 500).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v")).repartition(7)
    out = merge_aggregate(df, ["g"], ["v"], "x", "struct<calls: long, n: long>", lambda s, rows: (s[0] + 1, s[1] + len(rows)) if s else (1, len(rows)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: {"calls": s[0], "n": s[1]}).collect()
    assert sorted((r["g"], r["x"]["n"]) for r in out) == [(g, 40) for g in range(500)]
    assert sum(r["x"]["calls"] for r in out) < 2 * 500  # rows lie in seven parts: it was 3,500 or more


@pytest.mark.parametrize("cell_seconds", [1.0, 60.0, 7.5])
def test_summaries_of_spans(spark, cell_seconds):
    from tallyfield.operators.joins import span_summary

    pick = random.Random(5)
    micros = lambda x: None if x is None else T0 + dt.timedelta(microseconds=x)
    spans = []
    for i in range(300):
        s = pick.choice([None, pick.randrange(3 * 10**9), 60_000_000 * pick.randrange(50)])
        spans.append((i, pick.choice(["a", "b", None]), s, None if s is None else s + pick.choice([0, 1, 999_999, 10**6, 60_000_000 - 1, 60_000_000, pick.randrange(4 * 10**9), 10**13, -5])))
    points = [(k, pick.choice(["a", "b", None]), pick.choice([None, pick.randrange(3 * 10**9), 60_000_000 * pick.randrange(60)])) for k in range(400)] + [(None, "a", 64)]
    left = spark.createDataFrame([(i, k, micros(s), micros(e)) for i, k, s, e in spans], "id int, k string, s timestamp, e timestamp")
    right = spark.createDataFrame([(i, k, micros(t)) for i, k, t in points], "v int, k string, t timestamp")
    got = {r["id"]: (r["n"], r["least"], r["most"]) for r in span_summary(left, right, "k", "s", "e", "t", "id", "v", cell_seconds).collect()}
    for i, k, s, e in spans:
        hits = [p for p, k2, t in points if p is not None and k is not None and k == k2 and None not in (s, e, t) and s <= t <= e]
        assert got[i] == (len(hits), min(hits, default=None), max(hits, default=None))
    assert len(got) == len(spans)


def test_lags_do_not_multiply_what_is_shuffled(spark, monkeypatch):
    """Chains with gaps and repeated draws over several blocks, as plain pairs; sixteen times the lags are not twice the bytes."""
    monkeypatch.setattr(diagnostics, "BLOCK", 32, raising=False)
    pick = random.Random(6)
    draws = [("p", c, t, pick.gauss(0, 1)) for c in range(2) for t in range(300) if t % 7 or c] + [("p", 0, 33, 0.5), ("p", 0, 33, 0.7)]
    df = spark.createDataFrame(draws, "parameter string, chain int, draw int, value double")
    got = {r["lag"]: r["rho"] for r in diagnostics.autocorrelations(df, most=40).collect()}
    means = {c: np.mean([v for _, k, _, v in draws if k == c]) for c in range(2)}
    sums = {}
    for (_, c, t, v), (_, k, u, w) in itertools.product(draws, draws):
        if c == k and 0 <= u - t <= 40:
            sums[c, u - t] = sums.get((c, u - t), 0.0) + (v - means[c]) * (w - means[c])
    assert got == pytest.approx({lag: np.mean([sums[c, lag] / sums[c, 0] for c in range(2)]) for lag in range(41)})
    monkeypatch.setattr(diagnostics, "BLOCK", 1024, raising=False)
    long = spark.range(20000).select(F.lit("p").alias("parameter"), F.lit(1).alias("chain"), F.col("id").alias("draw"), F.rand(3).alias("value"))
    context, sizes = spark.sparkContext._jsc.sc(), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (5, 80):
            context.listenerBus().waitUntilEmpty()
            before = context.statusStore().executorSummary("driver").totalShuffleWrite()
            assert diagnostics.autocorrelations(long, most=most).count() == most + 1
            context.listenerBus().waitUntilEmpty()
            sizes.append(context.statusStore().executorSummary("driver").totalShuffleWrite() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sizes[1] < 2 * sizes[0]
