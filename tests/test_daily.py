"""Daily backtests against a loop over days."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyfield.warehouse import daily

DAY = dt.date(2024, 1, 1)


def made(seed=3, n=200):
    pick = random.Random(seed)
    return [(pick.choice("AB"), k, DAY + dt.timedelta(days=pick.randrange(40)), f"t{pick.randrange(4)}", f"t{pick.randrange(4, 8)}", pick.randrange(4), pick.randrange(3)) for k in range(n)]


def test_against_a_loop(spark):
    rows = made()
    df = spark.createDataFrame(rows, "run string, id int, day date, home string, away string, hg int, ag int")
    seen = daily.lookback(daily.appearances(df, ["run"], "day", "home", "away", "hg", "ag"), ["run", "side"], "day", scored=F.col("scored"), conceded=F.when(F.col("venue") == "home", F.col("conceded")))
    got = {(r["run"], r["side"], r["day"]): (r["n"], r["scored"], r["conceded"]) for r in seen.collect()}
    for run, _, day, home, away, _, _ in rows:
        for side in (home, away):
            known = [(hg, ag) if h == side else (ag, None) for r, _, d, h, a, hg, ag in rows if r == run and d < day and side in (h, a)]
            conceded = [c for _, c in known if c is not None]
            assert got[run, side, day] == (len(known), sum(s for s, _ in known) if known else None, sum(conceded) if conceded else None)
    bets = df.select("run", "id", "day", F.lit(20.0).alias("stake"), (1.2 + F.col("id") % 7 / F.lit(4.0)).alias("price"), F.when(F.col("id") % 11 > 0, F.col("hg") > F.col("ag")).alias("won"))
    for stop in (True, False):
        out = {(r["run"], r["id"]): r["bankroll"] for r in daily.account(bets, ["run"], "day", ["id"], 60.0, stop).collect()}
        want = {}
        for run in "AB":
            bankroll = 60.0
            for _, k, _, _, _, hg, ag in sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1])):
                won = k % 11 > 0 and hg > ag
                bankroll += 20 * (1.2 + k % 7 / 4 - 1) if won else -20
                want[run, k] = bankroll
                if stop and bankroll < -1e-9:
                    break
        assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 1e-9 for k in want)


def test_results_and_no_bets(spark):
    bets = spark.createDataFrame([(1, DAY, 10.0, 3.0, True), (2, DAY, 10.0, 3.0, None)], "id int, day date, stake double, price double, won boolean")
    (r,) = daily.results(daily.account(bets, [], "day", ["id"], 100.0), [], 100.0).collect()
    assert (r["n_bets"], r["n_won"], r["won_percent"], r["most"], r["least"], r["profit"], r["roi"]) == (2, 1, 50.0, 120.0, 110.0, 10.0, 10.0)
    assert daily.account(bets.limit(0), [], "day", ["id"]).collect() == []


def test_a_bankroll_of_exactly_nothing_goes_on(spark):
    bets = [(0, DAY, 1e7, 2.0, False)] + [(k, DAY + dt.timedelta(days=k), 0.3, 2.0, False) for k in range(1, 11)] + [(11, DAY + dt.timedelta(days=11), 1.0, 2.0, True)]
    df = spark.createDataFrame(bets, "id int, day date, stake double, price double, won boolean")
    out = sorted((r["id"], r["bankroll"]) for r in daily.account(df, [], "day", ["id"], 1e7 + 3).collect())
    assert out[-2:] == [(10, 0.0), (11, 1.0)]  # sums of doubles are below 0 after ten times 0.3
