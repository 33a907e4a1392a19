"""Fits over whole tables, held to their score equations: at a fit each side's goals are those expected of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import goal_fits
from tallyfield.plans.market_queries import LEAGUE, _league
from tallyfield.plans.registry import query
from tallyfield.warehouse import daily, models

#: Boundaries of the walk: Mondays of 33 weeks.
WEEKS = [dt.datetime(1997, 1, 6) + dt.timedelta(weeks=k) for k in range(33)]
HALF_LIFE = 365


def _close(df: DataFrame, *keys: str) -> DataFrame:
    """Goals, and what is left of the score equations to four decimals."""
    off = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("off_for", "off_against", "off_home", "off_rho")]
    return df.select(*keys, "team", F.round("goals_for", 6).alias("goals_for"), F.round("goals_against", 6).alias("goals_against"), *off)


SIDES = "s AS (SELECT league, h AS team, x AS f, y AS a, day FROM m JOIN (SELECT o_orderkey AS id, o_orderdate AS day FROM orders) USING (id) UNION ALL SELECT league, a, y, x, day FROM m JOIN (SELECT o_orderkey AS id, o_orderdate AS day FROM orders) USING (id))"


@query("goal_fit_scores", f"""WITH {LEAGUE}, {SIDES}
SELECT kind, league, CAST(team AS VARCHAR) AS team, CAST(sum(f) AS DOUBLE) AS goals_for, CAST(sum(a) AS DOUBLE) AS goals_against, 0::DOUBLE AS off_for, 0::DOUBLE AS off_against, 0::DOUBLE AS off_home, 0::DOUBLE AS off_rho
FROM s CROSS JOIN (SELECT unnest(['poisson', 'dixon_coles']) AS kind) GROUP BY kind, league, team""")
def goal_fit_scores(spark, d):
    """Poisson and Dixon-Coles fits of every league, and their score equations from the leagues' matches."""
    sums = goal_fits.pair_sums(_league(spark, d), ["league"])
    out = None
    for kind in goal_fits.KINDS:
        rows = goal_fits.score_residuals(sums, goal_fits.fit_sums(sums, ["league"], kind), ["league"]).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.union(rows)
    return _close(out, "kind", "league")


@query("walk_forward_scores", f"""WITH {LEAGUE}, {SIDES},
b AS (SELECT TIMESTAMP '1997-01-06' + k * INTERVAL 7 DAY AS trained_through FROM range(33) r(k))
SELECT trained_through, league, CAST(team AS VARCHAR) AS team, round(sum(f * pow(0.5, date_diff('day', day, trained_through) / {HALF_LIFE}::DOUBLE)), 6) AS goals_for, round(sum(a * pow(0.5, date_diff('day', day, trained_through) / {HALF_LIFE}::DOUBLE)), 6) AS goals_against,
  0::DOUBLE AS off_for, 0::DOUBLE AS off_against, 0::DOUBLE AS off_home, 0::DOUBLE AS off_rho
FROM s JOIN b ON day < trained_through GROUP BY trained_through, league, team""")
def walk_forward_scores(spark, d):
    """A Dixon-Coles fit of every league and week from results settled before it, weighted by age, and its score equations."""
    league = _league(spark, d).withColumns({"kickoff_utc": F.col("day").cast("timestamp"), "settled_at": F.col("day").cast("timestamp")})
    fits = models.walk_forward(league, WEEKS, ["league"], "dixon_coles", HALF_LIFE)
    slots = goal_fits.slot_sums(league, WEEKS, ["league"], HALF_LIFE, "kickoff_utc", "settled_at")
    sums = goal_fits.boundary_sums(slots, WEEKS, ["league"], HALF_LIFE)
    return _close(goal_fits.score_residuals(sums, fits, ["league", "trained_through"]), "trained_through", "league")


DAILY = f"""WITH {LEAGUE}, f AS (SELECT m.*, o_orderdate AS day FROM m JOIN orders ON o_orderkey = id),
s AS (SELECT league, day, h AS side, x AS scored FROM f UNION ALL SELECT league, day, a, y FROM f),
k AS (SELECT DISTINCT league, day, side, coalesce(sum(1) OVER w, 0) AS n, sum(scored) OVER w AS goals FROM s WINDOW w AS (PARTITION BY league, side ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
b AS (SELECT f.league, f.id, f.day, 10.0::DOUBLE AS stake, 1.5 + f.id % 30 / 10.0::DOUBLE AS price, x > y AS won FROM f JOIN k kh ON kh.league = f.league AND kh.day = f.day AND kh.side = f.h JOIN k ka ON ka.league = f.league AND ka.day = f.day AND ka.side = f.a
  WHERE kh.n >= 5 AND ka.n >= 5 AND kh.goals / kh.n > ka.goals / ka.n),
p AS (SELECT *, CAST(CASE WHEN won THEN stake * (price - 1) ELSE -stake END AS DECIMAL(28, 9)) AS profit FROM b),
r AS (SELECT *, 300 + sum(profit) OVER (PARTITION BY league ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS bankroll FROM p),
e AS (SELECT *, count(*) FILTER (bankroll < 0) OVER (PARTITION BY league ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broke FROM r)"""


def _daily(spark, d) -> DataFrame:
    league = _league(spark, d)
    shown = daily.lookback(daily.appearances(league, ["league"], "day", "home", "away", "home_goals", "away_goals"), ["league", "side"], "day", goals=F.col("scored"))
    of = lambda side: shown.select("league", "day", F.col("side").alias(side), F.col("n").alias(f"{side}_n"), (F.col("goals") / F.col("n")).alias(f"{side}_mean")).filter(F.col(f"{side}_n") >= 5)
    bets = league.join(of("home"), ["league", "day", "home"]).join(of("away"), ["league", "day", "away"]).filter("home_mean > away_mean")
    bets = bets.select("league", "id", "day", F.lit(10.0).alias("stake"), (1.5 + F.col("id") % 30 / F.lit(10.0)).alias("price"), (F.col("home_goals") > F.col("away_goals")).alias("won"))
    return daily.account(bets, ["league"], "day", ["id"], 300.0)


@query("daily_backtest", f"{DAILY} SELECT league, id, day, round(profit::DOUBLE, 6) AS profit, round(bankroll::DOUBLE, 6) AS bankroll FROM e WHERE broke = 0")
def daily_backtest(spark, d):
    """Ten on the side that has scored more so far, judged by earlier days only; a league stops when its bankroll is gone."""
    return _daily(spark, d).select("league", "id", "day", F.round("profit", 6).alias("profit"), F.round("bankroll", 6).alias("bankroll"))


@query("daily_backtest_results", f"{DAILY} SELECT league, count(*) AS n_bets, CAST(sum(won::INT) AS BIGINT) AS n_won, round(100.0 * sum(won::INT) / count(*), 6) AS won_percent, round(max(bankroll)::DOUBLE, 6) AS most, round(min(bankroll)::DOUBLE, 6) AS least, round(sum(profit)::DOUBLE, 6) AS profit, round(100 * sum(profit)::DOUBLE / 300, 6) AS roi FROM e WHERE broke = 0 GROUP BY league")
def daily_backtest_results(spark, d):
    out = daily.results(_daily(spark, d), ["league"], 300.0)
    return out.select("league", "n_bets", "n_won", *[F.round(c, 6).alias(c) for c in ("won_percent", "most", "least", "profit", "roi")])
