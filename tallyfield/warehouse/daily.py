"""Event backtests day by day: what is known of a fixture is what was played on earlier days.

A strategy is a set of expressions over fixtures and their lookback: whether to bet, the stake,
the price and whether it won.  Lookback sums are running sums over days; the account is a running
sum of profits in order of day and fixture, days first, so neither a busy side nor a long
run is summed up bet by bet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Exact amounts while they are summed.
MONEY = "decimal(28,9)"


def appearances(fixtures: DataFrame, keys: Sequence[str], day: str, home: str, away: str, home_goals: str, away_goals: str) -> DataFrame:
    """keys, day, side, venue, scored and conceded: two rows a fixture."""
    one = lambda who, venue, f, a: F.struct(F.col(who).alias("side"), F.lit(venue).alias("venue"), F.col(f).alias("scored"), F.col(a).alias("conceded"))
    return fixtures.select(*keys, day, F.explode(F.array(one(home, "home", home_goals, away_goals), one(away, "away", away_goals, home_goals))).alias("_s")).select(*keys, day, "_s.*")


def lookback(rows: DataFrame, keys: Sequence[str], day: str, **sums: Column) -> DataFrame:
    """keys, day, n and the sums over the rows of strictly earlier days: a row for each day on which the keys have one."""
    days = rows.groupBy(*keys, day).agg(F.count("*").alias("_c"), *[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    return days.select(*keys, day, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("n"), *[F.sum(f"_{k}").over(before).alias(k) for k in sums])


def account(bets: DataFrame, by: Sequence[str], day: str, order: Sequence[str], initial: float = 1000.0, stop_at_negative: bool = True) -> DataFrame:
    """bets (stake, price, won) with profit and the bankroll after each; a run ends with the fixture that takes it below 0.

    Profits are rounded to nine decimals and summed exactly, so neither the order of sums nor a run's length moves its end.
    """
    won = F.coalesce(F.col("won"), F.lit(False))
    rows = bets.withColumn("profit", F.when(won, F.col("stake") * (F.col("price") - 1)).otherwise(-F.col("stake")).cast(MONEY))
    days = rows.groupBy(*by, day).agg(F.sum("profit").alias("_p"))
    opened = days.select(*by, day, (F.lit(initial).cast(MONEY) + F.coalesce(F.sum("_p").over(W.partitionBy(*by).orderBy(day).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(MONEY))).alias("_open"))
    within = F.sum("profit").over(W.partitionBy(*by, day).orderBy(*order))
    out = rows.withColumn("_in", within).join(opened, [*by, day]).withColumn("_left", F.col("_open") + F.col("_in")).drop("_open", "_in")
    plain = lambda df: df.withColumns({"profit": F.col("profit").cast("double"), "bankroll": F.col("_left").cast("double")}).drop("_left")
    if not stop_at_negative:
        return plain(out)
    place = F.struct(day, *order)
    broke = out.filter("_left < 0").groupBy(*by).agg(F.min(place).alias("_end")) if by else out.filter("_left < 0").agg(F.min(place).alias("_end"))
    joined = out.join(broke, list(by), "left") if by else out.crossJoin(F.broadcast(broke))  # one row
    return plain(joined.filter(F.col("_end").isNull() | (place <= F.col("_end"))).drop("_end"))


def results(history: DataFrame, by: Sequence[str], initial: float = 1000.0) -> DataFrame:
    """by, n_bets, n_won, won_percent, most, least, profit and roi of an account's history."""
    won = F.coalesce(F.col("won"), F.lit(False)).cast("long")
    profit = F.sum(F.col("profit").cast(MONEY)).cast("double").alias("profit")
    out = history.groupBy(*by).agg(F.count("*").alias("n_bets"), F.sum(won).alias("n_won"), F.max("bankroll").alias("most"), F.min("bankroll").alias("least"), profit)
    return out.select(*by, "n_bets", "n_won", (100 * F.col("n_won") / F.col("n_bets")).alias("won_percent"), "most", "least", "profit", (100 * F.col("profit") / initial).alias("roi"))
