"""Capital: fitting a cohort's stakes into what may be staked, and drawdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POLICIES = ("reject", "pro_rata", "truncate")


def cents(value: Column) -> Column:
    """Money rounded down to cents, as an exact decimal."""
    exact = value.cast("decimal(28,10)")
    return (F.floor(exact * 100).cast("decimal(28,2)") / F.lit(100)).cast("decimal(18,2)")


def constrain(requests: DataFrame, cohort: Sequence[str], stake: str, available: str, policy: str = "pro_rata", rank: Column | None = None, tie: str | None = None) -> DataFrame:
    """requests with `granted` and `constrained`: a cohort within its capital gets what it asks for.

    Beyond it: reject grants nothing, pro_rata scales all stakes, truncate fills them by rank
    (the highest first, the last one in part).
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    ask, have = F.col(stake).cast("decimal(28,10)"), F.col(available).cast("decimal(28,10)")
    whole = W.partitionBy(*cohort)
    total = F.sum(ask).over(whole)
    fits = total <= have
    if policy == "reject":
        beyond = F.lit(0).cast("decimal(18,2)")
    elif policy == "pro_rata":
        small = lambda x: F.round(x * 100, 0).cast("decimal(18,0)")  # noqa: E731  whole cents
        part, all_ = small(cents(ask)) * small(have), F.nullif(small(total), F.lit(0).cast("decimal(18,0)"))
        beyond = (((part - part % all_) / all_).cast("decimal(18,0)").cast("decimal(20,2)") / 100).cast("decimal(18,2)")  # the quotient is whole
    else:
        if rank is None:
            raise ValueError("truncate needs a rank")
        before = F.coalesce(F.sum(ask).over(whole.orderBy(rank.desc(), *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        beyond = cents(F.greatest(F.lit(0).cast("decimal(28,10)"), F.least(ask, have - before)))
    return requests.withColumns({"granted": F.when(fits, cents(ask)).otherwise(beyond), "constrained": ~fits})


def drawdown(curve: DataFrame, by: Sequence[str], order: Sequence[str], equity: str = "equity") -> DataFrame:
    """curve with the running peak and the share lost since."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = curve.withColumn("peak", F.max(equity).over(w))
    return out.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col(equity)) / F.col("peak")).otherwise(0.0))
