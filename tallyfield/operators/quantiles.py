"""Exact order statistics of groups of any size.

Equal values are counted first.  The counts are dealt by ranges of (group, value) into more parts
than tasks; a part's total says which ranks it holds, so only the parts in which a wanted rank
falls are summed up value by value, each by itself.  A group with most of the rows is many parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfield.shared import written

#: Ranges for each shuffle partition.
RANGES = 4


def order_statistics(cells: DataFrame, by: Sequence[str], value: str, count: str, wanted: DataFrame, rank: str) -> DataFrame:
    """wanted (by, rank from 1) with `value`: the rank-th smallest of its group, from distinct values and their counts."""
    spark = cells.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(cells.select(*by, F.col(value).alias("_v"), F.col(count).alias("_c")).repartitionByRange(parts, *by, "_v").withColumn("_part", F.spark_partition_id()))
    spans = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_in"))
    before = F.sum("_in").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_before", F.coalesce(before, F.lit(0)))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in by]
    ranks = wanted.select(*by, F.col(rank).alias("_rank")).distinct()
    held = spans.join(ranks, [*same(spans, ranks), F.col("_rank") > F.col("_before"), F.col("_rank") <= F.col("_before") + F.col("_in")]) if by else spans.join(ranks, (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
    held = held.select(*[spans[k] for k in by], "_part", "_before", "_rank")
    upto = dealt.withColumn("_upto", F.sum("_c").over(W.partitionBy("_part", *by).orderBy("_v")))
    near = upto.join(held, [*same(upto, held), upto["_part"] == held["_part"], F.col("_upto") + F.col("_before") >= F.col("_rank")])
    found = near.groupBy(*[upto[k] for k in by], "_rank").agg(F.min("_v").alias(value))
    return wanted.join(found, [*same(wanted, found), wanted[rank] == found["_rank"]], "left").select(*[wanted[c] for c in wanted.columns], value)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """by, prob and quantile: between the two nearest order statistics, as `percentile` gives it; nulls and NaN are left out."""
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).filter(~F.isnan("_v"))
    cells = written(known.groupBy(*by, "_v").agg(F.count("*").alias("_c")))
    sizes = cells.groupBy(*by).agg(F.sum("_c").alias("_n"))
    asked = sizes.select(*by, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    place = F.col("prob") * (F.col("_n") - 1)
    asked = written(asked.filter("_n > 0").select(*by, "prob", (place - F.floor(place)).alias("_part_of"), (F.floor(place) + 1).cast("long").alias("_low"), (F.ceil(place) + 1).cast("long").alias("_high")))
    ranks = asked.select(*by, "_low").union(asked.select(*by, "_high")).distinct().toDF(*by, "_at")
    found = order_statistics(cells, by, "_v", "_c", ranks, "_at")
    low, high = found.toDF(*[f"_l{k}" for k in range(len(by))], "_la", "_lv"), found.toDF(*[f"_h{k}" for k in range(len(by))], "_ha", "_hv")
    out = asked.join(low, [*[F.col(c).eqNullSafe(F.col(f"_l{k}")) for k, c in enumerate(by)], F.col("_low") == F.col("_la")])
    out = out.join(high, [*[F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(by)], F.col("_high") == F.col("_ha")])
    return out.select(*by, "prob", (F.col("_lv") + F.col("_part_of") * (F.col("_hv") - F.col("_lv"))).alias("quantile"))
