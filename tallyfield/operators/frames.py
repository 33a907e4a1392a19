"""Rolling order statistics: frames of many rows whose aggregates cannot be undone.

A group's rows are numbered and cut into blocks as long as the frame.  A block needs its own rows
and those of the block before it, so each row is sent twice and a block is at most two frames
of rows, whatever the group's size; hot groups are many blocks.  Within a block the frame
slides: one value comes into a sorted list and one goes, so the time is linear in rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


class _Frame:
    """The known values of a frame: in order, and by how often they stand in it."""

    def __init__(self):
        self.sorted: list[float] = []
        self.counts: Counter = Counter()

    def add(self, v: float) -> None:
        insort(self.sorted, v)
        self.counts[v] += 1

    def drop(self, v: float) -> None:
        del self.sorted[bisect_left(self.sorted, v)]
        self.counts[v] -= 1
        if not self.counts[v]:
            del self.counts[v]

    def quantile(self, p: float) -> float | None:
        if not self.sorted:
            return None
        at = p * (len(self.sorted) - 1)
        low, high = self.sorted[int(np.floor(at))], self.sorted[int(np.ceil(at))]
        return low + (at - np.floor(at)) * (high - low)


AGGREGATES: dict[str, Callable[[_Frame], float | None]] = {
    "median": lambda f: f.quantile(0.5),
    "iqr": lambda f: f.quantile(0.75) - f.quantile(0.25) if f.sorted else None,
    "range": lambda f: f.sorted[-1] - f.sorted[0] if f.sorted else None,
    "min": lambda f: f.sorted[0] if f.sorted else None,
    "max": lambda f: f.sorted[-1] if f.sorted else None,
    "nunique": lambda f: float(len(f.counts)),
    "count": lambda f: float(len(f.sorted)),
}


def _of(how: str | float) -> Callable[[_Frame], float | None]:
    if isinstance(how, str):
        if how not in AGGREGATES:
            raise ValueError(f"one of {', '.join(AGGREGATES)}, or a probability")
        return AGGREGATES[how]
    if not 0 <= how <= 1:
        raise ValueError("a probability lies between 0 and 1")
    return lambda f: f.quantile(how)


def rolling_order(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, rows: int, **aggregates: str | float) -> DataFrame:
    """df with a column for each aggregate of `value` over the last `rows` rows of the group, the row itself included; order tells rows of a group apart.  Nulls and NaN are not counted."""
    if rows < 1:
        raise ValueError("a frame has a row at least")
    ways = {name: _of(how) for name, how in aggregates.items()}
    body = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    numbered = df.select(*[F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(by)], body.alias("_row"), F.col(f"`{value}`").cast("double").alias("_v"), (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).alias("_n"))
    keys = [f"_g{k}" for k in range(len(by))]
    block = F.floor(F.col("_n") / rows).cast("long")
    sent = numbered.withColumn("_to", F.explode(F.array(F.lit(0), F.lit(1)))).select(*keys, (block + F.col("_to")).alias("_block"), F.when(F.col("_to") == 0, F.col("_row")).alias("_row"), "_v", "_n", (F.col("_to") == 1).alias("_before"))
    schema = T.StructType([sent.schema["_row"], *[T.StructField(n, T.DoubleType()) for n in ways]])

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        values, own = pdf["_v"].to_numpy(float), ~pdf["_before"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=["_row", *ways])
        frame, first, out = _Frame(), int(np.argmax(own)), {n: [] for n in ways}
        for k, v in enumerate(values):
            if v == v:
                frame.add(v)
            if k >= rows and values[k - rows] == values[k - rows]:
                frame.drop(values[k - rows])
            if k >= first:
                for name, way in ways.items():
                    out[name].append(way(frame))
        return pd.DataFrame({"_row": pdf["_row"][own].tolist(), **{n: pd.array(x, "Float64") for n, x in out.items()}})

    return sent.groupBy(*keys, "_block").applyInPandas(slide, schema).select("_row.*", *ways)
