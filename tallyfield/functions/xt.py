"""Expected threat: the chance of a goal before the ball is lost, by pitch cell.

Counts by cell are Spark aggregates; what comes to the driver is at most cells x cells
numbers a family, where a linear system gives the surface.  Scoring looks the surface up in
a literal array, so it is a projection without a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types of moves by family, and of shots.
MOVES = {"pass": "pass", "carry": "carry", "throw_in": "set_piece", "goal_kick": "set_piece", "corner": "set_piece", "free_kick": "set_piece"}
SHOTS = ("shot", "free_kick_shot")


def scaled(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """A coordinate of a range as 0 to 100, clipped."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (value.cast("double") - low) / (high - low) * 100))


def cell(x: Column, y: Column, columns: int = 16, rows: int = 12) -> Column:
    """Number of the cell of a point with coordinates 0 to 100; null without both."""
    place = lambda v, n: F.least(F.floor(scaled(v) * n / 100), F.lit(n - 1))
    return (place(y, rows) * columns + place(x, columns)).cast("int")


@dataclass(frozen=True)
class Surface:
    """Threat of each cell, row by row."""

    values: tuple[float, ...]
    columns: int = 16
    rows: int = 12

    def at(self, x: Column, y: Column) -> Column:
        return F.try_element_at(F.lit(list(self.values)), cell(x, y, self.columns, self.rows) + 1)

    def value_at(self, x: float, y: float) -> float:
        place = lambda v, n: min(int(min(max(v, 0.0), 100.0) * n / 100), n - 1)
        return self.values[place(y, self.rows) * self.columns + place(x, self.columns)]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.values)], "cell int, xt double")


def fit(events: DataFrame, columns: int = 16, rows: int = 12, shrink: float = 5.0) -> Surface:
    """Fit on rows (x, y, end_x, end_y, event_type, is_success).

    Goal chances are smoothed by one goal and one miss a cell.  Each family's transitions are
    drawn to the pooled ones with a weight of `shrink` moves and mixed by the family's share
    of the cell's moves.  Failed moves take their share without going anywhere.
    """
    n = columns * rows
    start, end = cell(F.col("x"), F.col("y"), columns, rows), cell(F.col("end_x"), F.col("end_y"), columns, rows)
    family = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in MOVES.items()])
    done = F.coalesce(F.col("is_success").cast("boolean"), F.lit(False))
    e = events.select(start.alias("c"), end.alias("d"), family.alias("f"), done.alias("ok"), F.col("event_type").isin(*SHOTS).alias("shot")).filter("c IS NOT NULL")
    if e.filter("f IS NOT NULL AND ok AND d IS NULL").limit(1).count():
        raise ValueError("a successful move has no end")
    shots = e.filter("shot").groupBy("c").agg(F.count("*").alias("n"), F.count_if("ok").alias("goals")).collect()
    moves = e.filter("f IS NOT NULL").groupBy("f", "c").agg(F.count("*").alias("n")).collect()
    steps = e.filter("f IS NOT NULL AND ok").groupBy("f", "c", "d").agg(F.count("*").alias("n")).collect()
    if not shots and not steps:
        raise ValueError("no events to fit a surface on")
    shot, goal = np.zeros(n), np.zeros(n)
    for r in shots:
        shot[r["c"]], goal[r["c"]] = r["n"], r["goals"]
    families = sorted({r["f"] for r in moves})
    tried = {f: np.zeros(n) for f in families}
    moved = {f: np.zeros((n, n)) for f in families}
    for r in moves:
        tried[r["f"]][r["c"]] = r["n"]
    for r in steps:
        moved[r["f"]][r["c"], r["d"]] = r["n"]
    total = shot + sum(tried.values(), np.zeros(n))
    some = np.maximum(total, 1)
    pooled = _shares(sum(moved.values(), np.zeros((n, n))))
    carry = np.zeros((n, n))
    for f in families:
        own = _shares(moved[f] + shrink * pooled)
        carry += (moved[f].sum(1) / some)[:, None] * own
    gain = shot / some * (goal + 1) / (shot + 2)
    surface = np.linalg.solve(np.eye(n) - carry, gain)
    return Surface(tuple(float(v) for v in surface), columns, rows)


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)


def score(events: DataFrame, surface: Surface) -> DataFrame:
    """events with xt_start (all moves), xt_end and xt_added (successful ones)."""
    move = F.col("event_type").isin(*MOVES)
    ends = move & F.coalesce(F.col("is_success").cast("boolean"), F.lit(False))
    out = events.withColumns({"xt_start": F.when(move, surface.at(F.col("x"), F.col("y"))), "xt_end": F.when(ends, surface.at(F.col("end_x"), F.col("end_y")))})
    return out.withColumn("xt_added", F.col("xt_end") - F.col("xt_start"))


def histogram(points: DataFrame, x: str = "x", y: str = "y", columns: int = 16, rows: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Counts by cell: the data of a pitch heat map."""
    return points.withColumn("cell", cell(F.col(x), F.col(y), columns, rows)).filter("cell IS NOT NULL").groupBy(*by, "cell").agg(F.count("*").alias("n"))
