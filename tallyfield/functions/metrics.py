"""Scoring rules of probability forecasts over arrays, and aggregates of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-15


def _checked(probs: Column, outcome: Column, value: Column) -> Column:
    bad = outcome.isNull() | (outcome < 0) | (outcome >= F.size(probs))
    return F.when(bad, F.raise_error(F.lit("the outcome is no place of the probabilities")).cast("double")).otherwise(value)


def brier(probs: Column, outcome: Column) -> Column:
    """Sum of squared differences over the classes; outcome is a place from 0."""
    hit = F.transform(probs, lambda p, i: F.pow(p - F.when(i == outcome, 1.0).otherwise(0.0), F.lit(2.0)))
    return _checked(probs, outcome, F.aggregate(hit, F.lit(0.0), lambda a, x: a + x))


def ignorance(probs: Column, outcome: Column) -> Column:
    """Minus the base-2 log of the probability of what came."""
    return _checked(probs, outcome, -F.log2(F.greatest(F.try_element_at(probs, outcome.cast("int") + 1), F.lit(EPSILON))))


def log_loss(probs: Column, outcome: Column) -> Column:
    return _checked(probs, outcome, -F.ln(F.greatest(F.try_element_at(probs, outcome.cast("int") + 1), F.lit(EPSILON))))


def rps(probs: Column, outcome: Column) -> Column:
    """Ranked probability score of ordered classes."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def step(s: Column, p: Column) -> Column:
        run = s["run"] + p - F.when(s["i"] == outcome, 1.0).otherwise(0.0)
        return F.struct(run.alias("run"), (s["sum"] + run * run).alias("sum"), (s["i"] + 1).alias("i"))

    return _checked(probs, outcome, F.aggregate(probs, start, step, lambda s: s["sum"] / (F.size(probs) - 1)))


def rps_average(probs: Column, outcome: Column) -> Column:
    return F.avg(rps(probs, outcome))


def brier_average(probs: Column, outcome: Column) -> Column:
    return F.avg(brier(probs, outcome))


def brier_per_selection(probs: Column, outcome: Column) -> Column:
    """Mean over rows and classes."""
    return F.avg(brier(probs, outcome) / F.size(probs))


def ignorance_average(probs: Column, outcome: Column) -> Column:
    return F.avg(ignorance(probs, outcome))


def decay_weight(day: Column, base: Column, xi: float) -> Column:
    """exp(-xi days)."""
    return F.exp(-F.lit(float(xi)) * F.datediff(base, day))


def half_life_weight(day: Column, base: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), F.datediff(base, day) / F.lit(float(half_life_days)))
