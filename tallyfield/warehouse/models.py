"""Forecast pools and walk-forward fitting."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions import goal_fits, goals
from tallyfield.functions.metrics import brier, log_loss, rps


def log_pool(market: Column, model: Column, weight: Column | float) -> Column:
    """Arrays of probabilities mixed on the log scale and made to sum to 1."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    mixed = F.zip_with(market, model, lambda a, b: F.exp((1 - w) * F.ln(F.greatest(a, F.lit(1e-12))) + w * F.ln(F.greatest(b, F.lit(1e-12)))))
    total = F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x)
    return F.transform(mixed, lambda x: x / total)


def golden_section(f, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    ratio = (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def fit_weights(rows: DataFrame, boundaries: Sequence, market: str = "market", model: str = "model", outcome: str = "outcome", settled: str = "settled_at", by: Sequence[str] = ()) -> DataFrame:
    """The best pool weight for each boundary, from rows settled strictly before it.

    Each boundary's rows are one group; a row goes to all boundaries after it.
    """
    marks = F.array(*[F.lit(b).cast("timestamp") for b in boundaries])
    spread = rows.withColumn("trained_through", F.explode(F.filter(marks, lambda m: F.col(settled).cast("timestamp") < m)))
    keys = [*by, "trained_through"]
    schema = T.StructType([*[spread.schema[k] for k in keys], *T._parse_datatype_string("n_train int, train_max_settled_at timestamp, weight double, unconstrained double, train_logloss double, market_logloss double").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.log(np.maximum(np.stack(pdf[c].to_numpy()), 1e-12)) for c in (market, model))
        y, row = pdf[outcome].to_numpy(int), np.arange(len(pdf))

        def loss(w: float) -> float:
            mixed = (1 - w) * p + w * q
            return float(-(mixed[row, y] - np.log(np.exp(mixed).sum(1))).mean())

        inside, free = golden_section(loss), golden_section(loss, -1.0, 2.0)
        inside = min((0.0, inside, 1.0), key=loss)
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], len(pdf), pdf[settled].max(), inside, free, loss(inside), loss(0.0))], columns=schema.names)

    return spread.groupBy(*keys).applyInPandas(run, schema)


def score_forecasts(rows: DataFrame, by: Sequence[str], probs: str = "probs", outcome: str = "outcome") -> DataFrame:
    """Brier (mean over selections), log loss and ranked probability score."""
    p, y = F.col(probs), F.col(outcome)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(brier(p, y) / F.size(p)).alias("brier"), F.avg(log_loss(p, y)).alias("logloss"), F.avg(rps(p, y)).alias("rps"))


def compare_forecasts(rows: DataFrame, by: Sequence[str], first: str, second: str, outcome: str = "outcome", score: str = "logloss", draws: int = 1000, seed: int = 1) -> DataFrame:
    """Mean gain of the second forecast over the first (negative: the second is better), with its interval over resampled rows."""
    from tallyfield.warehouse.backtest import bootstrap_mean

    of = {"brier": lambda p: brier(p, F.col(outcome)) / F.size(p), "logloss": lambda p: log_loss(p, F.col(outcome)), "rps": lambda p: rps(p, F.col(outcome))}
    if score not in of:
        raise ValueError(f"score is one of {', '.join(of)}")
    gains = rows.select(*by, (of[score](F.col(second)) - of[score](F.col(first))).alias("gain"))
    means = gains.groupBy(*by).agg(F.count("*").alias("n"), F.avg("gain").alias("gain"))
    intervals = bootstrap_mean(gains, by, "gain", draws, seed)
    return means.join(intervals, list(by)) if by else means.crossJoin(F.broadcast(intervals))  # one row on either side


def walk_forward(matches: DataFrame, boundaries: Sequence, by: Sequence[str], kind: str = "dixon_coles", half_life_days: float | None = None, least: int = 20, date: str = "kickoff_utc", settled: str = "settled_at", home: str = "home", away: str = "away", home_goals: str = "home_goals", away_goals: str = "away_goals") -> DataFrame:
    """One fit for each group and boundary from results settled strictly before it: (by, trained_through, team, attack, defence, home_advantage, extra, n_train)."""
    if kind in goal_fits.KINDS:  # from running sums of each pair
        return goal_fits.walk_forward(matches, boundaries, by, kind, half_life_days, least, date, settled, home=home, away=away, home_goals=home_goals, away_goals=away_goals)
    marks = F.array(*[F.lit(b).cast("timestamp") for b in boundaries])
    spread = matches.withColumn("trained_through", F.explode(F.filter(marks, lambda m: F.col(settled).cast("timestamp") < m)))
    if half_life_days:
        spread = spread.withColumn("_w", F.pow(F.lit(0.5), F.datediff("trained_through", date) / F.lit(float(half_life_days))))
    keys = [*by, "trained_through"]
    schema = T.StructType([*[spread.schema[k] for k in keys], *T._parse_datatype_string("team string, attack double, defence double, home_advantage double, extra string, n_train int").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=schema.names)
        m = goals.fit(pdf, kind, home, away, home_goals, away_goals, "_w" if half_life_days else None)
        out = pd.DataFrame({"team": m.teams, "attack": m.attack, "defence": m.defence, "home_advantage": m.home_advantage, "extra": json.dumps(m.extra), "n_train": len(pdf)})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return spread.groupBy(*keys).applyInPandas(run, schema)
