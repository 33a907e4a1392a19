"""Bayesian goal models by differential-evolution MCMC: one chain group a task.

The ensemble moves each walker by the difference of two others, so it needs no step sizes.
Independent ensembles run as groups of a DataFrame; draws are reduced by team.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tallyfield.functions.goals import log_likelihood


def sample(log_density, start: np.ndarray, draws: int, burn: int, seed: int) -> np.ndarray:
    """(draws, walkers, dimensions) of an ensemble that starts at `start` (walkers, dimensions)."""
    rng = np.random.default_rng(seed)
    x = start.copy()
    walkers, dims = x.shape
    density = np.array([log_density(v) for v in x])
    gamma = 2.38 / math.sqrt(2 * dims)
    out = np.empty((draws, walkers, dims))
    for t in range(burn + draws):
        scale = 1.0 if t % 10 == 9 else gamma
        for k in range(walkers):
            i, j = rng.choice(walkers - 1, 2, replace=False)
            i, j = i + (i >= k), j + (j >= k)
            new = x[k] + scale * (x[i] - x[j]) + rng.normal(0, 1e-4, dims)
            value = log_density(new)
            if math.log(rng.random() + 1e-300) < value - density[k]:
                x[k], density[k] = new, value
        if t >= burn:
            out[t - burn] = x
    return out


def rhat(chains: np.ndarray) -> float:
    """Split potential scale reduction of (chains, draws)."""
    half = chains.shape[1] // 2
    parts = np.concatenate([chains[:, :half], chains[:, half : 2 * half]])
    within, between = parts.var(1, ddof=1).mean(), half * parts.mean(1).var(ddof=1)
    return float(np.sqrt(((half - 1) / half * within + between / half) / within)) if within > 0 else float("nan")


def effective_size(chains: np.ndarray) -> float:
    """Effective number of draws from autocorrelations up to the first negative pair."""
    m, n = chains.shape
    centred = chains - chains.mean(1, keepdims=True)
    variance = (centred**2).mean()
    if variance == 0:
        return float(m * n)
    rho = [float((centred[:, : n - k] * centred[:, k:]).mean() / variance) for k in range(min(n - 1, 200))]
    total = 0.0
    for k in range(1, len(rho) - 1, 2):
        if rho[k] + rho[k + 1] < 0:
            break
        total += rho[k] + rho[k + 1]
    return m * n / (1 + 2 * total)


def fit(spark: SparkSession, matches: pd.DataFrame, kind: str = "poisson", chains: int = 4, draws: int = 200, burn: int = 200, walkers: int | None = None, seed: int = 1, prior: float = 1.0, hierarchical: bool = False) -> DataFrame:
    """(parameter, mean, sd, rhat, ess) with normal priors; hierarchical ones learn the strengths' spread.

    `matches` (home, away, home_goals, away_goals) is one league's, so it is sent to each chain.
    """
    teams = sorted({str(t) for t in [*matches["home"], *matches["away"]]})
    at, n = {t: i for i, t in enumerate(teams)}, len(teams)
    i, j = (np.array([at[str(t)] for t in matches[c]]) for c in ("home", "away"))
    h, a = (matches[c].to_numpy(int) for c in ("home_goals", "away_goals"))
    names = [*(f"attack[{t}]" for t in teams), *(f"defence[{t}]" for t in teams), "home_advantage", *["log_spread"] * hierarchical]
    level = math.log(max(0.1, (h.mean() + a.mean()) / 2))

    def density(x: np.ndarray) -> float:
        spread = math.exp(x[2 * n + 1]) if hierarchical else prior
        if spread > 20:
            return -1e300
        mh, ma = np.exp(np.clip(x[2 * n] + x[i] + x[n + j], -8, 4)), np.exp(np.clip(x[j] + x[n + i], -8, 4))
        out = log_likelihood(kind, h, a, mh, ma, ()).sum() - 0.5 * ((x[:n] ** 2).sum() + ((x[n : 2 * n] - level) ** 2).sum()) / spread**2 - 0.5 * (x[2 * n] / 0.5) ** 2
        return float(out - 2 * n * math.log(spread) - 0.5 * x[2 * n + 1] ** 2) if hierarchical else float(out)

    size = walkers or max(2 * len(names) // 3, 8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng(seed + chain)
        base = np.concatenate([np.zeros(n), np.full(n, level), [0.2], *[[0.0]] * hierarchical])
        got = sample(density, base + rng.normal(0, 0.1, (size, len(base))), draws, burn, seed + 1000 * chain)
        return pd.DataFrame({"chain": chain, "place": np.repeat(np.arange(len(names)), draws), "draw": np.tile(np.arange(draws), len(names)), "value": got.mean(1).T.ravel(), "square": (got**2).mean(1).T.ravel()})

    drawn = spark.range(chains).selectExpr("CAST(id AS INT) AS chain").groupBy("chain").applyInPandas(run, "chain int, place int, draw int, value double, square double")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["chain", "draw"])["value"].to_numpy().reshape(chains, draws)
        mean = values.mean()
        return pd.DataFrame({"parameter": [names[int(pdf["place"].iloc[0])]], "mean": [mean], "sd": [math.sqrt(max(0.0, pdf["square"].mean() - mean**2))], "rhat": [rhat(values)], "ess": [effective_size(values)]})

    return drawn.groupBy("place").applyInPandas(reduce, "parameter string, mean double, sd double, rhat double, ess double")
