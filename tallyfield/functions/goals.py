"""Goal models: six likelihoods fitted by maximum likelihood, and their predictions.

A fit takes one league's matches, some hundred rows; many fits (leagues, walk-forward
boundaries) run beside each other as groups.  The optimiser is a small BFGS with
difference gradients; all likelihoods are array expressions over the matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG_FACTORIAL = np.cumsum(np.log(np.maximum(np.arange(200), 1)))


def log_factorial(k: np.ndarray) -> np.ndarray:
    return _LOG_FACTORIAL[np.asarray(k, np.int64)]


_gamma = np.vectorize(math.lgamma, otypes=[float])


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 200, tolerance: float = 1e-6, slope: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """BFGS with a halving line search; central differences where no slope is given."""
    x, n = start.astype(float), len(start)
    step = 1e-5

    def differences(at: np.ndarray) -> np.ndarray:
        out = np.empty(n)
        for i in range(n):
            d = np.zeros(n)
            d[i] = step
            out[i] = (f(at + d) - f(at - d)) / (2 * step)
        return out

    slope = slope or differences
    inverse, value, grad = np.eye(n), f(x), slope(x)
    for _ in range(rounds):
        if np.abs(grad).max() < tolerance:
            break
        way = -inverse @ grad
        if way @ grad >= 0:
            inverse, way = np.eye(n), -grad
        t = 1.0
        while (new := f(x + t * way)) > value + 1e-4 * t * (way @ grad) or not np.isfinite(new):
            t /= 2
            if t < 1e-10:
                return x, value
        s = t * way
        x, g = x + s, slope(x + s)
        y, change = g - grad, value - new
        value, grad = new, g
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            a = np.eye(n) - rho * np.outer(s, y)
            inverse = a @ inverse @ a.T + rho * np.outer(s, s)
        if change < tolerance * 1e-3 * (1 + abs(value)):
            break
    return x, value


def tau(h: np.ndarray, a: np.ndarray, mh: np.ndarray, ma: np.ndarray, rho: float) -> np.ndarray:
    """The low-score correction of Dixon and Coles."""
    out = np.ones(np.broadcast(h, a, mh, ma).shape)
    for x, y, v in ((0, 0, 1 - mh * ma * rho), (0, 1, 1 + mh * rho), (1, 0, 1 + ma * rho), (1, 1, 1 - rho)):
        out = np.where((h == x) & (a == y), v, out)
    return out


def _poisson(k: np.ndarray, m: np.ndarray) -> np.ndarray:
    return -m + k * np.log(m) - log_factorial(k)


def _negative_binomial(k: np.ndarray, m: np.ndarray, r: float) -> np.ndarray:
    return _gamma(k + r) - _gamma(np.array(r)) - log_factorial(k) + r * np.log(r / (r + m)) + k * np.log(m / (r + m))


def _zero_inflated(k: np.ndarray, m: np.ndarray, z: float) -> np.ndarray:
    return np.where(k == 0, np.log(z + (1 - z) * np.exp(-m)), np.log(1 - z) + _poisson(k, m))


def _bivariate(h: np.ndarray, a: np.ndarray, mh: np.ndarray, ma: np.ndarray, shared: float) -> np.ndarray:
    total = np.zeros(np.broadcast(h, a, mh, ma).shape)
    for k in range(int(min(h.max(initial=0), a.max(initial=0))) + 1):
        ok = (h >= k) & (a >= k)
        part = _poisson(np.maximum(h - k, 0), mh) + _poisson(np.maximum(a - k, 0), ma) + _poisson(np.array(k), np.array(shared))
        total += np.where(ok, np.exp(part), 0.0)
    return np.log(np.maximum(total, 1e-10))


def weibull_counts(rate: np.ndarray, shape: float, most: int, terms: int = 40) -> np.ndarray:
    """P(N = 0 .. most) of a Weibull renewal count with each rate, by its series."""
    alpha = np.zeros((most + 2, terms))
    j = np.arange(terms)
    alpha[0] = np.exp(_gamma(shape * j + 1) - _gamma(j + 1))
    for n in range(most + 1):
        for k in range(n + 1, terms):
            m = np.arange(n, k)
            alpha[n + 1, k] = (alpha[n, m] * np.exp(_gamma(shape * (k - m) + 1) - _gamma(k - m + 1))).sum()
    out = np.zeros((len(rate), most + 1))
    for n in range(most + 1):
        k = np.arange(n, terms)
        sign = (-1.0) ** (k + n)
        out[:, n] = (sign * rate[:, None] ** k * alpha[n, k] / np.exp(_gamma(shape * k + 1))).sum(1)
    return np.clip(out, 1e-12, 1.0)


def frank_copula(u: np.ndarray, v: np.ndarray, kappa: float) -> np.ndarray:
    if abs(kappa) < 1e-6:
        return u * v
    return -np.log1p(np.expm1(-kappa * u) * np.expm1(-kappa * v) / np.expm1(-kappa)) / kappa


@dataclass(frozen=True)
class Kind:
    """A model: names, starts and transforms of what it has besides strengths and home advantage."""

    extra: tuple[str, ...] = ()
    start: tuple[float, ...] = ()


KINDS = {"poisson": Kind(), "dixon_coles": Kind(("rho",), (-0.05,)), "negative_binomial": Kind(("log_dispersion",), (3.0,)), "zero_inflated": Kind(("logit_zero",), (-4.0,)), "bivariate": Kind(("log_shared",), (-2.0,)), "weibull_copula": Kind(("log_shape", "kappa"), (0.0, 0.1))}


@dataclass
class GoalModel:
    """A fitted model: strengths by team, home advantage and extras."""

    kind: str
    teams: list[str]
    attack: np.ndarray
    defence: np.ndarray
    home_advantage: float
    extra: dict[str, float] = field(default_factory=dict)
    log_likelihood: float = float("nan")
    n_params: int = 0

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.log_likelihood

    def means(self, home: str, away: str, neutral: bool = False) -> tuple[float, float, bool]:
        """(home mean, away mean, whether a side is unknown): an unknown side has average strength."""
        at = {t: i for i, t in enumerate(self.teams)}
        part = lambda values, t: float(values[at[t]]) if t in at else float(values.mean())
        hfa = 0.0 if neutral else self.home_advantage
        return math.exp(hfa + part(self.attack, home) + part(self.defence, away)), math.exp(part(self.attack, away) + part(self.defence, home)), home not in at or away not in at

    def grid(self, home: str, away: str, most: int = 12, neutral: bool = False) -> np.ndarray:
        """Probabilities of scores 0 .. most, summing to 1."""
        mh, ma, _ = self.means(home, away, neutral)
        return score_matrix(self.kind, mh, ma, self.extra, most)


def score_matrix(kind: str, mh: float, ma: float, extra: dict[str, float], most: int = 12) -> np.ndarray:
    h, a = np.meshgrid(np.arange(most + 1), np.arange(most + 1), indexing="ij")
    mh_, ma_ = np.array(mh), np.array(ma)
    if kind == "weibull_copula":
        shape = math.exp(extra["log_shape"])
        cum = [np.concatenate([[0.0], np.minimum(np.cumsum(weibull_counts(np.array([m]), shape, most)[0]), 1.0)]) for m in (mh, ma)]
        c = frank_copula(cum[0][:, None], cum[1][None, :], extra["kappa"])
        p = c[1:, 1:] - c[:-1, 1:] - c[1:, :-1] + c[:-1, :-1]
    elif kind == "bivariate":
        p = np.exp(_bivariate(h, a, mh_, ma_, math.exp(extra["log_shared"])))
    elif kind == "negative_binomial":
        r = math.exp(extra["log_dispersion"])
        p = np.exp(_negative_binomial(h, mh_, r) + _negative_binomial(a, ma_, r))
    elif kind == "zero_inflated":
        z = 1 / (1 + math.exp(-extra["logit_zero"]))
        p = np.exp(_zero_inflated(h, mh_, z) + _zero_inflated(a, ma_, z))
    else:
        p = np.exp(_poisson(h, mh_) + _poisson(a, ma_))
        if kind == "dixon_coles":
            p = p * np.maximum(tau(h, a, mh_, ma_, extra["rho"]), 0.0)
    p = np.maximum(p, 0.0)
    return p / p.sum()


def log_likelihood(kind: str, h: np.ndarray, a: np.ndarray, mh: np.ndarray, ma: np.ndarray, extra: Sequence[float]) -> np.ndarray:
    """Log probability of each match's score."""
    if kind == "dixon_coles":
        return _poisson(h, mh) + _poisson(a, ma) + np.log(np.maximum(tau(h, a, mh, ma, extra[0]), 1e-9))
    if kind == "negative_binomial":
        r = math.exp(min(extra[0], 12.0))
        return _negative_binomial(h, mh, r) + _negative_binomial(a, ma, r)
    if kind == "zero_inflated":
        z = 1 / (1 + math.exp(-extra[0]))
        return _zero_inflated(h, mh, z) + _zero_inflated(a, ma, z)
    if kind == "bivariate":
        return _bivariate(h, a, mh, ma, math.exp(extra[0]))
    if kind == "weibull_copula":
        shape, kappa = math.exp(extra[0]), extra[1]
        most = int(max(h.max(), a.max()))
        ch, ca = (np.concatenate([np.zeros((len(m), 1)), np.minimum(np.cumsum(weibull_counts(m, shape, most), 1), 1.0)], 1) for m in (mh, ma))
        i, j, row = h.astype(int), a.astype(int), np.arange(len(h))
        c = lambda u, v: frank_copula(ch[row, u], ca[row, v], kappa)
        return np.log(np.maximum(c(i + 1, j + 1) - c(i, j + 1) - c(i + 1, j) + c(i, j), 1e-12))
    return _poisson(h, mh) + _poisson(a, ma)


def _merged(*columns: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct columns, sums of their weights, their numbers)."""
    whole = [c.astype(np.int64) for c in columns]
    spans = [int(c.max()) + 1 for c in whole]
    key, place, sizes = np.unique(np.ravel_multi_index(whole, spans), return_inverse=True, return_counts=True)
    rows = np.stack(np.unravel_index(key, spans))
    return rows, np.bincount(place.ravel(), w, rows.shape[1]), sizes


def fit(matches: pd.DataFrame, kind: str = "dixon_coles", home: str = "home", away: str = "away", home_goals: str = "home_goals", away_goals: str = "away_goals", weight: str | None = None, neutral: str | None = None, ridge: float = 1e-3) -> GoalModel:
    """Maximum likelihood with attack strengths of mean 0; a slight ridge keeps unbeaten sides finite."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    if matches.empty:
        raise ValueError("no matches to fit")
    teams = sorted({str(t) for t in [*matches[home], *matches[away]]})
    at, n = {t: i for i, t in enumerate(teams)}, len(teams)
    i, j = (np.array([at[str(t)] for t in matches[c]]) for c in (home, away))
    h, a = (matches[c].to_numpy(float).astype(int) for c in (home_goals, away_goals))
    w = matches[weight].to_numpy(float) if weight else np.ones(len(matches))
    away_from_home = matches[neutral].to_numpy(bool) if neutral else np.zeros(len(matches), bool)
    own = KINDS[kind]
    # matches of the same sides and score count together
    (i, j, h, a, away_from_home), w, sizes = _merged(i, j, h, a, away_from_home, w=w)
    away_from_home = away_from_home.astype(bool)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        attack = x[:n] - x[:n].mean()
        return attack, x[n : 2 * n], 0.0 if away_from_home.all() else x[2 * n], x[2 * n + 1 :]

    def logs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log means of both sides, and the extras."""
        attack, defence, hfa, extra = parts(x)
        return hfa * ~away_from_home + attack[i] + defence[j], attack[j] + defence[i], extra

    def likelihood(lh: np.ndarray, la: np.ndarray, extra: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return w * log_likelihood(kind, h, a, np.exp(np.clip(lh, -8, 4)), np.exp(np.clip(la, -8, 4)), extra)

    def loss(x: np.ndarray) -> float:
        total = -likelihood(*logs(x)).sum()
        return float(total + ridge * (x[: 2 * n] ** 2).sum()) if np.isfinite(total) else 1e30

    def slope(x: np.ndarray, step: float = 1e-5) -> np.ndarray:
        """By differences of each match's two log means and of the extras, carried over to the strengths."""
        lh, la, extra = logs(x)
        by_home = -(likelihood(lh + step, la, extra) - likelihood(lh - step, la, extra)) / (2 * step)
        by_away = -(likelihood(lh, la + step, extra) - likelihood(lh, la - step, extra)) / (2 * step)
        attack = np.bincount(i, by_home, n) + np.bincount(j, by_away, n)
        defence = np.bincount(j, by_home, n) + np.bincount(i, by_away, n)
        hfa = 0.0 if away_from_home.all() else by_home[~away_from_home].sum()
        more = [-(likelihood(lh, la, extra + d).sum() - likelihood(lh, la, extra - d).sum()) / (2 * step) for d in np.eye(len(extra)) * step]
        out = np.concatenate([attack - attack.mean(), defence, [hfa], more])
        out[: 2 * n] += 2 * ridge * x[: 2 * n]
        return np.nan_to_num(out, posinf=0.0, neginf=0.0)

    level = math.log(max(0.1, (np.average(h, weights=sizes) + np.average(a, weights=sizes)) / 2))
    x, value = minimise(loss, np.concatenate([np.zeros(n), np.full(n, level), [0.2], own.start]), slope=slope)
    attack, defence, hfa, extra = parts(x)
    return GoalModel(kind, teams, attack, defence, float(hfa), dict(zip(own.extra, (float(v) for v in extra), strict=True)), -float(value), 2 * n + len(own.extra))


def fit_groups(matches: DataFrame, by: Sequence[str], kind: str = "dixon_coles", **columns: str) -> DataFrame:
    """(by, team, attack, defence, home_advantage, extra as JSON, aic): one fit a group, groups side by side."""
    import json

    schema = T.StructType([*[matches.schema[c] for c in by], *T._parse_datatype_string("team string, attack double, defence double, home_advantage double, extra string, aic double").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit(pdf, kind, **columns)
        out = pd.DataFrame({"team": m.teams, "attack": m.attack, "defence": m.defence, "home_advantage": m.home_advantage, "extra": json.dumps(m.extra), "aic": m.aic})
        for k in reversed(list(by)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return matches.groupBy(*by).applyInPandas(run, schema)


def predict_many(fixtures: DataFrame, strengths: DataFrame, by: Sequence[str], home: str = "home", away: str = "away", rho: float = 0.0, most: int = 12) -> DataFrame:
    """fixtures with lambda_home, lambda_away, used_prior and a score grid: two joins and expressions.

    A side without strengths takes the group's average.
    """
    from tallyfield.functions.markets import score_grid

    mean = strengths.groupBy(*by).agg(F.avg("attack").alias("_ma"), F.avg("defence").alias("_md"), F.first("home_advantage").alias("_hfa"))
    out = fixtures.join(mean, list(by))
    for side, col in (("h", home), ("a", away)):
        s = strengths.select(*by, F.col("team").alias(col), F.col("attack").alias(f"_{side}a"), F.col("defence").alias(f"_{side}d"))
        out = out.join(s, [*by, col], "left")
    part = lambda name, side: F.coalesce(F.col(f"_{side}{name}"), F.col(f"_m{name}"))
    out = out.withColumns({"lambda_home": F.exp(F.col("_hfa") + part("a", "h") + part("d", "a")), "lambda_away": F.exp(part("a", "a") + part("d", "h")), "used_prior": F.col("_ha").isNull() | F.col("_aa").isNull()})
    return out.withColumn("grid", score_grid(F.col("lambda_home"), F.col("lambda_away"), F.lit(rho), most)).drop("_ma", "_md", "_hfa", "_ha", "_hd", "_aa", "_ad")


def goal_expectancy(home: float, draw: float, away: float, rho: float = 0.0, most: int = 12) -> tuple[float, float, float]:
    """(home mean, away mean, squared error): the means whose grid gives the three probabilities best."""
    total = home + draw + away
    if min(home, draw, away) < 0 or total <= 0:
        raise ValueError("probabilities are not negative and not all 0")
    want = np.array([home, draw, away]) / total

    def loss(x: np.ndarray) -> float:
        p = score_matrix("dixon_coles", math.exp(x[0]), math.exp(x[1]), {"rho": rho}, most)
        got = np.array([np.tril(p, -1).sum(), np.trace(p), np.triu(p, 1).sum()])
        return float(((got - want) ** 2).mean())

    x, value = minimise(loss, np.log([1.4, 1.1]), tolerance=1e-9)
    return math.exp(x[0]), math.exp(x[1]), value


def _three_way(home: np.ndarray, away: np.ndarray, rho: float, most: int) -> np.ndarray:
    """(home, draw, away) probabilities of score grids, a row a pair of means."""
    k = np.arange(most + 1)
    log_factorial = np.cumsum(np.log(np.maximum(k, 1)))
    p, q = (np.exp(k * np.log(m)[:, None] - m[:, None] - log_factorial) for m in (home, away))
    grid = p[:, :, None] * q[:, None, :]
    for (h, a), tau in {(0, 0): 1 - home * away * rho, (0, 1): 1 + home * rho, (1, 0): 1 + away * rho, (1, 1): np.full(len(home), 1 - rho)}.items():
        grid[:, h, a] *= np.maximum(tau, 0)
    grid /= grid.sum((1, 2), keepdims=True)
    return np.stack([(grid * np.tri(most + 1, k=-1)).sum((1, 2)), np.trace(grid, axis1=1, axis2=2), (grid * np.tri(most + 1, k=-1).T).sum((1, 2))], 1)


def expected_goals(home, draw, away, rho: float = 0.0, most: int = 12, steps: int = 60):
    """Column of (home, away, error): the goal means whose grid gives three probabilities; Newton steps for whole batches.  Null or impossible probabilities give null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("home double, away double, error double")
    def solve(h: pd.Series, d: pd.Series, a: pd.Series) -> pd.DataFrame:
        want = np.stack([x.to_numpy(float) for x in (h, d, a)], 1)
        good = np.isfinite(want).all(1) & (want >= 0).all(1) & (want.sum(1) > 0)
        want = np.where(good[:, None], want, 1.0)
        want /= want.sum(1, keepdims=True)
        x = np.tile(np.log([1.4, 1.1]), (len(want), 1))
        gap = lambda at: _three_way(np.exp(at[:, 0]), np.exp(at[:, 1]), rho, most)[:, [0, 2]] - want[:, [0, 2]]
        for _ in range(steps):
            now = gap(x)
            slope = np.stack([(gap(x + e) - gap(x - e)) / 2e-6 for e in np.eye(2) * 1e-6], 2)
            move = np.linalg.solve(slope + np.eye(2) * 1e-12, now[:, :, None])[:, :, 0]
            x = np.clip(x - np.clip(move, -0.5, 0.5), -8, 3)
            if np.abs(move).max(initial=0) < 1e-13:
                break
        error = ((_three_way(np.exp(x[:, 0]), np.exp(x[:, 1]), rho, most) - want) ** 2).mean(1)
        hide = lambda v: np.where(good, v, np.nan)
        return pd.DataFrame({"home": hide(np.exp(x[:, 0])), "away": hide(np.exp(x[:, 1])), "error": hide(error)}).astype(object).where(lambda f: f.notna(), None)

    return solve(home, draw, away)


def score_log_probability(kind: str, home_goals, away_goals, home_mean, away_mean, extra: Sequence[float] = ()):
    """Column of the log probability of a final score under a model's means and extras, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    if kind not in KINDS or len(extra) != len(KINDS[kind].extra):
        raise ValueError(f"a kind of {', '.join(KINDS)} and its extras")

    @pandas_udf("double")
    def run(h: pd.Series, a: pd.Series, mh: pd.Series, ma: pd.Series) -> pd.Series:
        return pd.Series(log_likelihood(kind, h.to_numpy(int), a.to_numpy(int), mh.to_numpy(float), ma.to_numpy(float), list(extra)))

    return run(home_goals, away_goals, home_mean, away_mean)
