"""Poisson and Dixon-Coles fits from what they need to know of a league: a few sums for each pair of sides.

The likelihood sees a pair's matches only through the weight of all of them, the goals of both
sides and the weights of the four lowest scores.  Those sums are a DataFrame aggregate, so a
league's matches are spread over all tasks, however many they are; the Newton steps of a group
then read one row a pair.  Gradients and curvatures are exact, so a fit ends at the zero of its
score equations, which `score_residuals` states as aggregates again.

Walk-forward fits keep running sums: each pair's sums decay from boundary to boundary and take in
what has settled since; no result is read for more than one boundary, and each fit starts from
the one before.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

KINDS = ("poisson", "dixon_coles")
#: Weight, goals of both sides, weights of the scores 0-0, 0-1, 1-0 and 1-1.
SUMS = ("w", "gh", "ga", "w00", "w01", "w10", "w11")
RIDGE = 1e-3
#: Boundaries that one task fits in a row.
BLOCK = 8


def pair_sums(matches: DataFrame, keys: Sequence[str], weight: Column | None = None, home: str = "home", away: str = "away", home_goals: str = "home_goals", away_goals: str = "away_goals", neutral: str | None = None) -> DataFrame:
    """keys, home, away, neutral, SUMS and n: one row a pair (and kind of ground)."""
    w = F.lit(1.0) if weight is None else weight
    h, a = F.col(home_goals), F.col(away_goals)
    low = {f"w{x}{y}": F.sum(F.when((h == x) & (a == y), w).otherwise(0.0)) for x in (0, 1) for y in (0, 1)}
    ground = F.lit(False) if neutral is None else F.coalesce(F.col(neutral), F.lit(False))
    played = matches.filter(h.isNotNull() & a.isNotNull())
    sums = {"w": F.sum(w), "gh": F.sum(w * h), "ga": F.sum(w * a)} | low | {"n": F.count("*")}
    return played.groupBy(*keys, F.col(home).cast("string").alias("home"), F.col(away).cast("string").alias("away"), ground.alias("neutral")).agg(*[v.alias(k) for k, v in sums.items()])


class Fit:
    """Newton steps of one group: x holds attacks (their mean is taken off), defences, the home advantage and, for dixon_coles, rho."""

    def __init__(self, home: np.ndarray, away: np.ndarray, neutral: np.ndarray, sums: dict[str, np.ndarray], sides: int, kind: str, ridge: float = RIDGE):
        self.i, self.j, self.own, self.s, self.n, self.rho, self.ridge = home, away, ~neutral, sums, sides, kind == "dixon_coles", ridge

    def start(self) -> np.ndarray:
        level = math.log(max(0.1, (self.s["gh"].sum() + self.s["ga"].sum()) / max(2 * self.s["w"].sum(), 1e-12)))
        return np.concatenate([np.zeros(self.n), np.full(self.n, level), [0.2], [-0.05] * self.rho])

    def means(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        n = self.n
        attack, defence = x[:n] - x[:n].mean(), x[n : 2 * n]
        return np.exp(x[2 * n] * self.own + attack[self.i] + defence[self.j]), np.exp(attack[self.j] + defence[self.i]), float(x[-1]) if self.rho else 0.0

    def corrections(self, mh: np.ndarray, ma: np.ndarray, rho: float) -> dict[str, np.ndarray]:
        return {"w00": 1 - mh * ma * rho, "w01": 1 + mh * rho, "w10": 1 + ma * rho, "w11": np.full(len(mh), 1 - rho)}

    def loss(self, x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            mh, ma, rho = self.means(x)
            s = self.s
            total = (s["gh"] * np.log(mh) - s["w"] * mh + s["ga"] * np.log(ma) - s["w"] * ma).sum()
            if self.rho:
                for k, t in self.corrections(mh, ma, rho).items():
                    if (t[s[k] > 0] <= 0).any():
                        return np.inf
                    total += (s[k] * np.log(np.where(s[k] > 0, t, 1.0))).sum()
            out = -total + self.ridge * (x[: 2 * self.n] ** 2).sum()
        return float(out) if np.isfinite(out) else np.inf

    def derivatives(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss."""
        s, n, p = self.s, self.n, len(x)
        mh, ma, rho = self.means(x)
        by_h, by_a = s["gh"] - s["w"] * mh, s["ga"] - s["w"] * ma
        hh, aa, ha = -s["w"] * mh, -s["w"] * ma, np.zeros(len(mh))
        if self.rho:
            t, q = self.corrections(mh, ma, rho), mh * ma
            by_h = by_h - s["w00"] * q * rho / t["w00"] + s["w01"] * mh * rho / t["w01"]
            by_a = by_a - s["w00"] * q * rho / t["w00"] + s["w10"] * ma * rho / t["w10"]
            ha = -s["w00"] * q * rho / t["w00"] ** 2
            hh = hh + ha + s["w01"] * mh * rho / t["w01"] ** 2
            aa = aa + ha + s["w10"] * ma * rho / t["w10"] ** 2
            by_r = (-s["w00"] * q / t["w00"] + s["w01"] * mh / t["w01"] + s["w10"] * ma / t["w10"] - s["w11"] / t["w11"]).sum()
            rr = -(s["w00"] * (q / t["w00"]) ** 2 + s["w01"] * (mh / t["w01"]) ** 2 + s["w10"] * (ma / t["w10"]) ** 2 + s["w11"] / t["w11"] ** 2).sum()
            hr = -s["w00"] * q / t["w00"] ** 2 + s["w01"] * mh / t["w01"] ** 2
            ar = -s["w00"] * q / t["w00"] ** 2 + s["w10"] * ma / t["w10"] ** 2
        grad, curve = np.zeros(p), np.zeros((p, p))
        # the log mean of the home side moves with its attack, the other's defence and the home advantage; that of the away side with two
        of_h = [(self.i, 1.0), (n + self.j, 1.0), (np.full(len(mh), 2 * n), self.own.astype(float))]
        of_a = [(self.j, 1.0), (n + self.i, 1.0)]
        for places, slope, own in ((of_h, by_h, hh), (of_a, by_a, aa)):
            for at, d in places:
                np.add.at(grad, at, d * slope)
                for at2, d2 in places:
                    np.add.at(curve, (at, at2), d * d2 * own)
        if self.rho:
            for at, d in of_h:
                for at2, d2 in of_a:
                    np.add.at(curve, (at, at2), d * d2 * ha)
                    np.add.at(curve, (at2, at), d * d2 * ha)
            grad[-1], curve[-1, -1] = by_r, rr
            for places, mixed in ((of_h, hr), (of_a, ar)):
                for at, d in places:
                    line = np.bincount(at, d * mixed, p)
                    curve[-1] += line
                    curve[:, -1] += line
        grad[:n] -= grad[:n].mean()
        curve[:n] -= curve[:n].mean(0)
        curve[:, :n] -= curve[:, :n].mean(1, keepdims=True)
        if not self.own.any():  # nothing tells the home advantage
            curve[2 * n, 2 * n] -= 1.0
        grad, curve = -grad, -curve
        grad[: 2 * n] += 2 * self.ridge * x[: 2 * n]
        curve[np.arange(2 * n), np.arange(2 * n)] += 2 * self.ridge
        return grad, curve

    def run(self, x: np.ndarray | None = None, rounds: int = 100, tolerance: float = 1e-11) -> np.ndarray:
        x = self.start() if x is None else x
        value = self.loss(x)
        if not np.isfinite(value):
            x = self.start()
            value = self.loss(x)
        for _ in range(rounds):
            grad, curve = self.derivatives(x)
            try:
                way = -np.linalg.solve(curve, grad)
            except np.linalg.LinAlgError:
                way = -grad
            if way @ grad >= 0:
                way = -grad / max(1.0, np.abs(np.diag(curve)).max())
            t = 1.0
            while (new := self.loss(x + t * way)) > value + 1e-12 * (1 + abs(value)):
                t /= 2
                if t < 1e-12:
                    return x
            x, value = x + t * way, new
            if np.abs(t * way).max() < tolerance:
                break
        return x


_COEFFICIENTS = "team string, attack double, defence double, home_advantage double, extra string, n_train long"


def _frame(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    teams = sorted({*pdf["home"], *pdf["away"]})
    at = pd.Index(teams)
    return teams, at.get_indexer(pdf["home"]), at.get_indexer(pdf["away"]), pdf["neutral"].to_numpy(bool), {c: pdf[c].to_numpy(float) for c in SUMS}


def _coefficients(teams: list[str], x: np.ndarray, kind: str, n: int) -> pd.DataFrame:
    k = len(teams)
    extra = json.dumps({"rho": float(x[-1])} if kind == "dixon_coles" else {})
    return pd.DataFrame({"team": teams, "attack": x[:k] - x[:k].mean(), "defence": x[k : 2 * k], "home_advantage": float(x[2 * k]), "extra": extra, "n_train": n})


def fit_sums(sums: DataFrame, by: Sequence[str], kind: str = "dixon_coles", ridge: float = RIDGE) -> DataFrame:
    """(by, team, attack, defence, home_advantage, extra, n_train) from `pair_sums`: one fit a group."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    schema = T.StructType([*[sums.schema[c] for c in by], *T._parse_datatype_string(_COEFFICIENTS).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        teams, i, j, neutral, s = _frame(pdf)
        out = _coefficients(teams, Fit(i, j, neutral, s, len(teams), kind, ridge).run(), kind, int(pdf["n"].sum()))
        for c in reversed(list(by)):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return sums.groupBy(*by).applyInPandas(run, schema)


def _days(at: dt.datetime | dt.date) -> int:
    return (at.date() if isinstance(at, dt.datetime) else at).toordinal()


def slot_sums(matches: DataFrame, boundaries: Sequence, by: Sequence[str], half_life_days: float | None, date: str, settled: str, **columns: str) -> DataFrame:
    """`pair_sums` of what settles before each boundary but not before the one in front of it (_slot), weighted as that boundary weights it."""
    marks = F.array(*[F.lit(b).cast("timestamp") for b in boundaries])
    slots = matches.withColumn("_slot", F.size(F.filter(marks, lambda m: m <= F.col(settled).cast("timestamp")))).filter(F.col("_slot") < len(boundaries))
    decay = F.pow(F.lit(0.5), F.datediff(F.element_at(marks, F.col("_slot") + 1), date) / F.lit(float(half_life_days))) if half_life_days else None
    return pair_sums(slots, [*by, "_slot"], decay, **columns)


def _decay(days: float, half_life: float | None) -> float:
    return 0.5 ** (days / half_life) if half_life else 1.0


def walk_forward(matches: DataFrame, boundaries: Sequence, by: Sequence[str], kind: str = "dixon_coles", half_life_days: float | None = None, least: int = 20, date: str = "kickoff_utc", settled: str = "settled_at", **columns: str) -> DataFrame:
    """One fit for each group and boundary from results settled strictly before it: (by, trained_through, team, attack, defence, home_advantage, extra, n_train)."""
    boundaries = sorted(boundaries)
    days = [_days(b) for b in boundaries]
    sums = slot_sums(matches, boundaries, by, half_life_days, date, settled, **columns)
    # a block of boundaries takes its own slots, and one row a pair for all before
    blocks = range(-(-len(boundaries) // BLOCK))
    own = F.floor(F.col("_slot") / BLOCK).cast("int")
    spread = sums.withColumn("_block", F.explode(F.filter(F.array(*[F.lit(b) for b in blocks]), lambda b: b >= own)))
    starts = F.array(*[F.lit(days[b * BLOCK]) for b in blocks])
    at = F.array(*[F.lit(d) for d in days])
    before = F.col("_block") > own
    gap = F.element_at(starts, F.col("_block") + 1) - F.element_at(at, F.col("_slot") + 1)
    aged = F.when(before, F.pow(F.lit(0.5), gap / F.lit(float(half_life_days)))).otherwise(1.0) if half_life_days else F.lit(1.0)
    turn = F.when(before, -1).otherwise(F.col("_slot"))
    table = spread.groupBy(*by, "_block", turn.alias("_turn"), "home", "away", "neutral").agg(*[F.sum(F.col(c) * aged).alias(c) for c in SUMS], F.sum("n").alias("n"))
    schema = T.StructType([*[matches.schema[c] for c in by], T.StructField("_slot", T.IntegerType()), *T._parse_datatype_string(_COEFFICIENTS).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        key, columns_ = ["home", "away", "neutral"], [*SUMS, "n"]
        running = pdf[pdf["_turn"] < 0].set_index(key)[columns_]
        out, known = [], None
        for slot in range(block * BLOCK, min((block + 1) * BLOCK, len(boundaries))):
            if slot > block * BLOCK:
                running = running.copy()
                running[list(SUMS)] *= _decay(days[slot] - days[slot - 1], half_life_days)
            running = running.add(pdf[pdf["_turn"] == slot].set_index(key)[columns_], fill_value=0.0)
            n = int(running["n"].sum())
            if n < least:
                continue
            teams, i, j, neutral, s = _frame(running.reset_index())
            fit = Fit(i, j, neutral, s, len(teams), kind)
            x = fit.start()
            if known is not None:  # from where the fit before has ended; new sides start at the average
                old, last = known
                place = pd.Index(old).get_indexer(teams)
                for part in (0, 1):
                    x[part * len(teams) : (part + 1) * len(teams)] = np.where(place >= 0, last[part * len(old) + place], last[part * len(old) : (part + 1) * len(old)].mean())
                x[2 * len(teams) :] = last[2 * len(old) :]
            x = fit.run(x)
            known = teams, x
            out.append(_coefficients(teams, x, kind, n).assign(_slot=slot))
        if not out:
            return pd.DataFrame(columns=schema.names)
        out = pd.concat(out)
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[schema.names]

    fits = table.groupBy(*by, "_block").applyInPandas(run, schema)
    marks = F.array(*[F.lit(b).cast("timestamp") for b in boundaries])
    return fits.select(*by, F.element_at(marks, F.col("_slot") + 1).alias("trained_through"), "team", "attack", "defence", "home_advantage", "extra", "n_train")


def boundary_sums(slots: DataFrame, boundaries: Sequence, by: Sequence[str], half_life_days: float | None) -> DataFrame:
    """`pair_sums` of all that has settled before each boundary (trained_through), as running sums over `slot_sums`."""
    days = [_days(b) for b in boundaries]
    at = F.array(*[F.lit(d) for d in days])
    age = lambda c: F.pow(F.lit(0.5), (F.lit(days[-1]) - F.element_at(at, c + 1)) / F.lit(float(half_life_days))) if half_life_days else F.lit(1.0)
    pairs = slots.select(*by, "home", "away", "neutral").distinct().withColumn("_slot", F.explode(F.array(*[F.lit(k) for k in range(len(days))])))
    over = W.partitionBy(*by, "home", "away", "neutral").orderBy("_slot")
    # weights as the last boundary has them, so that sums run; then as the slot's own boundary has them
    filled = pairs.join(slots, [*by, "home", "away", "neutral", "_slot"], "left")
    ran = filled.select(*by, "home", "away", "neutral", "_slot", *[(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * age(F.col("_slot"))).over(over) / age(F.col("_slot"))).alias(c) for c in SUMS], F.sum(F.coalesce("n", F.lit(0))).over(over).alias("n"))
    marks = F.array(*[F.lit(b).cast("timestamp") for b in boundaries])
    return ran.filter("n > 0").withColumn("trained_through", F.element_at(marks, F.col("_slot") + 1)).drop("_slot")


def score_residuals(sums: DataFrame, fits: DataFrame, by: Sequence[str], ridge: float = RIDGE) -> DataFrame:
    """by, team, goals_for, goals_against, off_for, off_against, off_home and off_rho: how far each score equation is from 0 at a fit.

    off_for of a side is its goals less those expected (and the low-score terms and the ridge); off_home and off_rho are the group's."""
    side = lambda name: fits.select(*by, F.col("team").alias(name), F.col("attack").alias(f"{name}_a"), F.col("defence").alias(f"{name}_d"))
    group = fits.groupBy(*by).agg(F.first("home_advantage").alias("_hfa"), F.coalesce(F.first(F.get_json_object("extra", "$.rho").cast("double")), F.lit(0.0)).alias("_rho"), F.avg("defence").alias("_level"))
    rows = sums.join(side("home"), [*by, "home"]).join(side("away"), [*by, "away"]).join(group, list(by))
    own = F.when(F.col("neutral"), 0.0).otherwise(F.col("_hfa"))
    rows = rows.withColumns({"mh": F.exp(own + F.col("home_a") + F.col("away_d")), "ma": F.exp(F.col("away_a") + F.col("home_d")), "r": F.col("_rho")})
    rows = rows.withColumns({"q": F.expr("mh * ma"), "u": F.expr("-w00 * mh * ma * r / (1 - mh * ma * r)")})
    rows = rows.withColumns({"of_h": F.expr("gh - w * mh + u + w01 * mh * r / (1 + mh * r)"), "of_a": F.expr("ga - w * ma + u + w10 * ma * r / (1 + ma * r)"), "of_r": F.expr("-w00 * q / (1 - q * r) + w01 * mh / (1 + mh * r) + w10 * ma / (1 + ma * r) - w11 / (1 - r)")})
    two = rows.select(*by, "_level", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("gh").alias("f"), F.col("ga").alias("a"), F.col("of_h").alias("x"), F.col("of_a").alias("y")), F.struct(F.col("away").alias("team"), F.col("ga").alias("f"), F.col("gh").alias("a"), F.col("of_a").alias("x"), F.col("of_h").alias("y")))).alias("s"))
    sides = two.groupBy(*by, "s.team").agg(F.sum("s.f").alias("goals_for"), F.sum("s.a").alias("goals_against"), F.sum("s.x").alias("_x"), F.sum("s.y").alias("_y"), F.first("_level").alias("_level"))
    whole = rows.groupBy(*by).agg(F.sum(F.when(~F.col("neutral"), F.col("of_h")).otherwise(0.0)).alias("off_home"), F.when(F.first("_rho") == 0, 0.0).otherwise(F.sum("of_r")).alias("off_rho"))
    out = sides.join(fits.select(*by, "team", "attack", "defence"), [*by, "team"]).join(whole, list(by))
    return out.select(*by, "team", "goals_for", "goals_against", (F.col("_x") - 2 * ridge * (F.col("attack") + F.col("_level"))).alias("off_for"), (F.col("_y") - 2 * ridge * F.col("defence")).alias("off_against"), "off_home", "off_rho")
