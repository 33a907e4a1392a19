"""Fits from pair sums against the general optimiser, and running sums against sums made anew."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import goal_fits, goals

DAY = dt.datetime(2024, 1, 1)


def made(sides=8, n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, d = rng.normal(0, 0.3, sides), rng.normal(0, 0.3, sides)
    rows = []
    for k in range(n):
        i, j = rng.choice(sides, 2, replace=False)
        rows.append(("L", f"t{i}", f"t{j}", int(rng.poisson(np.exp(0.3 + a[i] + d[j]))), int(rng.poisson(np.exp(a[j] + d[i]))), DAY + dt.timedelta(days=k // 3), k % 9 == 0))
    return pd.DataFrame(rows, columns=["league", "home", "away", "home_goals", "away_goals", "at", "neutral"])


def sums_of(m, w):
    low = {f"w{x}{y}": w * ((m.home_goals == x) & (m.away_goals == y)) for x in (0, 1) for y in (0, 1)}
    return m.assign(w=w, gh=w * m.home_goals, ga=w * m.away_goals, **low, n=1).groupby(["home", "away", "neutral"], as_index=False)[[*goal_fits.SUMS, "n"]].sum()


@pytest.mark.parametrize("kind", goal_fits.KINDS)
def test_against_the_general_optimiser(kind):
    m = made()
    m["w"] = 0.5 ** (np.arange(len(m)) / 200)
    g = goals.fit(m, kind, weight="w", neutral="neutral")
    teams, i, j, neutral, s = goal_fits._frame(sums_of(m, m.w))
    fit = goal_fits.Fit(i, j, neutral, s, len(teams), kind)
    x = fit.run()
    old = np.concatenate([g.attack, g.defence, [g.home_advantage], list(g.extra.values())])
    assert teams == g.teams and fit.loss(x) <= fit.loss(old) + 1e-9
    grad, curve = fit.derivatives(x)
    assert np.abs(grad).max() < 1e-9 and np.linalg.eigvalsh(curve).min() > 0
    assert np.abs(np.concatenate([x[: len(teams)] - x[: len(teams)].mean(), x[len(teams) :]]) - old).max() < 2e-3
    at = x + 0.02  # gradient and curvature by differences
    step = np.eye(len(x)) * 1e-6
    assert np.allclose(fit.derivatives(at)[0], [(fit.loss(at + e) - fit.loss(at - e)) / 2e-6 for e in step], atol=1e-5)
    assert np.allclose(fit.derivatives(at)[1], [(fit.derivatives(at + e)[0] - fit.derivatives(at - e)[0]) / 2e-6 for e in step], atol=1e-5)


def test_extremes_are_finite():
    """A side without a goal, all grounds neutral, one match."""
    for rows in ([("a", "b", 0, 3)] * 9 + [("b", "a", 2, 0)], [("a", "b", 1, 1)]):
        for neutral in (True, False):
            m = pd.DataFrame(rows, columns=["home", "away", "home_goals", "away_goals"]).assign(neutral=neutral)
            for kind in goal_fits.KINDS:
                teams, i, j, ground, s = goal_fits._frame(sums_of(m, 1.0))
                fit = goal_fits.Fit(i, j, ground, s, len(teams), kind)
                x = fit.run()
                assert np.isfinite(x).all() and np.isfinite(fit.loss(x))
                if not kind == "dixon_coles":
                    assert np.abs(fit.derivatives(x)[0]).max() < 1e-6


def test_walk_forward_is_the_fit_of_all_that_was_known(spark):
    m = made(n=240)
    marks = [DAY + dt.timedelta(days=d) for d in (1, *range(12, 90, 7))]  # more than a block; the first has too few results
    df = spark.createDataFrame(m.drop(columns="neutral")).withColumns({"kickoff_utc": F.col("at"), "settled_at": F.col("at") + F.expr("INTERVAL 2 HOURS")})
    got = goal_fits.walk_forward(df, marks, ["league"], "dixon_coles", 60.0).toPandas()
    assert set(got.trained_through) == {pd.Timestamp(b) for b in marks[1:]}
    for b, fit in got.groupby("trained_through"):
        known = m[m["at"] + pd.Timedelta(hours=2) < b].assign(neutral=False)
        w = 0.5 ** ((b.normalize() - known["at"].dt.normalize()).dt.days / 60.0)
        teams, i, j, ground, s = goal_fits._frame(sums_of(known, w))
        x = goal_fits.Fit(i, j, ground, s, len(teams), "dixon_coles").run()
        want = goal_fits._coefficients(teams, x, "dixon_coles", len(known))
        fit = fit.sort_values("team").reset_index(drop=True)
        assert list(fit.team) == teams and (fit.n_train == len(known)).all()
        for c in ("attack", "defence", "home_advantage"):
            assert np.abs(fit[c] - want[c]).max() < 1e-6
        assert abs(json.loads(fit.extra[0])["rho"] - json.loads(want.extra[0])["rho"]) < 1e-6


def test_running_sums(spark):
    m = made(n=90)
    marks = [DAY + dt.timedelta(days=d) for d in (5, 11, 25)]
    df = spark.createDataFrame(m)
    slots = goal_fits.slot_sums(df, marks, ["league"], 30.0, "at", "at", neutral="neutral")
    got = {(r["trained_through"], r["home"], r["away"], r["neutral"]): r for r in goal_fits.boundary_sums(slots, marks, ["league"], 30.0).collect()}
    n = 0
    for b in marks:
        known = m[m["at"] < b]
        w = 0.5 ** ((pd.Timestamp(b) - known["at"].dt.normalize()).dt.days / 30.0)
        for r in sums_of(known, w).itertuples():
            n += 1
            row = got[b, r.home, r.away, r.neutral]
            assert row["n"] == r.n and all(abs(row[c] - getattr(r, c)) < 1e-9 for c in goal_fits.SUMS)
    assert n == len(got)


def test_unknown_goals_do_not_count_and_kinds_are_checked(spark):
    df = spark.createDataFrame([("L", "a", "b", 1, 0), ("L", "b", "a", None, 2), ("L", "b", "a", 2, 2)], "league string, home string, away string, home_goals int, away_goals int")
    assert goal_fits.fit_sums(goal_fits.pair_sums(df, ["league"]), ["league"]).first()["n_train"] == 2
    with pytest.raises(ValueError, match="kind"):
        goal_fits.fit_sums(goal_fits.pair_sums(df, ["league"]), ["league"], "weibull")
