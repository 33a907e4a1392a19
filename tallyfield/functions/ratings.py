"""Team ratings: Elo and Pi as ordered folds, Colley and Massey as small linear systems.

A fold depends on every match before, so a league is one task (`by`); leagues run beside
each other.  Spark sorts a league's matches and the fold reads them in batches; what it keeps is
the ratings of the teams, however long the league.  The linear systems take their counts from Spark aggregates and are solved for
each league in a task that holds a row for each pair of its teams; nothing comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folded(matches: DataFrame, by: Sequence[str], order: Sequence[str], fields: str, fold) -> DataFrame:
    """Run a fold over each group's matches in order; fold(rows, state) gives lists of new values by column and keeps in `state` (a dict, empty at a group's start) what later rows need."""
    new = T._parse_datatype_string(fields)
    schema = T.StructType([*matches.schema.fields, *new.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for pdf in batches:
            keys = pd.DataFrame({k: pdf[k] for k in by}, index=pdf.index)
            before = keys.shift()
            starts = np.flatnonzero(~((keys == before) | (keys.isna() & before.isna())).all(axis=1).to_numpy())
            bounds = sorted({0, *starts.tolist(), len(pdf)})
            for low, high in zip(bounds, bounds[1:], strict=False):
                rows = pdf.iloc[low:high].reset_index(drop=True)
                key = tuple(None if pd.isna(x) else x for x in (rows[k].iloc[0] for k in by))
                if key != last:
                    last, state = key, {}
                yield rows.assign(**fold(rows, state))

    one = matches.repartition(*by) if by else matches.repartition(1)
    return one.sortWithinPartitions(*by, *[F.asc_nulls_last(c) for c in order]).mapInPandas(run, schema)


def elo(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, order: Sequence[str], by: Sequence[str] = (), k: float = 20.0, home_advantage: float = 100.0, start: float = 1500.0) -> DataFrame:
    """Ratings of both sides before and after each match, and the home side's expectation."""

    def fold(rows: pd.DataFrame, rating: dict[object, float]) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {n: [] for n in ("home_elo_before", "away_elo_before", "home_expected", "home_elo", "away_elo")}
        for h, a, x, y in zip(rows[home], rows[away], rows[home_goals], rows[away_goals], strict=True):
            r, s = rating.get(h, start), rating.get(a, start)
            expected = 1 / (1 + 10 ** ((s - r - home_advantage) / 400))
            actual = 1.0 if x > y else 0.0 if x < y else 0.5
            rating[h], rating[a] = r + k * (actual - expected), s - k * (actual - expected)
            for n, v in zip(out, (r, s, expected, rating[h], rating[a]), strict=True):
                out[n].append(v)
        return out

    return _folded(matches, by, order, "home_elo_before double, away_elo_before double, home_expected double, home_elo double, away_elo double", fold)


def _phi(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def pi(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, order: Sequence[str], by: Sequence[str] = (), own: float = 0.15, cross: float = 0.10, damping: float = 0.75, sigma: float = 1.0) -> DataFrame:
    """Home and away ratings in goals; a damped error of the goal difference moves both sides' both ratings.

    Outcome probabilities take the expected difference as the mean of a normal goal
    difference with deviation sigma, cut half a goal from 0.
    """

    def fold(rows: pd.DataFrame, state: dict[str, dict[object, float]]) -> dict[str, list[float]]:
        at_home, at_away = state.setdefault("home", {}), state.setdefault("away", {})
        out: dict[str, list[float]] = {n: [] for n in ("expected_difference", "p_home", "p_draw", "p_away", "home_pi", "away_pi")}
        for h, a, x, y in zip(rows[home], rows[away], rows[home_goals], rows[away_goals], strict=True):
            expected = at_home.get(h, 0.0) - at_away.get(a, 0.0)
            error = float(x - y) - expected
            move = error / (1 + damping * abs(error))
            for ratings, team, share in ((at_home, h, own), (at_away, h, cross), (at_home, a, -cross), (at_away, a, -own)):
                ratings[team] = ratings.get(team, 0.0) + share * move
            low, high = _phi((-0.5 - expected) / sigma), _phi((0.5 - expected) / sigma)
            mean = lambda t: (at_home[t] + at_away[t]) / 2
            for n, v in zip(out, (expected, 1 - high, high - low, low, mean(h), mean(a)), strict=True):
                out[n].append(v)
        return out

    return _folded(matches, by, order, "expected_difference double, p_home double, p_draw double, p_away double, home_pi double, away_pi double", fold)


def elo_probabilities(home_rating, away_rating, home_advantage: float = 100.0, draw_base: float = 0.3, draw_width: float = 200.0):
    """(home, draw, away) columns from two ratings: the draw is a bell around equal strength."""
    gap = home_rating + home_advantage - away_rating
    tie = F.lit(draw_base) * F.exp(-gap * gap / (2 * draw_width**2))
    win = 1 / (1 + F.pow(F.lit(10.0), -gap / 400))
    return win / (1 + tie), tie / (1 + tie), (1 - win) / (1 + tie)


def _solved(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, by: Sequence[str], fields: str, solve) -> DataFrame:
    """Counts for every ordered pair of teams, and solve(teams, counts) for each league: a task holds a row a pair of one league's teams."""
    row = lambda t, o, x, y: F.struct(F.col(t).cast("string").alias("team"), F.col(o).cast("string").alias("other"), F.col(x).cast("double").alias("f"), F.col(y).cast("double").alias("a"))
    both = matches.select(*by, F.explode(F.array(row(home, away, home_goals, away_goals), row(away, home, away_goals, home_goals))).alias("r")).select(*by, "r.*")
    pairs = both.groupBy(*by, "team", "other").agg(F.count("*").alias("n"), F.count_if(F.col("f") > F.col("a")).alias("won"), F.count_if(F.col("f") == F.col("a")).alias("drawn"), F.sum("f").alias("f"), F.sum("a").alias("a"))
    schema = T.StructType([matches.schema[c] for c in by] + [T.StructField("team", T.StringType()), *T._parse_datatype_string(fields).fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(pdf["team"]))
        at = {t: i for i, t in enumerate(teams)}
        counts = {c: np.zeros((len(teams), len(teams))) for c in ("n", "won", "drawn", "f", "a")}
        where = pdf["team"].map(at).to_numpy(), pdf["other"].map(at).to_numpy()
        for c, m in counts.items():
            m[where] = pdf[c].to_numpy()
        out = pd.DataFrame({"team": teams, **solve(**counts)})
        for k, c in enumerate(by):
            out.insert(k, c, [pdf[c].iloc[0]] * len(teams))
        return out

    return pairs.groupBy(*by).applyInPandas(run, schema)


def colley(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, include_draws: bool = True, draw_weight: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Colley ratings of each league: C r = b with C = 2 + games on the diagonal; a draw adds half of draw_weight to both sides."""

    def solve(n, won, drawn, f, a):
        c = np.diag(2 + n.sum(1)) - n
        lost = n - won - drawn
        b = 1 + ((won - lost) / 2 + (drawn * draw_weight / 2 if include_draws else 0.0)).sum(1)
        return {"rating": np.linalg.solve(c, b)}

    return _solved(matches, home, away, home_goals, away_goals, by, "rating double", solve)


def massey(matches: DataFrame, home: str, away: str, home_goals: str, away_goals: str, by: Sequence[str] = ()) -> DataFrame:
    """Massey ratings of each league by least squares with a zero sum, and their offence and defence parts."""

    def solve(n, won, drawn, f, a):
        games, diff, scored = n.sum(1), (f - a).sum(1), f.sum(1)
        rating = np.linalg.lstsq(np.vstack([np.diag(games) - n, np.ones(len(n))]), np.append(diff, 0.0), rcond=None)[0]
        # (T + P) d = T r - f, with T the games and P the meetings
        defence = np.linalg.lstsq(np.diag(games) + n, games * rating - scored, rcond=None)[0]
        return {"rating": rating, "offence": rating - defence, "defence": defence}

    return _solved(matches, home, away, home_goals, away_goals, by, "rating double, offence double, defence double", solve)
