"""Research queries: labelled matches, the situation scan, false discovery control, event study."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from tallyfield.functions import implied, metrics
from tallyfield.warehouse.market import consensus
from tallyfield.warehouse.views import ONE_X_TWO, Warehouse, analytic_lineups, analytic_matches, day_steps, outcome

SELECTIONS = ("HOME", "DRAW", "AWAY")


def label_matches(w: Warehouse, precision: str = "PREMATCH") -> DataFrame:
    """Played matches with rest days, matches in eight days, points before, matchday, calendar and prices.

    Each match is unpivoted into its two appearances once; one shuffle by team serves all
    windows, and one pivot back by match replaces joins of the two roles.
    """
    r = w["match_results"].select("match_id", "goals_home", "goals_away")
    m = analytic_matches(w).select("match_id", "competition_id", "season_id", "kickoff_utc", "home_team_id", "away_team_id").join(r, "match_id")
    m = m.withColumn("outcome", outcome(F.col("goals_home"), F.col("goals_away")))
    points = lambda side: F.when(F.col("outcome") == side, 3).when(F.col("outcome") == "DRAW", 1).otherwise(0)
    row = lambda side: F.struct(F.lit(side).alias("side"), F.col(f"{side.lower()}_team_id").alias("team_id"), points(side).alias("points"))
    shown = m.select("match_id", "kickoff_utc", F.explode(F.array(row("HOME"), row("AWAY"))).alias("x")).select("match_id", "kickoff_utc", "x.*")
    order = W.partitionBy("team_id").orderBy("kickoff_utc", "match_id")
    by_time = W.partitionBy("team_id").orderBy(F.unix_micros(F.col("kickoff_utc").cast("timestamp"))).rangeBetween(-8 * 86_400_000_000, 0)
    timed = shown.select("match_id", "side", day_steps(F.col("kickoff_utc"), F.lag("kickoff_utc").over(order)).alias("rest_days"), F.count("*").over(by_time).alias("matches_8d"), F.coalesce(F.sum("points").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("points"), F.row_number().over(order).cast("long").alias("matchday"), F.count("*").over(W.partitionBy("team_id")).alias("season_length"))
    at = lambda side, c, name: F.max(F.when(F.col("side") == side, F.col(c))).alias(name)
    sides = timed.groupBy("match_id").agg(at("HOME", "rest_days", "home_rest_days"), at("AWAY", "rest_days", "away_rest_days"), at("HOME", "matches_8d", "home_matches_8d"), at("AWAY", "matches_8d", "away_matches_8d"), at("HOME", "points", "home_points"), at("AWAY", "points", "away_points"), at("HOME", "matchday", "home_matchday"), at("HOME", "season_length", "season_length"))
    books = F.broadcast(w["bookmakers"].filter("is_reference").select("bookmaker_id"))
    fair = w["fair_probabilities"].filter((F.col("market_type") == ONE_X_TWO) & (F.col("capture_precision") == precision)).join(books, "bookmaker_id", "left_semi")
    of = lambda s, c, name: F.max(F.when(F.col("selection") == s, F.col(c))).alias(name)
    prices = fair.groupBy("match_id", "bookmaker_id").agg(*[of(s, "fair_prob", f"p_{s.lower()}") for s in SELECTIONS], *[of(s, "raw_implied_prob", f"raw_{s.lower()}") for s in SELECTIONS]).filter("p_home IS NOT NULL AND p_draw IS NOT NULL AND p_away IS NOT NULL").drop("bookmaker_id")
    out = m.drop("goals_home", "goals_away", "home_team_id", "away_team_id").join(sides, "match_id").join(prices, "match_id")
    return out.withColumns({"dow": (F.dayofweek("kickoff_utc") - 1).cast("long"), "month": F.month("kickoff_utc").cast("long")})


# The family of situations, each a condition over labelled matches; {prob} is
# the selection's probability.  The last two fields say which price is used and whether
# matches are split for each selection apart.
HYPOTHESES: dict[str, tuple[str, str, bool]] = {
    "control_longshot_raw": ("{prob} < 0.12", "raw", True),
    "control_favourite_raw": ("{prob} > 0.60", "raw", True),
    "control_longshot_devigged": ("{prob} < 0.12", "p", True),
    "control_all_matches": ("TRUE", "p", False),
    "home_short_rest": ("home_rest_days <= 3", "p", False),
    "away_short_rest": ("away_rest_days <= 3", "p", False),
    "home_rest_advantage": ("home_rest_days - away_rest_days >= 3", "p", False),
    "away_rest_advantage": ("away_rest_days - home_rest_days >= 3", "p", False),
    "home_congested": ("home_matches_8d >= 3", "p", False),
    "away_congested": ("away_matches_8d >= 3", "p", False),
    "dead_rubber": ("home_matchday > season_length - 4 AND abs(home_points - away_points) < 8 AND home_points BETWEEN season_length AND season_length * 1.7", "p", False),
    "mismatch_late_season": ("home_matchday > season_length - 6 AND abs(home_points - away_points) >= 20", "p", False),
    "midweek": ("dow IN (2, 3, 4)", "p", False),
    "festive": ("month IN (12, 1)", "p", False),
    "season_opening": ("home_matchday <= 3", "p", False),
}


def scan(labelled: DataFrame, hypotheses: Mapping[str, tuple[str, str, bool]] = HYPOTHESES, least: int = 30) -> DataFrame:
    """For each situation and selection: mean residual inside and outside, their difference, its error, z and p.

    A residual is 1 or 0 for what came less the market's probability.  One pass explodes the
    matches into (selection, residual) and one aggregation serves all situations; the error of
    the difference is that of two independent means, to which a bootstrap of matches tends.
    """
    flags = {}
    for name, (condition, price, _) in hypotheses.items():
        for s in SELECTIONS:
            prob = f"{price}_{s.lower()}"
            flags[f"{name}|{s}"] = (F.coalesce(F.expr(condition.format(prob=prob)), F.lit(False)), (F.col("outcome") == s).cast("double") - F.col(prob))
    rows = labelled.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), inside.alias("inside"), residual.alias("r")) for k, (inside, residual) in flags.items()])).alias("x")).select("x.*")
    means = rows.groupBy("k").agg(*[x for tag, side in (("in", F.col("inside")), ("out", ~F.col("inside"))) for x in (F.count_if(side).alias(f"n_{tag}"), F.avg(F.when(side, F.col("r"))).alias(f"bias_{tag}"), F.var_samp(F.when(side, F.col("r"))).alias(f"_v_{tag}"))])
    out = means.filter((F.col("n_in") >= least) & (F.col("n_out") >= least))
    out = out.withColumns({"hypothesis": F.split("k", r"\|")[0], "selection": F.split("k", r"\|")[1], "delta": F.col("bias_in") - F.col("bias_out"), "se": F.sqrt(F.col("_v_in") / F.col("n_in") + F.col("_v_out") / F.col("n_out"))})
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("delta") / F.col("se")).otherwise(0.0))
    return out.withColumn("p_value", two_sided(F.col("z"))).withColumn("positive_control", F.col("hypothesis").startswith("control_")).drop("k", "_v_in", "_v_out")


def two_sided(z: Column) -> Column:
    """Two-sided p value of a normal deviate."""

    @pandas_udf("double")
    def erfc(x):
        return x.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))

    return erfc(z)


#: Bins of p values for each halving.
BINS = 64


def benjamini_hochberg(results: DataFrame, p: str = "p_value", q: float = 0.10, by: tuple[str, ...] = ()) -> DataFrame:
    """results with q_value and discovery, for families of any size; null p values have neither.

    Equal p values have one q value, so values are counted first.  They are ranked in bins
    of their logarithm (at most 1075 * BINS of them a family), and the bins' counts and least
    values are carried over from bin to bin: no task holds a family.
    """
    family = (F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)).alias("_family")
    named = results.select("*", family, F.col(p).cast("double").alias("_p"))
    bin_ = F.when(F.col("_p") <= 0, F.lit(-1076 * BINS)).otherwise(-F.floor(-F.log2("_p") * BINS)).cast("long")
    values = named.filter("_p IS NOT NULL").groupBy("_family", "_p").agg(F.count("*").alias("_n")).withColumn("_bin", bin_)
    of = W.partitionBy("_family").orderBy("_bin")
    bins = values.groupBy("_family", "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.select("_family", "_bin", (F.sum("_n").over(of) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy("_family")).alias("_m"))
    own = W.partitionBy("_family", "_bin").orderBy("_p")
    ranked = values.join(bins, ["_family", "_bin"]).withColumn("_rank", F.col("_before") + F.sum("_n").over(own)).withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank"))
    after = ranked.groupBy("_family", "_bin").agg(F.min("_v").alias("_v")).select("_family", "_bin", F.min("_v").over(W.partitionBy("_family").orderBy("_bin").rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    last = ranked.groupBy("_family").agg(F.max(F.when(F.col("_p") <= F.lit(q) * F.col("_rank") / F.col("_m"), F.col("_rank"))).alias("_last"))
    least = F.least(F.lit(1.0), F.min("_v").over(own.rowsBetween(0, W.unboundedFollowing)), F.col("_after"))
    judged = ranked.join(after, ["_family", "_bin"]).join(last, "_family").select("_family", "_p", least.alias("q_value"), F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False)).alias("discovery"))
    return named.join(judged, ["_family", "_p"], "left").select(*[F.col(f"`{c}`") for c in results.columns], "q_value", "discovery")


# --- event study ----------------------------------------------------------------------


def require_timestamped(w: Warehouse) -> None:
    """An event study without instants measures nothing: raise."""
    if not w["odds_observations"].filter("capture_precision = 'TIMESTAMPED' AND captured_at IS NOT NULL").limit(1).count():
        raise RuntimeError("no timestamped odds: an event study needs prices with instants")
    if w["lineups"].filter("published_at IS NULL").limit(1).count():
        raise RuntimeError("a lineup has no publication instant")


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(p / (1 - p))


def measure_windows(w: Warehouse, seconds: float = 2700, market: str = ONE_X_TWO, bookmaker: str | None = None) -> DataFrame:
    """Moves in log-odds before and after a match's first lineup, within a window."""
    require_timestamped(w)
    first = analytic_lineups(w).groupBy("match_id").agg(F.min("published_at").alias("t"))
    o = w["odds_observations"].filter((F.col("capture_precision") == "TIMESTAMPED") & (F.col("market_type") == market))
    o = o if bookmaker is None else o.filter(F.col("bookmaker_id") == bookmaker)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = o.select("match_id", "selection", "captured_at", "price_decimal").join(first, "match_id").filter(F.abs(micros("captured_at") - micros("t")) <= round(seconds * 1e6))
    before = F.col("captured_at") < F.col("t")
    pick = lambda f, side: f("price_decimal", F.when(side, F.col("captured_at")))
    out = near.groupBy("match_id", "selection").agg(pick(F.min_by, before).alias("pre_first"), pick(F.max_by, before).alias("pre_last"), pick(F.min_by, ~before).alias("post_first"), pick(F.max_by, ~before).alias("post_last"))
    out = out.dropna(subset=["pre_first", "pre_last", "post_first", "post_last"])
    moved = lambda a, b: logit(1 / F.col(b)) - logit(1 / F.col(a))
    out = out.withColumns({"pre_move": moved("pre_first", "pre_last"), "post_move": moved("post_first", "post_last")})
    return out.withColumn("did", F.col("post_move") - F.col("pre_move")).drop("pre_first", "pre_last", "post_first", "post_last")


def difference_in_differences(windows: DataFrame, categories: DataFrame) -> DataFrame:
    """For each category: mean absolute double difference of treated matches less that of matches without news.

    `categories` has (match_id, category), with a row for every category of a match but none.
    """
    treated = windows.join(categories, "match_id").groupBy("category").agg(F.count("*").alias("n_treated"), F.avg(F.abs("did")).alias("treated_did"), F.var_samp(F.abs("did")).alias("_vt"))
    control = windows.join(categories.select("match_id").distinct(), "match_id", "left_anti").agg(F.count("*").alias("n_control"), F.avg(F.abs("did")).alias("control_did"), F.var_samp(F.abs("did")).alias("_vc"))
    out = treated.crossJoin(F.broadcast(control)).filter("n_treated > 1 AND n_control > 1")  # one row on the right
    out = out.withColumns({"effect": F.col("treated_did") - F.col("control_did"), "se": F.sqrt(F.col("_vt") / F.col("n_treated") + F.col("_vc") / F.col("n_control"))})
    out = out.withColumn("z", F.when(F.col("se") > 0, F.col("effect") / F.col("se")).otherwise(0.0))
    return out.withColumn("p_value", two_sided(F.col("z"))).drop("_vt", "_vc")


# What a position weighs in a formation shock.
POSITION_WEIGHT = {"GOALKEEPER": 1.0, "DEFENDER": 0.6, "MIDFIELDER": 0.5, "FORWARD": 0.8}


def formation_shock(absences: DataFrame, by: str = "match_id", eleven: int = 11) -> DataFrame:
    """Weighted gap between absent players and their replacements, and the kinds of news it makes."""
    position, share = F.col("position"), F.coalesce("start_share", F.lit(0.0))
    weight = F.coalesce(*[F.when(position == k, v) for k, v in POSITION_WEIGHT.items()], F.lit(0.5))
    gap = F.greatest(share - F.coalesce("replacement_share", F.lit(0.0)), F.lit(0.0))
    out = absences.groupBy(by).agg(F.sum(weight * gap).alias("shock"), F.count("*").alias("n_absent"), F.bool_or(position == "GOALKEEPER").alias("_g"), F.bool_or((position == "FORWARD") & (share >= 0.6)).alias("_f"), F.bool_or((position == "DEFENDER") & (share >= 0.6)).alias("_d"))
    kinds = F.filter(F.array(F.when(F.col("_g"), "GOALKEEPER_OUT"), F.when(F.col("_f"), "KEY_FORWARD_OUT"), F.when(F.col("_d"), "KEY_DEFENDER_OUT"), F.when(F.col("n_absent") >= 3, "MULTIPLE_ABSENCES"), F.when(F.col("n_absent") >= eleven // 2, "SURPRISE_XI")), lambda x: x.isNotNull())
    return out.select(by, "shock", "n_absent", F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("NONE"))).alias("categories"))


# --- measurements of the analysis scripts ---------------------------------------------


def cells(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, error, t and p of a value in each cell."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se"))).withColumn("p_value", two_sided(F.col("t")))


def price_band(price: Column, edges: tuple[float, ...] = (1.5, 2.0, 3.0, 5.0, 10.0)) -> Column:
    out = F.lit(f"{edges[-1]:g}+")
    for low, high in reversed(list(zip((1.0, *edges[:-1]), edges, strict=True))):
        out = F.when(price < high, F.lit(f"{low:g}-{high:g}")).otherwise(out)
    return out


def calibration_error(rows: DataFrame, by: list[str], prob: str, won: str, bands: int = 10) -> DataFrame:
    """Mean absolute gap between forecast and frequency over bands of probability, weighted by rows."""
    band = F.least(F.floor(F.col(prob) * bands), F.lit(bands - 1))
    per = rows.groupBy(*by, band.alias("_b")).agg(F.count("*").alias("_n"), F.abs(F.avg(prob) - F.avg(F.col(won).cast("double"))).alias("_gap"))
    return per.groupBy(*by).agg((F.sum(F.col("_gap") * F.col("_n")) / F.sum("_n")).alias("calibration_error"), F.sum("_n").alias("n"))


def brier_skill(rows: DataFrame, by: list[str], prob: str, won: str) -> DataFrame:
    """1 - Brier / Brier of the group's base rate."""
    y = F.col(won).cast("double")
    out = rows.groupBy(*by).agg(F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier"), F.avg(y).alias("_r"))
    return out.withColumn("skill", 1 - F.col("brier") / F.nullif(F.col("_r") * (1 - F.col("_r")), F.lit(0.0))).drop("_r")


def net_price(price: Column, commission: float) -> Column:
    return 1 + (price - 1) * (1 - commission)


def evidence_class(edge: Column, null_edge: Column, n_books: Column, aged: Column) -> Column:
    """A to D: beyond ordinary disagreement with enough books and fresh prices, down to no evidence."""
    return F.when(edge.isNull() | (n_books < 3), "D").when((edge > null_edge) & (n_books >= 5) & ~aged, "A").when((edge > null_edge) & ~aged, "B").when(edge > 0, "C").otherwise("D")


#: Blocks of distinct values that tasks deal apart.
BLOCKS = 64


def _split(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` rows drawn from groups of sizes left (draws, groups) come from each group, in every draw."""
    out = np.zeros_like(left)
    rest, take = left.sum(1), np.full(len(left), take, np.int64)
    for g in range(left.shape[1]):
        rest = rest - left[:, g]
        out[:, g] = rng.hypergeometric(left[:, g], rest, take)
        take = take - out[:, g]
    return out


def _share(seed: int, block: int, totals: np.ndarray, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Rows of each group in a block (draws, groups): the rows are halved down a tree of blocks, each node seeded by itself, so every task finds the same numbers on its way down."""
    left, low, high, node = np.tile(sizes, (draws, 1)), 0, len(totals), 1
    while high - low > 1:
        middle = (low + high) // 2
        first = _split(np.random.Generator(np.random.Philox(key=[seed, node])), left, int(totals[low:middle].sum()))
        if block < middle:
            left, high, node = first, middle, 2 * node
        else:
            left, low, node = left - first, middle, 2 * node + 1
    return left


def permutation_test(rows: DataFrame, group: str, value: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """(observed, p_value): spread of group means against that of shuffled groups.

    Every draw keeps the sizes of the groups and the copies of each value: the rows of all groups are
    split down a tree of blocks of values, then value by value, by multivariate hypergeometric
    numbers.  Equal values are counted first and blocks are dealt by a hash of the value, so the
    result does not depend on how rows lie; a block sends on one sum a draw and group.  The
    spread is the variance of group means weighted by size.  Fewer than 1e9 rows.
    """
    known = rows.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    own = known.groupBy("_g").agg(F.count("*").alias("_n"), F.avg("_v").alias("_m"))
    spread = (F.sum(F.col("_n") * F.col("_m") * F.col("_m")) / F.sum("_n") - F.pow(F.sum(F.col("_n") * F.col("_m")) / F.sum("_n"), F.lit(2.0))).alias("spread")
    observed = own.agg(spread).first()["spread"]
    sizes = np.array([r["_n"] for r in own.orderBy("_g").select("_n").collect()], np.int64)  # a row a group
    counted = known.groupBy("_v").agg(F.count("*").alias("_c")).withColumn("_b", F.pmod(F.xxhash64("_v"), F.lit(BLOCKS)).cast("int"))
    totals = np.zeros(BLOCKS, np.int64)
    for r in counted.groupBy("_b").agg(F.sum("_c").alias("_n")).collect():  # a row a block
        totals[r["_b"]] = r["_n"]
    if totals.sum() >= 1_000_000_000:
        raise ValueError("hypergeometric numbers are drawn from fewer than 1e9 rows")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_b"].iloc[0])
        left = _share(seed, block, totals, sizes, draws)
        rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 32) + block]))
        total = np.zeros(left.shape)
        for v, c in pdf.sort_values("_v")[["_v", "_c"]].itertuples(index=False):
            dealt = _split(rng, left, int(c))
            left = left - dealt
            total += v * dealt
        return pd.DataFrame({"_d": np.repeat(np.arange(draws), len(sizes)), "_k": np.tile(np.arange(len(sizes)), draws), "_n": np.tile(sizes, draws).astype(float), "_t": total.ravel()})

    dealt = counted.groupBy("_b").applyInPandas(deal, "_d int, _k int, _n double, _t double").groupBy("_d", "_k").agg(F.max("_n").alias("_n"), F.sum("_t").alias("_t")).filter("_n > 0")
    drawn = dealt.withColumn("_m", F.col("_t") / F.col("_n")).groupBy("_d").agg(spread)
    return drawn.agg(F.lit(observed).alias("observed"), ((F.count_if(F.col("spread") >= observed - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def bootstrap_errors(labelled: DataFrame, hypotheses: Mapping[str, tuple[str, str, bool]] = HYPOTHESES, key: str = "match_id", draws: int = 1000, seed: int = 1) -> DataFrame:
    """(hypothesis, selection, se): deviation of `scan`'s difference over resampled matches.

    A match weighs a Poisson(1) number in each draw, seeded by its key; a task sends on the
    weighted sums of its matches.
    """
    names, flags = [], []
    for name, (condition, price, _) in hypotheses.items():
        for s in SELECTIONS:
            prob = f"{price}_{s.lower()}"
            names.append((name, s))
            flags.append(F.struct(F.coalesce(F.expr(condition.format(prob=prob)), F.lit(False)).alias("i"), ((F.col("outcome") == s).cast("double") - F.col(prob)).alias("r")))
    rows = labelled.select(F.xxhash64(key).alias("h"), F.transform(F.array(*flags), lambda x: x["i"]).alias("i"), F.transform(F.array(*flags), lambda x: x["r"]).alias("r"))

    def resample(batches):
        sums = np.zeros((2, 2, len(names), draws))  # inside or not, weight or weighted residual
        for pdf in batches:
            for h, i, r in zip(pdf["h"], pdf["i"], pdf["r"], strict=True):
                w = np.random.Generator(np.random.Philox(key=[seed, int(np.int64(h).view(np.uint64))])).poisson(1.0, draws)
                inside, known = np.asarray(i, bool), np.asarray(r, float)
                for side in (0, 1):
                    at = (inside == bool(side)) & ~np.isnan(known)
                    sums[side, 0, at] += w
                    sums[side, 1, at] += known[at][:, None] * w
        yield pd.DataFrame({"k": np.repeat(np.arange(len(names)), draws), "d": np.tile(np.arange(draws), len(names)), **{c: sums[side, what].ravel() for c, side, what in (("n1", 1, 0), ("t1", 1, 1), ("n0", 0, 0), ("t0", 0, 1))}})

    drawn = rows.mapInPandas(resample, "k int, d int, n1 double, t1 double, n0 double, t0 double").groupBy("k", "d").agg(*[F.sum(c).alias(c) for c in ("n1", "t1", "n0", "t0")])
    se = drawn.filter("n1 > 0 AND n0 > 0").groupBy("k").agg(F.stddev_samp(F.col("t1") / F.col("n1") - F.col("t0") / F.col("n0")).alias("se"))
    of = lambda j: F.get(F.array(*[F.lit(x[j]) for x in names]), F.col("k"))
    return se.select(of(0).alias("hypothesis"), of(1).alias("selection"), "se")


def market_channel(w: Warehouse, market: str = ONE_X_TWO, moved: float = 0.01) -> DataFrame:
    """What the way from the price before the match to the closing one brings: scores of both, their gain, and how far prices move.

    One row over the reference bookmaker's matches with a result; a negative gain means that
    the closing price knows more.
    """
    books = w["bookmakers"].filter("is_reference").select("bookmaker_id")
    fair = w["fair_probabilities"].filter(F.col("market_type") == market).join(F.broadcast(books), "bookmaker_id")  # a reference bookmaker or two
    pick = lambda p, s: F.max(F.when((F.col("capture_precision") == p) & (F.col("selection") == s), F.col("fair_prob")))
    wide = fair.groupBy("match_id").agg(*[F.array(*[pick(p, s) for s in SELECTIONS]).alias(n) for p, n in (("PREMATCH", "pre"), ("CLOSING", "close"))])
    wide = wide.filter(~F.exists(F.concat("pre", "close"), lambda x: x.isNull()))
    result = F.when(F.col("goals_home") > F.col("goals_away"), 0).when(F.col("goals_home") == F.col("goals_away"), 1).otherwise(2)
    rows = wide.join(analytic_matches(w).select("match_id"), "match_id").join(w["match_results"].select("match_id", result.alias("y")), "match_id")
    rows = rows.withColumn("move", F.array_max(F.zip_with("pre", "close", lambda a, b: F.abs(a - b))))
    score = {"brier": lambda p: metrics.brier(p, F.col("y")) / F.size(p), "logloss": lambda p: metrics.log_loss(p, F.col("y")), "rps": lambda p: metrics.rps(p, F.col("y"))}
    out = [F.count("*").alias("n"), F.median("move").alias("median_move"), F.avg("move").alias("mean_move"), F.avg((F.col("move") > moved).cast("double")).alias("share_moved")]
    for name, f in score.items():
        out += [F.avg(f(F.col("pre"))).alias(f"pre_{name}"), F.avg(f(F.col("close"))).alias(f"close_{name}"), F.avg(f(F.col("close")) - f(F.col("pre"))).alias(f"{name}_gain")]
    return rows.agg(*out)


def two_way_clv(rows: DataFrame, market: str, books: Mapping[str, tuple[str, str]], closing: tuple[str, str], selections: tuple[str, str], method: str = "shin", absurd: float = 0.5) -> DataFrame:
    """(market, book, selection, price, clv) of a two-way market in a wide table: prices against the fair closing ones; values beyond `absurd` are errors of the source."""
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    close = F.array(*[number(c) for c in closing])
    good = rows.filter(F.forall(close, lambda x: F.coalesce(x > 1, F.lit(False))))
    quotes = [F.struct(F.lit(b).alias("book"), F.lit(s).alias("selection"), F.lit(k).alias("k"), number(pair[k]).alias("price"), F.least(*[F.coalesce(number(c), F.lit(0.0)) for c in pair]).alias("least")) for b, pair in books.items() for k, s in enumerate(selections)]
    out = good.withColumn("_fair", implied.probabilities(close, method)).withColumn("_q", F.explode(F.array(*quotes))).filter("_q.least > 1")
    out = out.select(*rows.columns, F.lit(market).alias("market"), F.col("_q.book").alias("book"), F.col("_q.selection").alias("selection"), F.col("_q.price").alias("price"), (F.get("_fair", F.col("_q.k")) * F.col("_q.price") - 1).alias("clv"))
    return out.filter(F.abs("clv") <= absurd)


def last_days(quotes: DataFrame, closing: DataFrame, results: DataFrame, today: Column, days: int = 3, least_books: int = 5, method: str = "shin") -> DataFrame:
    """The best prices of matches played in the last days against the other books' consensus, with what closing prices and results made of them.

    quotes (match_id, bookmaker_id, odds), closing (match_id, odds), results (match_id, day, outcome as a place of the odds).
    """
    recent = results.filter(F.col("day") >= F.date_sub(today, days))
    seen = consensus(quotes.join(recent.select("match_id"), "match_id", "left_semi"), method=method).filter(F.col("n_books") >= least_books)
    fair = closing.select("match_id", implied.probabilities(F.col("odds"), method).alias("_close"))
    out = seen.join(recent, "match_id").join(fair, "match_id", "left")
    return out.select("match_id", "day", "place", "n_books", "fair", "best_book", "best_price", F.col("edge_vs_consensus").alias("edge"), (F.get("_close", F.col("place")) * F.col("best_price") - 1).alias("clv"), (F.col("outcome") == F.col("place")).alias("won"))
