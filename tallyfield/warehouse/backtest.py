"""Backtests: candidates are SQL, the ledger is a fold of one run in one task.

What a run can stake depends on every bet before, so a run is sequential; runs (strategies,
settings, leagues) are groups and go side by side.  Spark sorts a run's candidates and the fold
reads them in batches; what it keeps is the open bets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_DOWN, Context, Decimal, localcontext
from itertools import groupby, islice
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyfield.functions.markets import settle_bet
from tallyfield.shared import written
from tallyfield.warehouse.views import ONE_X_TWO, QUOTE, Warehouse, analytic_matches, expected_value

CANDIDATE = ["kickoff_utc", *QUOTE, "price", "price_precision", "model_prob", "rank"]


@dataclass(frozen=True)
class Frictions:
    """What a stake loses on its way: commission on winnings, increments, limits and slippage."""

    commission_rate: float = 0.0
    stake_increment: Decimal = Decimal("0.01")
    min_stake: Decimal = Decimal("0.50")
    max_stake: Decimal | None = None
    slippage: float = 0.0

    def round_stake(self, stake: Decimal) -> Decimal:
        if stake <= 0:
            return Decimal(0)
        out = stake // self.stake_increment * self.stake_increment
        if self.max_stake is not None:
            out = min(out, self.max_stake)
        return out if out >= self.min_stake else Decimal(0)

    def price(self, quoted: float) -> float:
        return max(1 + (quoted - 1) * (1 - self.slippage), 1.0000001) if self.slippage > 0 else quoted

    def commission(self, profit: Decimal) -> Decimal:
        if profit <= 0 or self.commission_rate <= 0:
            return Decimal(0)
        return (profit * Decimal(str(self.commission_rate))).quantize(Decimal("0.000001"), ROUND_DOWN)


@dataclass(frozen=True)
class Config:
    initial_bankroll: Decimal = Decimal("1000")
    stake_fraction: float = 0.01
    max_exposure: float = 0.25
    policy: str = "pro_rata"
    settlement_lag_seconds: int = 7200
    stop_at_ruin: bool = True
    ruin_threshold: Decimal = Decimal(0)
    frictions: Frictions = Frictions()


# --- strategies: DataFrames of candidates ---------------------------------------------


def with_priced(w: Warehouse, precision: str = "PREMATCH") -> Warehouse:
    """w with its priced candidates joined once, for several strategies: a union of strategies that each join them would sort all matches as often in one task."""
    return {**w, f"priced_{precision}": written(_priced(w, precision))}


def _priced(w: Warehouse, precision: str) -> DataFrame:
    if f"priced_{precision}" in w:
        return w[f"priced_{precision}"]
    m = analytic_matches(w).select("match_id", "kickoff_utc")
    o = w["odds_observations"].filter(F.col("capture_precision") == precision)
    return o.join(m, "match_id").select("kickoff_utc", *QUOTE, F.col("price_decimal").alias("price"), F.col("capture_precision").alias("price_precision"), F.lit(None).cast("double").alias("model_prob"))


def take_selection(w: Warehouse, selection: str, precision: str = "PREMATCH", market: str = ONE_X_TWO) -> DataFrame:
    return _priced(w, precision).filter((F.col("selection") == selection) & (F.col("market_type") == market)).withColumn("rank", F.lit(0.0))


def favourite(w: Warehouse, precision: str = "PREMATCH", market: str = ONE_X_TWO) -> DataFrame:
    """The shortest price of each bookmaker's market; of equal ones the first by name."""
    own = W.partitionBy("match_id", "bookmaker_id", "line").orderBy("price", "selection")
    return _priced(w, precision).filter(F.col("market_type") == market).withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n").withColumn("rank", 1 / F.col("price"))


def oracle(w: Warehouse, precision: str = "PREMATCH") -> DataFrame:
    """What wins: an instrument to check the engine with, not a strategy."""
    r = w["match_results"].select("match_id", "goals_home", "goals_away")
    won = settle_bet(F.col("market_type"), F.col("line"), F.col("selection"), F.col("goals_home"), F.col("goals_away")) == "WIN"
    return _priced(w, precision).join(r, "match_id").filter(won).drop("goals_home", "goals_away").withColumn("rank", F.col("price"))


def model_edge(w: Warehouse, least: float = 0.02, precision: str = "PREMATCH", model_name: str | None = None) -> DataFrame:
    """Prices worth more than `least` under the freshest fit that was trained before the kickoff."""
    runs = w["model_runs"].select("model_run_id", "model_name", "trained_through")
    runs = runs if model_name is None else runs.filter(F.col("model_name") == model_name)
    p = w["predictions"].join(runs, "model_run_id").join(analytic_matches(w).select("match_id", "kickoff_utc"), "match_id").filter(F.col("trained_through") <= F.col("kickoff_utc"))
    fresh = p.groupBy("match_id", "market_type", "line", "selection").agg(*[F.max_by(c, F.struct("trained_through", "model_run_id")).alias(c) for c in ("prob_win", "prob_half_win", "prob_half_lose", "prob_lose")])
    out = _priced(w, precision).drop("model_prob").join(fresh, ["match_id", "market_type", "line", "selection"])
    edge = expected_value(F.col("prob_win"), F.col("prob_half_win"), F.col("prob_half_lose"), F.col("prob_lose"), F.col("price"))
    return out.withColumn("rank", edge).filter(F.col("rank") > least).select("kickoff_utc", *QUOTE, "price", "price_precision", F.col("prob_win").alias("model_prob"), "rank")


def deduplicated(candidates: DataFrame) -> DataFrame:
    """One candidate for each quote and kickoff, the one of the best rank."""
    own = W.partitionBy("kickoff_utc", *QUOTE).orderBy(F.desc("rank"), F.desc("price"))
    return candidates.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


#: Blocks of rows that tasks resample apart.
BLOCKS = 64


# --- the ledger -----------------------------------------------------------------------

BETS = "run_id string, kickoff_utc timestamp, match_id string, bookmaker_id string, market_type string, line double, selection string, price_taken double, price_precision string, model_prob double, stake decimal(38,6), outcome string, returned decimal(38,6), commission decimal(38,6), pnl decimal(38,6), settled_at timestamp, equity_open decimal(38,6), constrained boolean, drawdown double"
AMOUNT = "decimal(38,6)"
AMOUNTS = [x.split()[0] for x in BETS.split(", ") if x.endswith(AMOUNT)]
#: Digits of products and whole quotients of amounts; they take memory only as far as an amount has them, so that amounts of any size are exact.
DIGITS = 1_000_000
#: For a drawdown, which is a double.
ROUGH = Context(prec=60)
#: Bets that leave the fold together.
PAGE = 2_000

_RETURN = {"WIN": lambda p: p, "HALF_WIN": lambda p: 1 + (p - 1) / 2, "PUSH": lambda p: 1.0, "VOID": lambda p: 1.0, "HALF_LOSE": lambda p: 0.5, "LOSE": lambda p: 0.0}


def _grant(asked: list[Decimal], available: Decimal, policy: str, rank: list[float]) -> tuple[list[Decimal], bool]:
    cent = lambda x: x.quantize(Decimal("0.01"), ROUND_DOWN)
    total = sum(asked, Decimal(0))
    if total <= available:
        return [cent(x) for x in asked], False
    if policy == "reject":
        return [Decimal(0)] * len(asked), True
    if policy == "pro_rata":
        return [(x * available * 100 // total).scaleb(-2) for x in asked], True
    out = [Decimal(0)] * len(asked)
    for k in sorted(range(len(asked)), key=lambda i: -rank[i]):
        out[k] = cent(min(asked[k], available)) if available > 0 else Decimal(0)
        available -= out[k]
    return out, True


def _settled(rows: Iterable, config: Config) -> Iterator[dict]:
    """The bets of one run whose candidates come in order of kickoff and quote: settle what is due, size the cohort, stake.  To be read with DIGITS digits."""
    lag, f = pd.Timedelta(seconds=config.settlement_lag_seconds), config.frictions
    cash = peak = Decimal(config.initial_bankroll)
    exposure = Decimal(0)
    open_bets: deque[dict] = deque()  # all are due one lag after their kickoff, so in the order in which they were placed

    def settle(at: pd.Timestamp | None) -> Iterator[dict]:
        nonlocal cash, peak, exposure
        while open_bets and (at is None or open_bets[0]["due"] <= at):
            b = open_bets.popleft()
            exposure -= b["stake"]
            known = b["state"] if not pd.isna(b["state"]) and (at is None or b["known"] <= at) else "VOID"
            returned = (b["stake"] * Decimal(str(_RETURN[known](b["price_taken"])))).quantize(Decimal("0.000001"), ROUND_DOWN)
            fee = f.commission(returned - b["stake"])
            cash += returned - fee
            peak = max(peak, cash + exposure)
            b |= {"outcome": known, "returned": returned, "commission": fee, "pnl": returned - b["stake"] - fee, "settled_at": at if at is not None else b["due"]}
            b["drawdown"] = float(ROUGH.divide(peak - cash - exposure, peak)) if peak > 0 else 0.0
            yield b

    for at, rows_at in groupby(rows, attrgetter("kickoff_utc")):
        yield from settle(at)
        equity = cash + exposure
        if config.stop_at_ruin and equity <= config.ruin_threshold:
            break
        cohort = list(rows_at)
        available = max(equity * Decimal(str(config.max_exposure)) - exposure, Decimal(0))
        asked = [f.round_stake(equity * Decimal(str(config.stake_fraction)))] * len(cohort)
        granted, constrained = _grant(asked, available, config.policy, [r.rank for r in cohort])
        for stake, r in zip(granted, cohort, strict=True):
            stake = f.round_stake(stake)
            if stake <= 0 or stake > cash:
                continue
            cash -= stake
            exposure += stake
            open_bets.append({"run_id": r.run_id, "kickoff_utc": at, **{k: getattr(r, k) for k in QUOTE}, "price_taken": f.price(r.price), "price_precision": r.price_precision, "model_prob": r.model_prob, "stake": stake, "state": r.state, "known": r.settled_at, "due": at + lag, "equity_open": equity, "constrained": constrained})
    yield from settle(None)


def fold_run(rows: pd.DataFrame, config: Config) -> pd.DataFrame:
    """The bets of one run."""
    rows = rows[rows["kickoff_utc"].notna()].sort_values(["kickoff_utc", *QUOTE], kind="stable")
    with localcontext(prec=DIGITS):
        return pd.DataFrame(list(_settled(rows.itertuples(index=False), config)))


def run(w: Warehouse, candidates: DataFrame, config: Config = Config(), run_id: str | Column = "run", text: bool = False) -> DataFrame:
    """The settled bets of each run of the candidates (a column run_id splits them).

    Amounts are AMOUNT, and one beyond it is an error; with `text` they are text with six digits after the point, of any size (see `fitted`).
    """
    rows = candidates if "run_id" in candidates.columns else candidates.withColumn("run_id", F.lit(run_id) if isinstance(run_id, str) else run_id)
    own = W.partitionBy("run_id", "kickoff_utc", *QUOTE).orderBy(F.desc("rank"), F.desc("price"))
    rows = rows.filter(F.col("kickoff_utc").isNotNull()).withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")
    r = w["match_results"].select("match_id", "goals_home", "goals_away", "settled_at")
    state = settle_bet(F.col("market_type"), F.col("line"), F.col("selection"), F.col("goals_home"), F.col("goals_away"))
    rows = rows.join(r, "match_id", "left").withColumn("state", state).drop("goals_home", "goals_away")
    names = [x.split()[0] for x in BETS.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = (r for pdf in batches for r in pdf.itertuples(index=False))
        bets = (b for _, own in groupby(read, lambda r: None if pd.isna(r.run_id) else r.run_id) for b in _settled(own, config))
        while True:
            with localcontext(prec=DIGITS):
                page = [{c: b[c] for c in names} for b in islice(bets, PAGE)]
                if text:
                    page = [b | {c: f"{b[c]:.6f}" for c in AMOUNTS} for b in page]
            if not page:
                return
            yield pd.DataFrame(page, columns=names)

    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", *[F.asc_nulls_last(c) for c in ("kickoff_utc", *QUOTE)])
    return ordered.mapInPandas(fold, BETS.replace(AMOUNT, "string") if text else BETS)


def fitted(bets: DataFrame) -> DataFrame:
    """Bets with amounts as text, with amounts as AMOUNT if that holds all of them; where a run compounds beyond, they stay text, exact to the last digit.

    The bets are written first, as their amounts tell the type.
    """
    bets = written(bets)
    beyond = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(AMOUNT).isNull()) for c in AMOUNTS]
    fits = not any(bets.agg(*beyond).first())
    return bets.withColumns({c: F.col(c).cast(AMOUNT) for c in AMOUNTS}) if fits else bets


def metrics(bets: DataFrame, initial: Decimal | float = 1000) -> DataFrame:
    """Per run: turnover, profit, yield, growth, win rate, Sharpe ratio of bet returns, deepest drawdown."""
    ret = F.col("pnl").cast("double") / F.nullif(F.col("stake").cast("double"), F.lit(0.0))
    out = bets.groupBy("run_id").agg(F.count("*").alias("n_bets"), F.sum(F.col("stake").cast("double")).alias("turnover"), F.sum(F.col("pnl").cast("double")).alias("pnl"), F.avg(F.col("outcome").isin("WIN", "HALF_WIN").cast("double")).alias("win_rate"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.max("drawdown").alias("max_drawdown"))
    return out.withColumns({"yield_on_turnover": F.col("pnl") / F.nullif("turnover", F.lit(0.0)), "growth": F.col("pnl") / F.lit(float(initial)), "sharpe": F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt("n_bets")).otherwise(0.0)}).drop("_m", "_s")


def bootstrap_mean(df: DataFrame, by: Iterable[str], value: str, draws: int = 1000, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a mean by the Poisson bootstrap.

    Every row weighs a Poisson(1) number in each draw, so c equal rows weigh a Poisson(c) number.
    Equal rows are counted first and dealt to blocks by a hash; a block draws all its numbers from
    one generator, in order of its rows, and sends on two sums a group and draw.  The result
    does not depend on how rows lie.
    """
    keys = list(by)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_weights", T.ArrayType(T.DoubleType()))])
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_v", *keys), F.lit(BLOCKS)).cast("int"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.Generator(np.random.Philox(key=[seed, int(pdf["_b"].iloc[0])]))
        pdf = pdf.sort_values([*keys, "_v"], kind="stable").reset_index(drop=True)
        out = []
        for key, own in pdf.groupby(keys, dropna=False, sort=True) if keys else [((), pdf)]:
            sums = np.zeros((2, draws))
            for low in range(0, len(own), 1000):
                v, c = (own[x].to_numpy(float)[low : low + 1000] for x in ("_v", "_c"))
                w = rng.poisson(c[:, None], (len(c), draws))
                sums += np.stack([v @ w, w.sum(0)])
            out.append((*(key if isinstance(key, tuple) else (key,)), sums[0].tolist(), sums[1].tolist()))
        return pd.DataFrame(out, columns=schema.names)

    parts = rows.groupBy("_b").applyInPandas(resample, schema).select(*keys, F.posexplode(F.arrays_zip("_sums", "_weights")).alias("_d", "_x"))
    means = parts.groupBy(*keys, "_d").agg((F.sum("_x._sums") / F.nullif(F.sum("_x._weights"), F.lit(0.0))).alias("_m"))
    return means.groupBy(*keys).agg(F.percentile("_m", F.lit(alpha / 2)).alias("low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("high"), F.stddev_samp("_m").alias("se"))
