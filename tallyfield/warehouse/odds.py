"""Closing lines, fair probabilities and closing line value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions import implied
from tallyfield.warehouse.views import MARKET, ONE_X_TWO, QUOTE, Warehouse, reference_market, unit_steps

#: A closing price taken from a path is trusted if it is at most so old at kickoff.
STALE_SECONDS = 6 * 3600
#: Selections of a complete market.
COMPLETE = {ONE_X_TWO: 3, "BTTS": 2, "TOTALS": 2, "ASIAN_HANDICAP": 2, "DOUBLE_CHANCE": 3}

ODDS_JSON = "array<struct<bookmaker:string,market_type:string,line:double,selection:string,price_decimal:double,capture_precision:string,captured_at:timestamp>>"


def observations_from_json(bronze: DataFrame, column: str = "odds_json") -> DataFrame:
    """One row for each quote in a bronze row's JSON list; prices of 1 or less and unreadable lists give none."""
    rows = bronze.withColumn("_quotes", F.from_json(F.col(column), ODDS_JSON)).select("*", F.explode("_quotes").alias("_q"))
    out = rows.select(*[c for c in bronze.columns if c != column], "_q.*").filter("price_decimal > 1")
    stamped = F.col("capture_precision") == "TIMESTAMPED"
    return out.withColumn("observation_id", F.substring(F.sha2(F.concat_ws("|", "source", "source_id", "bookmaker", "market_type", F.col("line").cast("string"), "selection", "capture_precision", F.coalesce(F.col("captured_at").cast("string"), F.lit(""))), 256), 1, 32)).withColumn("captured_at", F.when(stamped, F.col("captured_at")))


def materialise_closing(w: Warehouse, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """A closing price for each quote: the declared one, else the last timestamped one before kickoff."""
    o = w["odds_observations"]
    declared = o.filter("capture_precision = 'CLOSING'").select(*QUOTE, "price_decimal", "observation_id", F.lit("DECLARED").alias("closing_basis"), F.lit(None).cast("long").alias("seconds_to_kickoff"), F.lit(True).alias("is_trusted"))
    path = o.filter("capture_precision = 'TIMESTAMPED' AND (observed_before IS NULL OR captured_at <= observed_before)").join(declared.select(*QUOTE).distinct(), QUOTE, "left_anti")
    last = path.groupBy(*QUOTE).agg(F.max_by("price_decimal", "captured_at").alias("price_decimal"), F.max_by("observation_id", "captured_at").alias("observation_id"), F.max("captured_at").alias("_at"), F.any_value("observed_before", True).alias("_kickoff"))
    gap = unit_steps("second", F.col("_kickoff"), F.col("_at"))
    return declared.unionByName(last.select(*QUOTE, "price_decimal", "observation_id", F.lit("LATEST").alias("closing_basis"), gap.alias("seconds_to_kickoff"), (gap <= stale_seconds).alias("is_trusted")))


def fair_probabilities(observations: DataFrame, method: str = "shin") -> DataFrame:
    """Fair probabilities of complete markets; a market that lacks a selection is left out, never normalised."""
    keys = ["match_id", "bookmaker_id", "market_type", "line", "capture_precision"]
    markets = observations.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("selection", "price_decimal"))).alias("_m"))
    wanted = F.coalesce(*[F.when(F.col("market_type") == k, n) for k, n in COMPLETE.items()], F.size("_m"))
    whole = markets.filter((F.size("_m") == wanted) & (F.size(F.array_distinct(F.col("_m.selection"))) == F.size("_m")) & F.forall("_m", lambda x: x["price_decimal"] > 1))
    prices = whole.withColumn("_odds", F.col("_m.price_decimal"))
    fair = prices.withColumn("_fair", implied.probabilities(F.col("_odds"), method)).withColumn("_over", F.aggregate("_odds", F.lit(0.0), lambda a, x: a + 1 / x) - 1)
    rows = fair.select(*keys, "_over", F.size("_m").alias("n_selections"), F.explode(F.arrays_zip("_m", "_fair")).alias("x"))
    return rows.select(*keys, F.col("x._m.selection").alias("selection"), F.lit(method.upper()).alias("devig_method"), F.col("x._fair").alias("fair_prob"), (1 / F.col("x._m.price_decimal")).alias("raw_implied_prob"), F.col("_over").alias("overround"), "n_selections")


def clv_price(taken: Column, close: Column) -> Column:
    return taken / close - 1


def clv_ev(fair: Column, taken: Column) -> Column:
    return fair * taken - 1


def clv_log(fair: Column, taken: Column) -> Column:
    return F.ln(fair * taken)


def compute_clv(w: Warehouse) -> DataFrame:
    """Each bet against the reference close of its market, or the reason why not."""
    close = reference_market(w).select(*MARKET, "closing_price", "closing_fair_prob", "closing_basis", "reference_bookmaker_id")
    closed = close.select("match_id", F.lit(True).alias("_any")).distinct()
    b = w["bets"].select("bet_id", *MARKET, "price_taken").join(close, MARKET, "left").join(closed, "match_id", "left")
    known, fair = F.col("closing_price").isNotNull(), F.col("closing_fair_prob").isNotNull()
    reason = F.when(~known & F.col("_any"), "line_not_matched").when(~known, "no_reference_close").when(~fair, "no_fair_probability")
    scored = known & fair
    return b.select("bet_id", F.col("reference_bookmaker_id").alias("ref_bookmaker_id"), "closing_price", "closing_fair_prob", "closing_basis", F.when(known, clv_price(F.col("price_taken"), F.col("closing_price"))).alias("clv_price"), F.when(scored, clv_ev(F.col("closing_fair_prob"), F.col("price_taken"))).alias("clv_ev"), F.when(scored, clv_log(F.col("closing_fair_prob"), F.col("price_taken"))).alias("clv_log"), F.when(known, F.col("price_taken") > F.col("closing_price")).alias("beat_close"), scored.alias("line_matched"), reason.alias("exclusion_reason"))


def replay_bets(w: Warehouse, precision: str = "CLOSING", run_id: str = "replay") -> DataFrame:
    """Every price of one precision as a bet of its own: an instrument to check the scoring with."""
    o = w["odds_observations"].filter(F.col("capture_precision") == precision)
    return o.select(F.substring(F.sha2(F.concat_ws("|", F.lit(run_id), "observation_id"), 256), 1, 32).alias("bet_id"), F.lit(run_id).alias("run_id"), *QUOTE, F.col("price_decimal").alias("price_taken"), F.lit(precision).alias("price_precision"), F.lit(None).cast(T.TimestampType()).alias("placed_at"), F.lit(None).cast("double").alias("model_prob"))
