"""Views of the warehouse as functions of its tables.

A Warehouse is a mapping from table names to DataFrames.  Every reader of knowable facts
takes `at`, the instant it may look back from.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Warehouse = Mapping[str, DataFrame]
MARKET = ["match_id", "market_type", "line", "selection"]
QUOTE = ["match_id", "bookmaker_id", "market_type", "line", "selection"]
ONE_X_TWO = "ONE_X_TWO"


def day_steps(later: Column, earlier: Column) -> Column:
    """Midnights crossed between two instants."""
    return F.datediff(later, earlier).cast("long")


def unit_steps(unit: str, later: Column, earlier: Column) -> Column:
    """Boundaries of a unit (second, minute, hour) crossed between two instants."""
    size = {"second": 1, "minute": 60, "hour": 3600}[unit]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (F.floor(micros(later) / F.lit(size * 1_000_000)) - F.floor(micros(earlier) / F.lit(size * 1_000_000))).cast("long")


# --- matches and identity -------------------------------------------------------------


def analytic_matches(w: Warehouse) -> DataFrame:
    """Matches with their latest kickoff, without merged ones and those of a team with an unapproved alias."""
    latest = w["match_kickoff_revisions"].groupBy("match_id").agg(F.max_by("kickoff_utc", "observed_at").alias("revised"))
    doubtful = w["team_aliases"].filter(F.col("status") != "APPROVED").select("team_id").distinct()
    merged = w["match_merges"].select(F.col("merged_match_id").alias("match_id")).distinct()
    m = w["matches"].join(merged, "match_id", "left_anti")
    # one anti join a side: an OR of two keys would need a nested loop
    for side in ("home_team_id", "away_team_id"):
        m = m.join(doubtful.withColumnRenamed("team_id", side), side, "left_anti")
    m = m.join(latest, "match_id", "left")
    columns = [c for c in w["matches"].columns if c != "kickoff_utc"]
    return m.select(*columns, F.col("kickoff_utc").alias("kickoff_utc_original"), F.coalesce("revised", "kickoff_utc").alias("kickoff_utc"))


def identity_audit(w: Warehouse) -> DataFrame:
    """Per team: sources, aliases, source ids, open proposals, overrides.  Each side is counted before it is joined, so nothing multiplies."""
    aliases = w["team_aliases"].groupBy("team_id").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("alias_raw").alias("n_aliases"))
    ids = w["team_source_ids"].groupBy("team_id").agg(F.count_distinct("source_id").alias("n_source_ids"))
    proposals = w["team_alias_proposals"].filter("status = 'PROPOSED'").groupBy(F.col("candidate_team_id").alias("team_id")).agg(F.count_distinct("proposal_id").alias("n_open_proposals"))
    overrides = w["team_identity_overrides"].groupBy("team_id").agg(F.count_distinct("override_id").alias("n_overrides"))
    out = w["teams"].select("team_id", "canonical_name", "country")
    for side in (aliases, ids, proposals, overrides):
        out = out.join(side, "team_id", "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_")])


def cross_source_matches(w: Warehouse) -> DataFrame:
    seen = w["match_source_ids"].groupBy("match_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    out = analytic_matches(w).select("match_id", "competition_id", "season_id", "match_date_utc").join(seen, "match_id", "left")
    return out.withColumn("n_sources", F.coalesce(F.size("sources"), F.lit(0)).cast("long"))


def coverage(w: Warehouse) -> DataFrame:
    """Share of matches with a result, by competition and season."""
    m = analytic_matches(w).join(w["match_results"].select("match_id", F.lit(1).alias("has")), "match_id", "left")
    out = m.groupBy("competition_id", "season_id").agg(F.count("*").alias("n_matches"), F.count("has").alias("n_with_result"), F.min("match_date_utc").alias("first_match"), F.max("match_date_utc").alias("last_match"))
    return out.withColumn("result_coverage", F.col("n_with_result").cast("double") / F.nullif(F.col("n_matches"), F.lit(0)))


def results_as_of(w: Warehouse, at: Column) -> DataFrame:
    """Results known at `at` (settled no later)."""
    return w["match_results"].filter(F.col("settled_at") <= at).join(analytic_matches(w).select("match_id", "competition_id", "season_id", "match_date_utc", "kickoff_utc", "home_team_id", "away_team_id"), "match_id")


def upcoming_matches_as_of(w: Warehouse, at: Column) -> DataFrame:
    """Matches that kick off after `at`."""
    return analytic_matches(w).filter(F.col("kickoff_utc") > at)


def team_membership_as_of(w: Warehouse, at: Column) -> DataFrame:
    """(team, competition, season) of teams that have kicked off by `at`; both roles of a match come from one pass."""
    m = analytic_matches(w).filter(F.col("kickoff_utc") <= at)
    return m.select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "competition_id", "season_id").distinct()


class PointInTime:
    """Readers at one instant, which only moves forward."""

    def __init__(self, warehouse: Warehouse, at):
        self.warehouse, self.at = warehouse, at

    def advance(self, at) -> PointInTime:
        if at < self.at:
            raise ValueError("a point in time does not move back")
        self.at = at
        return self

    def _at(self) -> Column:
        return F.lit(self.at)

    def results(self) -> DataFrame:
        return results_as_of(self.warehouse, self._at())

    def upcoming(self) -> DataFrame:
        return upcoming_matches_as_of(self.warehouse, self._at())

    def odds(self) -> DataFrame:
        return odds_as_of(self.warehouse, self._at())

    def membership(self) -> DataFrame:
        return team_membership_as_of(self.warehouse, self._at())


# --- odds -----------------------------------------------------------------------------


def reference_market(w: Warehouse) -> DataFrame:
    """The reference bookmaker's closing prices with their fair probabilities."""
    books = F.broadcast(w["bookmakers"].filter("is_reference").select("bookmaker_id"))  # a handful of rows
    close = w["odds_closing"].join(books, "bookmaker_id", "left_semi")
    fair = w["fair_probabilities"].filter("capture_precision = 'CLOSING'").select(*QUOTE, F.col("fair_prob").alias("closing_fair_prob"), F.col("overround").alias("closing_overround"), "devig_method")
    return close.join(fair, QUOTE, "left").select(*MARKET, F.col("price_decimal").alias("closing_price"), "closing_basis", "seconds_to_kickoff", "is_trusted", "closing_fair_prob", "closing_overround", "devig_method", F.col("bookmaker_id").alias("reference_bookmaker_id"))


def line_movement(w: Warehouse) -> DataFrame:
    """Opening and closing price of each quote and the drift between them."""
    early = F.col("capture_precision").isin("OPENING", "PREMATCH")
    out = w["odds_observations"].groupBy(*QUOTE).agg(F.max(F.when(early, F.col("price_decimal"))).alias("opening_price"), F.max(F.when(F.col("capture_precision") == "CLOSING", F.col("price_decimal"))).alias("closing_price"), F.count("*").alias("n_observations"))
    return out.withColumn("drift", F.col("closing_price") / F.nullif("opening_price", F.lit(0.0)) - 1)


def odds_coverage(w: Warehouse) -> DataFrame:
    """Matches with odds, with a reference close, and bookmakers seen, by competition and season."""
    odds = w["odds_observations"].groupBy("match_id").agg(F.collect_set("bookmaker_id").alias("books"))
    close = reference_market(w).select("match_id", F.lit(1).alias("closed")).distinct()
    m = analytic_matches(w).select("match_id", "competition_id", "season_id").join(odds, "match_id", "left").join(close, "match_id", "left")
    out = m.groupBy("competition_id", "season_id").agg(F.count("*").alias("n_matches"), F.count("books").alias("n_with_any_odds"), F.count("closed").alias("n_with_reference_close"), F.size(F.array_distinct(F.flatten(F.collect_set("books")))).cast("long").alias("n_bookmakers"))
    return out.withColumn("reference_close_coverage", F.col("n_with_reference_close").cast("double") / F.nullif(F.col("n_matches"), F.lit(0)))


def odds_as_of(w: Warehouse, at: Column) -> DataFrame:
    """The last timestamped price of each quote by `at`."""
    seen = w["odds_observations"].filter((F.col("capture_precision") == "TIMESTAMPED") & (F.col("captured_at") <= at))
    extra = [F.max_by("available_size", "captured_at").alias("available_size")] if "available_size" in seen.columns else []
    return seen.groupBy(*QUOTE).agg(F.max_by("price_decimal", "captured_at").alias("price_decimal"), *extra, F.max("captured_at").alias("captured_at"))


def best_price_as_of(w: Warehouse, at: Column) -> DataFrame:
    """The best price of each selection by `at` and who offers it; of equal prices the first bookmaker by name."""
    top = F.max(F.struct("price_decimal"))["price_decimal"]
    return odds_as_of(w, at).groupBy(*MARKET).agg(F.min_by("bookmaker_id", F.struct(-F.col("price_decimal"), F.col("bookmaker_id"))).alias("bookmaker_id"), top.alias("price_decimal"), F.count("*").alias("n_books"))


def market_path(w: Warehouse) -> DataFrame:
    """Each timestamped price with the one before it."""
    m = analytic_matches(w).select("match_id", "competition_id", "kickoff_utc")
    o = w["odds_observations"].filter("capture_precision = 'TIMESTAMPED' AND captured_at IS NOT NULL")
    path = W.partitionBy(*QUOTE).orderBy("captured_at")
    before, when = F.lag("price_decimal").over(path), F.lag("captured_at").over(path)
    out = o.select(*QUOTE, "captured_at", "price_decimal", before.alias("previous_price"), when.alias("previous_at")).join(m, "match_id")
    return out.withColumns({"implied_prob": 1 / F.col("price_decimal"), "implied_delta": 1 / F.col("price_decimal") - 1 / F.col("previous_price"), "seconds_since_previous": unit_steps("second", F.col("captured_at"), F.col("previous_at")), "minutes_to_kickoff": unit_steps("minute", F.col("kickoff_utc"), F.col("captured_at"))})


def market_moves(w: Warehouse, least: float = 0.01) -> DataFrame:
    """Moves of at least one point of probability."""
    return market_path(w).filter(F.col("previous_price").isNotNull() & (F.abs("implied_delta") >= least))


def market_summary(w: Warehouse) -> DataFrame:
    """Drift and travel of each quote's path."""
    out = market_path(w).groupBy("match_id", "competition_id", *QUOTE[1:]).agg(
        F.count("*").alias("n_observations"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.min("minutes_to_kickoff").alias("closest_to_kickoff"),
        F.min_by("price_decimal", "captured_at").alias("first_price"), F.max_by("price_decimal", "captured_at").alias("last_price"),
        F.sum(F.abs("implied_delta")).alias("total_implied_travel"), F.max(F.abs("implied_delta")).alias("largest_single_move"),
    )
    return out.withColumns({"observed_minutes": unit_steps("minute", F.col("last_seen"), F.col("first_seen")), "net_implied_drift": 1 / F.col("last_price") - 1 / F.col("first_price")})


def market_breadth(w: Warehouse, least: float = 0.005) -> DataFrame:
    """How many bookmakers move a selection in one minute, and how far apart."""
    return market_moves(w, least).groupBy(*MARKET, F.date_trunc("minute", "captured_at").alias("minute")).agg(F.count_distinct("bookmaker_id").alias("n_books_moving"), F.avg("implied_delta").alias("mean_delta"), F.stddev_samp("implied_delta").alias("delta_dispersion"), F.min("implied_delta").alias("min_delta"), F.max("implied_delta").alias("max_delta"))


def path_coverage(w: Warehouse) -> DataFrame:
    """Matches with a price path, and rows with and without an instant."""
    stamped = F.col("capture_precision") == "TIMESTAMPED"
    per_match = w["odds_observations"].groupBy("match_id").agg(F.count_if(stamped).alias("t"), F.count_if(~stamped).alias("u"))
    return analytic_matches(w).join(per_match, "match_id", "left").groupBy("competition_id", "season_id").agg(F.count("*").alias("n_matches"), F.count_if(F.col("t") > 0).alias("n_with_path"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_timestamped_rows"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_untimestamped_rows"))


# --- closing line value ---------------------------------------------------------------


def bet_clv_view(w: Warehouse) -> DataFrame:
    m = analytic_matches(w).select("match_id", "competition_id", "season_id", "match_date_utc", "kickoff_utc")
    return w["bets"].join(m, "match_id").join(w["bet_clv"], "bet_id", "left")


def clv_summary(w: Warehouse) -> DataFrame:
    """Mean, median and t statistic of closing line value."""
    scored = bet_clv_view(w).filter("line_matched AND clv_ev IS NOT NULL")
    out = scored.groupBy("run_id", "competition_id", "season_id", "market_type").agg(F.count("*").alias("n_bets"), F.avg("clv_ev").alias("mean_clv_ev"), F.median("clv_ev").alias("median_clv_ev"), F.avg("clv_log").alias("mean_clv_log"), F.avg("clv_price").alias("mean_clv_price"), F.avg(F.col("beat_close").cast("double")).alias("beat_close_rate"), F.stddev_samp("clv_ev").alias("clv_ev_stddev"))
    t = F.col("mean_clv_ev") / (F.col("clv_ev_stddev") / F.sqrt("n_bets"))
    return out.withColumn("clv_t_stat", F.when((F.col("clv_ev_stddev") > 0) & (F.col("n_bets") > 1), t))


def clv_coverage(w: Warehouse) -> DataFrame:
    """Share of scored bets and the reasons of the others."""
    out = bet_clv_view(w).groupBy("run_id").agg(F.count("*").alias("n_bets"), F.count_if("line_matched").alias("n_scored"), F.count_if(~F.col("line_matched")).alias("n_excluded"), F.sort_array(F.collect_set("exclusion_reason")).alias("exclusion_reasons"))
    return out.withColumn("scored_fraction", F.col("n_scored").cast("double") / F.nullif(F.col("n_bets"), F.lit(0)))


# --- models ---------------------------------------------------------------------------


def expected_value(win: Column, half_win: Column, half_lose: Column, lose: Column, price: Column) -> Column:
    """Expected profit of a unit stake over the five outcomes of a bet (a push gives 0)."""
    gain = price - 1
    return win * gain + half_win * gain / 2 - half_lose / 2 - lose


def model_vs_market(w: Warehouse) -> DataFrame:
    """Every prediction against every offered price of its selection."""
    prices = w["odds_observations"].select(*MARKET, "bookmaker_id", F.col("price_decimal").alias("offered_price"), "capture_precision")
    close = reference_market(w).select(*MARKET, "closing_price", "closing_fair_prob")
    m = analytic_matches(w).select("match_id", "competition_id", "season_id", "kickoff_utc")
    runs = w["model_runs"].select("model_run_id", "model_name")
    out = w["predictions"].join(runs, "model_run_id").join(m, "match_id").join(prices, MARKET).join(close, MARKET, "left")
    return out.withColumn("edge_ev", expected_value(*[F.col(f"prob_{k}") for k in ("win", "half_win", "half_lose", "lose")], F.col("offered_price")))


def outcome(home: Column, away: Column) -> Column:
    return F.when(home > away, "HOME").when(home < away, "AWAY").otherwise("DRAW")


def model_calibration(w: Warehouse) -> DataFrame:
    """Brier score and log loss of model and market, a row for each run, competition and season."""
    close = reference_market(w).select(*MARKET, "closing_fair_prob")
    result = w["match_results"].select("match_id", outcome(F.col("goals_home"), F.col("goals_away")).alias("outcome"))
    m = analytic_matches(w).select("match_id", "competition_id", "season_id")
    rows = w["predictions"].filter(F.col("market_type") == ONE_X_TWO).join(m, "match_id").join(close, MARKET).join(result, "match_id")
    won = (F.col("selection") == F.col("outcome")).cast("int")
    squared = lambda p: F.avg(F.pow(F.col(p) - won, F.lit(2.0)))
    loss = lambda p: F.avg(-F.ln(F.nullif(F.when(won == 1, F.col(p)).otherwise(1 - F.col(p)), F.lit(0.0))))
    out = rows.groupBy("model_run_id", "competition_id", "season_id").agg(F.count("*").alias("n"), F.avg(F.col("used_prior").cast("int")).alias("prior_fraction"), squared("prob_win").alias("model_brier"), squared("closing_fair_prob").alias("market_brier"), loss("prob_win").alias("model_logloss"), loss("closing_fair_prob").alias("market_logloss"))
    return out.withColumn("brier_edge", F.col("market_brier") - F.col("model_brier"))


def weight_leakage(w: Warehouse) -> DataFrame:
    """Weights that were trained on a result settled at or after their boundary."""
    leaked = w["ensemble_weights"].filter("train_max_settled_at >= trained_through")
    return leaked.select("weight_id", "experiment", "market_source", "trained_through", "train_max_settled_at", unit_steps("second", F.col("train_max_settled_at"), F.col("trained_through")).alias("seconds_past_boundary"))


def weight_trajectory(w: Warehouse) -> DataFrame:
    """Weights over time, with the gain in sample."""
    return w["ensemble_weights"].select("experiment", "market_source", "competition_id", "season_id", "trained_through", "n_train", "weight", "unconstrained", (F.col("market_logloss") - F.col("train_logloss")).alias("in_sample_gain")).orderBy("experiment", "market_source", "competition_id", "season_id", "trained_through")


# --- lineups and readiness ------------------------------------------------------------


def analytic_lineups(w: Warehouse) -> DataFrame:
    """Confirmed lineups without a player whose alias is unapproved."""
    doubtful = w["player_aliases"].filter("status <> 'APPROVED'").select("player_id").distinct()
    bad = w["lineup_slots"].join(doubtful, "player_id", "left_semi").select("lineup_id").distinct()
    return w["lineups"].filter("lineup_status = 'CONFIRMED'").join(bad, "lineup_id", "left_anti")


def resolved_lineups(w: Warehouse, seconds: float = 900) -> DataFrame:
    """Lineups whose instant is known to some uncertainty, and whether that is a quarter of an hour at most."""
    return analytic_lineups(w).filter("known_at_uncertainty_seconds IS NOT NULL").withColumn("resolves_quarter_hour", F.col("known_at_uncertainty_seconds") <= seconds)


def research_opportunities(w: Warehouse, now: Column) -> DataFrame:
    """The state of every match's data at `now`."""
    price = w["odds_observations"].groupBy("match_id").agg(F.count("*").alias("n_prices"), F.count_if(F.col("capture_precision") == "TIMESTAMPED").alias("n_stamped"), F.max("captured_at").alias("last_captured"))
    model = w["predictions"].join(w["model_runs"].select("model_run_id"), "model_run_id", "left_semi").groupBy("match_id").agg(F.count("*").alias("n_predictions"))
    lineup = analytic_lineups(w).groupBy("match_id").agg(F.count("*").alias("n_lineups"), F.min("published_at").alias("published_at"))
    done = w["match_results"].select("match_id", F.lit(True).alias("finished"))
    m = analytic_matches(w)
    for side in ("home", "away"):
        m = m.join(w["teams"].select(F.col("team_id").alias(f"{side}_team_id"), F.col("canonical_name").alias(f"{side}_team")), f"{side}_team_id")
    for part in (done, price, model, lineup):
        m = m.join(part, "match_id", "left")
    m = m.fillna(0, ["n_prices", "n_stamped", "n_predictions", "n_lineups"])
    later = F.col("kickoff_utc") > now
    return m.select(
        "match_id", "competition_id", "season_id", "home_team", "away_team", "kickoff_utc",
        F.when(F.col("finished"), "FINISHED").when(later, "UPCOMING").otherwise("EXISTS").alias("fixture_status"),
        F.when(F.col("n_prices") > 0, "AVAILABLE").otherwise("DATA_GAP").alias("odds_status"),
        F.when(F.col("n_prices") == 0, "NONE").when(F.col("n_stamped") > 0, "TIMESTAMPED").otherwise("UNKNOWN_INSTANT").alias("odds_timestamp_quality"),
        F.when(F.col("n_lineups") > 0, "AVAILABLE").when(later, "NOT_YET_AVAILABLE").otherwise("DATA_GAP").alias("lineup_status"),
        F.when(F.col("published_at").isNotNull(), "PUBLISHED_AT_KNOWN").otherwise("NONE").alias("lineup_timestamp_quality"),
        F.when(F.col("n_predictions") > 0, "RUN").otherwise("NOT_RUN").alias("model_status"),
        F.when((F.col("n_prices") > 0) & (F.col("n_predictions") > 0), "EVALUABLE").otherwise("DATA_GAP").alias("decision_status"),
        "n_prices", "n_predictions", "last_captured",
    )


def data_readiness(w: Warehouse, now: Column) -> DataFrame:
    states = (("n_with_odds", "odds_status", "AVAILABLE"), ("n_timestamped", "odds_timestamp_quality", "TIMESTAMPED"), ("n_with_lineup", "lineup_status", "AVAILABLE"), ("n_with_model", "model_status", "RUN"), ("n_evaluable", "decision_status", "EVALUABLE"), ("n_data_gap", "decision_status", "DATA_GAP"))
    return research_opportunities(w, now).groupBy("competition_id", "season_id", "fixture_status").agg(F.count("*").alias("n_matches"), *[F.count_if(F.col(c) == v).alias(n) for n, c, v in states])
