"""Data-quality, point-in-time and identity checks: each gives rows (check_name, severity, subject, n)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.warehouse.views import Warehouse, analytic_lineups, analytic_matches, cross_source_matches, weight_leakage

BLOCKING, WARNING, INFO = "BLOCKING", "WARNING", "INFO"


def _rows(df: DataFrame, name: str, severity: str, subject: Column | None = None, n: Column | None = None) -> DataFrame:
    """A finding for each row."""
    return df.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), (F.lit("") if subject is None else subject.cast("string")).alias("subject"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _count(df: DataFrame, name: str, severity: str) -> DataFrame:
    """One finding with the number of rows, or none."""
    return _rows(df.agg(F.count("*").alias("c")).filter("c > 0"), name, severity, n=F.col("c"))


# --- data quality ---------------------------------------------------------------------


def duplicate_matches(w: Warehouse) -> DataFrame:
    keys = ["competition_id", "season_id", "match_date_utc", "home_team_id", "away_team_id"]
    twice = w["matches"].groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")
    return _rows(twice, "duplicate_match", BLOCKING, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("c"))


def missing_results(w: Warehouse) -> DataFrame:
    return _count(analytic_matches(w).filter("status = 'FINISHED'").join(w["match_results"].select("match_id"), "match_id", "left_anti"), "missing_result", WARNING)


def result_before_kickoff(w: Warehouse) -> DataFrame:
    both = w["match_results"].join(w["matches"].select("match_id", "kickoff_utc"), "match_id")
    return _count(both.filter("settled_at <= kickoff_utc"), "result_settled_before_kickoff", BLOCKING)


def match_outside_season(w: Warehouse) -> DataFrame:
    both = w["matches"].join(F.broadcast(w["seasons"].select("season_id", "start_date", "end_date")), "season_id")  # a row a year
    return _count(both.filter("match_date_utc < start_date OR match_date_utc > end_date"), "match_outside_season", WARNING)


def provenance(w: Warehouse) -> DataFrame:
    no_source = w["matches"].join(w["match_source_ids"].select("match_id"), "match_id", "left_anti")
    no_run = w["matches"].join(w["ingestion_runs"].select("ingestion_run_id"), "ingestion_run_id", "left_anti")
    return _count(no_source, "match_without_source_id", BLOCKING).union(_count(no_run, "match_without_run", BLOCKING))


def cross_source_join(w: Warehouse) -> DataFrame:
    """How many matches several sources confirm; none at all blocks where there are several sources."""
    reach = cross_source_matches(w).agg(F.count_if(F.col("n_sources") > 1).alias("multi"), F.count_if(F.col("n_sources") <= 1).alias("single"))
    sources = w["match_source_ids"].agg(F.count_distinct("source").alias("n_sources"))
    both = reach.crossJoin(F.broadcast(sources))  # one row on either side
    broken = both.filter("multi = 0 AND single > 0")
    return _rows(both, "cross_source_reach", INFO, n=F.col("multi")).union(_rows(broken.filter("n_sources >= 2"), "no_cross_source_join", BLOCKING, n=F.col("single"))).union(_rows(broken.filter("n_sources < 2"), "single_source_dataset", WARNING, n=F.col("single")))


def membership_consistency(w: Warehouse) -> DataFrame:
    played = w["matches"].select(F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"), "competition_id", "season_id").distinct()
    return _count(played.join(w["team_season_membership"], ["team_id", "competition_id", "season_id"], "left_anti"), "missing_membership", BLOCKING)


def source_coverage_scope(w: Warehouse) -> DataFrame:
    runs = w["ingestion_runs"]
    if "competition_id" not in runs.columns:
        return _count(runs.filter("false"), "ingest_outside_coverage", BLOCKING)
    return _count(runs.filter("competition_id IS NOT NULL").join(w["source_coverage"].select("source", "competition_id"), ["source", "competition_id"], "left_anti"), "ingest_outside_coverage", BLOCKING)


def prematch_margin_divergence(w: Warehouse, most: float = 0.01) -> DataFrame:
    """Bookmakers whose margin before the match is far above their closing one: an opening price, then."""
    of = lambda p: F.median(F.when(F.col("capture_precision") == p, F.col("overround")))
    margins = w["fair_probabilities"].groupBy("bookmaker_id").agg(of("PREMATCH").alias("pre"), of("CLOSING").alias("close"))
    return _rows(margins.filter(F.col("pre") - F.col("close") > most), "prematch_is_an_opening_price", WARNING, F.col("bookmaker_id"))


# --- the point-in-time chain ----------------------------------------------------------


def decision_after_kickoff(w: Warehouse) -> DataFrame:
    both = w["bets"].filter("placed_at IS NOT NULL").join(analytic_matches(w).select("match_id", "kickoff_utc"), "match_id")
    return _count(both.filter("placed_at >= kickoff_utc"), "decision_after_kickoff", BLOCKING)


def settlement_before_kickoff(w: Warehouse) -> DataFrame:
    both = w["match_results"].join(w["matches"].select("match_id", "kickoff_utc"), "match_id")
    return _count(both.filter("settled_at < kickoff_utc"), "settlement_before_kickoff", BLOCKING)


def price_after_decision(w: Warehouse) -> DataFrame:
    keys = ["match_id", "bookmaker_id", "market_type", "line", "selection"]
    o = w["odds_observations"].filter("capture_precision = 'TIMESTAMPED'").select(*keys, F.col("price_decimal").alias("price_taken"), "captured_at")
    b = w["bets"].filter("price_precision = 'TIMESTAMPED' AND placed_at IS NOT NULL")
    return _count(b.join(o, [*keys, "price_taken"]).filter("captured_at > placed_at"), "price_after_decision", BLOCKING)


def fit_after_decision(w: Warehouse) -> DataFrame:
    keys = ["match_id", "market_type", "line", "selection"]
    p = w["predictions"].join(w["model_runs"].select("model_run_id", "trained_through"), "model_run_id").select(*keys, "prob_win", "trained_through")
    b = w["bets"].filter("placed_at IS NOT NULL AND model_prob IS NOT NULL")
    return _count(b.join(p, keys).filter("trained_through > placed_at AND abs(prob_win - model_prob) < 1e-12"), "fit_after_decision", BLOCKING)


def weight_past_boundary(w: Warehouse) -> DataFrame:
    return _count(weight_leakage(w), "weight_trained_past_boundary", BLOCKING)


def lineup_after_kickoff(w: Warehouse) -> DataFrame:
    both = analytic_lineups(w).join(w["matches"].select("match_id", "kickoff_utc"), "match_id")
    return _count(both.filter("published_at >= kickoff_utc"), "lineup_published_after_kickoff", WARNING)


def lineup_informed_bets(w: Warehouse) -> DataFrame:
    if "bet_lineup_inputs" not in w:
        return _count(w["bets"].filter("false"), "bet_used_unpublished_lineup", BLOCKING)
    both = w["bet_lineup_inputs"].join(w["bets"].select("bet_id", "placed_at"), "bet_id").join(w["lineups"].select("lineup_id", "published_at"), "lineup_id")
    return _count(both.filter("published_at > placed_at"), "bet_used_unpublished_lineup", BLOCKING)


def timestamped_coverage(w: Warehouse) -> DataFrame:
    """Says aloud that links are untested where no price or lineup could break them."""
    odds = w["odds_observations"].agg(F.count("*").alias("n"), F.count_if(F.col("capture_precision") == "TIMESTAMPED").alias("t"))
    lineups = w["lineups"].agg(F.count("*").alias("l"))
    both = odds.crossJoin(F.broadcast(lineups))  # one row on either side
    return _rows(both.filter("n > 0 AND t = 0"), "no_timestamped_odds", WARNING, n=F.col("n")).union(_rows(both.filter("NOT (n > 0 AND t = 0) AND l = 0"), "no_lineups", WARNING, n=F.col("l")))


# --- identity -------------------------------------------------------------------------


def alias_collisions(w: Warehouse) -> DataFrame:
    a = w["team_aliases"].filter("status = 'APPROVED'").join(w["teams"].select("team_id", "country"), "team_id", "left")
    twice = a.groupBy("alias_raw", "source", "country").agg(F.count_distinct("team_id").alias("c")).filter("c > 1")
    return _rows(twice, "alias_collision", BLOCKING, F.concat_ws(":", "source", "alias_raw"), F.col("c"))


def homonyms(w: Warehouse) -> DataFrame:
    a = w["team_aliases"].filter("status = 'APPROVED'").join(w["teams"].select("team_id", "country"), "team_id", "left")
    twice = a.groupBy("alias_normalized", "country").agg(F.count_distinct("team_id").alias("c")).filter("c > 1")
    return _rows(twice, "homonym", BLOCKING, F.col("alias_normalized"), F.col("c"))


def open_proposals(w: Warehouse) -> DataFrame:
    return _count(w["team_alias_proposals"].filter("status = 'PROPOSED'"), "open_fuzzy_proposal", BLOCKING)


def orphan_teams(w: Warehouse) -> DataFrame:
    return _rows(w["teams"].join(w["team_aliases"].select("team_id"), "team_id", "left_anti"), "orphan_team", WARNING, F.col("team_id"))


def quarantined_matches(w: Warehouse) -> DataFrame:
    return _count(w["match_quarantine"], "quarantined_match", BLOCKING)


def fuzzy_aliases(w: Warehouse) -> DataFrame:
    return _count(w["team_aliases"].filter("match_method = 'FUZZY'"), "fuzzy_leaked_into_aliases", BLOCKING)


def unapproved_in_matches(w: Warehouse) -> DataFrame:
    doubtful = w["team_aliases"].filter("status <> 'APPROVED'").select("team_id").distinct()
    sides = w["matches"].select("match_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    return _count(sides.join(doubtful, "team_id", "left_semi").select("match_id").distinct(), "unapproved_identity_in_matches", BLOCKING)


Check = Callable[[Warehouse], DataFrame]
QUALITY: tuple[Check, ...] = (prematch_margin_divergence, duplicate_matches, missing_results, result_before_kickoff, match_outside_season, provenance, cross_source_join, membership_consistency, source_coverage_scope)
POINT_IN_TIME: tuple[Check, ...] = (decision_after_kickoff, settlement_before_kickoff, price_after_decision, fit_after_decision, weight_past_boundary, lineup_after_kickoff, lineup_informed_bets, timestamped_coverage)
IDENTITY: tuple[Check, ...] = (alias_collisions, homonyms, open_proposals, orphan_teams, quarantined_matches, fuzzy_aliases, unapproved_in_matches)


def run(w: Warehouse, checks: tuple[Check, ...]) -> DataFrame:
    """All findings of some checks."""
    return reduce(DataFrame.unionByName, [c(w) for c in checks])


def counts(w: Warehouse) -> DataFrame:
    """(name, n): sizes of the warehouse."""
    sized = {"teams": w["teams"], "aliases": w["team_aliases"], "fuzzy_proposals_total": w["team_alias_proposals"], "fuzzy_proposals_open": w["team_alias_proposals"].filter("status = 'PROPOSED'"), "overrides": w["team_identity_overrides"], "matches": w["matches"], "analytic_matches": analytic_matches(w), "match_results": w["match_results"], "quarantined_matches": w["match_quarantine"], "merged_matches": w["match_merges"], "team_source_ids": w["team_source_ids"], "match_source_ids": w["match_source_ids"], "team_season_memberships": w["team_season_membership"], "ingestion_runs": w["ingestion_runs"], "competitions": w["matches"].select("competition_id").distinct(), "seasons": w["matches"].select("season_id").distinct()}
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sized.items()])
