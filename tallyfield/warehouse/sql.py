"""The warehouse for SQL users: temporary views of its tables and views, and table functions that take an instant."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyfield.warehouse import views
from tallyfield.warehouse.views import Warehouse

VIEWS = {
    "v_analytic_matches": (views.analytic_matches, ("matches", "match_kickoff_revisions", "team_aliases", "match_merges")),
    "v_identity_audit": (views.identity_audit, ("teams", "team_aliases", "team_source_ids", "team_alias_proposals", "team_identity_overrides")),
    "v_cross_source_matches": (views.cross_source_matches, ("match_source_ids",)),
    "v_coverage": (views.coverage, ("match_results",)),
    "reference_market": (views.reference_market, ("odds_closing", "bookmakers", "fair_probabilities")),
    "v_line_movement": (views.line_movement, ("odds_observations",)),
    "v_odds_coverage": (views.odds_coverage, ("odds_observations", "odds_closing", "bookmakers", "fair_probabilities")),
    "v_market_path": (views.market_path, ("odds_observations",)),
    "v_market_moves": (views.market_moves, ("odds_observations",)),
    "v_market_summary": (views.market_summary, ("odds_observations",)),
    "v_market_breadth": (views.market_breadth, ("odds_observations",)),
    "v_path_coverage": (views.path_coverage, ("odds_observations",)),
    "v_bet_clv": (views.bet_clv_view, ("bets", "bet_clv")),
    "v_clv_summary": (views.clv_summary, ("bets", "bet_clv")),
    "v_clv_coverage": (views.clv_coverage, ("bets", "bet_clv")),
    "v_model_vs_market": (views.model_vs_market, ("predictions", "model_runs", "odds_observations", "odds_closing", "bookmakers", "fair_probabilities")),
    "v_model_calibration": (views.model_calibration, ("predictions", "match_results", "odds_closing", "bookmakers", "fair_probabilities")),
    "v_weight_leakage": (views.weight_leakage, ("ensemble_weights",)),
    "v_weight_trajectory": (views.weight_trajectory, ("ensemble_weights",)),
    "v_analytic_lineups": (views.analytic_lineups, ("lineups", "lineup_slots", "player_aliases")),
    "v_resolved_lineups": (views.resolved_lineups, ("lineups", "lineup_slots", "player_aliases")),
}

#: Table functions: columns, and the query over the views with the instant `at_ts`.
FUNCTIONS = {
    "results_as_of": ("match_id STRING, goals_home INT, goals_away INT, settled_at TIMESTAMP, kickoff_utc TIMESTAMP", "SELECT r.match_id, r.goals_home, r.goals_away, r.settled_at, m.kickoff_utc FROM match_results r JOIN v_analytic_matches m ON m.match_id = r.match_id WHERE r.settled_at <= at_ts"),
    "upcoming_matches_as_of": ("match_id STRING, competition_id STRING, kickoff_utc TIMESTAMP", "SELECT match_id, competition_id, kickoff_utc FROM v_analytic_matches WHERE kickoff_utc > at_ts"),
    "team_membership_as_of": ("team_id STRING, competition_id STRING, season_id STRING", "SELECT DISTINCT t.team_id, competition_id, season_id FROM v_analytic_matches LATERAL VIEW explode(array(home_team_id, away_team_id)) t AS team_id WHERE kickoff_utc <= at_ts"),
    "odds_as_of": ("match_id STRING, bookmaker_id STRING, market_type STRING, line DOUBLE, selection STRING, price_decimal DOUBLE, captured_at TIMESTAMP", "SELECT match_id, bookmaker_id, market_type, line, selection, max_by(price_decimal, captured_at), max(captured_at) FROM odds_observations WHERE capture_precision = 'TIMESTAMPED' AND captured_at <= at_ts GROUP BY ALL"),
}


def register(spark: SparkSession, w: Warehouse) -> list[str]:
    """Make the views and functions whose tables are there; their names."""
    made = []
    for name, df in w.items():
        df.createOrReplaceTempView(name)
        made.append(name)
    core = VIEWS["v_analytic_matches"][1]
    for name, (view, needs) in VIEWS.items():
        own = needs if name in ("v_analytic_lineups", "v_resolved_lineups", "v_weight_leakage", "v_weight_trajectory", "v_identity_audit", "v_line_movement", "reference_market") else (*core, *needs)
        if all(t in w for t in own):
            view(w).createOrReplaceTempView(name)
            made.append(name)
    for name, (columns, query) in FUNCTIONS.items():
        if "v_analytic_matches" in made and ("match_results" in w or "match_results" not in query) and ("odds_observations" in w or "odds_observations" not in query):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(at_ts TIMESTAMP) RETURNS TABLE ({columns}) RETURN {query}")
            made.append(name)
    return made
