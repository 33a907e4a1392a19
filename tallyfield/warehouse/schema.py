"""Typed tables of the warehouse, their keys and checks, and audits of those.

Two time axes run through them: when something happened (kickoff) and when it could be
known (settled_at, captured_at, trained_through, published_at).  Readers bound the second.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the key, references (column, table, column) and checks (name, SQL)."""

    ddl: str
    key: tuple[str, ...]
    references: tuple[tuple[str, str, str], ...] = ()
    checks: tuple[tuple[str, str], ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)


PRECISIONS = ("TIMESTAMPED", "OPENING", "PREMATCH", "CLOSING")

TABLES: dict[str, Table] = {
    "schema_migrations": Table("version int, name string, checksum string, applied_at timestamp", ("version",)),
    "competitions": Table("competition_id string, name string, country string, tier int", ("competition_id",)),
    "seasons": Table("season_id string, start_date date, end_date date", ("season_id",)),
    "competition_seasons": Table("competition_id string, season_id string", ("competition_id", "season_id"), (("competition_id", "competitions", "competition_id"), ("season_id", "seasons", "season_id"))),
    "source_coverage": Table("source string, competition_id string, season_id string, n_rows bigint", ("source", "competition_id", "season_id")),
    "ingestion_runs": Table("ingestion_run_id string, source string, started_at timestamp, finished_at timestamp, status string", ("ingestion_run_id",)),
    "teams": Table("team_id string, canonical_name string, country string, created_at timestamp", ("team_id",)),
    "team_aliases": Table("alias_id string, team_id string, source string, alias_raw string, alias_normalized string, match_method string, status string", ("alias_id",), (("team_id", "teams", "team_id"),), (("status", "status IN ('PROPOSED', 'APPROVED', 'REJECTED')"), ("no fuzzy alias", "match_method <> 'FUZZY'"))),
    "team_alias_proposals": Table("proposal_id string, source string, alias_raw string, candidate_team_id string, score double, status string", ("proposal_id",), (("candidate_team_id", "teams", "team_id"),)),
    "team_identity_overrides": Table("override_id string, source string, alias_raw string, team_id string, reason string", ("override_id",), (("team_id", "teams", "team_id"),)),
    "team_source_ids": Table("source string, source_id string, team_id string", ("source", "source_id"), (("team_id", "teams", "team_id"),)),
    "team_season_membership": Table("team_id string, competition_id string, season_id string", ("team_id", "competition_id", "season_id"), (("team_id", "teams", "team_id"),)),
    "matches": Table("match_id string, competition_id string, season_id string, match_date_utc date, kickoff_utc timestamp, home_team_id string, away_team_id string, neutral_venue boolean, status string, kickoff_precision string, ingestion_run_id string, ingested_at timestamp", ("match_id",), (("home_team_id", "teams", "team_id"), ("away_team_id", "teams", "team_id")), (("two teams", "home_team_id <> away_team_id"),)),
    "match_kickoff_revisions": Table("match_id string, kickoff_utc timestamp, observed_at timestamp, source string", ("match_id", "observed_at"), (("match_id", "matches", "match_id"),)),
    "match_results": Table("match_id string, goals_home int, goals_away int, goals_home_ht int, goals_away_ht int, settled_at timestamp, source string", ("match_id",), (("match_id", "matches", "match_id"),), (("goals", "goals_home >= 0 AND goals_away >= 0"), ("half time", "goals_home_ht IS NULL OR (goals_home_ht <= goals_home AND goals_away_ht <= goals_away)"))),
    "match_source_ids": Table("source string, source_id string, match_id string", ("source", "source_id"), (("match_id", "matches", "match_id"),)),
    "match_merges": Table("merged_match_id string, surviving_match_id string, reason string", ("merged_match_id",), (), (("not itself", "merged_match_id <> surviving_match_id"),)),
    "match_quarantine": Table("source string, source_id string, reason string, payload string, quarantined_at timestamp", ("source", "source_id")),
    "data_quality_runs": Table("run_id string, started_at timestamp, n_findings bigint", ("run_id",)),
    "data_quality_findings": Table("run_id string, check_name string, severity string, subject string, detail string", ("run_id", "check_name", "subject")),
    "bookmakers": Table("bookmaker_id string, name string, is_reference boolean", ("bookmaker_id",)),
    "odds_observations": Table("observation_id string, match_id string, bookmaker_id string, market_type string, line double, selection string, price_decimal double, capture_precision string, captured_at timestamp, observed_before timestamp, available_size decimal(18,2), source string, ingestion_run_id string, ingested_at timestamp", ("observation_id",), (("match_id", "matches", "match_id"), ("bookmaker_id", "bookmakers", "bookmaker_id")), (("price", "price_decimal > 1"), ("precision", f"capture_precision IN {PRECISIONS}"), ("instant", "(capture_precision = 'TIMESTAMPED') = (captured_at IS NOT NULL)"))),
    "odds_closing": Table("match_id string, bookmaker_id string, market_type string, line double, selection string, price_decimal double, observation_id string, closing_basis string, seconds_to_kickoff bigint, is_trusted boolean", ("match_id", "bookmaker_id", "market_type", "line", "selection")),
    "fair_probabilities": Table("match_id string, bookmaker_id string, market_type string, line double, selection string, capture_precision string, devig_method string, fair_prob double, raw_implied_prob double, overround double, n_selections int", ("match_id", "bookmaker_id", "market_type", "line", "selection", "capture_precision", "devig_method"), (), (("probability", "fair_prob > 0 AND fair_prob < 1"),)),
    "bets": Table("bet_id string, run_id string, match_id string, bookmaker_id string, market_type string, line double, selection string, price_taken double, price_precision string, placed_at timestamp, observed_before timestamp, model_prob double, cohort_id string, stake decimal(18,6), note string", ("bet_id",), (("match_id", "matches", "match_id"),), (("price", "price_taken > 1"), ("instant", "(price_precision = 'TIMESTAMPED') = (placed_at IS NOT NULL)"))),
    "bet_clv": Table("bet_id string, ref_bookmaker_id string, closing_price double, closing_fair_prob double, closing_basis string, clv_price double, clv_ev double, clv_log double, beat_close boolean, line_matched boolean, exclusion_reason string", ("bet_id",), (("bet_id", "bets", "bet_id"),), (("reason", "line_matched = (exclusion_reason IS NULL)"),)),
    "backtest_runs": Table("run_id string, strategy string, config string, started_at timestamp, initial_equity decimal(18,6)", ("run_id",)),
    "cohorts": Table("cohort_id string, run_id string, decided_at timestamp, equity decimal(18,6), n_candidates int, n_placed int", ("cohort_id",), (("run_id", "backtest_runs", "run_id"),)),
    "bet_settlements": Table("bet_id string, outcome string, pnl decimal(18,6), settled_at timestamp", ("bet_id",), (("bet_id", "bets", "bet_id"),)),
    "equity_curve": Table("run_id string, at timestamp, equity decimal(18,6), peak decimal(18,6), drawdown double", ("run_id", "at")),
    "model_runs": Table("model_run_id string, model_name string, competition_id string, trained_through timestamp, n_train int, config string, fitted_at timestamp", ("model_run_id",)),
    "predictions": Table("model_run_id string, match_id string, market_type string, line double, selection string, prob_win double, prob_push double, prob_half_win double, prob_half_lose double, prob_lose double, lambda_home double, lambda_away double, used_prior boolean", ("model_run_id", "match_id", "market_type", "line", "selection"), (("model_run_id", "model_runs", "model_run_id"),), (("sum", "abs(prob_win + prob_push + prob_half_win + prob_half_lose + prob_lose - 1) <= 1e-6"),)),
    "ensemble_weights": Table("weight_id string, experiment string, competition_id string, season_id string, market_source string, trained_through timestamp, n_train int, train_max_settled_at timestamp, weight double, unconstrained double, train_logloss double, market_logloss double, fitted_at timestamp", ("weight_id",), (), (("weight", "weight >= 0 AND weight <= 1"), ("train", "n_train > 0"))),
    "forecast_scores": Table("score_id string, experiment string, arm string, competition_id string, season_id string, market_source string, n int, brier double, logloss double, logloss_selection double, rps double, logloss_vs_market double, logloss_vs_market_low double, logloss_vs_market_high double, computed_at timestamp", ("score_id",)),
    "players": Table("player_id string, canonical_name string, birth_date date, created_at timestamp", ("player_id",)),
    "player_aliases": Table("alias_id string, player_id string, source string, raw_name string, normalized_name string, match_method string, status string", ("alias_id",), (("player_id", "players", "player_id"),), (("no fuzzy alias", "match_method <> 'FUZZY'"),)),
    "player_source_ids": Table("source string, source_id string, player_id string", ("source", "source_id"), (("player_id", "players", "player_id"),)),
    "lineups": Table("lineup_id string, match_id string, team_id string, source string, published_at timestamp, lineup_status string, known_at_uncertainty_seconds double, ingested_at timestamp", ("lineup_id",), (), (("status", "lineup_status IN ('CONFIRMED', 'PREDICTED')"),)),
    "lineup_slots": Table("lineup_id string, player_id string, role string, shirt_number int", ("lineup_id", "player_id"), (("lineup_id", "lineups", "lineup_id"),)),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the types of a table; columns it lacks are null, others go."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[name].schema.fields])


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n): numbers of duplicate keys, missing references and failed checks, one pass a rule."""
    parts = []
    for name, df in tables.items():
        spec = TABLES.get(name)
        if spec is None:
            continue
        keys = [k for k in spec.key if k in df.columns]
        if len(keys) == len(spec.key):
            twice = df.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")
            parts.append(twice.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit("duplicate key").alias("rule"), "n"))
        failed = [(rule, sql) for rule, sql in spec.checks]
        if failed:
            try:
                row = df.agg(*[F.count_if(~F.coalesce(F.expr(sql), F.lit(True))).alias(f"c{i}") for i, (_, sql) in enumerate(failed)])
            except Exception as error:
                if "UNRESOLVED_COLUMN" not in str(error):
                    raise
            else:
                parts.append(row.select(F.lit(name).alias("table_name"), F.explode(F.array(*[F.struct(F.lit(f"check: {rule}").alias("rule"), F.col(f"c{i}").alias("n")) for i, (rule, _) in enumerate(failed)])).alias("x")).select("table_name", "x.rule", "x.n"))
        for column, other, target in spec.references:
            if column in df.columns and other in tables:
                missing = df.filter(F.col(column).isNotNull()).join(tables[other].select(F.col(target).alias(column)), column, "left_anti")
                parts.append(missing.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(f"reference: {column}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)
