"""Warehouse tables made of the test tables, as one SQL text that Spark and DuckDB both run.

Orders play matches (customers their teams), events play prices: a user is a match, an event
type decides nothing, a value is a price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KICKOFF = "CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * (o_orderkey % 24)"
BASE: dict[str, str] = {
    "matches": f"""SELECT CAST(o_orderkey AS VARCHAR(20)) AS match_id, o_orderpriority AS competition_id, CAST(year(o_orderdate) AS VARCHAR(9)) AS season_id,
        CAST(o_orderdate AS DATE) AS match_date_utc, {KICKOFF} AS kickoff_utc, CAST(o_custkey AS VARCHAR(20)) AS home_team_id,
        CAST(o_custkey % 97 + 1 AS VARCHAR(20)) AS away_team_id, FALSE AS neutral_venue,
        CASE WHEN o_orderstatus = 'O' THEN 'SCHEDULED' ELSE 'FINISHED' END AS status, 'r' || CAST(o_orderkey % 7 AS VARCHAR(9)) AS ingestion_run_id FROM orders""",
    "match_results": f"""SELECT CAST(o_orderkey AS VARCHAR(20)) AS match_id, CAST(o_orderkey % 4 AS INTEGER) AS goals_home, CAST(o_orderkey % 3 AS INTEGER) AS goals_away,
        CAST(NULL AS INTEGER) AS goals_home_ht, CAST(NULL AS INTEGER) AS goals_away_ht, {KICKOFF} + INTERVAL '2' HOUR AS settled_at, 's' AS source
        FROM orders WHERE o_orderstatus <> 'O'""",
    "match_kickoff_revisions": f"""SELECT CAST(o_orderkey AS VARCHAR(20)) AS match_id, {KICKOFF} + INTERVAL '1' HOUR * k AS kickoff_utc,
        {KICKOFF} - INTERVAL '1' DAY * (3 - k) AS observed_at, 's' AS source
        FROM (SELECT *, 1 AS k FROM orders UNION ALL SELECT *, 2 AS k FROM orders) r WHERE o_orderkey % 10 = 0""",
    "team_aliases": """SELECT CAST(c_custkey AS VARCHAR(20)) || '-' || CAST(k AS VARCHAR(9)) AS alias_id, CAST(c_custkey AS VARCHAR(20)) AS team_id, 's' || CAST(k AS VARCHAR(9)) AS source,
        c_name AS alias_raw, lower(c_name) AS alias_normalized, CASE WHEN c_custkey % 90 = 11 AND k = 2 THEN 'FUZZY' ELSE 'EXACT' END AS match_method, CASE WHEN c_custkey % 50 = 7 AND k = 1 THEN 'PROPOSED' ELSE 'APPROVED' END AS status
        FROM (SELECT *, 1 AS k FROM customer UNION ALL SELECT *, 2 AS k FROM customer) r WHERE c_custkey % 5 <> k""",
    "match_merges": """SELECT CAST(o_orderkey AS VARCHAR(20)) AS merged_match_id, CAST(o_orderkey + 1 AS VARCHAR(20)) AS surviving_match_id, 'same' AS reason FROM orders WHERE o_orderkey % 1000 = 501""",
    "teams": "SELECT CAST(c_custkey AS VARCHAR(20)) AS team_id, c_name AS canonical_name, CAST(c_nationkey AS VARCHAR(9)) AS country FROM customer",
    "team_source_ids": "SELECT 's' AS source, 'x' || CAST(c_custkey AS VARCHAR(20)) AS source_id, CAST(c_custkey AS VARCHAR(20)) AS team_id FROM customer WHERE c_custkey % 3 = 0",
    "team_alias_proposals": "SELECT 'p' || CAST(c_custkey AS VARCHAR(20)) AS proposal_id, CAST(c_custkey AS VARCHAR(20)) AS candidate_team_id, CASE WHEN c_custkey % 2 = 0 THEN 'PROPOSED' ELSE 'REJECTED' END AS status FROM customer WHERE c_custkey % 40 = 3 OR c_custkey % 40 = 4",
    "team_identity_overrides": "SELECT 'o' || CAST(c_custkey AS VARCHAR(20)) AS override_id, 's1' AS source, c_name AS alias_raw, CAST(c_custkey AS VARCHAR(20)) AS team_id FROM customer WHERE c_custkey % 60 = 2",
    "match_source_ids": "SELECT 's' || CAST(k AS VARCHAR(9)) AS source, CAST(o_orderkey AS VARCHAR(20)) AS source_id, CAST(o_orderkey AS VARCHAR(20)) AS match_id FROM (SELECT *, 1 AS k FROM orders UNION ALL SELECT *, 2 AS k FROM orders) r WHERE o_orderkey % 3 <> k",
    "match_quarantine": "SELECT 's' AS source, CAST(o_orderkey AS VARCHAR(20)) AS source_id FROM orders WHERE o_orderkey % 5000 = 77",
    "team_season_membership": "SELECT DISTINCT CAST(o_custkey AS VARCHAR(20)) AS team_id, o_orderpriority AS competition_id, CAST(year(o_orderdate) AS VARCHAR(9)) AS season_id FROM orders",
    "ingestion_runs": "SELECT DISTINCT 'r' || CAST(o_orderkey % 5 AS VARCHAR(9)) AS ingestion_run_id, 's' AS source, o_orderpriority AS competition_id FROM orders",
    "source_coverage": "SELECT DISTINCT 's' AS source, o_orderpriority AS competition_id FROM orders WHERE o_orderpriority <> '5-LOW'",
    "seasons": "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR(9)) AS season_id, CAST(CAST(year(o_orderdate) AS VARCHAR(9)) || '-01-15' AS DATE) AS start_date, CAST(CAST(year(o_orderdate) AS VARCHAR(9)) || '-12-15' AS DATE) AS end_date FROM orders",
    "bookmakers": "SELECT DISTINCT 'b' || CAST(event_id % 4 AS VARCHAR(9)) AS bookmaker_id, event_id % 4 = 0 AS is_reference FROM events",
    "odds_observations": """SELECT CAST(event_id AS VARCHAR(20)) AS observation_id, CAST(user_id AS VARCHAR(20)) AS match_id, 'b' || CAST(event_id % 4 AS VARCHAR(9)) AS bookmaker_id,
        'ONE_X_TWO' AS market_type, CAST(0.0 AS DOUBLE) AS line, CASE event_id % 3 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' ELSE 'AWAY' END AS selection,
        1.05 + value / 25.0 AS price_decimal, CASE WHEN event_id % 10 < 6 THEN 'TIMESTAMPED' WHEN event_id % 10 = 6 THEN 'OPENING' WHEN event_id % 10 = 7 THEN 'PREMATCH' ELSE 'CLOSING' END AS capture_precision,
        CASE WHEN event_id % 10 < 6 THEN CAST(ts AS TIMESTAMP) END AS captured_at, TIMESTAMP '2024-01-25 12:00:00' AS observed_before, 's' AS source FROM events""",
    "model_runs": "SELECT DISTINCT 'm' || CAST(event_id % 2 AS VARCHAR(9)) AS model_run_id, 'model' AS model_name, TIMESTAMP '2024-01-10 00:00:00' AS trained_through FROM events",
    "predictions": """SELECT 'm' || CAST(k AS VARCHAR(9)) AS model_run_id, match_id, 'ONE_X_TWO' AS market_type, CAST(0.0 AS DOUBLE) AS line, selection, 0.2 + 0.1 * k + (CASE selection WHEN 'HOME' THEN 0.1 ELSE 0.0 END) AS prob_win,
        CAST(0.0 AS DOUBLE) AS prob_push, CAST(0.0 AS DOUBLE) AS prob_half_win, CAST(0.0 AS DOUBLE) AS prob_half_lose, 0.8 - 0.1 * k - (CASE selection WHEN 'HOME' THEN 0.1 ELSE 0.0 END) AS prob_lose, k = 1 AS used_prior
        FROM (SELECT DISTINCT CAST(user_id AS VARCHAR(20)) AS match_id, CASE event_id % 3 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' ELSE 'AWAY' END AS selection, event_id % 2 AS k FROM events WHERE user_id % 2 = 0) u""",
    "lineups": "SELECT DISTINCT 'l' || CAST(user_id AS VARCHAR(20)) AS lineup_id, CAST(user_id AS VARCHAR(20)) AS match_id, CAST(user_id AS VARCHAR(20)) AS team_id, TIMESTAMP '2024-01-15 12:00:00' AS published_at, CASE WHEN user_id % 5 = 0 THEN 'PREDICTED' ELSE 'CONFIRMED' END AS lineup_status, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id * 10 AS DOUBLE) END AS known_at_uncertainty_seconds FROM events",
    "lineup_slots": "SELECT DISTINCT 'l' || CAST(user_id AS VARCHAR(20)) AS lineup_id, 'q' || CAST(event_id % 20 AS VARCHAR(9)) AS player_id FROM events WHERE event_id % 11 = 0",
    "player_aliases": "SELECT DISTINCT 'q' || CAST(event_id % 20 AS VARCHAR(9)) AS player_id, CASE WHEN event_id % 20 = 3 THEN 'PROPOSED' ELSE 'APPROVED' END AS status FROM events",
    "ensemble_weights": "SELECT CAST(event_id AS VARCHAR(20)) AS weight_id, event_type AS experiment, 'PREMATCH' AS market_source, 'c' AS competition_id, 's' AS season_id, TIMESTAMP '2024-01-15 00:00:00' AS trained_through, 10 AS n_train, CAST(ts AS TIMESTAMP) AS train_max_settled_at, value / 100.0 AS weight, value / 90.0 AS unconstrained, 1.0 AS train_logloss, 1.0 + value / 1000.0 AS market_logloss FROM events WHERE event_id % 50 = 0",
    "bets": """SELECT CAST(event_id AS VARCHAR(20)) AS bet_id, event_type AS run_id, CAST(user_id AS VARCHAR(20)) AS match_id, 'b' || CAST(event_id % 4 AS VARCHAR(9)) AS bookmaker_id, 'ONE_X_TWO' AS market_type,
        CASE WHEN event_id % 17 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS line, CASE event_id % 3 WHEN 0 THEN 'HOME' WHEN 1 THEN 'DRAW' ELSE 'AWAY' END AS selection, 1.10 + value / 24.0 AS price_taken,
        'TIMESTAMPED' AS price_precision, CAST(ts AS TIMESTAMP) AS placed_at, CASE WHEN event_id % 2 = 0 THEN 0.3 END AS model_prob FROM events WHERE event_id % 3 = 1""",
}


def build(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Some of the base tables (all by default), lazily."""
    source = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "events")}
    out = {}
    for name in names or BASE:
        text = BASE[name]
        for t in source:
            text = text.replace(f" FROM {t} ", f" FROM {{{t}}} ") if f" FROM {t} " in text else text
            text = text.replace(f" FROM {t})", f" FROM {{{t}}})")
            text = text[: -len(f" FROM {t}")] + f" FROM {{{t}}}" if text.endswith(f" FROM {t}") else text
            text = text.replace(f"\n        FROM {t} ", f"\n        FROM {{{t}}} ")
        used = {t: df for t, df in source.items() if f"{{{t}}}" in text}
        out[name] = spark.sql(text, **used)
    return out


def ctes(*names: str) -> str:
    """WITH clause of base tables for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({BASE[n]})" for n in names)
