"""Warehouse functions on small tables."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfield.sources import adapters, api, nested
from tallyfield.warehouse import backtest, capital, decision, identity, ingest, market, models, odds, research, schema, versions, views

T0 = dt.datetime(2024, 1, 1, 12)


def hours(n: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=n)


def make(spark, name, rows, columns):
    df = spark.createDataFrame(rows, columns) if rows else spark.createDataFrame([], columns)
    return schema.conform(df, name)


def small(spark) -> dict:
    """Three matches of four teams, prices of two bookmakers and results of two matches."""
    w = {name: spark.createDataFrame([], t.schema) for name, t in schema.TABLES.items()}
    w["teams"] = make(spark, "teams", [(t, f"Team {t}", "X") for t in "ABCD"], "team_id string, canonical_name string, country string")
    w["team_aliases"] = make(spark, "team_aliases", [(f"a{t}", t, "s", f"Team {t}", f"team {t}".lower(), "EXACT", "APPROVED") for t in "ABCD"], "alias_id string, team_id string, source string, alias_raw string, alias_normalized string, match_method string, status string")
    w["matches"] = make(spark, "matches", [("m1", "c", "s", T0.date(), hours(0), "A", "B", "FINISHED"), ("m2", "c", "s", T0.date(), hours(1), "C", "D", "FINISHED"), ("m3", "c", "s", T0.date(), hours(48), "A", "C", "SCHEDULED")], "match_id string, competition_id string, season_id string, match_date_utc date, kickoff_utc timestamp, home_team_id string, away_team_id string, status string")
    w["match_results"] = make(spark, "match_results", [("m1", 2, 0, hours(2)), ("m2", 1, 1, hours(3))], "match_id string, goals_home int, goals_away int, settled_at timestamp")
    w["bookmakers"] = make(spark, "bookmakers", [("b1", "One", True), ("b2", "Two", False)], "bookmaker_id string, name string, is_reference boolean")
    rows = []
    for m in ("m1", "m2", "m3"):
        for b, shift in (("b1", 0.0), ("b2", 0.1)):
            for s, p in (("HOME", 2.0), ("DRAW", 3.4), ("AWAY", 4.0)):
                rows += [(f"{m}{b}{s}{q}", m, b, "ONE_X_TWO", 0.0, s, p + shift + x, q, None) for q, x in (("PREMATCH", 0.2), ("CLOSING", 0.0))]
    rows += [(f"t{k}", "m3", "b2", "BTTS", 0.0, "YES", 1.5 + k / 10, "TIMESTAMPED", hours(40 + k)) for k in range(3)]
    w["odds_observations"] = make(spark, "odds_observations", rows, "observation_id string, match_id string, bookmaker_id string, market_type string, line double, selection string, price_decimal double, capture_precision string, captured_at timestamp").withColumn("observed_before", F.lit(hours(48)))
    w["odds_closing"] = odds.materialise_closing(w)
    w["fair_probabilities"] = odds.fair_probabilities(w["odds_observations"], "shin")
    return w


def test_schema_audit(spark):
    w = small(spark)
    bad = {r["table_name"] + ":" + r["rule"]: r["n"] for r in schema.audit({k: w[k] for k in ("teams", "matches", "odds_observations", "bookmakers", "match_results")}).collect() if r["n"]}
    assert bad == {}
    w["match_results"] = w["match_results"].union(make(spark, "match_results", [("m1", -1, 0, None), ("zz", 1, 0, None)], "match_id string, goals_home int, goals_away int, settled_at timestamp"))
    bad = {r["rule"]: r["n"] for r in schema.audit({"match_results": w["match_results"], "matches": w["matches"]}).filter("table_name = 'match_results' AND n > 0").collect()}
    assert bad == {"duplicate key": 1, "check: goals": 1, "reference: match_id": 1}


def test_identity_and_merges_hide_matches(spark):
    w = small(spark)
    assert views.analytic_matches(w).count() == 3
    w["team_aliases"] = w["team_aliases"].withColumn("status", F.when(F.col("team_id") == "D", "PROPOSED").otherwise(F.col("status")))
    w["match_merges"] = make(spark, "match_merges", [("m3", "m1", "x")], "merged_match_id string, surviving_match_id string, reason string")
    w["match_kickoff_revisions"] = make(spark, "match_kickoff_revisions", [("m1", hours(5), hours(-3)), ("m1", hours(6), hours(-2))], "match_id string, kickoff_utc timestamp, observed_at timestamp")
    assert [(r["match_id"], r["kickoff_utc"], r["kickoff_utc_original"]) for r in views.analytic_matches(w).collect()] == [("m1", hours(6), hours(0))]


def test_point_in_time(spark):
    view = views.PointInTime(small(spark), hours(2))
    assert {r["match_id"] for r in view.results().collect()} == {"m1"} and {r["match_id"] for r in view.upcoming().collect()} == {"m3"}
    assert {r["team_id"] for r in view.membership().collect()} == set("ABCD")
    assert view.odds().count() == 0 and view.advance(hours(41)).odds().first()["price_decimal"] == 1.6
    with pytest.raises(ValueError):
        view.advance(hours(0))


def test_sql_views_and_table_functions(spark):
    from tallyfield.warehouse import sql

    w = small(spark)
    made = sql.register(spark, w)
    assert {"v_analytic_matches", "v_market_path", "v_clv_summary", "results_as_of"} <= set(made)
    assert {r["match_id"] for r in spark.sql("SELECT * FROM results_as_of(TIMESTAMP '2024-01-01 14:00:00')").collect()} == {"m1"}
    assert spark.sql("SELECT * FROM odds_as_of(TIMESTAMP '2024-01-03 05:00:00')").first()["price_decimal"] == 1.6
    assert spark.sql("SELECT count(*) AS n FROM team_membership_as_of(TIMESTAMP '2024-01-01 12:30:00')").first()["n"] == 2
    for name in made:
        if name.startswith("v_"):
            spark.table(name).limit(1).collect()


def test_closing_prefers_declared(spark):
    w = small(spark)
    got = {(r["match_id"], r["bookmaker_id"], r["market_type"], r["selection"]): r for r in w["odds_closing"].collect()}
    assert got["m1", "b1", "ONE_X_TWO", "HOME"]["closing_basis"] == "DECLARED"
    last = got["m3", "b2", "BTTS", "YES"]
    assert (last["closing_basis"], last["price_decimal"], last["seconds_to_kickoff"], last["is_trusted"]) == ("LATEST", 1.7, 6 * 3600, True)


def test_incomplete_markets_are_left_out(spark):
    fair = small(spark)["fair_probabilities"]
    assert fair.filter("market_type = 'BTTS'").count() == 0
    assert all(abs(r["s"] - 1) < 1e-6 for r in fair.groupBy("match_id", "bookmaker_id", "capture_precision").agg(F.sum("fair_prob").alias("s")).collect())


def test_taking_the_close_costs_the_margin(spark):
    w = small(spark)
    w["bets"] = odds.replay_bets(w).filter("bookmaker_id = 'b1'")
    w["fair_probabilities"] = odds.fair_probabilities(w["odds_observations"], "multiplicative")
    got = odds.compute_clv(w).collect()
    margin = 1 / 2.0 + 1 / 3.4 + 1 / 4.0 - 1
    assert len(got) == 9 and all(abs(r["clv_ev"] - (1 / (1 + margin) - 1)) < 1e-9 and r["clv_price"] == 0 and not r["beat_close"] for r in got)
    w["bets"] = schema.conform(w["bets"].limit(1).withColumn("line", F.lit(1.5)).union(w["bets"].limit(1).withColumn("match_id", F.lit("none"))), "bets")
    assert {r["exclusion_reason"] for r in odds.compute_clv(w).collect()} == {"line_not_matched", "no_reference_close"}


def test_odds_json(spark):
    df = spark.createDataFrame([("s", "1", '[{"bookmaker":"b","market_type":"ONE_X_TWO","line":0,"selection":"HOME","price_decimal":2.5,"capture_precision":"PREMATCH"},{"bookmaker":"b","price_decimal":1.0}]'), ("s", "2", None), ("s", "3", "broken")], "source string, source_id string, odds_json string")
    got = odds.observations_from_json(df).collect()
    assert [(r["source_id"], r["selection"], r["price_decimal"]) for r in got] == [("1", "HOME", 2.5)]


@pytest.mark.parametrize(("policy", "want"), [("reject", ["0.00"] * 3), ("pro_rata", ["16.66", "33.33", "50.00"]), ("truncate", ["0.00", "40.00", "60.00"])])
def test_capital(spark, policy, want):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(("20", "40", "60"))], "k string, i int, s string").select("k", "i", F.col("s").cast("decimal(18,2)").alias("s"), F.lit("100").cast("decimal(18,2)").alias("have"))
    got = capital.constrain(df, ["k"], "s", "have", policy, F.col("i")).orderBy("i").collect()
    assert [str(r["granted"]) for r in got] == want and all(r["constrained"] for r in got)
    free = capital.constrain(df.withColumn("have", F.lit("200").cast("decimal(18,2)")), ["k"], "s", "have", policy, F.col("i")).orderBy("i").collect()
    assert [str(r["granted"]) for r in free] == ["20.00", "40.00", "60.00"]


def test_backtest_conserves_money(spark):
    w = small(spark)
    config = backtest.Config(stake_fraction=0.1, max_exposure=0.5, frictions=backtest.Frictions(commission_rate=0.02))
    bets = backtest.run(w, backtest.take_selection(w, "HOME"), config).orderBy("kickoff_utc", "bookmaker_id").collect()
    assert len(bets) == 6 and {b["outcome"] for b in bets if b["match_id"] == "m1"} == {"WIN"} and {b["outcome"] for b in bets if b["match_id"] == "m3"} == {"VOID"}
    first = bets[0]
    assert first["stake"] == Decimal("100.000000") and first["returned"] == Decimal("220.000000") and first["commission"] == Decimal("2.400000") and first["pnl"] == first["returned"] - first["stake"] - first["commission"]
    assert backtest.run(w, backtest.oracle(w), config).filter("pnl <= 0 AND outcome <> 'VOID'").count() == 0
    assert {r["selection"] for r in backtest.favourite(w).collect()} == {"HOME"}
    m = backtest.metrics(backtest.run(w, backtest.oracle(w), config)).first()
    assert m["n_bets"] > 0 and m["yield_on_turnover"] > 0 and m["win_rate"] == 1


def test_fold_settles_before_it_stakes():
    rows = pd.DataFrame([{"run_id": "r", "kickoff_utc": pd.Timestamp(hours(k * 3)), "match_id": f"m{k}", "bookmaker_id": "b", "market_type": "ONE_X_TWO", "line": 0.0, "selection": "HOME", "price": 2.0, "price_precision": "PREMATCH", "model_prob": None, "rank": 0.0, "state": "LOSE" if k < 3 else "WIN", "settled_at": pd.Timestamp(hours(k * 3 + 2))} for k in range(4)])
    got = backtest.fold_run(rows, backtest.Config(stake_fraction=0.5, max_exposure=1.0))
    assert [str(x) for x in got["stake"]] == ["500.00", "250.00", "125.00", "62.50"] and list(got["outcome"]) == ["LOSE", "LOSE", "LOSE", "WIN"]
    ruined = backtest.fold_run(rows.assign(state="LOSE"), backtest.Config(stake_fraction=1.0, max_exposure=1.0))
    assert len(ruined) == 1


def test_model_edge_uses_the_freshest_fit_before_kickoff(spark):
    w = small(spark)
    w["model_runs"] = make(spark, "model_runs", [("old", "m", hours(-50)), ("new", "m", hours(-5)), ("late", "m", hours(50))], "model_run_id string, model_name string, trained_through timestamp")
    w["predictions"] = make(spark, "predictions", [(r, "m1", "ONE_X_TWO", 0.0, "HOME", p, 0.0, 0.0, 0.0, 1 - p) for r, p in (("old", 0.1), ("new", 0.6), ("late", 0.9))], "model_run_id string, match_id string, market_type string, line double, selection string, prob_win double, prob_push double, prob_half_win double, prob_half_lose double, prob_lose double")
    got = backtest.model_edge(w).collect()
    assert {r["model_prob"] for r in got} == {0.6} and all(abs(r["rank"] - (0.6 * r["price"] - 1)) < 1e-9 for r in got)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(3000)] + [("b", 1.0)] * 50, "k string, v double")
    got = {r["k"]: r for r in backtest.bootstrap_mean(df, ["k"], "v", draws=300).collect()}
    assert abs(got["a"]["se"] - 2 / 3000**0.5) < 0.006 and got["a"]["low"] < 3.0 < got["a"]["high"] and got["b"]["low"] == got["b"]["high"] == 1.0


def test_shock_and_did(spark):
    rows = [("m1", "GOALKEEPER", 1.0, 0.1), ("m2", "FORWARD", 0.9, 0.2), ("m2", "DEFENDER", 0.3, 0.5), ("m2", "MIDFIELDER", 0.5, 0.0)]
    got = {r["match_id"]: r for r in research.formation_shock(spark.createDataFrame(rows, "match_id string, position string, start_share double, replacement_share double")).collect()}
    assert abs(got["m1"]["shock"] - 0.9) < 1e-9 and got["m1"]["categories"] == ["GOALKEEPER_OUT"] and got["m2"]["categories"] == ["KEY_FORWARD_OUT", "MULTIPLE_ABSENCES"]
    windows = spark.createDataFrame([(f"m{i}", "HOME", 0.5 if i < 5 else 0.1 * (i % 2)) for i in range(12)], "match_id string, selection string, did double")
    cats = spark.createDataFrame([(f"m{i}", "GOALKEEPER_OUT") for i in range(5)], "match_id string, category string")
    r = research.difference_in_differences(windows, cats).first()
    assert (r["n_treated"], r["n_control"]) == (5, 7) and r["effect"] > 0.4 and r["p_value"] < 0.01
    with pytest.raises(RuntimeError):
        research.require_timestamped({"odds_observations": small(spark)["odds_observations"].limit(0), "lineups": None})


def test_scan_finds_a_planted_bias(spark):
    rows = [(i, "HOME" if (i % 10 < (7 if i % 2 else 4)) else "DRAW", 0.4, 0.3, 0.3, i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, outcome string, p_home double, p_draw double, p_away double, odd int")
    got = research.benjamini_hochberg(research.scan(df, {"odd": ("odd = 1", "p", False)})).collect()
    home = next(r for r in got if r["selection"] == "HOME")
    assert home["discovery"] and home["delta"] > 0.15 and len(got) == 3


def test_cells_bands_and_permutation(spark):
    df = spark.createDataFrame([("a", float(i % 5), 0.3, i % 3 == 0) for i in range(300)] + [("b", float(i % 5) + 1, 0.3, i % 3 == 0) for i in range(300)], "g string, v double, p double, won boolean")
    assert research.permutation_test(df, "g", "v", 50).first()["p_value"] < 0.05
    assert research.permutation_test(df.withColumn("v", F.col("v") - F.when(F.col("g") == "b", 1).otherwise(0)), "g", "v", 50).first()["p_value"] > 0.1
    assert {r["g"]: round(r["mean"], 6) for r in research.cells(df, ["g"], "v").collect()} == {"a": 2.0, "b": 3.0}
    assert abs(research.calibration_error(df, ["g"], "p", "won").first()["calibration_error"] - abs(0.3 - 1 / 3)) < 1e-9
    assert research.brier_skill(df, ["g"], "p", "won").count() == 2
    r = spark.range(1).select(research.price_band(F.lit(2.5)).alias("b"), research.price_band(F.lit(50.0)).alias("c"), research.net_price(F.lit(3.0), 0.05).alias("n"), research.evidence_class(F.lit(0.05), F.lit(0.02), F.lit(6), F.lit(False)).alias("e")).first()
    assert (r["b"], r["c"], r["n"], r["e"]) == ("2-3", "10+", 2.9, "A")


def test_consensus_and_null_edge(spark):
    q = spark.createDataFrame([("m", "b1", [2.0, 3.5, 4.0]), ("m", "b2", [2.1, 3.4, 3.9]), ("m", "b3", [1.95, 3.6, 4.2]), ("m", "Max", [2.1, 3.6, 4.2]), ("n", "b1", [2.0, 3.5, 4.0])], "match_id string, bookmaker_id string, odds array<double>")
    got = market.consensus(q).orderBy("place").collect()
    assert [r["match_id"] for r in got] == ["m"] * 3 and got[0]["best_book"] == "b2" and got[0]["n_books"] == 3
    fair = sorted(r for r in [x["edge"] for x in got[0]["leave_one_out"]])
    assert len(fair) == 3 and fair[0] < fair[-1]
    edge = spark.range(1).select(market.null_edge(F.lit(0.4), F.lit(0.05), F.lit(5), F.lit(0.05)).alias("e"), market.null_edge(F.lit(0.4), F.lit(0.0), F.lit(5), F.lit(0.05)).alias("z")).first()
    assert 0 < edge["e"] < 0.2 and edge["z"] == 0


def test_signals(spark):
    rows = [(0.05, 50, 0.02, 60.0, 0, False), (0.05, 50, -0.01, 60.0, 0, False), (None, 50, 0.02, 60.0, 0, False), (0.05, 50, 0.02, 4000.0, 0, False), (0.05, 50, 0.02, 60.0, 1, False), (0.05, 5, 0.02, 60.0, 0, False), (0.05, 50, 0.02, 60.0, 0, True)]
    df = spark.createDataFrame(rows, "edge double, n_settled long, historical_clv double, data_age_seconds double, pit_violations long, used_prior boolean")
    got = [(r["level"], r["uncapped_level"], r["reason"]) for r in decision.classify(df).collect()]
    assert got == [("WATCH", "CANDIDATE", "POSITIVE_CLV"), ("NO_SIGNAL", "NO_SIGNAL", "NEGATIVE_CLV"), ("DATA_GAP", "DATA_GAP", "NO_ODDS"), ("NO_SIGNAL", "NO_SIGNAL", "STALE_DATA"), ("NO_SIGNAL", "NO_SIGNAL", "PIT_VIOLATION"), ("WATCH", "WATCH", "THIN_SAMPLE"), ("WATCH", "WATCH", "LEAGUE_PRIOR")]
    assert decision.classify(df, promoted=True).first()["level"] == "QUALIFIED"
    s = [(r["score"], r["failed_gate"], r["data_gap"]) for r in decision.score_signal(df).collect()]
    assert abs(s[0][0] - (0.3 * 2 / 3 + 0.2 * 0.1 + 0.1) / 0.95) < 1e-9 and s[2] == (None, None, "NO_ODDS") and s[3][:2] == (0.0, "freshness")


def test_resolution_cascade(spark):
    w = small(spark)
    w["team_identity_overrides"] = make(spark, "team_identity_overrides", [("o", "s", "Odd Name", "B", "x")], "override_id string, source string, alias_raw string, team_id string, reason string")
    names = spark.createDataFrame([("s", "Team A", "X"), ("t", "TEAM  a FC", "X"), ("s", "Odd Name", "X"), ("s", "Teem A", "X"), ("s", "Team A", "Y")], "source string, raw_name string, country string")
    got = [(r["raw_name"], r["country"], r["team_id"], r["method"]) for r in identity.resolve(names, w).collect()]
    assert sorted(got, key=str) == sorted([("Team A", "X", "A", "EXACT"), ("TEAM  a FC", "X", "A", "NORMALIZED"), ("Odd Name", "X", "B", "OVERRIDE"), ("Teem A", "X", None, "UNRESOLVED"), ("Team A", "Y", None, "UNRESOLVED")], key=str)
    asked = identity.proposals(names.filter("raw_name = 'Teem A'"), w["teams"]).collect()
    assert asked and asked[0]["team_id"] == "A" and asked[0]["score"] >= 0.8


def test_proposals_without_a_common_initial(spark):
    teams = spark.createDataFrame([("i", "Inter", "X"), ("j", "Inter", "Y")], "team_id string, canonical_name string, country string")
    (r,) = identity.proposals(spark.createDataFrame([("s", "Jnter", "X")], "source string, raw_name string, country string"), teams).collect()
    assert r["team_id"] == "i" and abs(r["score"] - 13 / 15) < 1e-9


CSV = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,HTAG,PSH,PSD,PSA,PSCH,PSCD,PSCA,B365H\nI1,20/08/2023,19:45,Team A,Team B,2,1,H,1,0,2.1,3.3,3.9,2.0,3.4,4.0,1\nI1,21/08/23,,Team C,Nobody,,,,,,,,,,,,\n,,,,,,,,,,,,,,,,\n"


def test_bronze_to_silver(spark, tmp_path):
    (tmp_path / "i1.csv").write_text(CSV)
    bronze = adapters.read_results_csv(spark, str(tmp_path / "i1.csv"))
    rows = bronze.orderBy("match_date").collect()
    assert [(r["match_date"], r["kickoff_precision"], r["goals_home"]) for r in rows] == [("2023-08-20", "LOCAL_APPROX", "2"), ("2023-08-21", "DATE_ONLY", None)]
    assert odds.observations_from_json(bronze).count() == 6
    w = small(spark)
    countries = spark.createDataFrame([("I1", "X")], "competition string, country string")
    new = ingest.transform(bronze.unionByName(bronze.withColumns({"source": F.lit("z"), "kickoff_utc": F.lit("2023-08-20T20:00:00+00:00")}), allowMissingColumns=True).withColumns({c: F.lit(None).cast("string") for c in ("home_source_id", "away_source_id", "result_settled_at", "ingested_at")}), w, countries)
    counted = {k: v.count() for k, v in new.items()}
    # the second source names the same match, an unknown side goes to quarantine with a proposal at most
    assert counted["matches"] == 1 and counted["match_results"] == 1 and counted["match_quarantine"] == 2 and counted["team_season_membership"] == 2 and counted["match_source_ids"] == 2 and counted["match_kickoff_revisions"] == 1
    settled = new["match_results"].first()["settled_at"]
    assert settled == dt.datetime(2023, 8, 21, 3, 59)
    with pytest.raises(ValueError, match="missing"):
        (tmp_path / "bad.csv").write_text("Date,HomeTeam\n1,2\n")
        adapters.read_results_csv(spark, str(tmp_path / "bad.csv"))


def test_fixture_json_scores(spark, tmp_path):
    shapes = ['{"ft":[2,1],"ht":[1,0]}', '{"ft":[0,0]}', "{}", "[3,2]", None]
    rows = ",".join('{"date":"2024-01-0%d","time":"20:45","team1":"A","team2":"B"%s}' % (i + 1, f',"score":{s}' if s else "") for i, s in enumerate(shapes))
    (tmp_path / "f.json").write_text('{"name":"x","matches":[%s,{"date":"2024-01-09","team1":"A"}]}' % rows)
    got = adapters.read_fixtures_json(spark, str(tmp_path / "f.json"), "c", "s").orderBy("match_date").collect()
    assert [(r["goals_home"], r["goals_away"], r["goals_home_ht"]) for r in got] == [("2", "1", "1"), ("0", "0", None), (None, None, None), ("3", "2", None), (None, None, None)]
    assert got[0]["kickoff_utc"] == "2024-01-01T20:45:00+00:00"


def test_series_and_upcoming(spark):
    df = spark.createDataFrame([("7", "b", "1", "2.5", "2024-01-01 10:00:00", None), ("7", "b", "9", "2.5", "2024-01-01 10:00:00", None), ("7", "b", "2", "1.0", "", None)], "ID string, bookmaker string, result string, odds string, odds_datetime string, disabled_date string")
    assert [(r["selection"], r["price_decimal"]) for r in adapters.price_series(df).collect()] == [("HOME", 2.5)]
    with pytest.raises(Exception, match="without an instant"):
        adapters.price_series(df.withColumns({"odds": F.lit("2.0"), "result": F.lit("1")})).collect()
    up = spark.createDataFrame([("E0", "01/01/2024", "A", "B", "2.0", "3.0", "4.0", "2.1", "", "4.1"), ("E0", "01/01/2024", None, "B", "2", "3", "4", "2", "3", "4")], "Div string, Date string, HomeTeam string, AwayTeam string, PSH string, PSD string, PSA string, B365H string, B365D string, B365A string")
    assert [(r["match_key"], r["bookmaker"], r["home"]) for r in adapters.upcoming_quotes(up).collect()] == [("E0|01/01/2024|A|B", "pinnacle", 2.0)]
    assert adapters.snake_columns(up).columns[:3] == ["div", "date", "home_team"]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("s", "c", "2023", "2023-01-01", "1", 5)], "source string, competition string, season string, match_date string, source_id string, n int")
    versions.write_bronze(rows, root, "r1")
    first = versions.manifest(spark, root)
    assert versions.load(spark, versions.save(spark, first, str(tmp_path / "m"))) == first and versions.verify(spark, first) == []
    versions.write_bronze(rows.withColumns({"source_id": F.lit("2"), "extra": F.lit("e")}), root, "r2")
    assert versions.read_bronze(spark, root, source="s").count() == 2 and len(versions.verify(spark, first)) == 1
    assert versions.read_version(spark, first).count() == 1 and versions.manifest(spark, root)["version"] != first["version"]
    with pytest.raises(ValueError):
        versions.write_bronze(rows.limit(0), root, "r3")


def test_digest_ignores_order(spark):
    df = spark.range(100).select("id", F.lit(None).cast("string").alias("s"))
    a, b = ingest.snapshot_digest(df).first(), ingest.snapshot_digest(df.orderBy(F.desc("id")).repartition(7)).first()
    assert a == b and ingest.snapshot_digest(df.limit(99)).first() != a and ingest.snapshot_digest(df.limit(0)).first()["n"] == 0


def test_pool_and_walk_forward(spark):
    rows = [(hours(i), [0.5, 0.3, 0.2], [0.8, 0.1, 0.1] if i % 10 < 8 else [0.1, 0.45, 0.45], 0 if i % 10 < 8 else 1 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "settled_at timestamp, market array<double>, model array<double>, outcome int")
    got = models.fit_weights(df, [hours(100), hours(201), hours(-5)]).orderBy("trained_through").collect()
    assert [r["n_train"] for r in got] == [100, 200] and all(r["train_max_settled_at"] < r["trained_through"] and r["weight"] > 0.8 and r["train_logloss"] <= r["market_logloss"] for r in got)
    p = spark.range(1).select(models.log_pool(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.9), F.lit(0.1)), 0.5).alias("p")).first()["p"]
    assert abs(sum(p) - 1) < 1e-12 and abs(p[0] / p[1] - 3) < 1e-9
    scored = models.score_forecasts(df.withColumn("probs", F.col("model")), []).first()
    assert scored["n"] == 200 and scored["logloss"] < 0.6
    m = [("L", hours(24 * i), hours(24 * i + 2), f"T{i % 4}", f"T{(i + 1 + i // 4) % 4 if (i + 1 + i // 4) % 4 != i % 4 else (i + 2) % 4}", i % 4, (i * 7) % 3) for i in range(60)]
    fits = models.walk_forward(spark.createDataFrame(m, "league string, kickoff_utc timestamp, settled_at timestamp, home string, away string, home_goals int, away_goals int"), [hours(24 * 30), hours(24 * 59)], ["league"], "poisson", half_life_days=60)
    assert {(r["trained_through"], r["n_train"]) for r in fits.collect()} == {(hours(24 * 30), 30), (hours(24 * 59), 59)}


# --- provider documents


def test_unnesting(spark):
    doc = {"matchInfo": {"id": "m"}, "liveData": {"lineUp": [{"contestantId": "c1", "stat": [{"type": "goals", "value": "2"}, {"type": "pct", "value": "51.5"}], "player": [{"playerId": "p1", "stat": [{"type": "passes", "value": "10"}]}, {"playerId": "p2", "stat": []}]}], "event": [{"id": 1}, {"id": 2}], "matchDetails": {"state": "done"}}}
    from tallyfield.sources.records import frame

    df = frame(spark, [doc])
    players = nested.player_stats(df).collect()
    assert [(r["playerId"], r["stats"], r["_contestant_id"], r["_match_uuid"]) for r in players] == [("p1", {"passes": "10"}, "c1", "m")]
    team = nested.team_stats(df).select(nested.stat(F.col("stats"), "pct").alias("pct"), "contestantId").first()
    assert (team["pct"], team["contestantId"]) == (51.5, "c1")
    assert [r["id"] for r in nested.match_events(df).collect()] == [1, 2]
    assert nested.match_events(frame(spark, [{"liveData": {"events": {"event": [{"id": 5}]}}}])).first()["id"] == 5
    rank = frame(spark, [{"competition": {"id": "x"}, "matchData": {"id": "m", "stat": [{"type": "g", "value": "1"}], "teamData": [{"id": "h", "side": "Home"}, {"id": "a", "side": "Away"}]}, "team": [{"id": "t", "stat": [{"type": "g", "value": "3"}], "player": [{"id": "p", "stat": [{"type": "g", "value": "2"}]}]}]}])
    got = {r["_record_type"]: r for r in nested.rankings(rank).collect()}
    assert set(got) == {"match", "team", "player"} and (got["match"]["_home_team_id"], got["match"]["_away_team_id"], got["player"]["_team_id"]) == ("h", "a", "t")
    assert nested.tournament_schedule(frame(spark, [{"matchDate": [{"date": "d1", "match": [{"id": 1}, {"id": 2}]}, {"date": "d2", "match": [{"id": 3}]}]}])).count() == 3
    season = frame(spark, [{"competition": {"n": "c"}, "player": [{"id": "p", "stat": [{"name": "g", "value": "1"}]}, {"id": "q", "stat": None}], "contestant": {"id": "t", "stat": [{"name": "g", "value": "9"}], "player": [{"id": "p"}]}}])
    assert nested.season_player_stats(season).count() == 2 and nested.season_team_stats(season).first()["stats"] == {"g": "9"}
    merged = nested.possession(frame(spark, [{"matchInfo": {"id": "m", "z": 1}, "possession": {"home": 60, "z": 2}, "liveData": {"q": 3}}])).first()
    assert (merged["home"], merged["z"], merged["q"], merged["_possession"]["z"]) == (60, 1, 3, 2)
    assert nested.referees(frame(spark, [{"referee": [{"id": 1}, {"id": 2}]}])).count() == 2 and nested.transfers(frame(spark, [{"x": 1}])).first()["x"] == 1


def test_paged_source(spark, tmp_path):
    import json

    folder = tmp_path / "events"
    folder.mkdir()
    for page, n in ((1, 2), (2, 2), (3, 1)):
        (folder / f"{page}.json").write_text(json.dumps([{"id": page * 10 + k} for k in range(n)]))
    known = api.read(spark, "statsbomb", "events", "id long", root=str(tmp_path), pages=3, match_id=7)
    assert sorted(r["id"] for r in known.collect()) == [10, 11, 20, 21, 30] and known.rdd.getNumPartitions() == 3
    walked = api.read(spark, "opta", "events", root=str(tmp_path), page_size=2, fixture_uuid="x")
    assert sorted(r["page"] for r in walked.collect()) == [1, 2, 3]
    assert len(api.OPTA) == 22 and len(api.STATSBOMB) == 8
    for bad in (("none", "events", {}), ("opta", "none", {}), ("opta", "events", {"colour": 1})):
        with pytest.raises(ValueError):
            api.read(spark, bad[0], bad[1], **bad[2])


def test_provider_feeds(spark, tmp_path):
    import json

    from tallyfield.sources import providers

    ask = providers.Requests("K")
    assert len([n for n in dir(ask) if not n.startswith("_") and callable(getattr(ask, n))]) == len(api.OPTA) == 22
    assert ask.areas().paged and not ask.areas("a").paged and ask.areas().page(2, 10)["_pgNm"] == "2"
    for bad in (lambda: ask.matches(date_from="2024-02-01", date_to="2024-01-01"), lambda: ask.matches(date_from="2024-02-01"), lambda: ask.venues(), lambda: ask.player_career(), lambda: ask.player_career("p", "c"), lambda: ask.referees(), lambda: ask.referees("p", "t"), lambda: ask.injuries(contestant_uuid="c"), lambda: ask.transfers(), lambda: ask.transfers("p", start_date="2024-01-01"), lambda: ask.transfers(tournament_calendar_uuid="t", start_date="2024-01-01", end_date="2024-01-02"), lambda: ask.match(""), lambda: ask.tournament_calendars("no"), lambda: providers.StatsBomb.request("none")):
        with pytest.raises(ValueError):
            bad()
    assert not ask.transfers("p").paged and ask.transfers(contestant_uuid="c").paged and not ask.injuries("p", "t").paged
    (tmp_path / "squads").mkdir()
    for page, ids in ((1, [1, 2]), (2, [3])):
        (tmp_path / "squads" / f"{page}.json").write_text(json.dumps({"teamSquads": {"squad": [{"id": k} for k in ids]}, "noise": [1, 2, 3, 4]}))
    opta = providers.Opta(spark, root=str(tmp_path), page_size=2)
    assert sorted(r["id"] for r in opta.squads(contestant_uuid="c", schema="id long").collect()) == [1, 2, 3]
    assert sorted(json.loads(r["record"])["id"] for r in opta.squads(contestant_uuid="c").collect()) == [1, 2, 3]
    with pytest.raises(AttributeError):
        opta.nothing()


def test_resampling_does_not_depend_on_partitions(spark):
    rows = spark.range(600).select((F.col("id") % 3).alias("g"), (F.col("id") % 50 + F.when(F.col("id") % 3 == 0, 9).otherwise(0)).cast("double").alias("v"), F.col("id").cast("string").alias("match_id"))
    for measure in (lambda df: research.permutation_test(df, "g", "v", 300), lambda df: backtest.bootstrap_mean(df, ["g"], "v", 300)):
        one, many = (sorted(map(tuple, measure(df).collect())) for df in (rows.coalesce(1), rows.repartition(7, "match_id")))
        assert all(a == pytest.approx(b) for a, b in zip(one, many, strict=True))
    assert research.permutation_test(rows, "g", "v", 300).first()["p_value"] < 0.01
    assert research.permutation_test(rows.withColumn("g", F.floor(F.col("v")) % 2 * 0 + F.col("match_id").cast("long") % 2), "g", "v", 300).first()["p_value"] > 0.05


def test_bootstrap_of_matches_tends_to_the_closed_form(spark):
    rng = random.Random(4)
    rows = [(str(i), rng.choice(["HOME", "DRAW", "AWAY"]), 0.4, 0.3, 0.3, rng.random() < 0.3) for i in range(900)]
    df = spark.createDataFrame(rows, "match_id string, outcome string, p_home double, p_draw double, p_away double, odd boolean")
    family = {"odd": ("odd", "p", False)}
    formula = {r["selection"]: r["se"] for r in research.scan(df, family).collect()}
    drawn = {r["selection"]: r["se"] for r in research.bootstrap_errors(df, family, draws=800).collect()}
    assert all(abs(drawn[s] / formula[s] - 1) < 0.12 for s in formula) and len(formula) == 3


def test_multiple_testing_by_families(spark):
    rows = [(None if i % 40 == 7 else "ab"[i % 2], None if i == 3 else (i * 37 % 100) / 100.0 * (i % 4) / 4) for i in range(400)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, f string, p_value double")
    got = {r["id"]: r for r in research.benjamini_hochberg(df, by=("f",), q=0.2).collect()}
    assert len(got) == 400 and got[3]["q_value"] is None and not got[3]["discovery"]
    for f in ("a", "b", None):
        p = sorted((v, i) for i, (g, v) in enumerate(rows) if g == f and v is not None)
        m, best, q = len(p), 1.0, {}
        for k in range(m, 0, -1):
            best = min(best, p[k - 1][0] * m / k)
            q[p[k - 1][1]] = best
        last = max([k for k in range(1, m + 1) if p[k - 1][0] <= 0.2 * k / m], default=0)
        found = {i for _, i in p[:last]}
        assert all(abs(got[i]["q_value"] - x) < 1e-12 and got[i]["discovery"] == (i in found) for i, x in q.items())


def test_null_edge_against_plain_draws(spark):
    import numpy as np

    rows = [(0.4, 0.05, 5, 0.06), (0.02, 0.1, 4, 0.05), (0.3, 0.0, 6, 0.05), (0.5, 0.02, 2, 0.05), (0.33, 0.08, 8, 0.0)]
    df = spark.createDataFrame(rows, "c double, s double, n int, o double")
    got = [r[0] for r in df.select(market.null_edge(F.col("c"), F.col("s"), F.col("n"), F.col("o"))).collect()]
    for (c, s, n, o), e in zip(rows, got, strict=True):
        if s <= 0 or n < 3:
            assert e == 0
            continue
        rng = np.random.default_rng(20260909)
        drawn = np.maximum(1e-4, c + rng.uniform(-s / 2, s / 2, (4000, n)))
        mine = rng.integers(0, n, 4000)
        edges = [np.median(np.delete(d, m)) / (d[m] * (1 + o / 3)) - 1 for d, m in zip(drawn, mine, strict=True)]
        assert abs(np.quantile(edges, 0.95) - e) < 1e-9


def test_ledger_of_amounts_beyond_28_digits(spark):
    day = dt.datetime(2024, 1, 1)
    wins = spark.createDataFrame([("run", day + dt.timedelta(days=k), f"m{k}", "b", "ONE_X_TWO", 0.0, "HOME", 1e4, "PREMATCH", None, 0.0) for k in range(13)], "run_id string, kickoff_utc timestamp, match_id string, bookmaker_id string, market_type string, line double, selection string, price double, price_precision string, model_prob double, rank double")
    results = spark.createDataFrame([(f"m{k}", 1, 0, day + dt.timedelta(days=k, hours=1)) for k in range(13)], "match_id string, goals_home int, goals_away int, settled_at timestamp")
    bets = sorted(backtest.run({"match_results": results}, wins).collect(), key=lambda r: r["kickoff_utc"])
    cash = 10**5  # cents
    for b in bets:
        stake = cash // 100
        assert (b["stake"] * 100, b["returned"] * 100) == (stake, stake * 10**4)
        cash += stake * (10**4 - 1)
    assert len(bets) == 13 and cash > 10**28


def test_strategies_join_their_prices_once(spark, data):
    """A union of strategies that each join all matches sorts them as often in one task."""
    from tallyfield.plans import catalogue

    plan = catalogue.queries()["strategies"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "c_custkey" not in plan  # the results of the oracle
    w = small(spark)
    once = backtest.with_priced(w)
    for made in (backtest.oracle, backtest.favourite, lambda x: backtest.take_selection(x, "HOME"), lambda x: backtest.take_selection(x, "HOME", "CLOSING")):
        rows = made(w).collect()
        assert sorted(map(str, made(once).collect())) == sorted(map(str, rows))
    assert backtest.favourite(w).count() > 0


def _candidates(spark, rows):
    return spark.createDataFrame(rows, "run_id string, kickoff_utc timestamp, match_id string, bookmaker_id string, market_type string, line double, selection string, price double, price_precision string, model_prob double, rank double")


def test_ledger_of_amounts_beyond_any_decimal(spark):
    day = dt.datetime(2024, 1, 1)
    wins = _candidates(spark, [("run", day + dt.timedelta(days=k), f"m{k}", "b", "ONE_X_TWO", 0.0, "HOME", 1e4, "PREMATCH", None, 0.0) for k in range(130)])
    results = spark.createDataFrame([(f"m{k}", 1, 0, day + dt.timedelta(days=k, hours=1)) for k in range(130)], "match_id string, goals_home int, goals_away int, settled_at timestamp")
    bets = sorted(backtest.fitted(backtest.run({"match_results": results}, wins, text=True)).collect(), key=lambda r: r["kickoff_utc"])
    cash = 10**5  # cents
    whole = lambda x: f"{x // 100}.{x % 100:02d}0000"
    for b in bets:
        stake = cash // 100
        assert (b["equity_open"], b["stake"], b["returned"], b["pnl"]) == tuple(map(whole, (cash, stake, stake * 10**4, stake * (10**4 - 1)))) and b["drawdown"] == 0
        cash += stake * (10**4 - 1)
    assert len(bets) == 130 and cash > 10**250
    few = backtest.fitted(backtest.run({"match_results": results}, wins.filter("kickoff_utc < '2024-01-05'"), text=True))
    assert few.dtypes == backtest.run({"match_results": results}, wins).dtypes and few.count() == 4
    with pytest.raises(Exception, match="(?i)decimal|precision"):
        backtest.run({"match_results": results}, wins).collect()


@pytest.mark.parametrize("policy", ["pro_rata", "truncate"])
def test_runs_are_folded_in_batches(spark, policy):
    """Cohorts and runs that lie across batches, a null run and a null kickoff: the bets of each run folded by itself."""
    import random

    pick, day = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(run, day + dt.timedelta(hours=k // 9), f"m{pick.randrange(60)}", f"b{pick.randrange(4)}", "ONE_X_TWO", 0.0, "HOME", 1 + pick.randrange(1, 400) / 100, "PREMATCH", None, pick.random()) for run in ("a", "b", None, "c") for k in range(200)]
    rows += [("a", None, "m1", "b9", "ONE_X_TWO", 0.0, "HOME", 2.0, "PREMATCH", None, 0.0)]
    results = spark.createDataFrame([(f"m{k}", k % 3, 1, day + dt.timedelta(hours=k % 25)) for k in range(50)], "match_id string, goals_home int, goals_away int, settled_at timestamp")
    config = backtest.Config(stake_fraction=0.07, policy=policy, frictions=backtest.Frictions(commission_rate=0.02, stake_increment=Decimal("0.05")))
    own = {}
    for r in rows:
        key = r[:4]
        if r[1] is not None and (key not in own or (r[-1], r[7]) > (own[key][-1], own[key][7])):
            own[key] = r
    goals = {r["match_id"]: r for r in results.collect()}
    want = []
    for run in ("a", "b", None, "c"):
        got = [r for r in own.values() if r[0] == run]
        state = lambda m: None if m not in goals else "WIN" if goals[m]["goals_home"] > goals[m]["goals_away"] else "LOSE"
        pdf = pd.DataFrame([(*r, state(r[2]), goals[r[2]]["settled_at"] if r[2] in goals else None) for r in got], columns=["run_id", "kickoff_utc", "match_id", "bookmaker_id", "market_type", "line", "selection", "price", "price_precision", "model_prob", "rank", "state", "settled_at"])
        want += [(run, b.match_id, b.bookmaker_id, b.kickoff_utc, b.outcome, b.stake, b.pnl, b.equity_open, b.drawdown) for b in backtest.fold_run(pdf, config).itertuples()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        bets = backtest.run({"match_results": results}, _candidates(spark, rows), config).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [(b["run_id"], b["match_id"], b["bookmaker_id"], b["kickoff_utc"], b["outcome"], b["stake"], b["pnl"], b["equity_open"], b["drawdown"]) for b in bets]
    assert sorted(map(str, ((*map(str, x[:5]), *map(float, x[5:])) for x in got))) == sorted(map(str, ((*map(str, x[:5]), *map(float, x[5:])) for x in want))) and len(got) > 150
