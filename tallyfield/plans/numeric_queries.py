"""Queries of grids, stakes, ratings, pools and research measures, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import goals, implied, markets, ratings, xt
from tallyfield.operators.joins import resolve_merges
from tallyfield.plans.market_queries import ANALYTIC, CLOSING, FAIR, GRID, MATCH, ONE_PRICE, TRIPLES, _events, _grids, _triples, one_price, rounded, staged, with_market
from tallyfield.plans.registry import query, table
from tallyfield.plans.stage_tables import ctes
from tallyfield.streaming import folds
from tallyfield.warehouse import backtest, identity, ingest, market, models, odds, research, views

# --- grids and stakes -----------------------------------------------------------------


@query("price_grid_rest", GRID + """,
x AS (SELECT id, h, a, h - a AS m, h + a AS t, p FROM g)
SELECT id, round(sum(p) FILTER (WHERE m > 0), 9) AS first, round(sum(p) FILTER (WHERE m = 0), 9) AS second, round(sum(p) FILTER (WHERE m < 0), 9) AS third, round(sum(p) FILTER (WHERE h = 0 OR a = 0), 9) AS btts_no, round(sum(p) FILTER (WHERE m <= 0), 9) AS x2, round(sum(p) FILTER (WHERE m <> 0), 9) AS no_draw,
  round(sum(p) FILTER (WHERE m < 0) / sum(p) FILTER (WHERE m <> 0), 9) AS dnb_away, round((sum(p) FILTER (WHERE t < 2.5) + sum(p) FILTER (WHERE t < 3)) / 2, 9) AS under, round(sum(p) FILTER (WHERE t = 3) / 2, 9) AS push, round((sum(p) FILTER (WHERE t > 2.5) + sum(p) FILTER (WHERE t > 3)) / 2, 9) AS over,
  round((sum(p) FILTER (WHERE m < -0.5) + sum(p) FILTER (WHERE m < -1)) / 2, 9) AS ah_win, round(sum(p) FILTER (WHERE m = -1) / 2, 9) AS ah_push, round((sum(p) FILTER (WHERE m > -0.5) + sum(p) FILTER (WHERE m > -1)) / 2, 9) AS ah_lose, round(sum(p) FILTER (WHERE m >= 0), 9) AS ah_half,
  round(sum(p) FILTER (WHERE m < 0 AND h = 0), 9) AS nil_away, round(3 * sum(p) FILTER (WHERE m < 0) + sum(p) FILTER (WHERE m = 0), 9) AS points_away FROM x GROUP BY id""")
def price_grid_rest(spark, d):
    def prices(g: markets.Cells) -> list[Column]:
        three, totals, handicap = markets.home_draw_away(g), markets.totals(g, 2.75), markets.asian_handicap_probs(g, "AWAY", -0.75)
        return [
            three[0].alias("first"), three[1].alias("second"), three[2].alias("third"), markets.btts_no(g).alias("btts_no"), markets.double_chance_x2(g).alias("x2"), markets.double_chance_12(g).alias("no_draw"), markets.draw_no_bet_away(g).alias("dnb_away"),
            *[totals[c].alias(c) for c in ("under", "push", "over")], *[handicap[c].alias(f"ah_{c}") for c in ("win", "push", "lose")], markets.asian_handicap(g, "HOME", 0.5).alias("ah_half"), markets.win_to_nil_away(g).alias("nil_away"), markets.expected_points_away(g).alias("points_away"),
        ]

    out = markets.by_cells(_grids(spark, d), ["id"], "g", prices)
    return rounded(out, *[c for c in out.columns if c != "id"])


@query("price_grid_goals", GRID + " SELECT id, 'home' AS side, h::INTEGER AS goals, round(sum(p), 9) AS p FROM g GROUP BY id, h UNION ALL SELECT id, 'away', a::INTEGER, round(sum(p), 9) FROM g GROUP BY id, a")
def price_grid_goals(spark, d):
    g = _grids(spark, d)
    side = lambda name, f: g.select("id", F.lit(name).alias("side"), F.posexplode(f(F.col("g"), 12)).alias("goals", "p"))
    return rounded(side("home", markets.home_goal_distribution).union(side("away", markets.away_goal_distribution)), "p")


FIVE = "x AS (SELECT s_suppkey AS id, 0.30 + (s_suppkey % 7) / 50.0 AS w, 0.10::DOUBLE AS hw, 0.05 + (s_suppkey % 3) / 50.0 AS hl, 1.8 + (s_suppkey % 11) / 10.0 AS price FROM supplier), y AS (SELECT *, 0.9 - w - hw - hl AS l, price - 1 AS b FROM x)"


@query("kelly_five_state", f"""
WITH RECURSIVE {FIVE},
r AS (SELECT id, 0 AS i, 0.0::DOUBLE AS lo, 1 - 1e-9 AS hi FROM y
  UNION ALL SELECT id, i + 1, CASE WHEN s > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > 0 THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT r.*, w * b / (1 + (lo + hi) / 2 * b) + hw * b / 2 / (1 + (lo + hi) / 2 * b / 2) - hl * 0.5 / (1 - (lo + hi) / 2 * 0.5) - l / (1 - (lo + hi) / 2) AS s FROM r JOIN y USING (id) WHERE i < 60)),
f AS (SELECT y.*, w * price + hw * (1 + b / 2) + 0.1 + hl * 0.5 - 1 AS ev, (lo + hi) / 2 AS root FROM r JOIN y USING (id) WHERE i = 60)
SELECT id, round(ev, 9) AS ev, round(CASE WHEN ev <= 0 THEN 0 ELSE root END, 7) AS stake, round(w * ln(1 + 0.1 * b) + hw * ln(1 + 0.05 * b) + hl * ln(0.95) + l * ln(0.9), 9) AS growth FROM f""")
def kelly_five_state(spark, d):
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k.alias("id"), (F.lit(0.30) + k % 7 / F.lit(50.0)).alias("w"), (F.lit(0.05) + k % 3 / F.lit(50.0)).alias("hl"), (F.lit(1.8) + k % 11 / F.lit(10.0)).alias("price"))
    s = F.struct(F.col("w").alias("win"), F.lit(0.10).alias("half_win"), F.lit(0.1).alias("push"), F.col("hl").alias("half_lose"), (F.lit(0.9) - F.col("w") - F.lit(0.10) - F.col("hl")).alias("lose"))
    x = x.withColumn("s", s)
    out = x.select("id", markets.expected_value(F.col("s"), F.col("price")).alias("ev"), markets.kelly_five_state(F.col("s"), F.col("price")).alias("stake"), markets.log_growth(F.col("s"), F.col("price"), F.lit(0.1)).alias("growth"))
    return rounded(rounded(out, "ev", "growth"), "stake", digits=7)


@query("kelly_exclusive", TRIPLES + """,
o AS (SELECT user_id, k, CASE k WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END AS price, (CASE k WHEN 0 THEN 0.45 WHEN 1 THEN 0.3 ELSE 0.25 END)::DOUBLE AS p FROM t CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
c AS (SELECT *, p * price AS e, row_number() OVER w AS n, sum(p) OVER w AS sp, sum(1 / price) OVER w AS sq FROM o WINDOW w AS (PARTITION BY user_id ORDER BY p * price DESC, p DESC)),
v AS (SELECT *, coalesce(lag((1 - sp) / (1 - sq)) OVER (PARTITION BY user_id ORDER BY n), 1.0) AS before FROM c),
taken AS (SELECT *, bool_and(e > before AND sq < 1) OVER (PARTITION BY user_id ORDER BY n) AS go FROM v),
reserve AS (SELECT user_id, coalesce(arg_max((1 - sp) / (1 - sq), n) FILTER (WHERE go), 1.0) AS r FROM taken GROUP BY user_id)
SELECT user_id, k::INTEGER AS k, round(greatest(0, p - r / price), 9) AS stake FROM o JOIN reserve USING (user_id)""")
def kelly_exclusive(spark, d):
    t = _triples(spark, d)
    stakes = markets.kelly_exclusive(F.array(F.lit(0.45), F.lit(0.3), F.lit(0.25)), F.col("odds"))
    return rounded(t.select("user_id", F.posexplode(stakes).alias("k", "stake")), "stake")


@query("hedge_stakes", TRIPLES + " SELECT user_id, round((greatest(10 * o0, 20 * o1, 5 * o2) - 10 * o0) / (o0 * 0.9), 6) AS first, round((greatest(10 * o0, 20 * o1, 5 * o2) - 20 * o1) / (o1 * 0.9), 6) AS second, 0.4 * o0 - 1 > 0.05 AS value FROM t")
def hedge_stakes(spark, d):
    s = markets.hedge_stakes(F.array(F.lit(10.0), F.lit(20.0), F.lit(5.0)), F.col("odds"), F.transform("odds", lambda o: o * 0.9))
    return rounded(_triples(spark, d).select("user_id", F.get(s, F.lit(0)).alias("first"), F.get(s, F.lit(1)).alias("second"), markets.value_bet(F.lit(0.4), F.get("odds", F.lit(0)), 0.05).alias("value")), "first", "second", digits=6)


@query("kelly_independent", TRIPLES + " SELECT user_id, round(greatest(0, (0.6 * o0 - 1) / (o0 - 1)), 6) AS alone, TRUE AS no_less FROM t WHERE o0 > 1 AND o1 > 1")
def kelly_independent(spark, d):
    """One event alone has the plain Kelly stake; two at once have no lower growth than either alone."""
    t = _triples(spark, d).select("user_id", F.get("odds", F.lit(0)).alias("o0"), F.get("odds", F.lit(1)).alias("o1")).filter("o0 > 1 AND o1 > 1")
    t = t.withColumn("one", F.get(markets.kelly_independent(F.array(F.lit(0.6)), F.array("o0")), F.lit(0))).withColumn("two", markets.kelly_independent(F.array(F.lit(0.6), F.lit(0.55)), F.array("o0", "o1")))
    a, b = F.col("two")[0], F.col("two")[1]
    legs = [(0.6 * 0.55, a * (F.col("o0") - 1) + b * (F.col("o1") - 1)), (0.6 * 0.45, a * (F.col("o0") - 1) - b), (0.4 * 0.55, b * (F.col("o1") - 1) - a), (0.4 * 0.45, -a - b)]
    both = sum((F.lit(p) * F.ln(1 + r) for p, r in legs), F.lit(0.0))
    alone = F.lit(0.6) * F.ln(1 + F.col("one") * (F.col("o0") - 1)) + F.lit(0.4) * F.ln(1 - F.col("one"))
    return t.select("user_id", F.round("one", 6).alias("alone"), (both >= alone - 1e-9).alias("no_less"))


@query("goal_expectancy", TRIPLES + " SELECT user_id, round(1/o0/s, 6) AS home, round(1/o1/s, 6) AS draw, round(1/o2/s, 6) AS away FROM t WHERE 1/o1/s < 0.30 AND 1/o0/s > 0.05 AND 1/o2/s > 0.05")
def goal_expectancy(spark, d):
    """The means found for three probabilities give these probabilities back."""
    t = _triples(spark, d).withColumn("p", implied.multiplicative(F.col("odds"))).filter("p[1] < 0.30 AND p[0] > 0.05 AND p[2] > 0.05")
    t = t.withColumn("m", goals.expected_goals(F.col("p")[0], F.col("p")[1], F.col("p")[2])).withColumn("g", markets.score_grid(F.col("m.home"), F.col("m.away")))
    return rounded(t.select("user_id", markets.home_win(F.col("g")).alias("home"), markets.draw(F.col("g")).alias("draw"), markets.away_win(F.col("g")).alias("away")), "home", "draw", "away", digits=6)


@query("elo_probabilities", "SELECT o_orderkey AS id, round(w / (1 + t), 9) AS home, round(t / (1 + t), 9) AS draw, round((1 - w) / (1 + t), 9) AS away FROM (SELECT o_orderkey, 0.3 * exp(-(g * g) / 80000.0) AS t, 1 / (1 + pow(10, -g / 400.0)) AS w FROM (SELECT o_orderkey, (1500 + o_orderkey % 300) + 100 - (1400 + o_custkey % 400) AS g FROM orders))")
def elo_probabilities(spark, d):
    o = table(spark, d, "orders")
    p = ratings.elo_probabilities(F.lit(1500.0) + F.col("o_orderkey") % 300, F.lit(1400.0) + F.col("o_custkey") % 400)
    return rounded(o.select(F.col("o_orderkey").alias("id"), *[c.alias(n) for c, n in zip(p, ("home", "draw", "away"), strict=True)]), "home", "draw", "away")


XT = """
WITH RECURSIVE e AS (
  SELECT CAST(least(floor((event_id % 100) * 12 / 100), 11) * 16 + least(floor(value * 16 / 100), 15) AS INTEGER) AS c, CAST(least(floor(((event_id * 7) % 100) * 12 / 100), 11) * 16 + least(floor(fmod(raw + event_id % 30, 100) * 16 / 100), 15) AS INTEGER) AS d,
    CASE WHEN event_id % 6 = 0 THEN 'shot' WHEN event_id % 6 < 4 THEN 'pass' ELSE 'carry' END AS f, event_id % 5 <> 0 AS ok FROM (SELECT event_id, value AS raw, least(100.0, greatest(0.0, value)) AS value FROM events)),
total AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE f = 'shot') AS shots, count(*) FILTER (WHERE f = 'shot' AND ok) AS goals FROM e GROUP BY c),
moved AS (SELECT f, c, d, count(*) AS n FROM e WHERE f <> 'shot' AND ok GROUP BY ALL),
done AS (SELECT f, c, sum(n) AS n FROM moved GROUP BY ALL),
pooled AS (SELECT c, d, sum(n) / (sum(sum(n)) OVER (PARTITION BY c)) AS share FROM moved GROUP BY c, d),
step AS (
  SELECT done.c, pooled.d, sum(done.n / total.n::DOUBLE * (coalesce(moved.n, 0) + 5 * pooled.share) / (done.n + 5)) AS w
  FROM done JOIN pooled ON pooled.c = done.c JOIN total ON total.c = done.c LEFT JOIN moved ON moved.f = done.f AND moved.c = done.c AND moved.d = pooled.d GROUP BY done.c, pooled.d
  UNION ALL SELECT k, k, 0.0 FROM (SELECT unnest(range(192))::INTEGER AS k)),
gain AS (SELECT k AS c, coalesce(shots / n::DOUBLE * (goals + 1) / (shots + 2), 0.0) AS g FROM (SELECT unnest(range(192))::INTEGER AS k) LEFT JOIN total ON total.c = k),
r AS (
  SELECT c, 0 AS i, 0.0::DOUBLE AS x FROM gain
  UNION ALL SELECT gain.c, s.i + 1, gain.g + s.x FROM (SELECT step.c, r.i, sum(step.w * r.x) AS x FROM r JOIN step ON step.d = r.c GROUP BY step.c, r.i) s JOIN gain ON gain.c = s.c WHERE s.i < 150)
"""


@query("xt_surface", XT + "SELECT c AS cell, round(x, 8) AS xt FROM r WHERE i = 150")
def xt_surface(spark, d):
    return rounded(xt.fit(_events(spark, d)).table(spark), "xt", digits=8)


@query("xt_scored", XT + """, v AS (SELECT c, x FROM r WHERE i = 150), n AS (SELECT event_id, CAST(least(floor((event_id % 100) * 12 / 100), 11) * 16 + least(floor(least(100.0, greatest(0.0, value)) * 16 / 100), 15) AS INTEGER) AS c FROM events WHERE event_id % 6 <> 0)
SELECT event_id, round(x, 8) AS xt_start FROM n JOIN v USING (c)""")
def xt_scored(spark, d):
    e = _events(spark, d)
    return rounded(xt.score(e, xt.fit(e)).filter("xt_start IS NOT NULL").select("event_id", "xt_start"), "xt_start", digits=8)


# --- forecasts ------------------------------------------------------------------------


def _forecasts(spark, d) -> DataFrame:
    """Two forecasts of each user's outcome."""
    p = implied.multiplicative(F.col("odds"))
    flat = F.transform(p, lambda x: (x + F.lit(1 / 3)) / 2)
    return _triples(spark, d).select("user_id", p.alias("market"), flat.alias("model"), (F.col("user_id") % 3).cast("int").alias("outcome"), (F.col("user_id") % 4).alias("run"))


FORECASTS = TRIPLES + ", f AS (SELECT user_id, user_id % 3 AS y, user_id % 4 AS run, 1/o0/s AS a, 1/o1/s AS b, 1/o2/s AS c FROM t), m AS (SELECT *, (a + 1/3.0::DOUBLE) / 2 AS ma, (b + 1/3.0::DOUBLE) / 2 AS mb, (c + 1/3.0::DOUBLE) / 2 AS mc FROM f)"


@query("forecast_scores", FORECASTS + " SELECT run, count(*) AS n, round(avg((pow(a - (y = 0)::INT, 2) + pow(b - (y = 1)::INT, 2) + pow(c - (y = 2)::INT, 2)) / 3), 9) AS brier, round(avg(-ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END)), 9) AS logloss, round(avg((pow(a - (y = 0)::INT, 2) + pow(a + b - (y <= 1)::INT, 2)) / 2), 9) AS rps FROM f GROUP BY run")
def forecast_scores(spark, d):
    return rounded(models.score_forecasts(_forecasts(spark, d), ["run"], "market"), "brier", "logloss", "rps")


@query("forecast_comparison", FORECASTS + " SELECT run, count(*) AS n, round(avg(ln(CASE y WHEN 0 THEN a WHEN 1 THEN b ELSE c END) - ln(CASE y WHEN 0 THEN ma WHEN 1 THEN mb ELSE mc END)), 9) AS gain, TRUE AS inside FROM m GROUP BY run")
def forecast_comparison(spark, d):
    out = models.compare_forecasts(_forecasts(spark, d), ["run"], "market", "model", draws=400)
    return rounded(out.select("run", "n", "gain", ((F.col("low") < F.col("gain")) & (F.col("gain") < F.col("high"))).alias("inside")), "gain")


@query("log_pool", FORECASTS + " SELECT user_id, round(x / (x + y2 + z), 9) AS home, round(z / (x + y2 + z), 9) AS away FROM (SELECT user_id, pow(a, 0.7) * pow(ma, 0.3) AS x, pow(b, 0.7) * pow(mb, 0.3) AS y2, pow(c, 0.7) * pow(mc, 0.3) AS z FROM m)")
def log_pool(spark, d):
    p = models.log_pool(F.col("market"), F.col("model"), 0.3)
    return rounded(_forecasts(spark, d).select("user_id", F.get(p, F.lit(0)).alias("home"), F.get(p, F.lit(2)).alias("away")), "home", "away")


@query("pool_weights", FORECASTS.replace("WITH q", "WITH RECURSIVE q") + """,
z AS (SELECT run, ln(a) AS a, ln(b) AS b, ln(c) AS c, ln(ma) - ln(a) AS u, ln(mb) - ln(b) AS v, ln(mc) - ln(c) AS w, y FROM m),
r AS (SELECT DISTINCT run, 0 AS i, -1.0::DOUBLE AS lo, 2.0::DOUBLE AS hi FROM z
  UNION ALL SELECT run, i + 1, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT r.run, r.i, r.lo, r.hi, avg(CASE y WHEN 0 THEN u WHEN 1 THEN v ELSE w END - (u * exp(a + x * u) + v * exp(b + x * v) + w * exp(c + x * w)) / (exp(a + x * u) + exp(b + x * v) + exp(c + x * w))) AS slope
    FROM (SELECT *, (lo + hi) / 2 AS x FROM r WHERE i < 45) r JOIN z ON z.run = r.run GROUP BY r.run, r.i, r.lo, r.hi))
SELECT run, round((lo + hi) / 2, 5) AS unconstrained, round(greatest(0, least(1, (lo + hi) / 2)), 5) AS weight FROM r WHERE i = 45""")
def pool_weights(spark, d):
    rows = _forecasts(spark, d).withColumn("settled_at", F.lit("2024-01-01").cast("timestamp"))
    out = models.fit_weights(rows, [dt.datetime(2024, 6, 1)], by=["run"])
    return rounded(out.select("run", "unconstrained", "weight"), "unconstrained", "weight", digits=5)


@query("market_channel", ctes(*MATCH, "match_results", "odds_observations", "bookmakers") + ANALYTIC + ONE_PRICE + FAIR + """,
w AS (SELECT match_id, capture_precision AS p, max(fair_prob) FILTER (WHERE selection = 'HOME') AS a, max(fair_prob) FILTER (WHERE selection = 'DRAW') AS b, max(fair_prob) FILTER (WHERE selection = 'AWAY') AS c FROM fair_probabilities JOIN bookmakers USING (bookmaker_id) WHERE is_reference GROUP BY match_id, capture_precision),
both_ AS (SELECT x.match_id, x.a, x.b, x.c, y.a AS ca, y.b AS cb, y.c AS cc, CASE WHEN goals_home > goals_away THEN 0 WHEN goals_home = goals_away THEN 1 ELSE 2 END AS o FROM w x JOIN w y ON y.match_id = x.match_id AND x.p = 'PREMATCH' AND y.p = 'CLOSING' JOIN analytic m ON m.match_id = x.match_id JOIN match_results r ON r.match_id = x.match_id),
s AS (SELECT *, greatest(abs(a - ca), abs(b - cb), abs(c - cc)) AS move, -ln(CASE o WHEN 0 THEN a WHEN 1 THEN b ELSE c END) AS l0, -ln(CASE o WHEN 0 THEN ca WHEN 1 THEN cb ELSE cc END) AS l1 FROM both_)
SELECT count(*) AS n, round(median(move), 9) AS median_move, round(avg(move), 9) AS mean_move, round(avg((move > 0.01)::INT), 9) AS share_moved, round(avg(l0), 9) AS pre_logloss, round(avg(l1 - l0), 9) AS logloss_gain FROM s""")
def market_channel(spark, d):
    out = research.market_channel(with_market(spark, d, "match_results")).select("n", "median_move", "mean_move", "share_moved", "pre_logloss", "logloss_gain")
    return rounded(out, *out.columns[1:])


# --- research -------------------------------------------------------------------------


@query("situation_family", ctes(*MATCH, "match_results", "odds_observations", "bookmakers") + ANALYTIC + ONE_PRICE + FAIR + """,
played AS (SELECT m.*, CASE WHEN goals_home > goals_away THEN 'HOME' WHEN goals_home < goals_away THEN 'AWAY' ELSE 'DRAW' END AS outcome FROM analytic m JOIN match_results USING (match_id)),
sides AS (SELECT match_id, kickoff_utc, unnest([home_team_id, away_team_id]) AS team, unnest(['H', 'A']) AS side, unnest([CASE outcome WHEN 'HOME' THEN 3 WHEN 'DRAW' THEN 1 ELSE 0 END, CASE outcome WHEN 'AWAY' THEN 3 WHEN 'DRAW' THEN 1 ELSE 0 END]) AS points FROM played),
timed AS (SELECT match_id, side, date_diff('day', lag(kickoff_utc) OVER w, kickoff_utc) AS rest, count(*) OVER (PARTITION BY team ORDER BY kickoff_utc RANGE BETWEEN INTERVAL 8 DAY PRECEDING AND CURRENT ROW) AS near, sum(points) OVER (PARTITION BY team ORDER BY kickoff_utc, match_id) - points AS points, row_number() OVER w AS matchday, count(*) OVER (PARTITION BY team) AS total FROM sides WINDOW w AS (PARTITION BY team ORDER BY kickoff_utc, match_id)),
prices AS (SELECT match_id, max(fair_prob) FILTER (WHERE selection = 'HOME') AS h, max(fair_prob) FILTER (WHERE selection = 'DRAW') AS d, max(fair_prob) FILTER (WHERE selection = 'AWAY') AS a, max(raw_implied_prob) FILTER (WHERE selection = 'HOME') AS rh, max(raw_implied_prob) FILTER (WHERE selection = 'DRAW') AS rd, max(raw_implied_prob) FILTER (WHERE selection = 'AWAY') AS ra FROM fair_probabilities WHERE capture_precision = 'TIMESTAMPED' AND bookmaker_id = 'b0' GROUP BY match_id),
l AS (SELECT p.outcome, h.rest AS hr, a.rest AS ar, h.near AS hn, a.near AS an, h.points AS hp, a.points AS ap, h.matchday AS md, h.total AS len, dayofweek(p.kickoff_utc) AS dow, month(p.kickoff_utc) AS mon, prices.* FROM played p JOIN timed h ON h.match_id = p.match_id AND h.side = 'H' JOIN timed a ON a.match_id = p.match_id AND a.side = 'A' JOIN prices ON prices.match_id = p.match_id),
x AS (SELECT *, s, CASE s WHEN 'HOME' THEN h WHEN 'DRAW' THEN d ELSE a END AS p, CASE s WHEN 'HOME' THEN rh WHEN 'DRAW' THEN rd ELSE ra END AS raw, (outcome = s)::INT AS y FROM l CROSS JOIN (SELECT unnest(['HOME', 'DRAW', 'AWAY']) AS s)),
c AS (
  SELECT s, y - raw AS r, 'control_longshot_raw' AS k, raw < 0.12 AS i FROM x UNION ALL SELECT s, y - raw, 'control_favourite_raw', raw > 0.60 FROM x UNION ALL SELECT s, y - p, 'control_longshot_devigged', p < 0.12 FROM x UNION ALL SELECT s, y - p, 'control_all_matches', TRUE FROM x
  UNION ALL SELECT s, y - p, 'home_short_rest', hr <= 3 FROM x UNION ALL SELECT s, y - p, 'away_short_rest', ar <= 3 FROM x UNION ALL SELECT s, y - p, 'home_rest_advantage', hr - ar >= 3 FROM x UNION ALL SELECT s, y - p, 'away_rest_advantage', ar - hr >= 3 FROM x
  UNION ALL SELECT s, y - p, 'home_congested', hn >= 3 FROM x UNION ALL SELECT s, y - p, 'away_congested', an >= 3 FROM x UNION ALL SELECT s, y - p, 'dead_rubber', md > len - 4 AND abs(hp - ap) < 8 AND hp >= len AND hp <= len * 1.7 FROM x
  UNION ALL SELECT s, y - p, 'mismatch_late_season', md > len - 6 AND abs(hp - ap) >= 20 FROM x UNION ALL SELECT s, y - p, 'midweek', dow = 2 OR dow = 3 OR dow = 4 FROM x UNION ALL SELECT s, y - p, 'festive', mon = 1 OR mon = 12 FROM x UNION ALL SELECT s, y - p, 'season_opening', md <= 3 FROM x)
SELECT k AS hypothesis, s AS selection, count(*) FILTER (WHERE coalesce(i, FALSE)) AS n_in, count(*) FILTER (WHERE NOT coalesce(i, FALSE)) AS n_out, round(avg(r) FILTER (WHERE coalesce(i, FALSE)), 8) AS bias_in, round(avg(r) FILTER (WHERE NOT coalesce(i, FALSE)), 8) AS bias_out FROM c GROUP BY k, s HAVING count(*) FILTER (WHERE coalesce(i, FALSE)) >= 1 AND count(*) FILTER (WHERE NOT coalesce(i, FALSE)) >= 1""")
def situation_family(spark, d):
    """The whole family of situations over labelled matches."""
    labelled = research.label_matches(with_market(spark, d, "match_results"), "TIMESTAMPED")
    return rounded(research.scan(labelled, least=1).select("hypothesis", "selection", "n_in", "n_out", "bias_in", "bias_out"), "bias_in", "bias_out", digits=8)


@query("formation_shocks", """
WITH a AS (SELECT o_custkey * 8 + CAST(floor(o_totalprice) AS BIGINT) % 8 AS match_id, CASE o_orderkey % 4 WHEN 0 THEN 'GOALKEEPER' WHEN 1 THEN 'DEFENDER' WHEN 2 THEN 'MIDFIELDER' ELSE 'FORWARD' END AS position, (o_orderkey % 10) / 10.0::DOUBLE AS share, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 6) / 10.0::DOUBLE END AS other FROM orders),
s AS (SELECT match_id, sum(CASE position WHEN 'GOALKEEPER' THEN 1.0 WHEN 'DEFENDER' THEN 0.6 WHEN 'MIDFIELDER' THEN 0.5 ELSE 0.8 END * greatest(0, share - coalesce(other, 0))) AS shock, count(*) AS n, bool_or(position = 'GOALKEEPER') AS g, bool_or(position = 'FORWARD' AND share >= 0.6) AS f, bool_or(position = 'DEFENDER' AND share >= 0.6) AS d FROM a GROUP BY match_id)
SELECT match_id, round(shock, 9) AS shock, n AS n_absent, CASE WHEN g OR f OR d OR n >= 3 THEN concat_ws(',', CASE WHEN g THEN 'GOALKEEPER_OUT' END, CASE WHEN f THEN 'KEY_FORWARD_OUT' END, CASE WHEN d THEN 'KEY_DEFENDER_OUT' END, CASE WHEN n >= 3 THEN 'MULTIPLE_ABSENCES' END, CASE WHEN n >= 5 THEN 'SURPRISE_XI' END) ELSE 'NONE' END AS categories FROM s""")
def formation_shocks(spark, d):
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select((F.col("o_custkey") * 8 + F.floor("o_totalprice").cast("long") % 8).alias("match_id"), F.when(k % 4 == 0, "GOALKEEPER").when(k % 4 == 1, "DEFENDER").when(k % 4 == 2, "MIDFIELDER").otherwise("FORWARD").alias("position"), (k % 10 / F.lit(10.0)).alias("start_share"), F.when(k % 7 > 0, k % 6 / F.lit(10.0)).alias("replacement_share"))
    return rounded(research.formation_shock(a).withColumn("categories", F.array_join("categories", ",")), "shock")


@query("price_cells", "SELECT CASE WHEN v < 1.5 THEN '1-1.5' WHEN v < 2 THEN '1.5-2' WHEN v < 3 THEN '2-3' WHEN v < 5 THEN '3-5' WHEN v < 10 THEN '5-10' ELSE '10+' END AS band, count(*) AS n, round(avg(value), 8) AS mean, round(stddev_samp(value) / sqrt(count(*)), 8) AS se, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 6) AS t FROM (SELECT 1 + value / 8 AS v, value FROM events) GROUP BY 1")
def price_cells(spark, d):
    e = table(spark, d, "events").select(research.price_band(1 + F.col("value") / 8).alias("band"), "value")
    return rounded(rounded(research.cells(e, ["band"], "value").drop("p_value"), "mean", "se", digits=8), "t", digits=6)


@query("calibration_measures", """
WITH x AS (SELECT event_type, (event_id % 97) / 97.0::DOUBLE AS p, (event_id * 31 % 101 < event_id % 97)::INT AS y FROM events),
b AS (SELECT event_type, least(floor(p * 10), 9) AS band, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM x GROUP BY ALL),
c AS (SELECT event_type, sum(n * gap) / sum(n) AS error FROM b GROUP BY event_type), k AS (SELECT event_type, 1 - avg(pow(p - y, 2)) / (avg(y) * (1 - avg(y))) AS skill FROM x GROUP BY event_type)
SELECT event_type, round(error, 8) AS calibration_error, round(skill, 8) AS skill FROM c JOIN k USING (event_type)""")
def calibration_measures(spark, d):
    k = F.col("event_id")
    x = table(spark, d, "events").select("event_type", (k % 97 / F.lit(97.0)).alias("p"), (k * 31 % 101 < k % 97).alias("won"))
    both = research.calibration_error(x, ["event_type"], "p", "won").join(research.brier_skill(x, ["event_type"], "p", "won"), "event_type")
    return rounded(both.select("event_type", "calibration_error", "skill"), "calibration_error", "skill", digits=8)


@query("evidence_classes", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 13 > 0 THEN (event_id % 21 - 8) / 100.0::DOUBLE END AS edge, 0.02::DOUBLE AS null_edge, event_id % 9 AS n, event_id % 5 = 0 AS aged, 1 + value / 10 AS price FROM events)
SELECT event_id, CASE WHEN edge IS NULL OR n < 3 THEN 'D' WHEN edge > null_edge AND n >= 5 AND NOT aged THEN 'A' WHEN edge > null_edge AND NOT aged THEN 'B' WHEN edge > 0 THEN 'C' ELSE 'D' END AS class, round(1 + (price - 1) * 0.95, 9) AS net FROM x""")
def evidence_classes(spark, d):
    k = F.col("event_id")
    out = table(spark, d, "events").select("event_id", research.evidence_class(F.when(k % 13 > 0, (k % 21 - 8) / F.lit(100.0)), F.lit(0.02), k % 9, k % 5 == 0).alias("class"), research.net_price(1 + F.col("value") / 10, 0.05).alias("net"))
    return rounded(out, "net")


@query("difference_in_differences", """
WITH w AS (SELECT event_id AS match_id, value - 50 AS did FROM events), c AS (SELECT event_id AS match_id, event_type AS category FROM events WHERE event_id % 3 <> 0),
t AS (SELECT category, count(*) AS n, avg(abs(did)) AS m, var_samp(abs(did)) AS v FROM w JOIN c USING (match_id) GROUP BY category), k AS (SELECT count(*) AS n, avg(abs(did)) AS m, var_samp(abs(did)) AS v FROM w WHERE match_id NOT IN (SELECT match_id FROM c))
SELECT category, t.n AS n_treated, k.n AS n_control, round(t.m - k.m, 8) AS effect, round(sqrt(t.v / t.n + k.v / k.n), 8) AS se FROM t CROSS JOIN k""")
def difference_in_differences(spark, d):
    e = table(spark, d, "events")
    w = e.select(F.col("event_id").alias("match_id"), (F.col("value") - 50).alias("did"))
    c = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("match_id"), F.col("event_type").alias("category"))
    out = research.difference_in_differences(w, c)
    return rounded(out.select("category", "n_treated", "n_control", "effect", "se"), "effect", "se", digits=8)


@query("two_way_clv", "WITH x AS (SELECT event_id, 1.5 + event_id % 10 / 10.0::DOUBLE AS co, 1.6 + event_id % 7 / 10.0::DOUBLE AS cu, 1.4 + value / 100 AS o, 2.2::DOUBLE AS u FROM events), q AS (SELECT event_id, 'OVER' AS selection, o AS price, 1/co / (1/co + 1/cu) * o - 1 AS clv FROM x UNION ALL SELECT event_id, 'UNDER', u, 1/cu / (1/co + 1/cu) * u - 1 FROM x) SELECT event_id, selection, round(price, 9) AS price, round(clv, 9) AS clv FROM q WHERE abs(clv) <= 0.5")
def two_way_clv(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", (F.lit(1.5) + k % 10 / F.lit(10.0)).alias("C>"), (F.lit(1.6) + k % 7 / F.lit(10.0)).alias("C<"), (F.lit(1.4) + F.col("value") / 100).alias("B>"), F.lit("2.2").alias("B<"), F.lit("x").alias("Z>"), F.lit(None).cast("string").alias("Z<"))
    out = research.two_way_clv(rows, "TOTALS", {"b": ("B>", "B<"), "z": ("Z>", "Z<")}, ("C>", "C<"), ("OVER", "UNDER"), "multiplicative")
    return rounded(out.select("event_id", "selection", "price", "clv"), "price", "clv")


@query("last_days", """
WITH m AS (SELECT DISTINCT user_id AS match_id, DATE '2024-03-01' + CAST(user_id % 10 AS INTEGER) AS day, user_id % 3 AS y FROM events WHERE user_id % 10 >= 6),
q AS (SELECT match_id, b, 1.5 + (match_id * 7 + b * 13) % 20 / 10.0::DOUBLE AS o0, 2.5 + (match_id + b * 5) % 15 / 10.0::DOUBLE AS o1, 3.0 + (match_id * 3 + b) % 25 / 10.0::DOUBLE AS o2, day, y FROM m CROSS JOIN (SELECT unnest(range(6)) AS b)),
p AS (SELECT match_id, day, y, b, k, CASE k WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END AS price, 1 / CASE k WHEN 0 THEN o0 WHEN 1 THEN o1 ELSE o2 END / (1/o0 + 1/o1 + 1/o2) AS fair FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))
SELECT match_id, day, k::INTEGER AS place, round(median(fair), 9) AS fair, round(max(price), 9) AS best_price, round(median(fair) * max(price) - 1, 9) AS edge, round(max(price) / CASE k WHEN 0 THEN 2.0 WHEN 1 THEN 3.0 ELSE 4.0 END / (1/2.0::DOUBLE + 1/3.0::DOUBLE + 1/4.0::DOUBLE) - 1, 9) AS clv, any_value(y) = k AS won FROM p GROUP BY match_id, day, k""")
def last_days(spark, d):
    u = F.col("match_id")
    m = table(spark, d, "events").select(F.col("user_id").alias("match_id")).distinct()
    results = m.select("match_id", F.date_add(F.lit("2024-03-01").cast("date"), (u % 10).cast("int")).alias("day"), (u % 3).alias("outcome"))
    b = F.col("b")
    quotes = m.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("b")).select("match_id", F.concat(F.lit("b"), b).alias("bookmaker_id"), F.array(F.lit(1.5) + (u * 7 + b * 13) % 20 / F.lit(10.0), F.lit(2.5) + (u + b * 5) % 15 / F.lit(10.0), F.lit(3.0) + (u * 3 + b) % 25 / F.lit(10.0)).alias("odds"))
    closing = m.select("match_id", F.array(F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("odds"))
    out = research.last_days(quotes, closing, results, F.lit("2024-03-10").cast("date"), 3, 5, "multiplicative")
    return rounded(out.drop("n_books", "best_book"), "fair", "best_price", "edge", "clv")


@query("leave_one_out", """
WITH q AS (SELECT user_id AS m, b, 1.5 + (user_id * 7 + b * 13) % 20 / 10.0::DOUBLE AS o0, 2.5 + (user_id + b * 5) % 15 / 10.0::DOUBLE AS o1 FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT unnest(range(4)) AS b)),
f AS (SELECT *, 1/o0 / (1/o0 + 1/o1) AS p FROM q) SELECT x.m AS match_id, 'b' || x.b AS book, round(median(y.p) * x.o0 - 1, 9) AS edge FROM f x JOIN f y ON y.m = x.m AND y.b <> x.b GROUP BY x.m, x.b, x.o0""")
def leave_one_out(spark, d):
    u, b = F.col("match_id"), F.col("b")
    q = table(spark, d, "events").select(F.col("user_id").alias("match_id")).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3))))
    q = q.select("match_id", F.concat(F.lit("b"), b).alias("bookmaker_id"), F.array(F.lit(1.5) + (u * 7 + b * 13) % 20 / F.lit(10.0), F.lit(2.5) + (u + b * 5) % 15 / F.lit(10.0)).alias("odds"))
    out = market.consensus(q, method="multiplicative").filter("place = 0").select("match_id", F.explode("leave_one_out").alias("x"))
    return rounded(out.select("match_id", F.col("x.book").alias("book"), F.col("x.edge").alias("edge")), "edge")


# --- strategies, metrics, identity, ingest --------------------------------------------


PRICED = ctes(*MATCH, "match_results", "odds_observations", "model_runs", "predictions") + ANALYTIC + ", priced AS (SELECT o.*, m.kickoff_utc FROM odds_observations o JOIN analytic m ON m.match_id = o.match_id)"


@query("strategies", PRICED + """,
short AS (SELECT *, row_number() OVER (PARTITION BY match_id, bookmaker_id, line ORDER BY price_decimal, selection) AS n FROM priced WHERE capture_precision = 'PREMATCH'),
won AS (SELECT p.* FROM priced p JOIN match_results r ON r.match_id = p.match_id WHERE capture_precision = 'PREMATCH' AND selection = CASE WHEN goals_home > goals_away THEN 'HOME' WHEN goals_home < goals_away THEN 'AWAY' ELSE 'DRAW' END),
one AS (SELECT *, row_number() OVER (PARTITION BY kickoff_utc, match_id, bookmaker_id, market_type, line, selection ORDER BY price_decimal DESC) AS n FROM priced WHERE capture_precision = 'PREMATCH')
SELECT 'selection' AS strategy, match_id, bookmaker_id, selection, price_decimal AS price FROM priced WHERE capture_precision = 'PREMATCH' AND selection = 'HOME' UNION ALL SELECT 'favourite', match_id, bookmaker_id, selection, price_decimal FROM short WHERE n = 1
UNION ALL SELECT 'oracle', match_id, bookmaker_id, selection, price_decimal FROM won UNION ALL SELECT 'deduplicated', match_id, bookmaker_id, selection, price_decimal FROM one WHERE n = 1""")
def strategies(spark, d):
    w = backtest.with_priced(staged(spark, d, *MATCH, "match_results", "odds_observations"))
    every = backtest.take_selection(w, "HOME").unionByName(backtest.take_selection(w, "DRAW")).unionByName(backtest.take_selection(w, "AWAY")).withColumn("rank", F.col("price"))
    parts = {"selection": backtest.take_selection(w, "HOME"), "favourite": backtest.favourite(w), "oracle": backtest.oracle(w), "deduplicated": backtest.deduplicated(every)}
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("strategy"), "match_id", "bookmaker_id", "selection", "price")
        out = rows if out is None else out.union(rows)
    return out


@query("backtest_metrics", """
WITH b AS (SELECT event_type AS run_id, 5.0::DOUBLE AS stake, CASE WHEN event_id % 3 = 0 THEN value / 20 - 5 ELSE -1.0 END AS pnl, event_id % 3 = 0 AS won, value / 1000 AS drawdown FROM events)
SELECT run_id, count(*) AS n_bets, round(sum(pnl), 6) AS pnl, round(avg(won::INT), 9) AS win_rate, round(max(drawdown), 9) AS max_drawdown, round(sum(pnl) / sum(stake), 9) AS yield_on_turnover, round(sum(pnl) / 1000, 9) AS growth, round(avg(pnl / stake) / stddev_samp(pnl / stake) * sqrt(count(*)), 6) AS sharpe FROM b GROUP BY run_id""")
def backtest_metrics(spark, d):
    won = F.col("event_id") % 3 == 0
    b = table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.lit(5.0).alias("stake"), F.when(won, F.col("value") / 20 - 5).otherwise(-1.0).alias("pnl"), F.when(won, "WIN").otherwise("LOSE").alias("outcome"), (F.col("value") / 1000).alias("drawdown"))
    out = backtest.metrics(b).select("run_id", "n_bets", "pnl", "win_rate", "max_drawdown", "yield_on_turnover", "growth", "sharpe")
    return rounded(rounded(out, "win_rate", "max_drawdown", "yield_on_turnover", "growth"), "pnl", "sharpe", digits=6)


RESOLVE = ("teams", "team_aliases", "team_identity_overrides")


@query("resolved_names", ctes(*RESOLVE) + """,
n AS (SELECT DISTINCT source, alias_raw AS raw_name, country FROM (SELECT 's1' AS source, c_name AS alias_raw, CAST(c_nationkey AS VARCHAR) AS country FROM customer UNION ALL SELECT 's9', upper(c_name) || ' FC', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 's2', 'nobody', '3')),
good AS (SELECT a.*, t.country, trim(regexp_replace(lower(alias_raw), '#', ' ')) AS norm FROM team_aliases a JOIN teams t USING (team_id) WHERE status = 'APPROVED'),
ex AS (SELECT source, alias_raw, country, min(team_id) AS t FROM good GROUP BY ALL HAVING count(DISTINCT team_id) = 1), nm AS (SELECT norm, country, min(team_id) AS t FROM good GROUP BY ALL HAVING count(DISTINCT team_id) = 1),
ov AS (SELECT source, alias_raw, min(team_id) AS t FROM team_identity_overrides GROUP BY ALL)
SELECT n.source, n.raw_name, n.country, coalesce(ov.t, ex.t, nm.t) AS team_id, CASE WHEN ov.t IS NOT NULL THEN 'OVERRIDE' WHEN ex.t IS NOT NULL THEN 'EXACT' WHEN nm.t IS NOT NULL THEN 'NORMALIZED' ELSE 'UNRESOLVED' END AS method
FROM n LEFT JOIN ov ON ov.source = n.source AND ov.alias_raw = n.raw_name LEFT JOIN ex ON ex.source = n.source AND ex.alias_raw = n.raw_name AND ex.country = n.country LEFT JOIN nm ON nm.norm = trim(regexp_replace(regexp_replace(lower(n.raw_name), '#', ' '), ' fc$', '')) AND nm.country = n.country""")
def resolved_names(spark, d):
    c = table(spark, d, "customer")
    country = F.col("c_nationkey").cast("string").alias("country")
    names = c.select(F.lit("s1").alias("source"), F.col("c_name").alias("raw_name"), country).union(c.select(F.lit("s9"), F.concat(F.upper("c_name"), F.lit(" FC")), country)).union(c.select(F.lit("s2"), F.lit("nobody"), F.lit("3"))).distinct()
    return identity.resolve(names, staged(spark, d, *RESOLVE)).select("source", "raw_name", "country", "team_id", "method")


@query("settle_instants", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 18 HOUR ELSE date_trunc('day', o_orderdate) + INTERVAL 1439 MINUTE + INTERVAL 4 HOUR END AS known FROM orders")
def settle_instants(spark, d):
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 16 * 3600)
    return table(spark, d, "orders").select("o_orderkey", ingest.settle_instant(at, F.to_date("o_orderdate"), F.when(k % 3 == 0, "EXACT").when(k % 3 == 1, "LOCAL_APPROX").otherwise("DATE_ONLY")).alias("known"))


@query("odds_from_json", "SELECT 'x' || o_orderkey AS source_id, 'pinnacle' AS bookmaker, 'HOME' AS selection, (1.5 + o_orderkey % 10)::DOUBLE AS price_decimal, 'CLOSING' AS capture_precision FROM orders UNION ALL SELECT 'x' || o_orderkey, 'b2', 'AWAY', (o_orderkey % 4 + 0.5)::DOUBLE, 'PREMATCH' FROM orders WHERE o_orderkey % 4 >= 1")
def odds_from_json(spark, d):
    k = F.col("o_orderkey")
    quote = lambda b, s, p, c: F.struct(F.lit(b).alias("bookmaker"), F.lit("ONE_X_TWO").alias("market_type"), F.lit(0.0).alias("line"), F.lit(s).alias("selection"), p.alias("price_decimal"), F.lit(c).alias("capture_precision"))
    text = F.to_json(F.array(quote("pinnacle", "HOME", F.lit(1.5) + k % 10, "CLOSING"), quote("b2", "AWAY", k % 4 + F.lit(0.5), "PREMATCH")))
    rows = table(spark, d, "orders").select(F.lit("s").alias("source"), F.concat(F.lit("x"), k).alias("source_id"), text.alias("odds_json"))
    return odds.observations_from_json(rows).select("source_id", "bookmaker", "selection", F.col("price_decimal").cast("decimal(10,1)").cast("double").alias("price_decimal"), "capture_precision")


@query("merge_chains", "WITH RECURSIVE c AS (SELECT o_orderkey AS m, o_orderkey + 1 AS s FROM orders WHERE o_orderkey % 8 < 5), r AS (SELECT m, s FROM c UNION ALL SELECT r.m, c.s FROM r JOIN c ON c.m = r.s) SELECT m AS merged_id, max(s) AS final_id FROM r GROUP BY m")
def merge_chains(spark, d):
    k = F.col("o_orderkey")
    return resolve_merges(table(spark, d, "orders").filter(k % 8 < 5).select(k.alias("merged_id"), (k + 1).alias("surviving_id")))


@query("point_in_time", ctes(*MATCH, "match_results", "odds_observations") + ANALYTIC + " SELECT (SELECT count(*) FROM match_results JOIN analytic USING (match_id) WHERE settled_at <= TIMESTAMP '1995-01-01 00:00:00') AS before, (SELECT count(*) FROM match_results JOIN analytic USING (match_id) WHERE settled_at <= TIMESTAMP '1997-01-01 00:00:00') AS after, (SELECT count(*) FROM analytic WHERE kickoff_utc > TIMESTAMP '1997-01-01 00:00:00') AS upcoming, TRUE AS only_forward")
def point_in_time(spark, d):
    w = staged(spark, d, *MATCH, "match_results", "odds_observations")
    p = views.PointInTime(w, dt.datetime(1995, 1, 1))
    before = p.results().agg(F.count("*").alias("before"))
    p.advance(dt.datetime(1997, 1, 1))
    after, upcoming = p.results().agg(F.count("*").alias("after")), p.upcoming().agg(F.count("*").alias("upcoming"))
    try:
        p.advance(dt.datetime(1996, 1, 1))
        forward = False
    except ValueError:
        forward = True
    return before.crossJoin(after).crossJoin(upcoming).withColumn("only_forward", F.lit(forward))  # one row on either side


@query("sliding_windows", "SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS start, count(*) AS n FROM events CROSS JOIN (SELECT unnest(range(3)) AS k) GROUP BY ALL")
def sliding_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return folds.sliding(e, "ts", "6 hours", "2 hours", ["event_type"], n=F.count("*")).select("event_type", F.col("window.start").alias("start"), "n")


SILVER = ("teams", "team_aliases", "team_identity_overrides", "match_merges", "matches", "match_source_ids", "team_season_membership", "team_source_ids", "match_results", "match_kickoff_revisions", "match_quarantine", "team_alias_proposals")


@query("bronze_to_silver", """
WITH c AS (SELECT c_custkey AS k, c_name AS name, 'N' || c_nationkey AS competition, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer),
b AS (SELECT o_orderkey AS id, competition, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 13 > 0 AND k % 50 <> 7 THEN CAST(k AS VARCHAR) END AS home, CASE WHEN first % 50 <> 7 THEN CAST(first AS VARCHAR) END AS away, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS goals FROM orders JOIN c ON k = o_custkey),
good AS (SELECT *, row_number() OVER (PARTITION BY competition, season, day, home, away ORDER BY CAST(id AS VARCHAR)) AS n FROM b WHERE home IS NOT NULL AND away IS NOT NULL),
scored AS (SELECT *, row_number() OVER (PARTITION BY competition, season, day, home, away ORDER BY CAST(id AS VARCHAR)) AS r FROM good WHERE goals IS NOT NULL)
SELECT 'matches' AS name, count(*) AS n, sum(CAST(home AS BIGINT)) AS total FROM good WHERE n = 1 UNION ALL SELECT 'match_results', count(*), sum(goals) FROM scored WHERE r = 1 UNION ALL SELECT 'match_source_ids', count(*), sum(id) FROM good
UNION ALL SELECT 'team_season_membership', count(*), sum(CAST(t AS BIGINT)) FROM (SELECT home AS t, competition, season FROM good UNION SELECT away, competition, season FROM good) UNION ALL SELECT 'match_quarantine', count(*), sum(id) FROM b WHERE home IS NULL OR away IS NULL""")
def bronze_to_silver(spark, d):
    """All new rows of the silver tables out of bronze rows of every order; every thirteenth home name is unknown, and a team whose only alias is unapproved is not resolved."""
    from pyspark.sql.window import Window as W

    k = F.col("o_orderkey")
    c = table(spark, d, "customer").withColumn("_first", F.min(F.struct("c_custkey", "c_name")).over(W.partitionBy("c_nationkey"))["c_name"])
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    text = {"source": F.lit("s2"), "source_id": k, "competition": F.concat(F.lit("N"), "c_nationkey"), "season": F.year("o_orderdate"), "match_date": F.to_date("o_orderdate"), "home_name_raw": F.when(k % 13 > 0, F.col("c_name")).otherwise("Nobody United"), "away_name_raw": F.col("_first"), "goals_home": F.when(k % 3 > 0, k % 4), "goals_away": F.lit(1), "kickoff_precision": F.lit("DATE_ONLY")}
    names = [x.split()[0] for x in ingest.BRONZE.split(", ")]
    bronze = o.select(*[(text[n] if n in text else F.lit(None)).cast("string").alias(n) for n in names])
    w = staged(spark, d, *SILVER)
    for empty in SILVER[3:]:
        w[empty] = w[empty].filter("false")
    countries = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("competition"), F.col("n_nationkey").cast("string").alias("country"))
    made = ingest.transform(bronze, w, countries)
    sums = {"matches": "home_team_id", "match_results": "goals_home", "match_source_ids": "source_id", "team_season_membership": "team_id", "match_quarantine": "source_id"}
    out = None
    for name, column in sums.items():
        rows = made[name].agg(F.count("*").alias("n"), F.sum(F.col(column).cast("long")).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = rows if out is None else out.union(rows)
    return out


@query("goal_likelihoods", """
WITH x AS (SELECT o_orderkey AS id, o_orderkey % 4 AS h, o_orderkey % 3 AS a, 0.8 + o_orderkey % 10 / 5.0::DOUBLE AS m, 0.6 + o_orderkey % 7 / 5.0::DOUBLE AS n FROM orders),
f AS (SELECT unnest(range(4)) AS k, unnest([1.0, 1.0, 2.0, 6.0]) AS fact),
y AS (SELECT x.*, fh.fact AS fh, fa.fact AS fa, exp(-m) * pow(m, h) / fh.fact AS p, exp(-n) * pow(n, a) / fa.fact AS q FROM x JOIN f fh ON fh.k = h JOIN f fa ON fa.k = a),
b AS (SELECT id, sum(exp(-m) * pow(m, h - f.k) / g.fact * exp(-n) * pow(n, a - f.k) / j.fact * exp(-exp(-2.0)) * pow(exp(-2.0), f.k) / f.fact) AS p FROM x JOIN f ON f.k <= least(h, a) JOIN f g ON g.k = h - f.k JOIN f j ON j.k = a - f.k GROUP BY id),
c AS (SELECT x.id, coalesce(sum(exp(-m) * pow(m, f.k) / f.fact) FILTER (WHERE f.k <= h), 0) AS u, coalesce(sum(exp(-m) * pow(m, f.k) / f.fact) FILTER (WHERE f.k < h), 0) AS u0, coalesce(sum(exp(-n) * pow(n, f.k) / f.fact) FILTER (WHERE f.k <= a), 0) AS v, coalesce(sum(exp(-n) * pow(n, f.k) / f.fact) FILTER (WHERE f.k < a), 0) AS v0 FROM x CROSS JOIN f GROUP BY x.id),
z AS (SELECT *, exp(3.0) AS r, 1 / (1 + exp(4.0)) AS z FROM y)
SELECT z.id, round(ln(z.p) + ln(q), 8) AS poisson, round(ln(z.p) + ln(q) + ln(CASE WHEN h = 0 AND a = 0 THEN 1 + 0.05 * m * n WHEN h = 0 AND a = 1 THEN 1 - 0.05 * m WHEN h = 1 AND a = 0 THEN 1 - 0.05 * n WHEN h = 1 AND a = 1 THEN 1.05 ELSE 1 END), 8) AS dixon_coles,
  round(lgamma(h + r) - lgamma(r) - ln(fh) + r * ln(r / (r + m)) + h * ln(m / (r + m)) + lgamma(a + r) - lgamma(r) - ln(fa) + r * ln(r / (r + n)) + a * ln(n / (r + n)), 7) AS negative_binomial,
  round(ln(CASE WHEN h = 0 THEN z ELSE 0 END + (1 - z) * z.p) + ln(CASE WHEN a = 0 THEN z ELSE 0 END + (1 - z) * q), 8) AS zero_inflated, round(ln(b.p), 8) AS bivariate,
  round(ln((-ln(1 + (exp(-0.5 * u) - 1) * (exp(-0.5 * v) - 1) / (exp(-0.5) - 1)) + ln(1 + (exp(-0.5 * u0) - 1) * (exp(-0.5 * v) - 1) / (exp(-0.5) - 1)) + ln(1 + (exp(-0.5 * u) - 1) * (exp(-0.5 * v0) - 1) / (exp(-0.5) - 1)) - ln(1 + (exp(-0.5 * u0) - 1) * (exp(-0.5 * v0) - 1) / (exp(-0.5) - 1))) / 0.5), 6) AS weibull_copula
FROM z JOIN b ON b.id = z.id JOIN c ON c.id = z.id""")
def goal_likelihoods(spark, d):
    """Log probabilities of final scores under six models (the Weibull counts with a shape of 1, which are Poisson counts)."""
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(k.alias("id"), (k % 4).alias("h"), (k % 3).alias("a"), (F.lit(0.8) + k % 10 / F.lit(5.0)).alias("m"), (F.lit(0.6) + k % 7 / F.lit(5.0)).alias("n"))
    extras = {"poisson": (), "dixon_coles": (-0.05,), "negative_binomial": (3.0,), "zero_inflated": (-4.0,), "bivariate": (-2.0,), "weibull_copula": (0.0, 0.5)}
    digits = {"negative_binomial": 7, "weibull_copula": 6}
    return x.select("id", *[F.round(goals.score_log_probability(kind, F.col("h"), F.col("a"), F.col("m"), F.col("n"), e), digits.get(kind, 8)).alias(kind) for kind, e in extras.items()])


@query("predictions_of_strengths", """
WITH s AS (SELECT s_nationkey % 5 AS league, CAST(s_suppkey AS VARCHAR) AS team, s_suppkey % 9 / 20.0::DOUBLE AS attack, -(s_suppkey % 7) / 20.0::DOUBLE AS defence FROM supplier),
m AS (SELECT league, avg(attack) AS ma, avg(defence) AS md FROM s GROUP BY league),
f AS (SELECT c_custkey AS id, c_nationkey % 5 AS league, CAST(c_custkey % 150 AS VARCHAR) AS home, CAST(c_custkey % 130 + 1 AS VARCHAR) AS away FROM customer)
SELECT f.id, round(exp(0.25 + coalesce(h.attack, ma) + coalesce(a.defence, md)), 9) AS lambda_home, round(exp(coalesce(a.attack, ma) + coalesce(h.defence, md)), 9) AS lambda_away, h.team IS NULL OR a.team IS NULL AS used_prior
FROM f JOIN m USING (league) LEFT JOIN s h ON h.league = f.league AND h.team = f.home LEFT JOIN s a ON a.league = f.league AND a.team = f.away""")
def predictions_of_strengths(spark, d):
    k = F.col("s_suppkey")
    strengths = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("league"), k.cast("string").alias("team"), (k % 9 / F.lit(20.0)).alias("attack"), (-(k % 7) / F.lit(20.0)).alias("defence"), F.lit(0.25).alias("home_advantage"))
    c = F.col("c_custkey")
    fixtures = table(spark, d, "customer").select(c.alias("id"), (F.col("c_nationkey") % 5).alias("league"), (c % 150).cast("string").alias("home"), (c % 130 + 1).cast("string").alias("away"))
    return rounded(goals.predict_many(fixtures, strengths, ["league"]).select("id", "lambda_home", "lambda_away", "used_prior"), "lambda_home", "lambda_away")
