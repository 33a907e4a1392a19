"""Queries of the pipeline API: filters, the query language, reshaping, joins, groups, windows, order, sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyfield.flow import Flow, per_row
from tallyfield.functions import paths
from tallyfield.functions.aggregates import names as aggregate_names, percentile, register
from tallyfield.functions.predicates import where_contains, where_endswith, where_equals, where_exists, where_gt, where_gte, where_in, where_is_null, where_lt, where_lte, where_not_equals, where_not_in, where_regex_match, where_startswith
from tallyfield.operators.joins import interval_join, latest_as_of
from tallyfield.plans.registry import flow, query, table

# --- predicates


@query("purchases_by_user", "SELECT user_id, round(sum(value), 2) AS total_value, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def purchases_by_user(spark, d):
    bought = flow(spark, d, "events").filter(where_equals("event_type", "purchase"))
    out = bought.group_by("user_id").summary({"total_value": ("sum", "value"), "n": "count"}).df
    return out.withColumn("total_value", F.round("total_value", 2)).orderBy(F.desc("total_value"), "user_id")


@query("filter_equals", "SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT DISTINCT FROM 'Brand#11'")
def filter_equals(spark, d):
    return flow(spark, d, "part").filter(where_equals("p_brand", "Brand#11")).select("p_partkey", "p_brand").df


@query("filter_not_equals_keeps_null", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS DISTINCT FROM 1")
def filter_not_equals_keeps_null(spark, d):
    return flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels").select("doc_id", "toxic"), on="doc_id").filter(where_not_equals("toxic", 1)).df


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def filter_in(spark, d):
    return flow(spark, d, "events").filter(where_in("event_type", ["click", "purchase"])).select("event_id", "event_type").df


@query("filter_not_in_nullsafe", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.quality NOT IN (0)")
def filter_not_in_nullsafe(spark, d):
    return flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels").select("doc_id", "quality"), on="doc_id").filter(where_not_in("quality", [0])).df


@query("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 50000 AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'")
def filter_range(spark, d):
    day = dt.date
    return flow(spark, d, "orders").filter(where_gt("o_totalprice", 1000), where_lte("o_totalprice", 50000), where_gte("o_orderdate", day(1995, 1, 1)), where_lt("o_orderdate", day(1996, 1, 1))).select("o_orderkey", "o_totalprice").df


@query("filter_string_ops", "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer') AND contains(c_name, '00') AND ends_with(c_name, '7')")
def filter_string_ops(spark, d):
    return flow(spark, d, "customer").filter(where_startswith("c_name", "Customer"), where_contains("c_name", "00"), where_endswith("c_name", "7")).select("c_custkey", "c_name").df


@query("filter_regex", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, 'b[aeiou]|mach', 'i')")
def filter_regex(spark, d):
    import re

    return flow(spark, d, "customer").filter(where_regex_match("c_mktsegment", "b[aeiou]|mach", re.I)).select("c_custkey").df


@query("filter_bool_tree", "SELECT event_id FROM events WHERE (event_type = 'click' AND value > 50) OR NOT (event_type IN ('click', 'view') OR value <= 20)")
def filter_bool_tree(spark, d):
    p = (where_equals("event_type", "click") & where_gt("value", 50)) | ~(where_in("event_type", ["click", "view"]) | where_lte("value", 20))
    return flow(spark, d, "events").filter(p).select("event_id").df


@query("filter_exists_null", "SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.quality IS NULL AND d.doc_id % 2 = 0) OR (l.quality IS NOT NULL AND d.doc_id % 2 = 1)")
def filter_exists_null(spark, d):
    both = flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels").select("doc_id", "quality"), on="doc_id").assign(odd=F.col("doc_id") % 2)
    kept = both.filter((where_is_null("quality") & where_equals("odd", 0)) | (where_exists("quality") & where_equals("odd", 1)))
    return kept.assign(unlabelled=F.col("quality").isNull()).select("doc_id", "unlabelled").df


# --- the query language


@query("query_dsl_basic", "SELECT p_partkey, p_size FROM part WHERE (p_size > 40 OR p_brand IN ('Brand#11', 'Brand#12')) AND NOT p_size = 45")
def query_dsl_basic(spark, d):
    return flow(spark, d, "part").query("(p_size > @least or p_brand in ['Brand#11', 'Brand#12']) and not p_size == 45", least=40).select("p_partkey", "p_size").df


@query("query_dsl_chained", "SELECT p_partkey FROM part WHERE 10 <= p_size AND p_size < 20 AND 900 < p_retailprice")
def query_dsl_chained(spark, d):
    return flow(spark, d, "part").query("10 <= p_size < 20 and 900 < p_retailprice").select("p_partkey").df


@query("query_dsl_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00' AND o_orderdate < DATE '1995-06-01' AND o_orderpriority IS NOT NULL")
def query_dsl_dates(spark, d):
    return flow(spark, d, "orders").query("o_orderdate >= datetime(1995, 3, 1) and o_orderdate < date(1995, 6, 1) and o_orderpriority is not None").select("o_orderkey").df


@query("query_dsl_len_lower", "SELECT p_partkey FROM part WHERE len(p_name) > 10 AND lower(p_brand) = 'brand#23' AND contains(p_type, 'A')")
def query_dsl_len_lower(spark, d):
    return flow(spark, d, "part").query("len(p_name) > 10 and p_brand.lower() == 'brand#23' and p_type.contains('A')").select("p_partkey").df


@query("query_dsl_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^(eco|sta)', 'i') OR regexp_matches(p_name, 'e$')")
def query_dsl_regex(spark, d):
    return flow(spark, d, "part").query("p_type.regex('^(eco|sta)', re.IGNORECASE) or p_name.match('e$')").select("p_partkey").df


# --- reshaping


@query("select_assign_rename_drop", "SELECT event_id AS id, value, value * 2 AS twice FROM events")
def select_assign_rename_drop(spark, d):
    return flow(spark, d, "events").assign(twice=F.col("value") * 2).rename(event_id="id").drop("props", "ts").select("id", "value", "twice").df


@query("flatten_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"p.k\" FROM events")
def flatten_json_props(spark, d):
    return flow(spark, d, "events").assign(p=F.from_json("props", "k long")).select("event_id", "p").flatten().df


@query("nested_select_set", "SELECT event_id, user_id AS u, value AS v FROM events WHERE value > 90")
def nested_select_set(spark, d):
    nested = flow(spark, d, "events").assign(who=F.struct("user_id", "event_type")).set_field("who.stats.value", F.col("value"))
    kept = nested.filter(where_gt("who.stats.value", 90)).drop("who.event_type").select("event_id", "who.user_id", "who.stats.value")
    return kept.flatten().rename_fields({"who.user_id": "u", "who.stats.value": "v"}).df


@query("split_array_embedding", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings")
def split_array_embedding(spark, d):
    f = flow(spark, d, "embeddings").split_array("embedding", ["x", "y"])
    return f.assign(x=F.col("x").cast("double"), y=F.col("y").cast("double"), last=paths.get_index(f.df, "embedding", -1).cast("double")).select("vec_id", "x", "y", "last").df


@query("explode_sync", "SELECT vec_id, unnest(embedding[1:3])::DOUBLE AS v, unnest([1, 2, 3])::BIGINT AS place FROM embeddings")
def explode_sync(spark, d):
    f = flow(spark, d, "embeddings").assign(v=F.slice("embedding", 1, 3).cast("array<double>"), place=F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]))
    return f.explode("v", "place").select("vec_id", "v", "place").df


@query("cast_with_fallback", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS kind, TRY_CAST(value AS BIGINT) AS whole FROM (SELECT event_id, event_type, floor(value) AS value FROM events)")
def cast_with_fallback(spark, d):
    return flow(spark, d, "events").assign(kind=F.col("event_type"), whole=F.floor("value")).cast(kind="int", whole="long").select("event_id", "kind", "whole").df


@query("dropna_fields", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def dropna_fields(spark, d):
    return flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels").select("doc_id", "quality"), on="doc_id").dropna("quality").df


@query("coalesce_combine", "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS level, concat(CASE WHEN coalesce(l.quality, 0) = 0 THEN '' ELSE CAST(l.quality AS VARCHAR) END, '/', d.lang) AS tag FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce_combine(spark, d):
    f = flow(spark, d, "documents").select("doc_id", "lang").join(flow(spark, d, "labels"), on="doc_id")
    return f.assign(level=lambda x: paths.coalesce_paths(x, "quality", "toxic", default=-1), tag=lambda x: paths.combine_fields(x, "quality", "lang", join_str="/")).select("doc_id", "level", "tag").df


# --- joins


@query("join_inner", "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def join_inner(spark, d):
    lines = flow(spark, d, "lineitem").filter(where_gt("l_quantity", 45)).select("l_orderkey", "l_linenumber")
    return flow(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, left_on="o_orderkey", right_on="l_orderkey", how="inner").select("o_orderkey", "l_linenumber", "o_orderstatus").df


@query("join_left", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left(spark, d):
    return flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels"), on="doc_id").df


@query("join_right", "SELECT c_custkey, c_name, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark, d):
    return flow(spark, d, "orders").select("o_orderkey", "o_custkey").join(flow(spark, d, "customer").select("c_custkey", "c_name"), left_on="o_custkey", right_on="c_custkey", how="right").select("c_custkey", "c_name", "o_orderkey").df


@query("join_full", "SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal AS y FROM supplier) b ON a.k = b.k")
def join_full(spark, d):
    a = Flow(table(spark, d, "customer").selectExpr("c_custkey AS k", "c_acctbal AS x"))
    b = Flow(table(spark, d, "supplier").selectExpr("s_suppkey * 20 AS k", "s_acctbal AS y"))  # so that either side misses some
    return a.join(b, on="k", how="outer").df


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(spark, d):
    return flow(spark, d, "customer").select("c_custkey").join(flow(spark, d, "orders").filter(where_gt("o_totalprice", 250000)).select("o_custkey"), left_on="c_custkey", right_on="o_custkey", how="anti").df


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(spark, d):
    return flow(spark, d, "customer").select("c_custkey").join(flow(spark, d, "orders").filter(where_gt("o_totalprice", 100000)), left_on="c_custkey", right_on="o_custkey", how="semi").df


@query("join_suffixes", "SELECT a.n_nationkey, a.n_name AS n_name_l, b.n_name AS n_name_right FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_regionkey")
def join_suffixes(spark, d):
    n = flow(spark, d, "nation")
    return n.select("n_nationkey", "n_name").join(n.select("n_regionkey", "n_name"), left_on="n_nationkey", right_on="n_regionkey", lsuffix="_l").select("n_nationkey", "n_name_l", "n_name_right").df


@query("join_multi_key", "SELECT a.user_id, a.event_type, a.n, b.total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_type, round(sum(value), 4) AS total FROM events WHERE value > 50 GROUP BY ALL) b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def join_multi_key(spark, d):
    e = flow(spark, d, "events")
    b = Flow(e.filter(where_gt("value", 50)).group_by("user_id", "event_type").summary({"total": ("sum", "value")}).df.withColumn("total", F.round("total", 4)))
    return e.group_by("user_id", "event_type").summary({"n": "count"}).join(b, on=["user_id", "event_type"], how="inner").df


@query("join_coerced_string", "SELECT n_nationkey, r_name FROM nation JOIN region ON CAST(n_regionkey AS VARCHAR) = CAST(r_regionkey AS VARCHAR)")
def join_coerced_string(spark, d):
    r = flow(spark, d, "region").assign(key=F.col("r_regionkey").cast("string")).select("key", "r_name")
    return flow(spark, d, "nation").select("n_nationkey", "n_regionkey").join(r, left_on="n_regionkey", right_on="key", how="inner", type_coercion="string").select("n_nationkey", "r_name").df


@query("join_coerced_auto", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_coerced_auto(spark, d):
    r = flow(spark, d, "region").assign(key=F.concat(F.lit("0"), F.col("r_regionkey").cast("string"), F.lit(".0"))).select("key", "r_name")
    return flow(spark, d, "nation").select("n_nationkey", "n_regionkey").join(r, left_on="n_regionkey", right_on="key", how="inner", type_coercion="auto").select("n_nationkey", "r_name").df


@query("join_null_safe", "WITH a AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), b AS (SELECT * FROM (VALUES (0, 'bad'), (1, 'good'), (NULL, 'none')) v(q, word)) SELECT a.doc_id, b.word FROM a JOIN b ON a.quality IS NOT DISTINCT FROM b.q")
def join_null_safe(spark, d):
    a = flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels"), on="doc_id").select("doc_id", "quality")
    b = Flow(spark.createDataFrame([(0, "bad"), (1, "good"), (None, "none")], "q int, word string"))
    return a.join(b, left_on="quality", right_on="q", how="inner").select("doc_id", "word").df


@query("asof_latest", "SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id")
def asof_latest(spark, d):
    return latest_as_of(table(spark, d, "events"), ["user_id"], "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), ["value"], "event_id")


@query("asof_freshest_row_number", """
SELECT l.event_id, l.user_id, r.ts AS view_ts, r.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_freshest_row_number(spark, d):
    e = flow(spark, d, "events").select("event_id", "user_id", "ts", "value", "event_type")
    left = e.filter(where_equals("event_type", "purchase")).select("event_id", "user_id", "ts")
    right = e.filter(where_equals("event_type", "view")).select("user_id", "ts", "value")
    return left.asof_join(right, "user_id", "ts", "ts", prefix="view_").select("event_id", "user_id", "view_ts", "view_value").df


@query("interval_join", """
SELECT a.event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'click'""")
def interval(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return interval_join(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "ts", "ts", 7200, 3600).select("event_id", "right_event_id")


# --- aggregates


@query("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS taxed, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def agg_basic(spark, d):
    out = flow(spark, d, "lineitem").group_by("l_returnflag", "l_linestatus").summary({"n": "count", "taxed": ("count_nonnull", "l_tax"), "qty": ("sum", "l_quantity"), "price": ("mean", "l_extendedprice"), "low": ("min", "l_discount"), "high": ("max", "l_discount")}).df
    return out.withColumns({"qty": F.round("qty", 2), "price": F.round("price", 4)})


@query("agg_std_median_iqr_range", "SELECT event_type, round(stddev_pop(value), 6) AS std, round(var_pop(value), 5) AS var, round(median(value), 6) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(max(value) - min(value), 6) AS range FROM events GROUP BY event_type")
def agg_std_median_iqr_range(spark, d):
    out = flow(spark, d, "events").group_by("event_type").summary({k: (k, "value") for k in ("std", "var", "median", "iqr", "range")}).df
    return out.select("event_type", *[F.round(k, 5 if k == "var" else 6).alias(k) for k in ("std", "var", "median", "iqr", "range")])


@query("agg_percentile", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY user_id")
def agg_percentile(spark, d):
    return flow(spark, d, "events").group_by("user_id").summary({"p90": percentile("value", 90)}).df.withColumn("p90", F.round("p90", 6))


@query("agg_mode", """
SELECT user_id, arg_min(event_type, rank) AS mode FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ts), min(event_id)) AS rank FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def agg_mode(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("user_id").summary({"mode": ("mode", "event_type")}).df


@query("agg_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY user_id")
def agg_first_last(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("user_id").summary({"first": ("first", "event_type"), "last": ("last", "value")}).df


@query("agg_unique_list", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, list(event_type ORDER BY ts, event_id) AS path, count(DISTINCT event_type) AS n FROM events WHERE value > 60 GROUP BY user_id")
def agg_unique_list(spark, d):
    return flow(spark, d, "events", "ts", "event_id").filter(where_gt("value", 60)).group_by("user_id").summary({"kinds": ("unique", "event_type"), "path": ("list", "event_type"), "n": ("nunique", "event_type")}).df


@query("agg_all_any", "SELECT l_orderkey, bool_and(l_discount <> 0) AS every, bool_or(l_discount <> 0) AS some FROM lineitem GROUP BY l_orderkey")
def agg_all_any(spark, d):
    return flow(spark, d, "lineitem").group_by("l_orderkey").summary({"every": ("all", "l_discount"), "some": ("any", "l_discount")}).df


@query("agg_filter_clause", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE event_type = 'purchase') AS top, arg_max(ts, (value, ts)) FILTER (WHERE event_type = 'view' AND value IS NOT NULL) AS best_view FROM events GROUP BY user_id")
def agg_filter_clause(spark, d):
    """The best view is that of the highest value, of equal ones the latest."""
    table(spark, d, "events").createOrReplaceTempView("events_filter_clause")
    return spark.sql("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(value) FILTER (WHERE event_type = 'purchase') AS top, max_by(ts, struct(value, ts)) FILTER (WHERE event_type = 'view' AND value IS NOT NULL) AS best_view FROM events_filter_clause GROUP BY user_id")


@query("agg_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS names FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("names"))


@query("agg_global_summary", "SELECT count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(ts) AS first FROM events")
def agg_global_summary(spark, d):
    return flow(spark, d, "events").summary({"n": "count", "total": ("sum", "value"), "mean": ("mean", "value"), "first": ("min", "ts")}).df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("agg_having", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6")
def agg_having(spark, d):
    return flow(spark, d, "lineitem").group_by("l_orderkey").summary({"n": "count"}).filter(where_gt("n", 6)).df


@query("agg_product", "SELECT l_orderkey, round(product(1 - l_discount), 9) AS kept FROM lineitem GROUP BY l_orderkey")
def agg_product(spark, d):
    return flow(spark, d, "lineitem").assign(keep=1 - F.col("l_discount")).group_by("l_orderkey").summary({"kept": ("prod", "keep")}).df.withColumn("kept", F.round("kept", 9))


@query("pivot_last_wins", """
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS purchase, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id""")
def pivot_last_wins(spark, d):
    return flow(spark, d, "events", "ts", "event_id").pivot("user_id", "event_type", "value", ["click", "purchase", "view"]).df


@query("group_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_rollup(spark, d):
    return flow(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").summary({"n": "count"}).df


@query("group_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, d):
    return flow(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").summary({"qty": ("sum", "l_quantity")}).df.withColumn("qty", F.round("qty", 2))


@query("group_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def group_grouping_sets(spark, d):
    return table(spark, d, "orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


# --- windows


@query("win_cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def win_cumulative(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("user_id").cumulative("value", "running").df.select("event_id", F.round("running", 4).alias("running"))


@query("win_rolling_rows", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS high, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def win_rolling_rows(spark, d):
    out = flow(spark, d, "events", "ts", "event_id").group_by("user_id").rolling_summary(5, {"mean": ("mean", "value"), "high": ("max", "value"), "n": "count"}).df
    return out.select("event_id", F.round("mean", 6).alias("mean"), F.round("high", 6).alias("high"), "n")


@query("win_rolling_time_5h", "SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n, first(event_type) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW)")
def win_rolling_time(spark, d):
    out = flow(spark, d, "events", "ts", "event_id").group_by("user_id").rolling_summary("5h", {"total": ("sum", "value"), "n": "count", "first": ("first", "event_type")}, time_field="ts").df
    return out.select("event_id", F.round("total", 4).alias("total"), "n", "first")


@query("win_rolling_min_periods_step", "SELECT event_id, round(s, 4) AS s FROM (SELECT event_id, sum(value) OVER w AS s, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)) WHERE n >= 3 AND (i - 1) % 2 = 0")
def win_rolling_min_periods_step(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("user_id").rolling_summary(3, {"s": ("sum", "value")}, min_periods=3, step=2).df.select("event_id", F.round("s", 4).alias("s"))


@query("win_rolling_median", "SELECT event_id, round(median(value) OVER w, 6) AS m, round(stddev_pop(value) OVER w, 6) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)")
def win_rolling_median(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("user_id").rolling_summary(7, {"m": ("median", "value"), "s": ("std", "value")}).df.select("event_id", F.round("m", 6).alias("m"), F.round("s", 6).alias("s"))


@query("win_rank_topk", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def win_rank_topk(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("user_id", "event_id", "rank")


@query("win_points_before", "SELECT o_orderkey, coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS points FROM orders")
def win_points_before(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    points = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.sum(points).over(w), F.lit(0)).alias("points"))


@query("win_range_8_days", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 8 DAY PRECEDING AND CURRENT ROW) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def win_range_8_days(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    own = W.partitionBy("o_custkey")
    return o.select("o_orderkey", F.count("*").over(own.orderBy("day").rangeBetween(-8 * 86_400_000_000, 0)).alias("n"), F.lag("o_orderkey").over(own.orderBy("day", "o_orderkey")).alias("before"))


@query("time_bucket_left", """
WITH o AS (SELECT user_id, min(ts) AS origin FROM events GROUP BY user_id)
SELECT user_id, origin + to_microseconds(CAST(bin * 21600000000 AS BIGINT)) AS bucket, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT e.user_id, o.origin, e.value, (epoch_us(e.ts) - epoch_us(o.origin)) // 21600000000 AS bin FROM events e JOIN o USING (user_id)) GROUP BY user_id, origin, bin""")
def time_bucket_left(spark, d):
    out = flow(spark, d, "events", "ts", "event_id").group_by("user_id").time_bucket("6h", {"n": "count", "total": ("sum", "value")}, "ts").df
    return out.withColumn("total", F.round("total", 4))


@query("time_bucket_right", """
WITH o AS (SELECT event_type, min(ts) AS origin FROM events GROUP BY event_type)
SELECT event_type, origin + to_microseconds(CAST((bin + 1) * 86400000000 AS BIGINT)) AS "end", count(*) AS n
FROM (SELECT e.event_type, o.origin, (epoch_us(e.ts) - epoch_us(o.origin)) // 86400000000 AS bin FROM events e JOIN o USING (event_type)) GROUP BY event_type, origin, bin""")
def time_bucket_right(spark, d):
    return flow(spark, d, "events", "ts", "event_id").group_by("event_type").time_bucket("1d", {"n": "count"}, "ts", label="right", bucket_name="end").df


@query("time_bucket_numeric", "SELECT l_returnflag, floor(l_quantity / 10) * 10.0 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def time_bucket_numeric(spark, d):
    return flow(spark, d, "lineitem", "l_orderkey", "l_linenumber").group_by("l_returnflag").time_bucket(10, {"n": "count"}, "l_quantity").df


# --- order, samples, sets


@query("sort_mixed_nulls", "SELECT d.doc_id, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, l.toxic ASC NULLS LAST, d.doc_id) AS rank FROM documents d LEFT JOIN labels l USING (doc_id)")
def sort_mixed_nulls(spark, d):
    rows = flow(spark, d, "documents").select("doc_id").join(flow(spark, d, "labels"), on="doc_id").sort_by("quality", "toxic", "doc_id", ascending=[False, True, True])
    return rows.with_rank("rank").select("doc_id", "rank").df


@query("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_topk(spark, d):
    return flow(spark, d, "orders").select("o_orderkey", "o_totalprice").sort_by("o_totalprice", "o_orderkey", ascending=[False, True]).limit(25).df


@query("distinct_first", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def distinct_first(spark, d):
    return flow(spark, d, "orders", "o_orderdate", "o_orderkey").distinct("o_custkey").select("o_custkey", "o_orderkey").df


@query("distinct_last", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def distinct_last(spark, d):
    return flow(spark, d, "orders", "o_orderdate", "o_orderkey").distinct("o_custkey", keep="last").select("o_custkey", "o_orderkey").df


@query("distinct_rows", "SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(spark, d):
    return flow(spark, d, "events").select("event_type", "user_id").distinct().df


_SHARE = "CAST(('0x' || substr(md5(concat_ws('|', CAST({} AS VARCHAR), '7')), 1, 8)) AS BIGINT) / 4294967296.0"


@query("sample_hash_fraction", f"SELECT event_id FROM events WHERE {_SHARE.format('event_id')} < 0.1")
def sample_hash_fraction(spark, d):
    return flow(spark, d, "events").sample_fraction(0.1, seed=7, key="event_id").select("event_id").df


@query("sample_hash_n", f"SELECT o_orderkey FROM orders ORDER BY {_SHARE.format('o_orderkey')}, o_orderkey LIMIT 50")
def sample_hash_n(spark, d):
    return flow(spark, d, "orders").sample_n(50, seed=7, key="o_orderkey").select("o_orderkey").df


@query("concat_union_all", "SELECT c_nationkey AS nation, c_acctbal AS balance, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier")
def concat_union_all(spark, d):
    a = flow(spark, d, "customer").rename(c_nationkey="nation", c_acctbal="balance").select("nation", "balance")
    return a.concat(flow(spark, d, "supplier").rename(s_nationkey="nation", s_acctbal="balance").select("nation", "balance", "s_suppkey")).df


@query("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return flow(spark, d, "customer").rename(c_nationkey="nation").select("nation").union_distinct(flow(spark, d, "supplier").rename(s_nationkey="nation").select("nation")).df


@query("except_all", "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, d):
    return flow(spark, d, "customer").rename(c_nationkey="nation").select("nation").except_all(flow(spark, d, "supplier").rename(s_nationkey="nation").select("nation")).df


@query("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect(spark, d):
    return flow(spark, d, "orders").rename(o_custkey="k").select("k").intersect(flow(spark, d, "customer").filter(where_gt("c_acctbal", 0)).rename(c_custkey="k").select("k")).df


# --- rows in Python, schemas, groups, further forms of the query language


@query("map_rows", "SELECT n_nationkey * 2 AS twice, upper(substr(n_name, 1, 3)) AS short FROM nation WHERE n_regionkey <> 2")
def map_rows(spark, d):
    def change(row):
        return None if row["n_regionkey"] == 2 else {"twice": row["n_nationkey"] * 2, "short": row["n_name"][:3].upper()}

    return flow(spark, d, "nation").map(change, "twice long, short string").df


@query("assign_per_row", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, round(c_acctbal * 2, 2) AS double_balance, length(c_name) AS c_name FROM customer")
def assign_per_row(spark, d):
    f = flow(spark, d, "customer").assign(label=per_row(lambda r: f"{r['c_name']}/{r['c_mktsegment']}", "string"), double_balance=F.round(F.col("c_acctbal") * 2, 2))
    return f.cast(c_name=per_row(len, "long")).select("c_custkey", "label", "double_balance", "c_name").df


@query("pipe_steps", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderpriority HAVING count(*) > 2")
def pipe_steps(spark, d):
    dear = lambda f, least: f.filter(where_gt("o_totalprice", least))
    return flow(spark, d, "orders").pipe(dear, 200000).group_by("o_orderpriority").summary({"n": "count"}).pipe(lambda f: f.filter(where_gt("n", 2))).df


@query("with_schema", "SELECT p_partkey::VARCHAR AS p_partkey, TRY_CAST(p_name AS INTEGER) AS p_name, CAST(floor(p_retailprice) AS BIGINT) AS p_retailprice FROM part")
def with_schema(spark, d):
    return flow(spark, d, "part").assign(p_retailprice=F.floor("p_retailprice")).with_schema({"p_partkey": "string", "p_name": "int", "p_retailprice": "long"}, drop_extra=True).df


@query("grouped_rows", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def grouped_rows(spark, d):
    g = flow(spark, d, "nation", "n_nationkey").grouped("n_regionkey").df
    return g.select("n_regionkey", F.size("records").cast("long").alias("n"), F.array_join(F.transform("records", lambda r: r["n_name"]), ",").alias("names"))


@query("custom_aggregates", "SELECT event_type, count(*) AS n, CAST(max(event_id) - min(event_id) AS BIGINT) AS spread, CAST(arg_min(user_id, (ts, event_id)) AS BIGINT) AS first_user FROM events GROUP BY event_type")
def custom_aggregates(spark, d):
    """Python aggregates of five hot groups: states of batches are merged, no group is one list."""
    from tallyfield.operators.merged import merge_aggregate

    def add(state, rows):
        first = rows.sort_values(["at", "event_id"], kind="stable").iloc[0]
        own = (len(rows), int(rows["event_id"].min()), int(rows["event_id"].max()), (int(first["at"]), int(first["event_id"]), int(first["user_id"])))
        return own if state is None else merge(state, own)

    def merge(a, b):
        return a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3])

    e = table(spark, d, "events").select("event_type", "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = merge_aggregate(e, ["event_type"], ["event_id", "user_id", "at"], "x", "struct<n: long, spread: long, first_user: long>", add, merge, lambda s: {"n": s[0], "spread": s[2] - s[1], "first_user": s[3][2]})
    return out.select("event_type", "x.*")


@query("registered_aggregate", "SELECT event_type, sum(value * value) AS squares FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY event_type")
def registered_aggregate(spark, d):
    if "sum_of_squares" not in aggregate_names():
        register("sum_of_squares", lambda c, k, f: f.run(F.sum(c * c)))
    return flow(spark, d, "events").assign(value=F.floor("value").cast("double")).group_by("event_type").summary({"squares": ("sum_of_squares", "value")}).df


@query("dsl_further_forms", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%LOW') AND NOT (o_custkey = 3)")
def dsl_further_forms(spark, d):
    return flow(spark, d, "orders").query("o_orderstatus not in ['F', 'P'] and (o_orderpriority.startswith('1') or o_orderpriority.endswith('LOW')) and not (o_custkey == @key)", key=3).select("o_orderkey").df


@query("dsl_dotted_fields", "SELECT o_orderkey FROM orders WHERE o_custkey > 500 AND o_orderstatus = 'F' AND year(o_orderdate) >= 1995")
def dsl_dotted_fields(spark, d):
    o = table(spark, d, "orders")
    nested = o.select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("id")).alias("owner"), F.col("o_orderstatus").alias("status")).alias("meta"), F.struct(F.to_date("o_orderdate").alias("day")).alias("at"))
    return Flow(nested).query("meta.owner.id > 500 and meta.status == 'F' and at.day >= date(1995, 1, 1)").select("o_orderkey").df


@query("list_overlap", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = '2-HIGH'")
def list_overlap(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return Flow(o).filter(where_in("tags", ["1-URGENT", "2-HIGH"])).select("o_orderkey").df


@query("group_order", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, count(*) AS n FROM orders GROUP BY o_custkey")
def group_order(spark, d):
    g = flow(spark, d, "orders", "o_orderkey").group_by("o_custkey").sort_by("o_totalprice", ascending=False).select("o_orderkey", "o_totalprice")
    ranked = g.to_flow().df.withColumn("n_", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    sizes = g.to_flow().df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return ranked.filter("n_ = 1").select("o_custkey", F.col("o_orderkey").alias("dearest")).join(sizes, "o_custkey")


@query("win_rolling_time_peers", """
WITH x AS (SELECT o_orderkey, date_trunc('year', o_orderdate) AS t, floor(o_totalprice) AS v, row_number() OVER (ORDER BY date_trunc('year', o_orderdate), o_orderkey) AS k FROM orders),
c AS (SELECT *, sum(v) OVER (ORDER BY k) AS upto, count(*) OVER (ORDER BY k) AS n FROM x),
y AS (SELECT t, sum(v) AS v, count(*) AS n FROM x GROUP BY t)
SELECT c.o_orderkey, c.upto - coalesce(sum(y.v), 0) AS total, CAST(c.n - coalesce(sum(y.n), 0) AS BIGINT) AS n FROM c LEFT JOIN y ON y.t < c.t - INTERVAL 400 DAY GROUP BY c.o_orderkey, c.upto, c.n""")
def win_rolling_time_peers(spark, d):
    """Thousands of rows of a group at one instant: each sees those before it in row order."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_trunc("year", "o_orderdate").alias("t"), F.floor("o_totalprice").cast("long").alias("v"), F.lit(1).alias("g"))
    out = Flow(o, ["t", "o_orderkey"]).group_by("g").rolling_summary("400d", {"total": ("sum", "v"), "n": "count"}, time_field="t")
    return out.df.select("o_orderkey", F.col("total").cast("double").alias("total"), "n")
