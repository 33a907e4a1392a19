"""The pipeline API on small records."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyfield.flow import Flow
from tallyfield.functions import aggregates, paths
from tallyfield.functions import predicates as P


def flow(spark, rows, schema=None):
    return Flow.from_records(spark, rows, schema)


EVENT = {"type": {"name": "Shot"}, "team": {"name": "A"}, "xg": 0.3, "player": {"name": None}, "tags": ["a", "b"]}
OTHER = {"type": {"name": "Pass"}, "team": {"name": "B"}, "xg": None, "player": {"name": "X"}, "tags": []}


@pytest.mark.parametrize(
    ("predicate", "hits"),
    [
        (P.where_equals("type.name", "Shot"), [0]),
        (P.where_not_equals("xg", 0.3), [1]),
        (P.where_equals("xg", None), [1]),
        (P.where_in("tags", ["b", "z"]), [0]),
        (P.where_not_in("tags", ["b"]), [1]),
        (P.where_in("type.name", ["Shot", "Pass"]), [0, 1]),
        (P.where_not_in("player.name", ["Y"]), [0, 1]),
        (P.where_gt("xg", 0.1), [0]),
        (P.where_lte("xg", 0.1), []),
        (~P.where_gt("xg", 0.5), [0, 1]),
        (P.where_contains("player.name", ""), [0, 1]),
        (P.where_contains("type.name", "ho"), [0]),
        (P.where_startswith("type.name", "Pa"), [1]),
        (P.where_endswith("type.name", "ss"), [1]),
        (P.where_exists("player.name"), [1]),
        (P.where_is_null("player.name"), [0]),
        (P.where_exists("no.such.path"), []),
        (P.where_regex_match("type.name", "^s", 2), [0]),
        (P.and_(P.where_exists("xg"), P.where_equals("team.name", "A")), [0]),
        (P.or_(P.where_equals("team.name", "A"), P.where_equals("team.name", "B")), [0, 1]),
        (P.not_(P.where_equals("team.name", "A")), [1]),
        (P.where_in("player.name", [None, "Q"]), [0]),
    ],
)
def test_predicates(spark, predicate, hits):
    got = flow(spark, [{"n": 0, **EVENT}, {"n": 1, **OTHER}]).filter(predicate).collect()
    assert [r["n"] for r in got] == hits


def test_predicate_errors(spark):
    f = flow(spark, [EVENT])
    with pytest.raises(TypeError):
        f.filter(P.where_equals("team", "A"))
    with pytest.raises(TypeError):
        f.filter(P.where_gt("type.name", 3))
    with pytest.raises(Exception):  # noqa: B017
        P.where_regex_match("x", "(")


def test_event_and_qualifier_codes(spark):
    f = flow(spark, [{"n": 0, "typeId": 1, "qualifier": [{"qualifierId": 5, "value": "x"}]}, {"n": 1, "typeId": 2, "qualifier": [{"qualifierId": 6, "value": "y"}]}])
    assert [r["n"] for r in f.filter(P.where_coded_event("pass", {"Pass": 1, "Goal": 2})).collect()] == [0]
    assert [r["n"] for r in f.filter(P.where_qualifier("long", {"Long": 6})).collect()] == [1]
    assert f.filter(P.where_qualifier("Long", {"Long": 6}, "x")).collect() == []
    with pytest.raises(ValueError):
        P.where_coded_event("none", {"Pass": 1})


PEOPLE = [{"id": 1, "age": 17, "name": "Ann", "score": 1.0}, {"id": 2, "age": 25, "name": "bob", "score": None}, {"id": 3, "age": 30, "name": "Cy", "score": 3.0}, {"id": 4, "age": 18, "name": "Dee", "score": 2.0}]


@pytest.mark.parametrize(
    ("text", "params", "ids"),
    [
        ("age >= 18 and score is not None", {}, [3, 4]),
        ("18 <= age < 30", {}, [2, 4]),
        ("30 > age > @low", {"low": 17}, [2, 4]),
        ("not age == @a", {"a": 17}, [2, 3, 4]),
        ("score is None or name in ['Ann', 'Cy']", {}, [1, 2, 3]),
        ("name not in ('Ann',)", {}, [2, 3, 4]),
        ("name.lower() == 'ann'", {}, [1]),
        ("name.upper() == 'BOB'", {}, [2]),
        ("len(name) == 2", {}, [3]),
        ("name.contains('o')", {}, [2]),
        ("name.startswith('D') or name.endswith('y')", {}, [3, 4]),
        ("name.regex('^b')", {}, [2]),
        ("name.match('^B', re.IGNORECASE | re.M)", {}, [2]),
        ("score != 1.0", {}, [2, 3, 4]),
        ("name == '@x'", {}, []),
        ("age > -1", {}, [1, 2, 3, 4]),
    ],
)
def test_query_language(spark, text, params, ids):
    assert [r["id"] for r in flow(spark, PEOPLE).query(text, **params).collect()] == ids


@pytest.mark.parametrize("text", ["age >", "age + 1 > 2", "__import__('os')", "age is 3", "3 > 2", "age > name", "@x == age", "f(age)", "age.foo('x')", "name.contains()"])
def test_query_language_refuses(spark, text):
    with pytest.raises(ValueError):
        flow(spark, PEOPLE).query(text)


def test_query_dates(spark):
    rows = [{"id": 1, "at": dt.datetime(2024, 1, 1, 10)}, {"id": 2, "at": dt.datetime(2024, 2, 1)}, {"id": 3, "at": None}]
    assert [r["id"] for r in flow(spark, rows).query("at >= date(2024, 1, 15)").collect()] == [2]
    assert [r["id"] for r in flow(spark, rows).query("at < datetime(2024, 1, 1, 12)").collect()] == [1]


def test_select_rename_drop_flatten(spark):
    f = flow(spark, [EVENT])
    assert f.select("team.name", "xg", "missing").collect() == [{"team": {"name": "A"}, "xg": 0.3, "missing": None}]
    assert f.select("xg").rename(xg="goals").collect() == [{"goals": 0.3}]
    moved = f.select("team.name", "xg").rename_fields({"team.name": "side"}).collect()
    assert moved == [{"xg": 0.3, "side": "A"}]
    assert f.drop("team.name", "nothing").columns == ["type", "xg", "player", "tags"]
    assert set(f.flatten().columns) == {"type.name", "team.name", "xg", "player.name", "tags"}
    assert f.flatten().filter(P.where_equals("team.name", "A")).count() == 1


def test_assign_sees_the_row_as_it_was(spark):
    got = flow(spark, [{"x": 1}]).assign(x=F.col("x") + 1, y=F.col("x") * 10).collect()
    assert got == [{"x": 2, "y": 10}]


def test_paths(spark):
    f = flow(spark, [{"a": {"b": [{"c": 1}, {"c": 2}]}, "n": 0, "s": "x"}])
    got = f.assign(first=lambda d: paths.get_field(d, "a.b.0.c"), last=lambda d: paths.get_field(d, "a.b.-1.c"), none=lambda d: paths.get_field(d, "a.b.7.c", 9), both=lambda d: paths.combine_fields(d, "n", "s", "zz", join_str="-"), some=lambda d: paths.coalesce_paths(d, "zz", "s", default="d")).collect()[0]
    assert (got["first"], got["last"], got["none"], got["both"], got["some"]) == (1, 2, 9, "-x-", "x")
    deep = f.set_field("p.q.r", F.lit(5)).collect()[0]
    assert deep["p"] == {"q": {"r": 5}}


def test_dropna_keeps_nan(spark):
    f = flow(spark, [{"x": 1.0}, {"x": float("nan")}, {"x": None}])
    assert f.dropna("x").count() == 2 and f.dropna().count() == 2


def test_explode(spark):
    f = flow(spark, [{"k": 1, "a": [1, 2], "b": ["x", "y"]}, {"k": 2, "a": [], "b": []}, {"k": 3, "a": None, "b": None}])
    assert [(r["k"], r["a"], r["b"]) for r in f.explode("a", "b").collect()] == [(1, 1, "x"), (1, 2, "y"), (2, None, None), (3, None, None)]
    with pytest.raises(Exception, match="differ in length"):
        flow(spark, [{"a": [1], "b": [1, 2]}]).explode("a", "b").collect()
    assert flow(spark, [{"a": 5}]).explode("a").collect() == [{"a": 5}]


def test_split_array_and_casts(spark):
    assert flow(spark, [{"p": [1.0, 2.0]}, {"p": [3.0]}]).split_array("p", ["x", "y"]).select("x", "y").collect() == [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": None}]
    assert flow(spark, [{"x": "7"}, {"x": "q"}]).cast(x="int").collect() == [{"x": 7}, {"x": None}]
    with pytest.raises(Exception):  # noqa: B017
        flow(spark, [{"x": "q"}]).with_schema({"x": "int"}, strict=True).collect()
    assert flow(spark, [{"x": "1", "y": 2}]).with_schema({"x": "int"}, drop_extra=True).collect() == [{"x": 1}]


def test_map_and_pipe(spark):
    f = flow(spark, [{"x": 1}, {"x": 2}])
    assert [r["y"] for r in f.map(lambda r: {"y": r["x"] * 10} if r["x"] > 1 else None, "y long").collect()] == [20]
    assert f.pipe(lambda g, n: g.filter(F.col("x") > n), 1).select("x").collect() == [{"x": 2}]
    with pytest.raises(Exception, match="returns a dict"):
        f.map(lambda r: 3, "y long").collect()


def test_order_limit_distinct(spark):
    f = flow(spark, [{"k": "b", "v": 2}, {"k": "a", "v": None}, {"k": "b", "v": 1}, {"k": "a", "v": 3}])
    assert [r["v"] for r in f.sort_by("v").collect()] == [1, 2, 3, None]
    assert [r["v"] for r in f.sort_by("v", ascending=False).collect()] == [3, 2, 1, None]
    assert [(r["k"], r["v"]) for r in f.sort_by("k", "v", ascending=[True, False]).collect()] == [("a", 3), ("a", None), ("b", 2), ("b", 1)]
    assert [r["v"] for r in f.limit(2).collect()] == [2, None]
    assert [r["v"] for r in f.limit(3).limit(1).collect()] == [2]
    assert [(r["k"], r["v"]) for r in f.distinct("k").collect()] == [("b", 2), ("a", None)]
    assert {(r["k"], r["v"]) for r in f.distinct("k", keep="last").collect()} == {("b", 1), ("a", 3)}
    assert f.concat(f).distinct().count() == 4
    with pytest.raises(ValueError):
        Flow(f.df).limit(1).distinct("k")
    with pytest.raises(ValueError):
        f.sort_by("k", ascending=[True, False])


def test_samples(spark):
    f = flow(spark, [{"i": i} for i in range(1000)])
    part = f.sample_fraction(0.2, seed=3, key="i")
    assert 130 < part.count() < 270 and part.collect() == f.sample_fraction(0.2, seed=3, key="i").collect()
    assert f.sample_n(10, seed=1).count() == 10 and f.sample_n(10, seed=1, key="i").count() == 10
    assert f.sample_fraction(0.0).count() == 0


# --- aggregates


def test_aggregates(spark):
    f = flow(spark, [{"x": 10.0, "t": "b"}, {"x": None, "t": "a"}, {"x": 20.0, "t": "b"}, {"x": float("nan"), "t": None}, {"x": 40.0, "t": "a"}])
    got = f.summary({"n": "count", "nn": ("count_nonnull", "x"), "sum": ("sum", "x"), "mean": ("mean", "x"), "min": ("min", "x"), "max": ("max", "x"), "median": ("median", "x"), "range": ("range", "x"), "first": ("first", "t"), "last": ("last", "t"), "mode": ("mode", "t"), "unique": ("unique", "t"), "list": ("list", "t"), "any": ("any", "x"), "all": ("all", "x"), "p": aggregates.percentile("x", 50), "iqr": ("iqr", "x")}).collect()[0]
    assert got["n"] == 5 and got["nn"] == 4 and got["sum"] == 70 and abs(got["mean"] - 70 / 3) < 1e-9
    assert (got["min"], got["max"], got["median"], got["range"], got["p"], got["iqr"]) == (10, 40, 20, 30, 20, 15)
    assert (got["first"], got["last"], got["mode"]) == ("b", "a", "b")
    assert got["unique"] == ["a", "b", None] and got["list"] == ["b", "a", "b", None, "a"]
    assert got["any"] is True and got["all"] is False


def test_aggregates_of_nothing(spark):
    f = flow(spark, [{"x": None, "k": 1}], "x double, k long")
    got = f.group_by("k").summary({"s": ("sum", "x"), "m": ("mean", "x"), "a": ("all", "x"), "y": ("any", "x"), "missing": ("sum", "zz")}).collect()[0]
    assert (got["s"], got["m"], got["missing"]) == (0.0, None, 0.0)
    with pytest.raises(ValueError, match="unknown aggregate"):
        f.summary({"s": ("no_such", "x")})
    with pytest.raises(ValueError, match="order"):
        Flow(f.df).summary({"s": ("first", "x")})


def test_registered_and_custom_aggregates(spark):
    aggregates.register("double_sum", lambda c, k, f: f.run(F.sum(c)) * 2)
    f = flow(spark, [{"k": "a", "x": 1}, {"k": "a", "x": 2}, {"k": "b", "x": 5}])
    got = {r["k"]: r for r in f.group_by("k").summary({"d": ("double_sum", "x"), "c": aggregates.custom(lambda rows: sum(r["x"] for r in rows) ** 2, "long", "x")}).collect()}
    assert (got["a"]["d"], got["a"]["c"], got["b"]["c"]) == (6, 9, 25)


def test_group_keys(spark):
    f = flow(spark, [{"t": {"n": "A"}, "x": 1}, {"t": {"n": None}, "x": 2}, {"t": {"n": None}, "x": 3}])
    got = {r["t.n"]: r["s"] for r in f.group_by("t.n").summary({"s": ("sum", "x")}).collect()}
    assert got == {"A": 1, None: 5}
    records = {r["k"]: [x["x"] for x in r["records"]] for r in flow(spark, [{"k": 1, "x": 3}, {"k": 1, "x": 1}, {"k": 2, "x": 2}]).grouped("k").collect()}
    assert records == {1: [3, 1], 2: [2]}


def test_pivot(spark):
    f = flow(spark, [{"i": 1, "c": "x", "v": 1}, {"i": 1, "c": "x", "v": 2}, {"i": 1, "c": "y", "v": 3}, {"i": 2, "c": None, "v": 4}, {"i": 2, "c": "y", "v": 5}])
    got = {r["i"]: (r["x"], r["y"]) for r in f.pivot("i", "c", "v").collect()}
    assert got == {1: (2, 3), 2: (None, 5)}


# --- windows


def test_cumulative_and_rolling(spark):
    f = flow(spark, [{"t": "A", "v": 1}, {"t": "B", "v": 2}, {"t": "A", "v": 3}, {"t": "B", "v": 4}])
    assert [(r["t"], r["c"]) for r in f.group_by("t").cumulative("v", "c").collect()] == [("A", 1), ("B", 2), ("A", 4), ("B", 6)]
    g = flow(spark, [{"t": "A", "v": k} for k in (1, 2, 3, 4)])
    assert [r["s"] for r in g.group_by("t").rolling_summary(2, {"s": ("sum", "v")}).collect()] == [1, 3, 5, 7]
    assert [r["s"] for r in g.group_by("t").rolling_summary(2, {"s": ("sum", "v")}, min_periods=2).collect()] == [3, 5, 7]
    assert [r["s"] for r in g.group_by("t").rolling_summary(2, {"s": ("sum", "v")}, step=2).collect()] == [1, 5]
    many = g.group_by("t").rolling_summary(3, {"l": ("list", "v"), "m": ("median", "v"), "o": ("mode", "v"), "f": ("first", "v"), "u": ("nunique", "v")}).collect()
    assert many[-1]["l"] == [2, 3, 4] and many[-1]["m"] == 3 and many[-1]["f"] == 2 and many[-1]["u"] == 3
    with pytest.raises(ValueError):
        Flow(g.df).group_by("t").cumulative("v")


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_rolling_time_ties_and_bounds(spark):
    rows = [{"g": 1, "at": at(s), "v": v} for s, v in ((0, 1), (60, 2), (60, 4), (300, 8), (301, 16))]
    got = flow(spark, rows).group_by("g").rolling_summary("5m", {"s": ("sum", "v")}, time_field="at").collect()
    # a row at the same instant that comes later is not seen yet; the lower bound is inclusive
    assert [r["s"] for r in got] == [1, 3, 7, 15, 30]


def test_time_bucket(spark):
    f = flow(spark, [{"g": "A", "at": at(0), "v": 10}, {"g": "B", "at": at(10), "v": 10}, {"g": "A", "at": at(20), "v": 20}, {"g": "B", "at": at(35), "v": 10}, {"g": "A", "at": None, "v": 99}])
    got = f.group_by("g").time_bucket("30s", {"s": ("sum", "v")}, "at").collect()
    assert [(r["g"], r["bucket"], r["s"]) for r in got] == [("A", at(0), 30), ("B", at(10), 20)]
    right = flow(spark, [{"g": 1, "at": at(s), "v": 10} for s in (0, 20, 40)]).group_by("g").time_bucket("30s", {"s": ("sum", "v")}, "at", label="right").collect()
    assert [(r["bucket"], r["s"]) for r in right] == [(at(30), 20), (at(60), 10)]
    late = flow(spark, [{"g": 1, "at": at(40), "v": 1}, {"g": 1, "at": at(0), "v": 2}]).group_by("g").time_bucket("30s", {"s": ("sum", "v")}, "at").collect()
    assert [r["bucket"] for r in late] == [at(-20), at(40)]
    clock = flow(spark, [{"g": 1, "at": dt.timedelta(seconds=s), "v": 1} for s in (5, 35, 50)]).group_by("g").time_bucket("30s", {"s": "count"}, "at").collect()
    assert [(r["bucket"], r["s"]) for r in clock] == [(dt.timedelta(0), 1), (dt.timedelta(seconds=30), 2)]
    number = flow(spark, [{"g": 1, "m": m} for m in (1, 14, 16)]).group_by("g").time_bucket(15, {"s": "count"}, "m").collect()
    assert [(r["bucket"], r["s"]) for r in number] == [(0.0, 2), (15.0, 1)]


# --- joins


def test_join_types(spark):
    a, b = flow(spark, [{"id": i, "x": i * 10} for i in (1, 2, 3)]), flow(spark, [{"id": i, "y": i * 100} for i in (1, 2, 4)])
    assert [(r["id"], r["x"], r["y"]) for r in a.join(b, on="id").collect()] == [(1, 10, 100), (2, 20, 200), (3, 30, None)]
    assert a.join(b, on="id", how="inner").count() == 2
    assert {(r["id"], r["x"]) for r in a.join(b, on="id", how="right").collect()} == {(1, 10), (2, 20), (4, None)}
    assert {r["id"] for r in a.join(b, on="id", how="outer").collect()} == {1, 2, 3, 4}
    assert [r["id"] for r in a.join(b, on="id", how="anti").collect()] == [3]
    assert [r["id"] for r in a.join(b, on="id", how="semi").collect()] == [1, 2]


def test_join_names_and_errors(spark):
    a, b = flow(spark, [{"id": 1, "value": "l"}]), flow(spark, [{"id": 1, "value": "r"}])
    assert a.join(b, on="id").collect() == [{"id": 1, "value": "l", "value_right": "r"}]
    assert a.join(b, on="id", lsuffix="_l").collect() == [{"id": 1, "value_l": "l", "value_right": "r"}]
    assert a.join(b, on="id", rsuffix="").collect() == [{"id": 1, "value": "l"}]
    assert a.join(b, on="id", how="right").collect() == [{"id": 1, "value": "l"}]
    for bad in (dict(on="id", how="cross"), dict(), dict(left_on="id"), dict(left_on=["id", "value"], right_on="id"), dict(on="id", type_coercion="odd")):
        with pytest.raises(ValueError):
            a.join(b, **bad)
    with pytest.raises(TypeError):
        a.join(flow(spark, [{"id": "1"}]), on="id")


def test_join_nulls_and_coercion(spark):
    a = flow(spark, [{"k": 1, "n": "a"}, {"k": None, "n": "b"}, {"k": 3, "n": "c"}])
    b = flow(spark, [{"k": "1", "m": "x"}, {"k": None, "m": "y"}, {"k": "3.0", "m": "z"}])
    assert {(r["n"], r["m"]) for r in a.join(b, on="k", how="inner", type_coercion="auto").collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    c = flow(spark, [{"k": "0"}, {"k": "-1.0"}, {"k": "1"}, {"k": "01"}, {"k": "x"}])
    d = flow(spark, [{"k": 0.0}, {"k": -1.0}, {"k": 1.0}])
    assert c.join(d, on="k", how="semi", type_coercion="auto").count() == 4
    assert a.join(b, on="k", how="semi", type_coercion="string").count() == 2
    nested = flow(spark, [{"t": {"i": 1}}]).join(flow(spark, [{"u": {"i": 1}, "z": 5}]), left_on="t.i", right_on="u.i", how="inner")
    assert nested.collect()[0]["z"] == 5


def test_asof_join(spark):
    left = flow(spark, [{"k": 1, "t": at(5)}, {"k": 1, "t": at(0)}, {"k": 2, "t": at(9)}])
    right = flow(spark, [{"k": 1, "t": at(0), "p": 1}, {"k": 1, "t": at(4), "p": 2}, {"k": 1, "t": at(6), "p": 3}])
    got = {(r["k"], r["t"]): r["r_p"] for r in left.asof_join(right, "k", "t", "t", prefix="r_").collect()}
    assert got == {(1, at(5)): 2, (1, at(0)): 1, (2, at(9)): None}
    strict = {(r["k"], r["t"]): r["r_p"] for r in left.asof_join(right, "k", "t", "t", prefix="r_", strict=True).collect()}
    assert strict[(1, at(0))] is None
    near = left.asof_join(right, "k", "t", "t", prefix="r_", tolerance_seconds=0.5).collect()
    assert {r["r_p"] for r in near if r["t"] == at(5)} == {None}


def test_merge_chains(spark):
    from tallyfield.operators.joins import resolve_merges

    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "merged_id string, surviving_id string")
    assert {(r[0], r[1]) for r in resolve_merges(m).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")}
    with pytest.raises(ValueError, match="cycle"):
        resolve_merges(spark.createDataFrame([("a", "b"), ("b", "a")], "merged_id string, surviving_id string"))


# --- files


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.jsonl").write_text('{"x": 3, "y": "q"}\n\n{"x": 4}\n')
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "d.json").write_text(json.dumps({"x": 5}))
    assert sorted(r["x"] for r in Flow.from_json(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    assert Flow.from_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert sorted(r["x"] for r in Flow.from_folder(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    assert sorted(r["x"] for r in Flow.from_glob(spark, str(tmp_path / "**" / "*.json")).collect()) == [1, 2, 5]
    assert sorted(r["x"] for r in Flow.from_glob(spark, str(tmp_path / "*.jsonl")).collect()) == [3, 4]
    f = Flow.from_records(spark, [{"x": 1, "n": {"y": [1]}}])
    f.to_jsonl(str(tmp_path / "out"))
    assert Flow.from_jsonl(spark, str(tmp_path / "out")).collect() == [{"n": {"y": [1]}, "x": 1}]
    f.to_json(str(tmp_path / "one.json"))
    assert json.loads((tmp_path / "one.json").read_text()) == [{"x": 1, "n": {"y": [1]}}]
    f.to_parquet(str(tmp_path / "pq"))
    assert Flow.from_parquet(spark, str(tmp_path / "pq")).count() == 1
    with pytest.raises(FileNotFoundError):
        Flow.from_glob(spark, str(tmp_path / "**" / "*.none.json"))


def test_records_and_actions(spark, capsys):
    with pytest.raises(TypeError):
        Flow.from_records(spark, {"x": 1})
    f = Flow.from_records(spark, [{"x": 1, "y": {"z": "a"}}, {"x": 2.5, "w": [1]}])
    assert f.schema() == {"x": "double", "y.z": "string", "w": "array<bigint>"} and f.keys() == {"x", "y.z", "w"}
    assert len(f) == 2 and not f.is_empty() and [r["x"] for r in f] == [1.0, 2.5] and f.head(1)[0]["x"] == 1.0
    assert list(f.to_pandas()["x"]) == [1.0, 2.5]
    f.show(1)
    f.show(1, format="record")
    assert "x" in capsys.readouterr().out
    assert "Scan" in f.explain() and f.profile() and f.cache().count() == 2
    assert Flow.from_concat(f, f).count() == 4


def test_functions_of_rows_and_values(spark):
    from tallyfield.flow import Flow, per_row

    f = Flow.from_records(spark, [{"a": "1", "b": {"c": 2}}, {"a": "x", "b": {"c": None}}, {"a": None, "b": None}])
    got = f.assign(d=per_row(lambda r: None if r["b"] is None else (r["b"]["c"] or 0) + 1, "long")).cast(a=per_row(int, "long")).collect()
    assert [(r["a"], r["d"]) for r in got] == [(1, 3), (None, 1), (None, None)]


def test_ranks_over_ranges(spark):
    from tallyfield.flow import Flow

    f = Flow(spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.col("id").alias("v"))).sort_by("k", ascending=False)
    assert all(r["rank"] == 500 - r["k"] for r in f.with_rank().df.collect())
    with pytest.raises(ValueError):
        Flow(spark.range(3)).with_rank()


def test_asof_join_in_bins(spark):
    import datetime as dt
    import random

    from tallyfield.operators.joins import asof_join

    rng = random.Random(3)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(rng.choice("aab") if i % 9 else None, None if i % 31 == 0 else at(rng.randrange(4000)), i) for i in range(300)], "k string, t timestamp, i int")
    right = spark.createDataFrame([(rng.choice("ab") if i % 7 else None, None if i % 29 == 0 else at(rng.randrange(5000) - 500), i) for i in range(200)], "k string, u timestamp, v int")
    for how in ({}, {"strict": True}, {"tolerance_seconds": 60}):
        want = sorted(asof_join(left, right, "k", "t", "u", **how).collect(), key=lambda r: r["i"])
        for width in (50, 100_000, 0.5):
            assert sorted(asof_join(left, right, "k", "t", "u", bin_seconds=width, **how).collect(), key=lambda r: r["i"]) == want


def test_sums_of_time_frames_take_time_by_rows_not_frames(spark):
    import time

    df = spark.range(60_000).select(F.lit(1).alias("g"), F.timestamp_seconds(F.col("id") % 10 * 3600).alias("t"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), "id").coalesce(1)
    began = time.perf_counter()
    out = Flow(df, ["t", "id"]).group_by("g").rolling_summary("3h", {"s": ("sum", "v"), "n": "count", "k": ("count_nonnull", "v")}, time_field="t").df
    got = {r["id"]: (r["s"], r["n"], r["k"]) for r in out.collect()}
    assert time.perf_counter() - began < 20  # frames of 18,000 rows and more, each gone over anew, took minutes
    rows = sorted(range(60_000), key=lambda k: (k % 10, k))
    for at in [*range(0, 60_000, 997), 59_999]:
        frame = [k for k in rows[: at + 1] if k % 10 >= rows[at] % 10 - 3]
        known = [k for k in frame if k % 7]
        assert got[rows[at]] == (sum(known), len(frame), len(known))
