"""Flow: a lazy pipeline over nested rows that is a Spark plan underneath.

Row order is semantic for some operators (limit, first, last, list, cumulative, ...), and a
DataFrame has none.  A Flow therefore carries the columns that order it: `ordered(...)` or
`sort_by(...)` set them, `from_records` adds a hidden ordinal.  Operators that need an order
raise if there is none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyfield.functions import paths
from tallyfield.functions.aggregates import Frame
from tallyfield.functions.predicates import Predicate, as_predicate
from tallyfield.operators import joins, windows
from tallyfield.plans import query_dsl
from tallyfield.sources import files, records

ORDINAL = "__ordinal"


class PerRow:
    """A Python function of a row (a dict) or of a value, with the type it returns: the slow path, in Arrow batches."""

    def __init__(self, func: Callable[[Any], Any], returns: str | T.DataType):
        self.func, self.returns = func, returns

    def over_rows(self, df: DataFrame) -> Column:
        func = self.func
        return F.udf(lambda row: func(row.asDict(recursive=True)), self.returns, useArrow=True)(F.struct(*[F.col(f"`{c}`") for c in df.columns]))

    def over_value(self, value: Column) -> Column:
        func = self.func

        def convert(x: Any) -> Any:
            try:
                return None if x is None else func(x)
            except (TypeError, ValueError):
                return None

        return F.udf(convert, self.returns, useArrow=True)(value)


def per_row(func: Callable[[Any], Any], returns: str | T.DataType) -> PerRow:
    """For `assign` a function of the row as a dict, for `cast` one of the value (null where it fails)."""
    return PerRow(func, returns)


class Flow:
    """An immutable pipeline; every method gives a new one and nothing runs before an action."""

    def __init__(self, df: DataFrame, order: Sequence[str | tuple[str, bool]] = ()):
        self._df = df
        self._order = tuple((o, True) if isinstance(o, str) else o for o in order)

    # --- sources

    @classmethod
    def from_records(cls, spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None) -> Flow:
        if isinstance(rows, Mapping) or not all(isinstance(r, Mapping) for r in rows):
            raise TypeError("from_records takes a list of dicts")
        return cls(records.frame(spark, list(rows), schema, ORDINAL), [ORDINAL])

    from_list = from_records

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Flow:
        return cls(files.read_json(spark, path, schema))

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Flow:
        return cls(files.read_jsonl(spark, path, schema))

    @classmethod
    def from_folder(cls, spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Flow:
        return cls(files.read_folder(spark, path, schema))

    @classmethod
    def from_glob(cls, spark: SparkSession, pattern: str, schema: T.StructType | str | None = None) -> Flow:
        return cls(files.read_glob(spark, pattern, schema))

    @classmethod
    def from_parquet(cls, spark: SparkSession, *paths_: str) -> Flow:
        return cls(spark.read.parquet(*paths_))

    @classmethod
    def from_concat(cls, *flows: Flow) -> Flow:
        return flows[0].concat(*flows[1:])

    # --- plumbing

    @property
    def df(self) -> DataFrame:
        """The rows without the hidden ordinal."""
        return self._df.drop(ORDINAL)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c != ORDINAL]

    def _with(self, df: DataFrame, order: Sequence[tuple[str, bool]] | None = None) -> Flow:
        order = self._order if order is None else tuple(order)
        return Flow(df, [o for o in order if paths.resolve(df.schema, o[0])])

    def ordered(self, *columns: str) -> Flow:
        """Declare the columns that order rows; nothing is sorted by it."""
        return Flow(self._df, columns)

    def _order_columns(self) -> list[Column]:
        if not self._order:
            raise ValueError("this operator depends on row order: use ordered(...) or sort_by(...)")
        return [paths.get_field(self._df, c).asc_nulls_last() if up else paths.get_field(self._df, c).desc_nulls_last() for c, up in self._order]

    def _order_struct(self) -> Column | None:
        """One comparable value for row order, for first and last by aggregation; None without an order."""
        if not self._order or not all(up for _, up in self._order):
            return None
        return F.struct(*[paths.get_field(self._df, c).alias(f"o{i}") for i, (c, _) in enumerate(self._order)])

    # --- rows

    def filter(self, *predicates: Predicate | Column) -> Flow:
        df = self._df
        for p in predicates:
            df = df.filter(as_predicate(p).filter(df))
        return self._with(df)

    def query(self, text: str, **params: Any) -> Flow:
        return self.filter(query_dsl.parse(text, params))

    def select(self, *fields: str) -> Flow:
        """The fields, nested ones in their place; missing ones are null."""
        flat: dict[str, Any] = {}
        for path in fields:
            if path in self._df.columns or "." not in path:
                flat[path] = paths.get_field(self._df, path)
                continue
            node, parts = flat, path.split(".")
            for part in parts[:-1]:
                below = node.setdefault(part, {})
                node = node.setdefault(part, {}) if isinstance(below, dict) else {}
            node[parts[-1]] = paths.get_field(self._df, path)

        def build(name: str, x: Any) -> Column:
            return (F.struct(*[build(k, v) for k, v in x.items()]) if isinstance(x, dict) else x).alias(name)

        hidden = [F.col(ORDINAL)] if ORDINAL in self._df.columns else []
        return self._with(self._df.select(*[build(k, v) for k, v in flat.items()], *hidden))

    def assign(self, **fields: Column | Callable[[DataFrame], Column] | PerRow) -> Flow:
        """New or replaced columns; all of them see the row as it was.  `per_row(func, type)` computes one in Python."""
        fields = {k: v.over_rows(self.df) if isinstance(v, PerRow) else v for k, v in fields.items()}
        values = {k: v(self._df) if callable(v) and not isinstance(v, Column) else v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
        return self._with(self._df.withColumns(values))

    def set_field(self, path: str, value: Column) -> Flow:
        return self._with(paths.set_path(self._df, path, value))

    def rename(self, **mapping: str) -> Flow:
        return self.rename_fields(mapping)

    def rename_fields(self, mapping: Mapping[str, str]) -> Flow:
        """Rename columns, or move nested fields (a null nested value is not moved over)."""
        df, order = self._df, list(self._order)
        for old, new in mapping.items():
            found = paths.resolve(df.schema, old)
            if found is None:
                continue
            if old in df.columns and "." not in new:
                df = df.withColumnRenamed(old, new)
                order = [(new, up) if c == old else (c, up) for c, up in order]
            else:
                df = paths.delete_path(paths.set_path(df, new, found[0]), old)
        return self._with(df, order)

    def drop(self, *fields: str) -> Flow:
        df = self._df
        for f in fields:
            df = paths.delete_path(df, f)
        return self._with(df)

    def flatten(self) -> Flow:
        return self._with(paths.flatten(self._df))

    def dropna(self, *fields: str) -> Flow:
        """Rows without a null in the fields (all columns by default); NaN is no null."""
        df = self._df
        for f in fields or self.columns:
            df = df.filter(paths.get_field(df, f).isNotNull())
        return self._with(df)

    def explode(self, *fields: str) -> Flow:
        """One row for each place of the arrays, several arrays in step.

        Arrays of different lengths in a row raise; a null or empty array keeps its row with null.
        """
        if not fields:
            raise ValueError("explode needs a field")
        df = self._df
        found = {f: paths.resolve(df.schema, f) for f in fields}
        lists = [f for f in fields if found[f] and isinstance(found[f][1], T.ArrayType)]
        if not lists:
            return self
        sizes = [F.coalesce(F.size(found[f][0]), F.lit(0)) for f in lists]
        same = F.lit(True)
        for s in sizes[1:]:
            same = same & (s == sizes[0])
        zipped = F.when(same, F.arrays_zip(*[F.coalesce(found[f][0], F.array().cast(found[f][1])).alias(f"v{i}") for i, f in enumerate(lists)])).otherwise(F.raise_error(F.lit("arrays to explode differ in length")))
        kind = T.ArrayType(T.StructType([T.StructField(f"v{i}", found[f][1].elementType) for i, f in enumerate(lists)]))
        df = df.select("*", F.posexplode_outer(zipped.cast(kind)).alias("__place", "__item"))
        order = list(self._order)
        for i, f in enumerate(lists):
            df = paths.set_path(df, f, F.col(f"__item.v{i}"))
        if ORDINAL in df.columns:  # places follow their row
            df = df.withColumn(ORDINAL, F.col(ORDINAL) + F.coalesce(F.col("__place"), F.lit(0)) / F.lit(1e6))
        return self._with(df.drop("__place", "__item"), order)

    def split_array(self, field: str, into: Sequence[str]) -> Flow:
        """The first places of an array as columns; what it lacks is null."""
        found = paths.resolve(self._df.schema, field)
        if found is None or not isinstance(found[1], T.ArrayType):
            return self
        return self._with(self._df.withColumns({name: F.get(found[0], F.lit(i)) for i, name in enumerate(into)}))

    def cast(self, **types: str | T.DataType | PerRow) -> Flow:
        """Change types; what cannot be read becomes null.  `per_row(func, type)` converts the field's values in Python."""
        to = lambda k, v: v.over_value(paths.get_field(self._df, k)) if isinstance(v, PerRow) else paths.get_field(self._df, k).try_cast(v)
        return self._with(self._df.withColumns({k: to(k, v) for k, v in types.items()}))

    def with_schema(self, schema: Mapping[str, str | T.DataType], strict: bool = False, drop_extra: bool = False) -> Flow:
        """Cast fields to a schema; strict raises on values that cannot be read, else they become null."""
        cast = {k: paths.get_field(self._df, k).cast(v) if strict else paths.get_field(self._df, k).try_cast(v) for k, v in schema.items()}
        df = self._df.withColumns(cast)
        if drop_extra:
            df = df.select(*[F.col(f"`{k}`") for k in schema], *[c for c in (ORDINAL,) if c in df.columns])
        return self._with(df)

    def map(self, func: Callable[[dict[str, Any]], dict[str, Any] | None], schema: T.StructType | str) -> Flow:
        """A Python function from row to row (None drops it): the slow path, in Arrow batches."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    got = func(row)
                    if got is None:
                        continue
                    if not isinstance(got, dict):
                        raise TypeError("map takes a function that returns a dict or None")
                    out.append(got)
                yield pd.DataFrame(out, columns=names)

        names = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fieldNames()
        return self._with(self.df.mapInPandas(run, schema))

    def pipe(self, func: Callable[..., Flow], *args: Any, **kwargs: Any) -> Flow:
        return func(self, *args, **kwargs)

    # --- order and size

    def sort_by(self, *keys: str, ascending: bool | Sequence[bool] = True) -> Flow:
        """Sort, nulls last either way; the order before breaks ties."""
        up = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
        if len(up) != len(keys):
            raise ValueError("ascending has another length than the keys")
        order = [*zip(keys, up, strict=True), *[o for o in self._order if o[0] not in keys]]
        out = Flow(self._df, order)
        return Flow(self._df.orderBy(*out._order_columns()), order)

    def with_rank(self, name: str = "rank") -> Flow:
        """The place of each row in the flow's order, from 1.

        Rows are dealt to ranges of the order, numbered within them, and the ranges' sizes
        are carried over: no task holds all rows.
        """
        order = self._order_columns()
        if not order:
            raise ValueError("a rank needs an order")
        df = self._df
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        # persisted, so that the ranges are the same for their sizes and for their rows
        dealt = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()).persist()
        before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # a row a range
        starts = dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
        numbered = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
        return self._with(numbered.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__range", "__at", "__start"))

    def limit(self, n: int) -> Flow:
        if n < 0:
            raise ValueError("a limit is not negative")
        return self._with(self._df.orderBy(*self._order_columns()).limit(n) if self._order else self._df.limit(n))

    def distinct(self, *keys: str, keep: str = "first") -> Flow:
        """One row of each key, the first or last in order; whole rows without keys."""
        if keep not in ("first", "last"):
            raise ValueError("keep is first or last")
        if not keys:
            if ORDINAL not in self._df.columns:
                return self._with(self._df.distinct())
            keys = tuple(self.columns)
        order = self._order_columns()
        flags = [up for _, up in self._order]
        if keep == "last":
            order = [paths.get_field(self._df, c).desc_nulls_first() if up else paths.get_field(self._df, c).asc_nulls_first() for (c, _), up in zip(self._order, flags, strict=True)]
        w = W.partitionBy(*[paths.get_field(self._df, k) for k in keys]).orderBy(*order)
        return self._with(self._df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"))

    def sample_fraction(self, p: float, seed: int | None = None, key: str | None = None) -> Flow:
        """About a share p of the rows; with a key, those whose hash falls below p, on any cluster the same."""
        if not 0 <= p <= 1:
            raise ValueError("a fraction lies between 0 and 1")
        if key is None:
            return self._with(self._df.sample(fraction=p, seed=seed))
        return self._with(self._df.filter(hash_share(paths.get_field(self._df, key), seed) < p))

    def sample_n(self, n: int, seed: int | None = None, key: str | None = None) -> Flow:
        """n rows at random: the n least hashes of the key (a random number without one), so a top-n and no full sort."""
        by = F.rand(seed) if key is None else hash_share(paths.get_field(self._df, key), seed)
        tie = [] if key is None else [paths.get_field(self._df, key)]
        return self._with(self._df.withColumn("__h", by).orderBy("__h", *tie).limit(n).drop("__h"))

    # --- several flows

    def concat(self, *others: Flow) -> Flow:
        """All rows, by column name; columns that one lacks are null there."""
        df = self._df
        if ORDINAL in df.columns:
            df = df.withColumn(ORDINAL, F.col(ORDINAL).cast("double"))
        for k, other in enumerate(others, 1):
            right = other._df
            if ORDINAL in df.columns and ORDINAL in right.columns:
                right = right.withColumn(ORDINAL, F.col(ORDINAL).cast("double") + F.lit(k * 1e9))
            df = df.unionByName(right, allowMissingColumns=True)
        return self._with(df)

    def union_distinct(self, *others: Flow) -> Flow:
        return Flow(self.concat(*others).df.distinct())

    def except_all(self, other: Flow) -> Flow:
        return Flow(self.df.exceptAll(other.df))

    def intersect(self, other: Flow) -> Flow:
        return Flow(self.df.intersect(other.df))

    def join(self, other: Flow, on: str | Sequence[str] | None = None, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, how: str = "left", lsuffix: str = "", rsuffix: str = "_right", type_coercion: str = "strict") -> Flow:
        main, side = (self._df, other.df) if how.lower() != "right" else (self.df, other._df)
        return Flow(joins.join(main, side, on, left_on, right_on, how, lsuffix, rsuffix, type_coercion), self._order if how.lower() != "right" else other._order)

    def asof_join(self, other: Flow, by: str | Sequence[str], left_time: str, right_time: str, **how: Any) -> Flow:
        return Flow(joins.asof_join(self.df, other.df, by, left_time, right_time, **how))

    # --- groups

    def group_by(self, *keys: str) -> FlowGroup:
        return FlowGroup(self, keys)

    def grouped(self, key: str) -> Flow:
        """A row for each key with its rows as a list (in order, if there is one)."""
        row = F.struct(*[F.col(f"`{c}`") for c in self.columns])
        order = self._order_struct()
        many = F.collect_list(row) if order is None else F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), row.alias("r")))), lambda x: x["r"])
        return Flow(self._df.groupBy(paths.get_field(self._df, key).alias(key)).agg(many.alias("records")))

    def summary(self, aggregators: Mapping[str, Any]) -> Flow:
        """One row over all rows."""
        cols = windows.aggregate_columns(self._df, aggregators, Frame(order=self._order_struct()))
        return Flow(self._df.agg(*[v.alias(k) for k, v in cols.items()]))

    def rollup(self, *keys: str) -> FlowGroup:
        return FlowGroup(self, keys, "rollup")

    def cube(self, *keys: str) -> FlowGroup:
        return FlowGroup(self, keys, "cube")

    def pivot(self, index: str | Sequence[str], columns: str, values: str, names: Sequence[Any] | None = None) -> Flow:
        """A column for each value of `columns`, holding the last of `values`; give the names to spare a pass."""
        keys = [index] if isinstance(index, str) else list(index)
        df = self._df.filter(F.col(f"`{columns}`").isNotNull())
        order = self._order_struct()
        if order is None:
            raise ValueError("pivot keeps the last value: give the flow an ascending order")
        grouped = df.groupBy(*[paths.get_field(df, k).alias(k) for k in keys]).pivot(columns, list(names) if names else None)
        return Flow(grouped.agg(F.max_by(paths.get_field(df, values), order)))

    # --- schema

    def schema(self) -> dict[str, str]:
        """Types by dotted name."""
        return {n: k.simpleString() for n, k in paths.leaves(self.df.schema)}

    def keys(self, limit: int | None = 100) -> set[str]:
        return set(list(self.schema())[:limit])

    # --- actions

    def _sorted(self) -> DataFrame:
        return (self._df.orderBy(*self._order_columns()) if self._order else self._df).drop(ORDINAL)

    def collect(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self._sorted().collect()]

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return (r.asDict(recursive=True) for r in self._sorted().toLocalIterator())

    def __len__(self) -> int:
        return self.count()

    def count(self) -> int:
        return self._df.count()

    def is_empty(self) -> bool:
        return self._df.isEmpty()

    def head(self, n: int = 5) -> list[dict[str, Any]]:
        return self.limit(n).collect()

    def show(self, n: int = 5, format: str = "table") -> None:
        if format == "record":
            for r in self.head(n):
                print(json.dumps(r, indent=2, default=str))
        else:
            self.limit(n).flatten().df.show(n, truncate=False)

    def to_pandas(self) -> pd.DataFrame:
        return self._sorted().toPandas()

    def to_json(self, path: str, indent: int | None = 4) -> None:
        """One array in one local file, for small results; `to_jsonl` is the distributed sink."""
        text = json.dumps(self.collect(), indent=indent, default=str)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)

    def to_jsonl(self, path: str, mode: str = "errorifexists") -> None:
        """A folder of JSON lines, written by the executors."""
        self.df.write.mode(mode).json(os.fspath(path))

    def to_parquet(self, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).partitionBy(*partition_by).option("compression", "zstd").parquet(os.fspath(path))

    def cache(self) -> Flow:
        return Flow(self._df.persist(), self._order)

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text."""
        return self.df._jdf.queryExecution().explainString(self.df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def profile(self) -> str:
        return self.explain("cost")


class FlowGroup:
    """A flow with keys: summaries by partial aggregation, running ones by windows.  Groups are never gathered."""

    def __init__(self, flow: Flow, keys: Sequence[str], kind: str = "groupBy"):
        self.flow, self.keys, self.kind = flow, list(keys), kind

    def _keys(self) -> list[Column]:
        return [paths.get_field(self.flow._df, k).alias(k) for k in self.keys]

    def summary(self, aggregators: Mapping[str, Any]) -> Flow:
        cols = windows.aggregate_columns(self.flow._df, aggregators, Frame(order=self.flow._order_struct()))
        if self.kind == "groupBy":
            return Flow(self.flow._df.groupBy(*self._keys()).agg(*[v.alias(k) for k, v in cols.items()]))
        named = self.flow._df.withColumns({k: paths.get_field(self.flow._df, k) for k in self.keys if k not in self.flow._df.columns})
        return Flow(getattr(named, self.kind)(*[F.col(f"`{k}`") for k in self.keys]).agg(*[v.alias(k) for k, v in cols.items()]))

    def sort_by(self, *keys: str, ascending: bool | Sequence[bool] = True) -> FlowGroup:
        """The order of rows within groups."""
        up = [ascending] * len(keys) if isinstance(ascending, bool) else list(ascending)
        return FlowGroup(Flow(self.flow._df, [*zip(keys, up, strict=True), *[o for o in self.flow._order if o[0] not in keys]]), self.keys, self.kind)

    def cumulative(self, field: str, alias: str | None = None) -> Flow:
        return self.flow._with(windows.cumulative(self.flow._df, self.keys, field, self.flow._order_columns(), alias))

    def rolling_summary(self, window: int | str, aggregators: Mapping[str, Any], time_field: str | None = None, min_periods: int = 1, step: int | None = None) -> Flow:
        order = self.flow._order_columns() if self.flow._order or time_field is None else [paths.get_field(self.flow._df, time_field).asc()]
        return self.flow._with(windows.rolling(self.flow._df, self.keys, window, aggregators, order, time_field, min_periods, step))

    def time_bucket(self, freq: str | float, aggregators: Mapping[str, Any], time_field: str, label: str = "left", bucket_name: str = "bucket") -> Flow:
        order = self.flow._order_struct()
        if order is None:
            raise ValueError("a bucket's origin is the first time in row order: give the flow an ascending order")
        return Flow(windows.time_bucket(self.flow._df, self.keys, freq, aggregators, time_field, order, label, bucket_name), [*self.keys, bucket_name])

    def select(self, *fields: str) -> FlowGroup:
        return FlowGroup(self.flow.select(*dict.fromkeys([*self.keys, *fields])), self.keys, self.kind)

    def to_flow(self) -> Flow:
        return self.flow

    def collect(self) -> list[dict[str, Any]]:
        return self.flow.collect()


def hash_share(key: Column, seed: int | None = None) -> Column:
    """A number in [0, 1) from the MD5 of key and seed; SQL engines agree on it."""
    text = F.concat_ws("|", key.cast("string"), F.lit(str(seed or 0)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
