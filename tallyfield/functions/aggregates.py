"""Named aggregates: each name stands for a function from a column to an aggregate column.

The same functions serve grouped summaries (`Frame.grouped()`) and window frames
(`Frame(window)`).  Numeric ones skip null and NaN; `first`, `last`, `list`, `mode` follow
the frame's row order, which a summary must be told.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


class Frame:
    """Where an aggregate runs: a group (over=None) or a window; `order` orders rows in a group."""

    def __init__(self, over: WindowSpec | None = None, order: Column | None = None):
        self.over, self._order = over, order

    def run(self, agg: Column) -> Column:
        return agg if self.over is None else agg.over(self.over)

    def total(self, agg: Column) -> Column:
        """An exact sum or a count, which a frame may take as the difference of two running ones."""
        return self.run(agg)

    @property
    def order(self) -> Column:
        if self._order is None:
            raise ValueError("this aggregate depends on row order: give the flow an order")
        return self._order


Builder = Callable[[Column, T.DataType, Frame], Column]


def _number(col: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(col), col) if isinstance(kind, (T.DoubleType, T.FloatType)) else col


def _truthy(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        test = col
    elif isinstance(kind, T.NumericType):
        test = col != 0
    elif isinstance(kind, T.StringType):
        test = F.length(col) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        test = F.size(col) > 0
    else:
        test = col.isNotNull()
    return F.coalesce(test, F.lit(False))


def _percentile(p: float) -> Builder:
    return lambda c, k, f: f.run(F.percentile(_number(c, k), F.lit(p)))


def _sum(c: Column, k: T.DataType, f: Frame) -> Column:
    if isinstance(k, T.IntegralType) and f.over is not None:
        return F.coalesce(f.total(F.sum(c.cast("decimal(20,0)"))), F.lit(0)).cast("long")  # running totals may pass longs
    zero = F.lit(0) if isinstance(k, T.IntegralType) else F.lit(0.0)
    return F.coalesce(f.run(F.sum(_number(c, k))), zero)


def _first(c: Column, k: T.DataType, f: Frame) -> Column:
    if f.over is not None:
        return f.run(F.first(c, ignorenulls=True))
    return F.min_by(c, F.when(c.isNotNull(), f.order))


def _last(c: Column, k: T.DataType, f: Frame) -> Column:
    if f.over is not None:
        return f.run(F.last(c, ignorenulls=True))
    return F.max_by(c, F.when(c.isNotNull(), f.order))


def _listed(c: Column, f: Frame) -> Column:
    """Values, nulls too, in row order."""
    if f.over is not None:
        return F.transform(f.run(F.collect_list(F.struct(c.alias("v")))), lambda x: x["v"])
    return F.transform(F.array_sort(F.collect_list(F.struct(f.order.alias("o"), c.alias("v"))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: x["v"])


def _unique(c: Column, k: T.DataType, f: Frame) -> Column:
    """Distinct values in order, null last if there is one."""
    values = F.sort_array(f.run(F.collect_set(c)))
    empty = f.run(F.max(c.isNull()))
    return F.when(empty, F.concat(values, F.array(F.lit(None).cast(k)))).otherwise(values)


def _mode(c: Column, k: T.DataType, f: Frame) -> Column:
    """The most frequent value; of several the first to come."""
    values = F.filter(_listed(c, f), lambda x: x.isNotNull())
    seen = F.array_distinct(values)
    counted = F.transform(seen, lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast(k).alias("v")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return best["v"]


_REGISTRY: dict[str, Builder] = {
    "count": lambda c, k, f: f.total(F.count(F.lit(1))),
    "count_nonnull": lambda c, k, f: f.total(F.count(c)),
    "sum": _sum,
    "mean": lambda c, k, f: f.run(F.avg(_number(c, k))),
    "min": lambda c, k, f: f.run(F.min(_number(c, k))),
    "max": lambda c, k, f: f.run(F.max(_number(c, k))),
    "std": lambda c, k, f: f.run(F.stddev_pop(_number(c, k))),
    "var": lambda c, k, f: f.run(F.var_pop(_number(c, k))),
    "median": _percentile(0.5),
    "range": lambda c, k, f: f.run(F.max(_number(c, k))) - f.run(F.min(_number(c, k))),
    "iqr": lambda c, k, f: f.run(F.percentile(_number(c, k), F.lit(0.75))) - f.run(F.percentile(_number(c, k), F.lit(0.25))),
    "first": _first,
    "last": _last,
    "mode": _mode,
    "unique": _unique,
    "nunique": lambda c, k, f: f.run(F.count_distinct(c)) if f.over is None else F.size(f.run(F.collect_set(c))).cast("long"),
    "list": lambda c, k, f: _listed(c, f),
    "all": lambda c, k, f: F.coalesce(f.run(F.bool_and(_truthy(c, k))), F.lit(True)),
    "any": lambda c, k, f: F.coalesce(f.run(F.bool_or(_truthy(c, k))), F.lit(False)),
    "prod": lambda c, k, f: f.run(F.product(_number(c, k).cast("double"))),
}
_REGISTRY |= {"sum_": _REGISTRY["sum"], "mean_": _REGISTRY["mean"], "all_": _REGISTRY["all"], "any_": _REGISTRY["any"], "min_": _REGISTRY["min"], "max_": _REGISTRY["max"]}


def register(name: str, builder: Builder | None = None):
    """Add a named aggregate; with one argument a decorator."""
    if builder is None:
        return lambda b: register(name, b)
    _REGISTRY[name] = builder
    return builder


def names() -> list[str]:
    return sorted(_REGISTRY)


class Spec:
    """An aggregate of a field: built by name, or by `percentile` and `custom`."""

    def __init__(self, builder: Builder, field: str | None):
        self.builder, self.field = builder, field


def percentile(field: str, q: float, approximate: bool = False) -> Spec:
    """Linear percentile, q from 0 to 100; the approximate one merges sketches instead of values."""
    if approximate:
        return Spec(lambda c, k, f: f.run(F.percentile_approx(_number(c, k), q / 100, 10_000)), field)
    return Spec(_percentile(q / 100), field)


def custom(func: Callable[[list[dict[str, Any]]], Any], returns: str | T.DataType, *fields: str) -> Spec:
    """A Python function of a group's rows (dicts of `fields`, in row order if there is one), in Arrow batches: the slow path.

    A group comes to the function as one list, so it must fit a task's memory; use named
    aggregates or `register` a Column for groups of any size.
    """
    def build(c: Column, k: T.DataType, f: Frame) -> Column:
        row = F.struct(*[F.col(f"`{x}`") for x in fields])
        rows = f.run(F.collect_list(row)) if f.over is not None or f._order is None else _listed(row, f)
        return F.udf(lambda got: func([r.asDict(recursive=True) for r in got or []]), returns, useArrow=True)(rows)

    return Spec(build, None)


def resolve(spec: Any, alias: str) -> Spec | Column:
    """A spec: Column, Spec, "name" (of the alias's own field), or (name, field)."""
    if isinstance(spec, (Spec, Column)):
        return spec
    if isinstance(spec, str):
        name, field = spec, None if spec == "count" else alias
    elif isinstance(spec, tuple) and len(spec) == 2 and isinstance(spec[0], str):
        name, field = spec
    elif isinstance(spec, tuple) and len(spec) == 2 and callable(spec[0]):
        return Spec(spec[0], spec[1])
    else:
        raise ValueError(f"cannot read the aggregate {spec!r} of {alias}")
    if name not in _REGISTRY:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join(names())}")
    return Spec(_REGISTRY[name], field)
