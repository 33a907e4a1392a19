"""Running, rolling and bucketed summaries within groups."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W, WindowSpec

from tallyfield.functions.aggregates import Frame, Spec, resolve as resolve_spec
from tallyfield.functions.paths import get_field, resolve

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def seconds_of(window: str | float | int) -> float:
    """'90s', '5m', '1.5h', '2d' or a number, in seconds."""
    if isinstance(window, (int, float)):
        return float(window)
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([smhd])\s*", window)
    if not m:
        raise ValueError(f"cannot read the window {window!r}: a number and one of s, m, h, d")
    return float(m[1]) * _UNITS[m[2]]


def instant_micros(df: DataFrame, path: str) -> Column:
    """A time, an interval or a number of seconds as whole microseconds."""
    found = resolve(df.schema, path)
    if found is None:
        raise ValueError(f"no column {path}")
    col, kind = found
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(kind, T.DayTimeIntervalType):
        return F.unix_micros(F.timestamp_seconds(F.lit(0)) + col)
    if isinstance(kind, T.NumericType):
        return F.round(col.cast("double") * 1_000_000).cast("long")
    raise TypeError(f"{path} ({kind.simpleString()}) is no time")


def aggregate_columns(df: DataFrame, aggregators: Mapping[str, Any], frame: Frame) -> dict[str, Column]:
    """Aggregate columns by alias."""
    out = {}
    for alias, spec in aggregators.items():
        got = resolve_spec(spec, alias)
        if isinstance(got, Column):
            out[alias] = frame.run(got)
            continue
        assert isinstance(got, Spec)
        if got.field is None:
            col, kind = F.lit(1), T.IntegerType()
        else:
            found = resolve(df.schema, got.field)
            col, kind = found if found else (F.lit(None).cast("double"), T.DoubleType())
        out[alias] = got.builder(col, kind, frame)
    return out


def cumulative(df: DataFrame, keys: Sequence[str], field: str, order: Sequence[Column], alias: str | None = None) -> DataFrame:
    """Running sum of a field in row order; null counts 0."""
    found = resolve(df.schema, field)
    zero = F.lit(0)
    value = F.coalesce(found[0], zero) if found else zero
    w = W.partitionBy(*[get_field(df, k) for k in keys]).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(alias or f"cumulative_{field}", F.sum(value).over(w))


class _Span(Frame):
    """A frame of time: counts and exact sums are what was up to a row less what was before its frame, so their time does not grow with the frame's rows."""

    def __init__(self, over: WindowSpec, upto: WindowSpec, before: WindowSpec):
        super().__init__(over)
        self._upto, self._before = upto, before

    def total(self, agg: Column) -> Column:
        return F.coalesce(agg.over(self._upto), F.lit(0)) - F.coalesce(agg.over(self._before), F.lit(0))


def rolling(df: DataFrame, keys: Sequence[str], window: int | str, aggregators: Mapping[str, Any], order: Sequence[Column], time_field: str | None = None, min_periods: int = 1, step: int | None = None) -> DataFrame:
    """Aggregates over the last `window` rows, or the last time span, of each group.

    A time frame is [t - span, t] and sees of rows at the same instant only those that come
    before in row order.  For that, frames range over twice the instant, and the row's place
    among its peers in decimals (below 1 for up to ten thousand million peers).  Counts and sums of whole
    numbers are differences of running totals; other aggregates go over each frame's rows anew.  Rows come out where the frame has min_periods rows and,
    with a step, at every step-th row of the group.
    """
    parts = [get_field(df, k) for k in keys]
    if isinstance(window, int) and time_field is None:
        if window < 1:
            raise ValueError("a window has at least one row")
        ordered = W.partitionBy(*parts).orderBy(*order)
        frame = Frame(ordered.rowsBetween(-(window - 1), 0))
    else:
        if time_field is None:
            raise ValueError("a time window needs a time_field")
        span = round(seconds_of(window) * 1_000_000)
        at = instant_micros(df, time_field)
        df = df.filter(at.isNotNull())
        peers = W.partitionBy(*parts, at).orderBy(*order)
        place = (F.row_number().over(peers) - 1).cast("decimal(12,0)") * F.lit("0.0000000001").cast("decimal(10,10)")
        df = df.withColumn("__at", ((at * 2).cast("decimal(20,0)") + place).cast("decimal(32,10)"))
        ordered = W.partitionBy(*parts).orderBy("__at")
        frame = _Span(ordered.rangeBetween(-(2 * span + 1), 0), ordered.rowsBetween(W.unboundedPreceding, 0), ordered.rangeBetween(W.unboundedPreceding, -(2 * span + 1)))
    out = df.withColumns(aggregate_columns(df, aggregators, frame) | {"__n": frame.total(F.count(F.lit(1))), "__i": F.row_number().over(ordered)})
    out = out.filter(F.col("__n") >= min_periods)
    if step:
        out = out.filter((F.col("__i") - 1) % step == 0)
    return out.drop("__n", "__i", "__at")


def time_bucket(df: DataFrame, keys: Sequence[str], freq: str | float | int, aggregators: Mapping[str, Any], time_field: str, order: Column, label: str = "left", bucket_name: str = "bucket") -> DataFrame:
    """Bins of fixed width from each group's own origin, its first time in row order.

    Intervals start at 0 and plain numbers with a plain width are cut at its multiples.
    Null times are dropped and empty bins are absent.  The origin is one aggregation, joined
    back on the keys.
    """
    if label not in ("left", "right"):
        raise ValueError("label is left or right")
    found = resolve(df.schema, time_field)
    if found is None:
        raise ValueError(f"no column {time_field}")
    col, kind = found
    named = df.select("*", *[get_field(df, k).alias(f"__k{i}") for i, k in enumerate(keys)]).filter(col.isNotNull())
    group = [f"__k{i}" for i in range(len(keys))]
    if isinstance(kind, T.NumericType):
        size = float(freq) if isinstance(freq, (int, float)) else seconds_of(freq)
        bins = named.withColumn("__bin", F.floor(col / F.lit(size)))
        start, width = F.col("__bin") * F.lit(size), F.lit(size)
        named = bins
    else:
        size = round(seconds_of(freq) * 1_000_000)
        named = named.withColumn("__us", instant_micros(df, time_field))
        if isinstance(kind, T.DayTimeIntervalType):
            named = named.withColumn("__origin", F.lit(0).cast("long"))
        else:
            origin = named.groupBy(*group).agg(F.min_by("__us", order).alias("__origin"))
            condition = None
            o = origin.select(*[F.col(g).alias(f"{g}_o") for g in group], "__origin")
            for g in group:
                same = named[g].eqNullSafe(o[f"{g}_o"])
                condition = same if condition is None else condition & same
            named = named.join(o, condition) if group else named.crossJoin(F.broadcast(o))
        named = named.withColumn("__bin", F.floor((F.col("__us") - F.col("__origin")) / F.lit(size)))
        width = None
        named = named.withColumn("__start", F.col("__origin") + F.col("__bin") * F.lit(size))
    aggs = aggregate_columns(named, aggregators, Frame(order=order))
    if width is not None:
        out = named.groupBy(*group, "__bin").agg(*[v.alias(k) for k, v in aggs.items()])
        bucket = start + (width if label == "right" else F.lit(0.0))
    else:
        out = named.groupBy(*group, "__start").agg(*[v.alias(k) for k, v in aggs.items()])
        moment = F.timestamp_micros(F.col("__start") + F.lit(size if label == "right" else 0))
        bucket = moment.cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else moment - F.timestamp_seconds(F.lit(0))
    return out.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], bucket.alias(bucket_name), *[F.col(f"`{a}`") for a in aggs])
