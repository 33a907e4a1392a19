"""Rows of Python dicts as a DataFrame with one schema for all of them."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyfield.functions.paths import unify_types


def infer(value: Any) -> T.DataType:
    """The type of a value; dicts are structs."""
    match value:
        case None:
            return T.NullType()
        case bool():
            return T.BooleanType()
        case int():
            return T.LongType()
        case float():
            return T.DoubleType()
        case dt.datetime():
            return T.TimestampType() if value.tzinfo else T.TimestampNTZType()
        case dt.date():
            return T.DateType()
        case dt.timedelta():
            return T.DayTimeIntervalType()
        case decimal.Decimal():
            return T.DecimalType(38, 18)
        case bytes():
            return T.BinaryType()
        case Mapping():
            return T.StructType([T.StructField(str(k), infer(v)) for k, v in value.items()])
        case list() | tuple() | set():
            kind: T.DataType = T.NullType()
            for v in value:
                kind = merge(kind, infer(v))
            return T.ArrayType(kind)
    return T.StringType()


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = dict.fromkeys([*a.fieldNames(), *b.fieldNames()])
        return T.StructType([T.StructField(n, merge(*(s[n].dataType if n in s.fieldNames() else T.NullType() for s in (a, b)))) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    return unify_types(a, b)


def _settled(kind: T.DataType) -> T.DataType:
    """Null types as strings, so rows can be written anywhere."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    return kind


def _fitted(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_fitted(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, Mapping) else None
    if isinstance(kind, T.ArrayType):
        return [_fitted(v, kind.elementType) for v in value] if isinstance(value, (list, tuple, set)) else None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value)
    return value


def frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None, ordinal: str | None = None) -> DataFrame:
    """A DataFrame of dicts; numbers of two kinds become doubles and other mixtures text."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if schema is None:
        kind: T.DataType = T.StructType([])
        for r in rows:
            kind = merge(kind, infer(r))
        schema = _settled(kind)
    data = [_fitted(r, schema) for r in rows]
    if ordinal:
        schema = T.StructType([*schema.fields, T.StructField(ordinal, T.LongType())])
        data = [(*d, i) for i, d in enumerate(data)]
    return spark.createDataFrame(data, schema)
