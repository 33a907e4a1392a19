"""Dotted paths into nested rows, as columns.

A path names a top-level column as it stands, else it walks structs by field name, maps by
key and arrays by number (negative numbers count from the end).  What is not there is null.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """(column, type) of a path, or None where the schema has no such place."""
    names = schema.fieldNames()
    if path in names:
        return F.col(f"`{path}`"), schema[path].dataType
    parts = path.split(".")
    for size in range(len(parts) - 1, 0, -1):  # the longest column name that the path starts with
        head = ".".join(parts[:size])
        if head in names:
            return _walk(F.col(f"`{head}`"), schema[head].dataType, parts[size:])
    return None


def _walk(col: Column, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
    for part in parts:
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                return None
            col, kind = col.getField(part), kind[part].dataType
        elif isinstance(kind, T.ArrayType) and part.lstrip("-").isdigit():
            k = int(part)
            col, kind = F.try_element_at(col, F.lit(k + 1 if k >= 0 else k)), kind.elementType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(part).cast(kind.keyType)), kind.valueType
        else:
            return None
    return col, kind


def get_field(df: DataFrame, path: str, default: Any = None) -> Column:
    """The value at a path; `default` where it is null or missing."""
    found = resolve(df.schema, path)
    value = found[0] if found else F.lit(None)
    return value if default is None else F.coalesce(value, F.lit(default))


def get_index(df: DataFrame, path: str, index: int, default: Any = None) -> Column:
    """One element of the array at a path; negative indexes count from the end."""
    value = F.try_element_at(get_field(df, path), F.lit(index + 1 if index >= 0 else index))
    return value if default is None else F.coalesce(value, F.lit(default))


def combine_fields(df: DataFrame, *paths: str, join_str: str = " ") -> Column:
    """The values as text with a separator between; nulls and other empty values leave it standing."""
    parts = []
    for path in paths:
        found = resolve(df.schema, path)
        if found is None:
            parts.append(F.lit(""))
            continue
        col, kind = found
        text = col.cast("string")
        if isinstance(kind, T.NumericType):  # zero is empty too
            text = F.when(col == 0, F.lit("")).otherwise(text)
        elif isinstance(kind, T.BooleanType):
            text = F.when(col, text).otherwise(F.lit(""))
        parts.append(F.coalesce(text, F.lit("")))
    return F.concat_ws(join_str, *parts)


def coalesce_paths(df: DataFrame, *paths: str, default: Any = None) -> Column:
    """The first value that is not null."""
    return F.coalesce(*[get_field(df, p) for p in paths], F.lit(default))


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with the value at a path; missing structs are made."""
    if path in df.columns or "." not in path:
        return df.withColumn(path, value)
    head, *rest = path.split(".")
    kind = df.schema[head].dataType if head in df.columns else None
    return df.withColumn(head, _placed(F.col(f"`{head}`") if kind is not None else None, kind, rest, value))


def _placed(col: Column | None, kind: T.DataType | None, parts: list[str], value: Column) -> Column:
    if not parts:
        return value
    name, *rest = parts
    if col is None or not isinstance(kind, T.StructType):
        return F.struct(_placed(None, None, rest, value).alias(name))
    inner = kind[name].dataType if name in kind.fieldNames() else None
    new = _placed(col.getField(name) if inner is not None else None, inner, rest, value)
    # withField keeps a null struct null, so a missing one is made first
    kept = F.when(col.isNull(), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])).otherwise(col)
    return kept.withField(name, new)


def delete_path(df: DataFrame, path: str) -> DataFrame:
    """df without a column or a nested field; nothing happens where there is none."""
    if path in df.columns:
        return df.drop(F.col(f"`{path}`"))
    head, _, rest = path.partition(".")
    if not rest or head not in df.columns or resolve(df.schema, path) is None or not isinstance(df.schema[head].dataType, T.StructType):
        return df
    if "." not in rest and df.schema[head].dataType.fieldNames() == [rest]:
        return df.drop(F.col(f"`{head}`"))  # Spark has no struct without fields
    return df.withColumn(head, F.col(f"`{head}`").dropFields(rest))


def leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted names and types of all values that are not structs."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, f"{prefix}{f.name}.")
        else:
            out.append((prefix + f.name, f.dataType))
    return out


def flatten(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Structs as dotted columns; arrays and maps stay."""
    def columns(schema: T.StructType, col, prefix: str) -> list[Column]:
        out = []
        for f in schema.fields:
            own = F.col(f"`{f.name}`") if col is None else col.getField(f.name)
            if isinstance(f.dataType, T.StructType) and f.name not in keep:
                out += columns(f.dataType, own, f"{prefix}{f.name}.")
            else:
                out.append(own.alias(prefix + f.name))
        return out

    return df.select(*columns(df.schema, None, ""))


def unify_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type for values of two types: itself, double for numbers, else string."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return T.StringType()
