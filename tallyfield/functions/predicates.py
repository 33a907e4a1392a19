"""Row predicates with two-valued logic: a comparison with null is false, never unknown.

A predicate is turned into a boolean column for the schema it is applied to.  As a value it
is never null.  As a filter it is stated in plain comparisons, which scans can take over: a
row goes where a comparison is unknown, and a negation is moved inwards to the comparisons,
each of which is stated as "null, or not so".
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions.paths import resolve


Build = Callable[[T.StructType], Column]


class Predicate:
    """build: a boolean column that is never null; where and unless: filters for it and for its negation."""

    def __init__(self, build: Build, text: str = "predicate", where: Build | None = None, unless: Build | None = None):
        self.build, self.text = build, text
        self.where = where or build
        self.unless = unless or (lambda s: ~build(s))

    def __call__(self, df: DataFrame) -> Column:
        return self.build(df.schema)

    def filter(self, df: DataFrame) -> Column:
        """The condition for `df.filter`."""
        return self.where(df.schema)

    def __and__(self, other: Predicate) -> Predicate:
        o = as_predicate(other)
        return Predicate(lambda s: self.build(s) & o.build(s), f"({self.text} and {o.text})", lambda s: self.where(s) & o.where(s), lambda s: self.unless(s) | o.unless(s))

    def __or__(self, other: Predicate) -> Predicate:
        o = as_predicate(other)
        return Predicate(lambda s: self.build(s) | o.build(s), f"({self.text} or {o.text})", lambda s: self.where(s) | o.where(s), lambda s: self.unless(s) & o.unless(s))

    def __invert__(self) -> Predicate:
        return Predicate(lambda s: ~self.build(s), f"not {self.text}", self.unless, self.where)

    def __repr__(self) -> str:
        return self.text


def as_predicate(x: Predicate | Column) -> Predicate:
    """A predicate, or a boolean column whose nulls are false."""
    if isinstance(x, Predicate):
        return x
    if isinstance(x, Column):
        return Predicate(lambda s: F.coalesce(x, F.lit(False)), str(x), lambda s: x)
    raise TypeError(f"{type(x).__name__} is neither a predicate nor a column")


def _atom(text: str, test: Callable[[T.StructType], tuple[Column, Column] | Column]) -> Predicate:
    """A predicate of (field, plain test of it that is null for null), or of a column that is never null."""

    def build(schema: T.StructType) -> Column:
        got = test(schema)
        return _never(got[1]) if isinstance(got, tuple) else got

    def where(schema: T.StructType) -> Column:
        got = test(schema)
        return got[1] if isinstance(got, tuple) else got

    def unless(schema: T.StructType) -> Column:
        got = test(schema)
        return got[0].isNull() | ~got[1] if isinstance(got, tuple) else ~got

    return Predicate(build, text, where, unless)


def _never(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _at(schema: T.StructType, field: str) -> tuple[Column, T.DataType]:
    return resolve(schema, field) or (F.lit(None), T.NullType())


def _plain(field: str, kind: T.DataType) -> None:
    if isinstance(kind, (T.StructType, T.MapType)) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        raise TypeError(f"{field} is nested; name one of its fields")


def _family(kind: T.DataType) -> str:
    for name, classes in (("number", T.NumericType), ("text", T.StringType), ("time", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("bool", T.BooleanType)):
        if isinstance(kind, classes):
            return name
    return "any"


def _value_family(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "time" if isinstance(value, (dt.date, dt.datetime)) else "any"


def where_equals(field: str, value: Any) -> Predicate:
    def build(schema: T.StructType) -> tuple[Column, Column] | Column:
        col, kind = _at(schema, field)
        _plain(field, kind)
        if value is None:
            return col.isNull()
        if isinstance(kind, T.ArrayType):
            wanted = list(value) if isinstance(value, (list, tuple)) else None
            return F.lit(False) if wanted is None else _never(col == F.array(*[F.lit(v) for v in wanted]).cast(kind))
        if "any" not in (_family(kind), _value_family(value)) and _family(kind) != _value_family(value):
            return F.lit(False)
        return col, col == F.lit(value)

    return _atom(f"{field} == {value!r}", build)


def where_not_equals(field: str, value: Any) -> Predicate:
    """Null is unequal to any value."""
    out = ~where_equals(field, value)
    out.text = f"{field} != {value!r}"
    return out


def where_in(field: str, values: Iterable[Any]) -> Predicate:
    """The value is one of `values`; an array shares one with them."""
    wanted = list(values)

    def build(schema: T.StructType) -> tuple[Column, Column] | Column:
        col, kind = _at(schema, field)
        some = [v for v in wanted if v is not None]
        if isinstance(kind, T.ArrayType):
            return _never(F.arrays_overlap(col, F.array(*[F.lit(v) for v in some]).cast(kind))) if some else F.lit(False)
        own = _family(kind)
        fits = [v for v in some if "any" in (own, _value_family(v)) or own == _value_family(v)]
        if not fits or isinstance(kind, T.NullType):
            return col.isNull() if None in wanted else F.lit(False)
        return _never(col.isin(fits)) | col.isNull() if None in wanted else (col, col.isin(fits))

    return _atom(f"{field} in {wanted!r}", build)


def where_not_in(field: str, values: Iterable[Any]) -> Predicate:
    """Null passes, unless None is one of `values`."""
    return ~where_in(field, list(values))


def _compare(field: str, value: Any, op: str, compare: Callable[[Column, Column], Column]) -> Predicate:
    def build(schema: T.StructType) -> tuple[Column, Column] | Column:
        col, kind = _at(schema, field)
        if isinstance(kind, T.NullType) or value is None:
            return F.lit(False)
        a, b = _family(kind), _value_family(value)
        if a != b:
            raise TypeError(f"{field} ({kind.simpleString()}) cannot be compared with {value!r}")
        return col, compare(col, F.lit(value))

    return _atom(f"{field} {op} {value!r}", build)


def where_gt(field: str, value: Any) -> Predicate:
    return _compare(field, value, ">", lambda a, b: a > b)


def where_gte(field: str, value: Any) -> Predicate:
    return _compare(field, value, ">=", lambda a, b: a >= b)


def where_lt(field: str, value: Any) -> Predicate:
    return _compare(field, value, "<", lambda a, b: a < b)


def where_lte(field: str, value: Any) -> Predicate:
    return _compare(field, value, "<=", lambda a, b: a <= b)


def _text(field: str, name: str, part: str, test: Callable[[Column], Column]) -> Predicate:
    """A test of the value as text; null is the empty text, which holds nothing but the empty part."""

    def build(schema: T.StructType) -> tuple[Column, Column] | Column:
        if part == "":
            return F.lit(True)
        col = _at(schema, field)[0].cast("string")
        return col, test(col)

    return _atom(f"{field}.{name}({part!r})", build)


def where_contains(field: str, part: str) -> Predicate:
    return _text(field, "contains", part, lambda c: c.contains(part))


def where_startswith(field: str, part: str) -> Predicate:
    return _text(field, "startswith", part, lambda c: c.startswith(part))


def where_endswith(field: str, part: str) -> Predicate:
    return _text(field, "endswith", part, lambda c: c.endswith(part))


def where_regex_match(field: str, pattern: str, flags: int = 0) -> Predicate:
    """The pattern is found anywhere in the value as text; null has none.  A wrong pattern raises here."""
    re.compile(pattern, flags)
    inline = "".join(c for f, c in ((re.I, "i"), (re.M, "m"), (re.S, "s"), (re.X, "x")) if flags & f)
    java = f"(?{inline}){pattern}" if inline else pattern

    def build(schema: T.StructType) -> tuple[Column, Column]:
        col = _at(schema, field)[0].cast("string")
        return col, col.rlike(java)

    return _atom(f"{field} ~ {pattern!r}", build)


def where_exists(field: str) -> Predicate:
    return Predicate(lambda s: _at(s, field)[0].isNotNull(), f"{field} is not None")


where_not_none = where_exists


def where_is_null(field: str) -> Predicate:
    return Predicate(lambda s: _at(s, field)[0].isNull(), f"{field} is None")


where_none = where_is_null


def where_coded_event(names: str | Iterable[str], codes: Mapping[str, int], field: str = "typeId") -> Predicate:
    """The event's code is that of one of the names, whatever their case; `codes` maps names to numbers."""
    known = {k.lower(): v for k, v in codes.items()}
    wanted = [names] if isinstance(names, str) else list(names)
    missing = [n for n in wanted if n.lower() not in known]
    if missing:
        raise ValueError(f"unknown event names {missing}")
    return where_in(field, [known[n.lower()] for n in wanted])


def where_qualifier(name: str, codes: Mapping[str, int], value: Any = None, field: str = "qualifier", id_field: str = "qualifierId", value_field: str = "value") -> Predicate:
    """One of the event's qualifiers has the name's code and, if given, the value."""
    known = {k.lower(): v for k, v in codes.items()}
    if name.lower() not in known:
        raise ValueError(f"unknown qualifier {name!r}")

    def build(schema: T.StructType) -> Column:
        col, kind = _at(schema, field)
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return F.lit(False)

        def test(q: Column) -> Column:
            same = q[id_field].cast("long") == known[name.lower()]
            return same if value is None else same & (q[value_field].cast("string") == str(value))

        return _never(F.exists(col, lambda q: F.coalesce(test(q), F.lit(False))))

    return Predicate(build, f"qualifier {name!r}")


def and_(*preds: Predicate) -> Predicate:
    out = as_predicate(preds[0])
    for p in preds[1:]:
        out = out & p
    return out


def or_(*preds: Predicate) -> Predicate:
    out = as_predicate(preds[0])
    for p in preds[1:]:
        out = out | p
    return out


def not_(pred: Predicate) -> Predicate:
    return ~as_predicate(pred)
