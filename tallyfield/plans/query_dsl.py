"""A small query language: text to a predicate, by way of Python's own parser.

`age > 18 and team.name in ['A', 'B']`, chained comparisons, `is None`, `not`, `len(x)`,
`.lower()` and `.upper()` in comparisons, `.contains/.startswith/.endswith`, `.regex` and
`.match` (both search), `date(...)` and `datetime(...)`, and `@name` for a parameter.  Only
listed syntax is read; nothing is evaluated.
"""

from __future__ import annotations

import ast
import datetime as dt
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.functions import predicates as P
from tallyfield.functions.paths import resolve

_PARAMETER = "_given_"
_FLIP = {ast.Lt: ast.Gt, ast.Gt: ast.Lt, ast.LtE: ast.GtE, ast.GtE: ast.LtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq}
_BUILD = {ast.Eq: P.where_equals, ast.NotEq: P.where_not_equals, ast.Lt: P.where_lt, ast.LtE: P.where_lte, ast.Gt: P.where_gt, ast.GtE: P.where_gte}
_FLAGS = {"IGNORECASE": re.I, "I": re.I, "MULTILINE": re.M, "M": re.M, "DOTALL": re.S, "S": re.S, "VERBOSE": re.X, "X": re.X}


def parse(text: str, params: Mapping[str, Any] | None = None) -> P.Predicate:
    """The predicate of a query; ValueError for what the language does not have."""
    spoken = _parameters(text)
    try:
        tree = ast.parse(spoken.strip(), mode="eval")
    except SyntaxError as error:
        raise ValueError(f"cannot read the query {text!r}: {error.msg}") from error
    return _Reader(dict(params or {})).predicate(tree.body)


def _parameters(text: str) -> str:
    """@name outside of quotes as a plain name."""
    quoted = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    return re.sub(rf"({quoted})|@([A-Za-z_]\w*)", lambda m: m[1] or _PARAMETER + m[2], text)


class _Reader:
    def __init__(self, params: dict[str, Any]):
        self.params = params

    def predicate(self, node: ast.expr) -> P.Predicate:
        match node:
            case ast.BoolOp(op=op, values=values):
                parts = [self.predicate(v) for v in values]
                return P.and_(*parts) if isinstance(op, ast.And) else P.or_(*parts)
            case ast.UnaryOp(op=ast.Not(), operand=inner):
                return ~self.predicate(inner)
            case ast.Compare():
                return self._comparison(node)
            case ast.Call(func=ast.Attribute(value=owner, attr=name), args=args):
                return self._method(owner, name, args)
            case ast.Constant(value=bool(v)):
                return P.Predicate(lambda s: F.lit(v), str(v))
            case ast.Name() | ast.Attribute() if self._is_field(node):
                field = self._field(node)
                return P.where_equals(field, True)
        raise ValueError(f"not a condition: {ast.unparse(node)}")

    def _comparison(self, node: ast.Compare) -> P.Predicate:
        sides = [node.left, *node.comparators]
        parts = [self._pair(a, op, b) for a, op, b in zip(sides, node.ops, sides[1:], strict=False)]
        return P.and_(*parts)

    def _pair(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> P.Predicate:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Constant) and right.value is None):
                raise ValueError("`is` takes None only")
            field = self._field(left)
            return P.where_is_null(field) if isinstance(op, ast.Is) else P.where_exists(field)
        if isinstance(op, (ast.In, ast.NotIn)):
            values = self._value(right)
            if not isinstance(values, (list, tuple, set)):
                raise ValueError("`in` takes a list or a tuple")
            found = self._applied(left, lambda f: P.where_in(f, values), lambda c: F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False)))
            return ~found if isinstance(op, ast.NotIn) else found
        if type(op) not in _BUILD:
            raise ValueError(f"unknown comparison in {ast.unparse(left)}")
        kind = type(op)
        if not self._is_operand(left):
            if not self._is_operand(right):
                raise ValueError("a comparison needs a field")
            left, right, kind = right, left, _FLIP[kind]
        elif self._is_operand(right):
            raise ValueError("two fields cannot be compared")
        value = self._value(right)
        return self._applied(left, lambda f: _BUILD[kind](f, value), lambda c: self._column_compare(c, kind, value))

    @staticmethod
    def _column_compare(col: Column, kind: type, value: Any) -> Column:
        if kind is ast.Eq:
            return col.eqNullSafe(F.lit(value))
        if kind is ast.NotEq:
            return ~col.eqNullSafe(F.lit(value))
        out = {ast.Lt: col < value, ast.LtE: col <= value, ast.Gt: col > value, ast.GtE: col >= value}[kind]
        return F.coalesce(out, F.lit(False))

    def _applied(self, node: ast.expr, plain, by_column) -> P.Predicate:
        """A test of a field, or of len(), .lower() or .upper() of one."""
        if self._is_field(node):
            return plain(self._field(node))
        derive, field = self._derived(node)

        def build(schema: T.StructType) -> Column:
            found = resolve(schema, field)
            return by_column(derive(*found) if found else F.lit(None))

        return P.Predicate(build, ast.unparse(node))

    def _derived(self, node: ast.expr):
        match node:
            case ast.Call(func=ast.Name(id="len"), args=[inner]) if self._is_field(inner):
                return (lambda c, kind: F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c.cast("string"))), self._field(inner)
            case ast.Call(func=ast.Attribute(value=inner, attr="lower"), args=[]) if self._is_field(inner):
                return (lambda c, kind: F.lower(c.cast("string"))), self._field(inner)
            case ast.Call(func=ast.Attribute(value=inner, attr="upper"), args=[]) if self._is_field(inner):
                return (lambda c, kind: F.upper(c.cast("string"))), self._field(inner)
        raise ValueError(f"not a field: {ast.unparse(node)}")

    def _method(self, owner: ast.expr, name: str, args: list[ast.expr]) -> P.Predicate:
        if name in ("regex", "match"):
            if not 1 <= len(args) <= 2:
                raise ValueError(f".{name} takes a pattern and flags")
            return P.where_regex_match(self._field(owner), self._value(args[0]), self._flags(args[1]) if len(args) > 1 else 0)
        tests = {"contains": lambda c, v: c.contains(v), "startswith": lambda c, v: c.startswith(v), "endswith": lambda c, v: c.endswith(v)}
        if name not in tests or len(args) != 1:
            raise ValueError(f"unknown method .{name}")
        value = self._value(args[0])
        plain = {"contains": P.where_contains, "startswith": P.where_startswith, "endswith": P.where_endswith}[name]
        return self._applied(owner, lambda f: plain(f, value), lambda c: tests[name](F.coalesce(c, F.lit("")), value))

    def _flags(self, node: ast.expr) -> int:
        match node:
            case ast.BinOp(left=a, op=ast.BitOr(), right=b):
                return self._flags(a) | self._flags(b)
            case ast.Attribute(value=ast.Name(id="re"), attr=name) if name in _FLAGS:
                return int(_FLAGS[name])
        return int(self._value(node))

    def _is_field(self, node: ast.expr) -> bool:
        while isinstance(node, ast.Attribute):
            node = node.value
        return isinstance(node, ast.Name) and not node.id.startswith(_PARAMETER) and node.id != "re"

    def _is_operand(self, node: ast.expr) -> bool:
        if self._is_field(node):
            return True
        try:
            self._derived(node)
        except ValueError:
            return False
        return True

    def _field(self, node: ast.expr) -> str:
        if not self._is_field(node):
            raise ValueError(f"not a field: {ast.unparse(node)}")
        return ast.unparse(node)

    def _value(self, node: ast.expr) -> Any:
        match node:
            case ast.Constant(value=v):
                return v
            case ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items):
                return [self._value(x) for x in items]
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -self._value(inner)
            case ast.Name(id=name) if name.startswith(_PARAMETER):
                key = name.removeprefix(_PARAMETER)
                if key not in self.params:
                    raise ValueError(f"no parameter @{key}")
                return self.params[key]
            case ast.Call(func=ast.Name(id="datetime"), args=args):
                return dt.datetime(*[self._value(a) for a in args])
            case ast.Call(func=ast.Name(id="date"), args=args):
                return dt.date(*[self._value(a) for a in args])
        raise ValueError(f"not a value: {ast.unparse(node)}")
