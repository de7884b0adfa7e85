"""Predicates over documents and their compilation to Spark columns.

A predicate is either true or false: a missing field (NULL) never makes it unknown.
``Ne`` holds for a missing field and ``Not`` is the plain complement.  In positive
position the bare comparison is emitted, as a filter drops NULL like false and only bare
comparisons reach the Parquet scan; beneath ``Not`` the result is made two-valued first.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Expr:
    """Base of all predicates; ``&``, ``|`` and ``~`` combine them."""

    def __and__(self, other: Expr) -> Expr:
        return And(self, other)

    def __or__(self, other: Expr) -> Expr:
        return Or(self, other)

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class Compare(Expr):
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Between(Expr):
    field: str
    low: Any
    high: Any


@dataclass(frozen=True)
class In(Expr):
    field: str
    values: tuple


@dataclass(frozen=True)
class Text(Expr):
    """contains, starts_with, ends_with and equal_fold on a string field."""

    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Presence(Expr):
    field: str
    present: bool


@dataclass(frozen=True)
class OfArray(Expr):
    """contains a value, any / all of the values, or has a size."""

    field: str
    op: str
    value: Any


@dataclass(frozen=True, init=False)
class And(Expr):
    parts: tuple[Expr, ...]

    def __init__(self, *parts: Expr) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True, init=False)
class Or(Expr):
    parts: tuple[Expr, ...]

    def __init__(self, *parts: Expr) -> None:
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Not(Expr):
    part: Expr


def eq(field: str, value: Any) -> Expr:
    return Compare(field, "eq", value)


def ne(field: str, value: Any) -> Expr:
    return Compare(field, "ne", value)


def gt(field: str, value: Any) -> Expr:
    return Compare(field, "gt", value)


def gte(field: str, value: Any) -> Expr:
    return Compare(field, "gte", value)


def lt(field: str, value: Any) -> Expr:
    return Compare(field, "lt", value)


def lte(field: str, value: Any) -> Expr:
    return Compare(field, "lte", value)


def between(field: str, low: Any, high: Any) -> Expr:
    return Between(field, low, high)


def in_(field: str, *values: Any) -> Expr:
    return In(field, values)


def not_in(field: str, *values: Any) -> Expr:
    return Not(In(field, values))


def contains(field: str, value: str) -> Expr:
    return Text(field, "contains", value)


def starts_with(field: str, value: str) -> Expr:
    return Text(field, "starts_with", value)


def ends_with(field: str, value: str) -> Expr:
    return Text(field, "ends_with", value)


def equal_fold(field: str, value: str) -> Expr:
    return Text(field, "equal_fold", value)


def exists(field: str) -> Expr:
    return Presence(field, True)


def missing(field: str) -> Expr:
    return Presence(field, False)


def array_contains(field: str, value: Any) -> Expr:
    return OfArray(field, "contains", value)


def array_any(field: str, *values: Any) -> Expr:
    return OfArray(field, "any", values)


def array_all(field: str, *values: Any) -> Expr:
    return OfArray(field, "all", values)


def array_size(field: str, size: int) -> Expr:
    return OfArray(field, "size", size)


def _kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.datetime, dt.date)):
        return "time"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    return "other"


def _column_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.BinaryType):
        return "bytes"
    return "other"


def _comparable(t: T.DataType, value: Any) -> bool:
    kinds = _column_kind(t), _kind(value)
    # a time may be given as its text
    return kinds[0] == kinds[1] or kinds == ("time", "string") or kinds[0] == "other"


_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


def compile_expr(expr: Expr, schema: T.StructType) -> Column:
    """A column that is true exactly where ``expr`` holds; elsewhere it is false or NULL."""
    match expr:
        case And(parts):
            return reduce(lambda a, b: a & b, (compile_expr(p, schema) for p in parts)) if parts else F.lit(True)
        case Or(parts):
            return reduce(lambda a, b: a | b, (compile_expr(p, schema) for p in parts)) if parts else F.lit(False)
        case Not(Presence(field, present)):
            return compile_expr(Presence(field, not present), schema)
        case Not(Compare(field, "eq", value)):
            return compile_expr(Compare(field, "ne", value), schema)
        case Not(part):
            return ~F.coalesce(compile_expr(part, schema), F.lit(False))
    if expr.field not in schema.names:
        # a field that no document has is missing in all of them
        holds = expr == Presence(expr.field, False) or isinstance(expr, Compare) and ((expr.op == "ne") != (expr.value is None)) and expr.op in ("eq", "ne")
        return F.lit(bool(holds))
    c, t = F.col(f"`{expr.field}`"), schema[expr.field].dataType
    match expr:
        case Presence(_, present):
            return c.isNotNull() if present else c.isNull()
        case Compare(_, "eq", None):
            return c.isNull()
        case Compare(_, "ne", None):
            return c.isNotNull()
        case Compare(_, op, None):
            raise ValueError(f"{op} needs a value")
        case Compare(_, "ne", value):
            return ~c.eqNullSafe(F.lit(value)) if _comparable(t, value) else F.lit(True)
        case Compare(_, op, value):
            return _OPS[op](c, F.lit(value)) if _comparable(t, value) else F.lit(False)
        case Between(_, low, high):
            if low is None or high is None:
                raise ValueError("between needs two values")
            return (c >= F.lit(low)) & (c <= F.lit(high)) if _comparable(t, low) and _comparable(t, high) else F.lit(False)
        case In(_, values):
            known = [v for v in values if v is not None and _comparable(t, v)]
            found = c.isin(*known) if known else F.lit(False)
            return found | c.isNull() if None in values else found
        case Text(_, op, value):
            if not isinstance(t, T.StringType):
                return F.lit(False)
            return {"contains": lambda: c.contains(value), "starts_with": lambda: c.startswith(value), "ends_with": lambda: c.endswith(value), "equal_fold": lambda: F.lower(c) == value.lower()}[op]()
        case OfArray(_, op, value):
            if not isinstance(t, T.ArrayType):
                return F.lit(False)
            if op == "contains":
                return F.array_contains(c, value)
            if op == "size":
                return F.size(c) == value
            if not value:
                return F.lit(op == "all") & c.isNotNull()
            held = [F.array_contains(c, v) for v in value]
            return reduce((lambda a, b: a | b) if op == "any" else (lambda a, b: a & b), held)
    raise TypeError(f"not a predicate: {expr!r}")


#: What the JSON endpoints accept as filter operators.
JSON_OPS = {
    "eq": eq, "ne": ne, "gt": gt, "gte": gte, "lt": lt, "lte": lte, "contains": contains, "startsWith": starts_with, "endsWith": ends_with, "in": lambda f, v: in_(f, *v), "between": lambda f, v: between(f, *v),
}


def from_json(filters: list[dict[str, Any]]) -> Expr:
    """The conjunction of [{field, op, value}, ...]; an unknown operator is an error."""
    parts = []
    for f in filters:
        if f.get("op") not in JSON_OPS:
            raise ValueError(f"unknown filter operator: {f.get('op')!r}")
        parts.append(JSON_OPS[f["op"]](f["field"], f.get("value")))
    return And(*parts)
