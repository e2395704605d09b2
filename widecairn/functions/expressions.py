"""Compile expressions of the dialect to Columns, directed by the operands' types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError, ColumnNotFound, TypeMismatch
from ..plans.ast import Binary, Call, ColumnRef, Literal, Star, Unary
from ..plans.parser import AGGREGATES
from .types import BOOL, DATE, FLOAT, INT, NULL, OTHER, STRING, TIMESTAMP, as_text, parse_date, parse_timestamp


@dataclass(frozen=True)
class Typed:
    column: Column
    family: str
    literal: object = None  # the value, if the expression is a literal
    ntz: bool = False  # a time without a zone


class Scope:
    """Columns that an expression can name. ``special`` catches whole subexpressions first."""

    def __init__(self, columns: dict[str, Typed], names: tuple[str | None, ...] = (), special: Callable[[object], Typed | None] | None = None):
        self.columns, self.names, self.special = columns, names, special

    def resolve(self, ref: ColumnRef) -> Typed:
        if ref.table is not None and ref.table not in self.names:
            raise ColumnNotFound(f"unknown table {ref.table} in {ref.table}.{ref.name}")
        try:
            return self.columns[ref.name]
        except KeyError:
            raise ColumnNotFound(f"column {ref.name} not found") from None


def literal(v) -> Typed:
    if v is None:
        return Typed(F.lit(None), NULL)
    if isinstance(v, bool):
        return Typed(F.lit(v), BOOL, v)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise AnalysisError(f"number {v} is out of range")
        return Typed(F.lit(v).cast("bigint"), INT, v)
    if isinstance(v, float):
        return Typed(F.lit(v), FLOAT, v)
    return Typed(F.lit(v), STRING, v)


def compile_expr(e, scope: Scope) -> Typed:
    if scope.special and (found := scope.special(e)) is not None:
        return found
    if isinstance(e, Literal):
        return literal(e.value)
    if isinstance(e, ColumnRef):
        return scope.resolve(e)
    if isinstance(e, Unary):
        x = compile_expr(e.operand, scope)
        if e.op == "NOT":
            return Typed(~as_bool(x), BOOL)
        n = number(x, "-")
        return Typed(-n.column, n.family)
    if isinstance(e, Binary):
        if e.op in ("AND", "OR"):
            a, b = as_bool(compile_expr(e.left, scope)), as_bool(compile_expr(e.right, scope))
            return Typed(a & b if e.op == "AND" else a | b, BOOL)
        a, b = compile_expr(e.left, scope), compile_expr(e.right, scope)
        if e.op == "LIKE":
            return like(a, b)
        if e.op in "+-*/":
            return arithmetic(e.op, a, b)
        return compare(e.op, a, b)
    if isinstance(e, Call):
        if e.name in AGGREGATES:
            raise AnalysisError(f"aggregate {e} is not allowed here")
        raise AnalysisError(f"unknown function {e.name}")
    if isinstance(e, Star):
        raise AnalysisError("* is not allowed here")
    raise AnalysisError(f"unsupported expression {e}")


def as_bool(x: Typed) -> Column:
    """Truth of a value: numbers other than 0 and text that isn't empty are true; null stays null."""
    if x.family == BOOL:
        return x.column
    if x.family in (INT, FLOAT):
        return x.column != 0
    if x.family == STRING:
        return x.column != ""
    if x.family == NULL:
        return x.column.cast("boolean")
    if x.family in (DATE, TIMESTAMP):
        return F.when(x.column.isNotNull(), F.lit(True))
    raise TypeMismatch("type mismatch: no truth value")


def number(x: Typed, op: str) -> Typed:
    """BOOL counts as 0 or 1, a DATE as its days since 1970-01-01."""
    if x.family == INT:
        return Typed(x.column.cast("bigint"), INT, x.literal)
    if x.family == FLOAT:
        return Typed(x.column.cast("double"), FLOAT, x.literal)
    if x.family == BOOL:
        return Typed(x.column.cast("int").cast("bigint"), INT)
    if x.family == DATE:
        return Typed(F.unix_date(x.column).cast("bigint"), INT)
    if x.family == NULL:
        return Typed(x.column.cast("bigint"), NULL)
    raise TypeMismatch(f"type mismatch: {x.family} operand of {op}")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = number(a, op), number(b, op)
    family = FLOAT if FLOAT in (a.family, b.family) else INT
    x, y = (a.column, b.column) if family == INT else (a.column.cast("double"), b.column.cast("double"))
    if op == "/":
        zero = F.lit(0).cast("bigint") if family == INT else F.lit(0.0)
        if b.literal not in (None, 0, 0.0):  # a known divisor needs no guard
            guarded = y
        else:
            guarded = F.nullif(y, zero)
        return Typed(F.call_function("div", x, guarded) if family == INT else x / guarded, family)
    return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), family)


def like(a: Typed, pattern: Typed) -> Typed:
    """% and _ only: the escape character is one that patterns don't hold."""
    if a.family == OTHER or pattern.family not in (STRING, NULL):
        raise TypeMismatch("type mismatch: LIKE takes a text pattern")
    left = a.column if a.family == STRING else as_text(a.column, a.family)
    return Typed(F.like(left.cast("string"), pattern.column.cast("string"), F.lit("\x01")), BOOL)


def compare(op: str, a: Typed, b: Typed) -> Typed:
    x, y = comparable(a, b)
    return Typed({"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op](), BOOL)


def comparable(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Both sides in one type; text literals take the type of the other side."""
    if a.family == b.family and a.family != OTHER:
        return a.column, b.column
    families = {a.family, b.family}
    if NULL in families and OTHER not in families:
        return a.column, b.column
    if families == {INT, FLOAT}:
        return a.column, b.column
    for x, y, swap in ((a, b, False), (b, a, True)):
        other = None
        if x.family == TIMESTAMP and y.family == STRING and y.literal is not None:
            t = parse_timestamp(y.literal)
            other = F.lit(t.astimezone(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz") if x.ntz else F.lit(t)
        elif x.family == DATE and y.family == STRING and y.literal is not None:
            other = F.lit(parse_date(y.literal))
        elif x.family == DATE and y.family in (INT, FLOAT):
            return (y.column, F.unix_date(x.column)) if swap else (F.unix_date(x.column), y.column)
        elif x.family == DATE and y.family == TIMESTAMP:
            other = y.column.cast("date") if y.literal is not None else None
        elif x.family == BOOL and y.family == INT and y.literal in (0, 1):
            other = F.lit(bool(y.literal))
        if other is not None:
            return (other, x.column) if swap else (x.column, other)
    raise TypeMismatch(f"type mismatch: {a.family} compared with {b.family}")
