"""SELECT statements as a small logical tree, and the tree as one lazy DataFrame.

The tree has the nodes Scan, Filter, Project, Aggregate, Sort and Limit; it exists to name the
statement's steps for EXPLAIN and to check them.  Everything physical is Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError, TypeMismatch
from ..functions.expressions import Scope, Typed, as_bool, compile_expr
from ..functions.types import BOOL, FLOAT, INT, NULL, STRING, family_of
from .ast import Binary, Call, ColumnRef, Item, Literal, Select, Star, Unary
from .parser import AGGREGATES


@dataclass
class Node:
    operation: str
    detail: str
    children: list[Node] = field(default_factory=list)


def walk(e):
    """An expression and all below it."""
    yield e
    if isinstance(e, Binary):
        yield from walk(e.left)
        yield from walk(e.right)
    elif isinstance(e, Unary):
        yield from walk(e.operand)
    elif isinstance(e, Call):
        for a in e.args:
            yield from walk(a)


def has_aggregate(e) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def strip(e):
    """The expression without table qualifiers, so that t.a equals a."""
    if isinstance(e, ColumnRef):
        return ColumnRef(e.name)
    if isinstance(e, Binary):
        return Binary(e.op, strip(e.left), strip(e.right))
    if isinstance(e, Unary):
        return Unary(e.op, strip(e.operand))
    if isinstance(e, Call):
        return Call(e.name, tuple(map(strip, e.args)), e.distinct)
    return e


def scope_of(df: DataFrame, names: tuple[str | None, ...] = ()) -> Scope:
    return Scope({f.name: Typed(F.col(f"`{f.name}`"), family_of(f.dataType), ntz=isinstance(f.dataType, T.TimestampNTZType)) for f in df.schema}, names)


def name_of(item: Item) -> str:
    return item.alias or str(item.expr)


def expand(select: Select, columns: list[str]) -> list[Item]:
    out = []
    for i in select.items:
        out += [Item(ColumnRef(c)) for c in columns] if isinstance(i.expr, Star) else [i]
    return out


class Planned:
    """A SELECT against one table (or none): its tree and its DataFrame."""

    def __init__(self, spark: SparkSession, select: Select, table: DataFrame | None):
        self.spark, self.select = spark, select
        self.base = table if table is not None else spark.range(1).select()
        if table is None and any(isinstance(i.expr, Star) for i in select.items):
            raise AnalysisError("* needs a table")
        self.names = (select.table, select.table_alias)
        self.items = expand(select, self.base.columns)
        self.aggregate = bool(select.group_by) or select.having is not None or any(has_aggregate(i.expr) for i in self.items) or any(has_aggregate(o.expr) for o in select.order_by)
        self.df = self._plan()

    # -- DataFrame ----------------------------------------------------------------------

    def _plan(self) -> DataFrame:
        s, scope = self.select, scope_of(self.base, self.names)
        df = self.base
        if s.where is not None:
            if has_aggregate(s.where):
                raise AnalysisError("aggregates are not allowed in WHERE")
            df = df.where(as_bool(compile_expr(s.where, scope)))
        if self.aggregate:
            df, scope = self._aggregate(df, scope)
            if s.having is not None:
                df = df.where(as_bool(compile_expr(self._aliased(s.having), scope)))
        outputs = [(name_of(i), compile_expr(i.expr, scope)) for i in self.items]
        aliases = {i.alias: i.expr for i in self.items if i.alias}
        sort: list[Column] = []
        orders: list[tuple[str, Column, bool]] = []
        for k, o in enumerate(s.order_by):
            e = o.expr
            if isinstance(e, Literal) and isinstance(e.value, int) and not isinstance(e.value, bool):
                if not 1 <= e.value <= len(self.items):
                    raise AnalysisError(f"ORDER BY position {e.value} is not in the select list")
                e = self.items[e.value - 1].expr
            elif isinstance(e, ColumnRef) and e.table is None and e.name in aliases:
                e = aliases[e.name]
            at = next((j for j, i in enumerate(self.items) if strip(i.expr) == strip(e)), None)
            if at is not None:
                orders.append((f"_c{at}", None, o.ascending))
            elif s.distinct:
                raise AnalysisError("with DISTINCT, ORDER BY takes expressions of the select list")
            else:
                orders.append((f"_o{k}", compile_expr(e, scope).column, o.ascending))
        # Inner names are distinct even where the output's are not.
        inner = [t.column.alias(f"_c{j}") for j, (_, t) in enumerate(outputs)] + [c.alias(n) for n, c, _ in orders if c is not None]
        df = df.select(*inner)
        if s.distinct:
            df = df.distinct()
        for n, _, up in orders:
            sort.append(F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last())
        if sort:
            df = df.orderBy(*sort)
        if s.limit is not None:
            df = df.offset(s.offset).limit(s.limit) if s.offset else df.limit(s.limit)
        return df.select(*[F.col(f"_c{j}").alias(n) for j, (n, _) in enumerate(outputs)])

    def _aliased(self, e):
        """HAVING may name output columns."""
        aliases = {i.alias: i.expr for i in self.items if i.alias}
        if isinstance(e, ColumnRef) and e.table is None and e.name in aliases and e.name not in self.base.columns:
            return aliases[e.name]
        if isinstance(e, Binary):
            return Binary(e.op, self._aliased(e.left), self._aliased(e.right))
        if isinstance(e, Unary):
            return Unary(e.op, self._aliased(e.operand))
        return e

    def calls(self) -> list[Call]:
        """The distinct aggregates of the statement, in order of appearance."""
        s, found = self.select, {}
        parts = [i.expr for i in self.items] + ([self._aliased(s.having)] if s.having is not None else []) + [o.expr for o in s.order_by]
        for e in parts:
            for x in walk(e):
                if isinstance(x, Call) and x.name in AGGREGATES:
                    found.setdefault(strip(x))
        return list(found)

    def _aggregate(self, df: DataFrame, scope: Scope) -> tuple[DataFrame, Scope]:
        s = self.select
        if any(has_aggregate(g) for g in s.group_by):
            raise AnalysisError("aggregates are not allowed in GROUP BY")
        groups = [(strip(g), compile_expr(g, scope)) for g in s.group_by]
        calls = self.calls()
        made = [aggregate(c, scope) for c in calls]
        keys = [t.column.alias(f"_g{k}") for k, (_, t) in enumerate(groups)]
        columns = [t.column.alias(f"_a{k}") for k, t in enumerate(made)] or [F.count("*").alias("_a")]
        out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
        known = {e: Typed(F.col(f"_g{k}"), t.family, ntz=t.ntz) for k, (e, t) in enumerate(groups)}
        known |= {c: Typed(F.col(f"_a{k}"), t.family) for k, (c, t) in enumerate(zip(calls, made))}

        def special(e):
            found = known.get(strip(e)) if not isinstance(e, Literal) else None
            if found is None and isinstance(e, ColumnRef):
                scope.resolve(e)
                raise AnalysisError(f"column {e.name} is neither grouped by nor aggregated")
            return found

        return out, Scope({}, self.names, special)

    # -- tree -----------------------------------------------------------------------------

    def tree(self) -> Node:
        s = self.select
        used = [x.name for e in [i.expr for i in self.items] + [s.where, s.having, *s.group_by, *[o.expr for o in s.order_by]] if e is not None for x in walk(e) if isinstance(x, ColumnRef)]
        columns = [c for c in self.base.columns if c in used]
        if s.table is None:
            node = Node("Scan", "one row")
        else:
            node = Node("Scan", f"Table: {s.table}, Columns: [{' '.join(columns)}]" + (f", Predicate: {s.where}" if s.where is not None else ""))
        if self.aggregate:
            groups = f"GroupBy: [{', '.join(map(str, s.group_by))}], " if s.group_by else ""
            node = Node("Aggregate", f"{groups}Aggregates: [{', '.join(map(str, self.calls()))}]", [node])
            if s.having is not None:
                node = Node("Filter", f"Condition: {s.having}", [node])
        shown = ", ".join(f"{i.expr} AS {i.alias}" if i.alias else str(i.expr) for i in self.items)
        node = Node("Project", f"{'Distinct, ' if s.distinct else ''}Expressions: [{shown}]", [node])
        if s.order_by:
            node = Node("Sort", ", ".join(f"{o.expr} {'ASC' if o.ascending else 'DESC'}" for o in s.order_by), [node])
        if s.limit is not None:
            node = Node("Limit", f"Offset: {s.offset}, Count: {s.limit}", [node])
        return node

    def explain_rows(self) -> list[tuple[int, int, str, str]]:
        """(id, depth, operation, detail) in pre-order; the root has depth 0."""
        rows: list[tuple[int, int, str, str]] = []

        def visit(n: Node, depth: int) -> None:
            rows.append((len(rows) + 1, depth, n.operation, n.detail))
            for c in n.children:
                visit(c, depth + 1)

        visit(self.tree(), 0)
        return rows


def aggregate(c: Call, scope: Scope) -> Typed:
    if len(c.args) != 1:
        raise AnalysisError(f"{c.name} takes one argument")
    if isinstance(c.args[0], Star):
        if c.name != "count" or c.distinct:
            raise AnalysisError(f"{c} is not supported")
        return Typed(F.count("*"), INT)
    if any(has_aggregate(a) for a in c.args):
        raise AnalysisError(f"aggregates within {c}")
    x = compile_expr(c.args[0], scope)
    if c.name == "count":
        return Typed(F.count_distinct(x.column) if c.distinct else F.count(x.column), INT)
    if c.name in ("min", "max"):
        return Typed((F.min if c.name == "min" else F.max)(x.column), x.family, ntz=x.ntz)
    if x.family not in (INT, FLOAT, NULL):
        raise TypeMismatch(f"type mismatch: {c.name} of {BOOL if x.family == BOOL else STRING if x.family == STRING else x.family}")
    value = x.column.cast("bigint" if x.family == INT else "double")
    if c.name == "sum":
        return Typed(F.sum_distinct(value) if c.distinct else F.sum(value), INT if x.family == INT else FLOAT)
    return Typed(F.sum_distinct(value) / F.count_distinct(value) if c.distinct else F.avg(value), FLOAT)
