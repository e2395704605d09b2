"""INSERT, UPDATE, DELETE and bulk writes against keyed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError, ColumnNotFound, ConstraintViolation, PrimaryKeyConflict, TypeMismatch
from ..functions.expressions import Typed, as_bool, compile_expr
from ..functions.types import BOOL, DATE, FLOAT, INT, NULL, OTHER, STRING, TIMESTAMP, ColumnDef, parse_date, parse_timestamp, schema_of, value_for
from ..plans.ast import Delete, Insert, Update
from ..plans.planner import has_aggregate, scope_of
from ..sources.tables import KeyedTable, Table


def writable(table: Table) -> KeyedTable:
    if not isinstance(table, KeyedTable):
        raise AnalysisError(f"table {table.name} can only be read")
    return table


def insert(spark: SparkSession, table: Table, s: Insert) -> int:
    t = writable(table)
    names = s.columns or [c.name for c in t.columns]
    for n in names:
        if t.column(n) is None:
            raise ColumnNotFound(f"column {n} not found")
    if len(set(names)) < len(names):
        raise AnalysisError("a column is named twice")
    rows = []
    for r in s.rows:
        if len(r) != len(names):
            raise AnalysisError(f"{len(names)} columns but {len(r)} values")
        rows.append(_row(t, dict(zip(names, r))))
    keys = [tuple(r[i] for i, c in enumerate(t.columns) if c.name in t.primary_key) for r in rows]
    if len(set(keys)) < len(keys):
        raise PrimaryKeyConflict("a key occurs twice in the statement")
    return t.insert(spark.createDataFrame(rows, schema_of(t.columns)))


def _row(t: KeyedTable, values: Mapping) -> tuple:
    """The row in the table's order; missing columns are null."""
    out = []
    for c in t.columns:
        v = value_for(c, values.get(c.name))
        if v is None and not c.nullable:
            raise ConstraintViolation(f"column {c.name} must not be null")
        out.append(v)
    return tuple(out)


def write(spark: SparkSession, table: Table, rows: Iterable[Mapping]) -> int:
    """Bulk upsert of JSON rows: columns that the table lacks are ignored, the last row of a key wins."""
    t = writable(table)
    last: dict[tuple, tuple] = {}
    for r in rows:
        for k in t.primary_key:
            if r.get(k) is None:
                raise ConstraintViolation(f"primary key column {k} is missing")
        row = _row(t, r)
        last[tuple(row[i] for i, c in enumerate(t.columns) if c.name in t.primary_key)] = row
    if not last:
        return 0
    return t.upsert(spark.createDataFrame(list(last.values()), schema_of(t.columns)))


def assigned(column: ColumnDef, x: Typed) -> Column:
    """The value of a SET expression in the column's type."""
    f = column.family
    if x.family == NULL:
        return F.lit(None).cast(column.spark)
    if f == INT and x.family in (INT, FLOAT, BOOL, DATE):
        return (F.unix_date(x.column) if x.family == DATE else x.column.cast("int") if x.family == BOOL else x.column).cast("bigint")
    if f == FLOAT and x.family in (INT, FLOAT, BOOL):
        return (x.column.cast("int") if x.family == BOOL else x.column).cast("double")
    if f == BOOL and x.family in (BOOL, INT, FLOAT):
        return as_bool(x)
    if f == STRING and x.family == STRING:
        return x.column
    if f == DATE:
        if x.family == DATE:
            return x.column
        if x.family == STRING and x.literal is not None:
            return F.lit(parse_date(x.literal))
        if x.family == INT:
            return F.date_from_unix_date(x.column.cast("int"))
    if f == TIMESTAMP:
        if x.family == TIMESTAMP:
            return x.column
        if x.family == STRING and x.literal is not None:
            return F.lit(parse_timestamp(x.literal))
    raise TypeMismatch(f"type mismatch: column {column.name} is {column.logical}, value is {x.family if x.family != OTHER else 'of another type'}")


def _condition(df: DataFrame, where, name: str) -> Column | None:
    if where is None:
        return None
    if has_aggregate(where):
        raise AnalysisError("aggregates are not allowed in WHERE")
    return as_bool(compile_expr(where, scope_of(df, (name,))))


def update(table: Table, s: Update) -> int:
    t = writable(table)
    live = t.live()
    scope, sets = scope_of(live, (s.table,)), {}
    for name, e in s.assignments:
        c = t.column(name)
        if c is None:
            raise ColumnNotFound(f"column {name} not found")
        if name in sets:
            raise AnalysisError(f"column {name} is set twice")
        if has_aggregate(e):
            raise AnalysisError("aggregates are not allowed in SET")
        sets[name] = assigned(c, compile_expr(e, scope))
    return t.update(_condition(live, s.where, s.table), sets)


def delete(table: Table, s: Delete) -> int:
    t = writable(table)
    return t.delete(_condition(t.live(), s.where, s.table))
