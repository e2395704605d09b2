"""Logical column types: spellings, Spark types, families, values from JSON and literals, text form."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidSchema, TypeMismatch

BOOL, INT, FLOAT, STRING, DATE, TIMESTAMP, NULL, OTHER = "bool", "int", "float", "string", "date", "timestamp", "null", "other"

#: Logical types with family, Spark type and range of values.
LOGICAL: dict[str, tuple[str, T.DataType, tuple[int, int] | None]] = {
    "BOOL": (BOOL, T.BooleanType(), None),
    "INT8": (INT, T.ShortType(), (-128, 255)),
    "INT16": (INT, T.ShortType(), (-(1 << 15), (1 << 15) - 1)),
    "INT32": (INT, T.IntegerType(), (-(1 << 31), (1 << 31) - 1)),
    "INT64": (INT, T.LongType(), (-(1 << 63), (1 << 63) - 1)),
    "UINT64": (INT, T.LongType(), (0, (1 << 63) - 1)),
    "FLOAT64": (FLOAT, T.DoubleType(), None),
    "STRING": (STRING, T.StringType(), None),
    "DATE": (DATE, T.DateType(), None),
    "TIMESTAMP": (TIMESTAMP, T.TimestampType(), None),
}
#: Spellings in CREATE TABLE.
SPELLINGS = {
    "BOOL": "BOOL", "BOOLEAN": "BOOL", "TINYINT": "BOOL", "TINYINT UNSIGNED": "INT8", "INT8": "INT8",
    "SMALLINT": "INT16", "INT16": "INT16", "MEDIUMINT": "INT32", "INT32": "INT32",
    "INT": "INT64", "INTEGER": "INT64", "BIGINT": "INT64", "INT64": "INT64", "BIGINT UNSIGNED": "UINT64", "UINT64": "UINT64",
    "FLOAT": "FLOAT64", "DOUBLE": "FLOAT64", "FLOAT64": "FLOAT64",
    "TEXT": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "STRING": "STRING",
    "DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "DATETIME": "TIMESTAMP",
}


@dataclass(frozen=True)
class ColumnDef:
    name: str
    logical: str
    nullable: bool = True

    @property
    def family(self) -> str:
        return LOGICAL[self.logical][0]

    @property
    def spark(self) -> T.DataType:
        return LOGICAL[self.logical][1]

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.spark, True, {"logical_type": self.logical})


def logical_of(spelling: str) -> str:
    try:
        return SPELLINGS[spelling.upper()]
    except KeyError:
        raise InvalidSchema(f"unknown type {spelling}") from None


def schema_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([c.field() for c in columns])


def columns_of(schema: T.StructType) -> list[ColumnDef]:
    """Logical columns of a Spark schema; types without a counterpart can only be scanned and are called by their Spark name."""
    out = []
    for f in schema:
        logical = f.metadata.get("logical_type") if f.metadata else None
        if logical is None:
            logical = next((n for n, (_, t, _) in LOGICAL.items() if t == f.dataType and n not in ("INT8", "UINT64")), None)
        if logical is None and isinstance(f.dataType, T.TimestampNTZType):
            logical = "TIMESTAMP"
        if logical is None and isinstance(f.dataType, T.FloatType):
            logical = "FLOAT64"
        if logical is None and isinstance(f.dataType, T.ByteType):
            logical = "INT8"
        out.append(ColumnDef(f.name, logical or f.dataType.simpleString().upper(), f.nullable))
    return out


def family_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.DateType):
        return DATE
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return NULL if isinstance(t, T.NullType) else OTHER


def parse_date(s: str) -> dt.date:
    try:
        return dt.date.fromisoformat(s)
    except ValueError:
        raise TypeMismatch(f"type mismatch: {s!r} is no date") from None


def parse_timestamp(s: str) -> dt.datetime:
    """A point in time; text without an offset is UTC."""
    try:
        t = dt.datetime.fromisoformat(s.strip())
    except ValueError:
        raise TypeMismatch(f"type mismatch: {s!r} is no timestamp") from None
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def value_for(column: ColumnDef, v):
    """The value of a literal or of JSON for a column, or TypeMismatch."""

    def no():
        return TypeMismatch(f"type mismatch: column {column.name} is {column.logical}, value is {v!r}")

    if v is None:
        return None
    f = column.family
    if f == BOOL:
        if isinstance(v, bool):
            return v
        if isinstance(v, int) and v in (0, 1):
            return bool(v)
        raise no()
    if f == INT:
        if isinstance(v, bool):
            v = int(v)
        if isinstance(v, float) and math.isfinite(v):
            v = int(v)
        if not isinstance(v, int):
            raise no()
        lo, hi = LOGICAL[column.logical][2]
        if not lo <= v <= hi:
            raise ConstraintOutOfRange(column, v)
        return v
    if f == FLOAT:
        if isinstance(v, (bool, int, float)):
            return float(v)
        raise no()
    if f == STRING:
        if isinstance(v, str):
            return v
        raise no()
    if f == DATE:
        if isinstance(v, bool):
            raise no()
        if isinstance(v, int):
            return dt.date(1970, 1, 1) + dt.timedelta(days=v)
        if isinstance(v, str):
            return parse_date(v)
        raise no()
    if f == TIMESTAMP and isinstance(v, str):
        return parse_timestamp(v)
    raise no()


class ConstraintOutOfRange(TypeMismatch):
    def __init__(self, column: ColumnDef, v):
        super().__init__(f"value {v} is out of range for {column.logical} column {column.name}")


def to_json(v):
    """A result value for JSON: dates and times as text."""
    if isinstance(v, dt.datetime):
        t = v.astimezone(dt.timezone.utc) if v.tzinfo else v
        s = t.strftime("%Y-%m-%dT%H:%M:%S")
        if t.microsecond:
            s += f".{t.microsecond:06d}".rstrip("0")
        return s + "Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def as_text(c: Column, family: str) -> Column:
    """The text form that LIKE sees."""
    if family == FLOAT:
        whole = (F.abs(c) < 1e6) & (c == F.floor(c))
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if family == TIMESTAMP:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return c.cast("string")
