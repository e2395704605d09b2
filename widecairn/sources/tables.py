"""Primary-keyed, mutable tables on immutable Parquet files.

A table is a folder with data folders and numbered manifests; the highest manifest is the
table.  Writing a manifest that doesn't exist yet is the commit, so a statement happens
whole or not at all, readers keep the snapshot they began with, and files that no
manifest names are ignored.

A manifest names at most one base (unique keys, no hidden columns) and a list of deltas.
A delta holds rows with ``_version`` and ``_deleted``, at most one per key.  The live rows
are the base without the deltas' keys, and each delta key's newest row unless deleted.
Only the deltas go through a window, and the base meets just their keys: reading costs a
scan of the base and a join that is a broadcast while the deltas are small.  Predicates
and columns reach the base's scan; above the deltas' window only predicates on the key
may pass it, which Catalyst sees to.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflict, ConstraintViolation, InvalidSchema, PrimaryKeyConflict
from ..functions.types import LOGICAL, ColumnDef, columns_of, schema_of
from .files import Files

VERSION, DELETED, ORDER = "_version", "_deleted", "_order"
#: Deltas after which they are merged, and the share of the base's rows after which the base is rewritten.
MOST_DELTAS, REWRITE_SHARE = 8, 0.25
#: Keys of a statement that are looked up by value and not by range.
FEW_KEYS = 500


@dataclass
class Manifest:
    number: int = 0
    base: dict | None = None  # {"dir", "rows"}
    deltas: list[dict] = field(default_factory=list)  # {"dir", "rows", "version"}
    version: int = 0

    def text(self) -> str:
        return json.dumps({"number": self.number, "base": self.base, "deltas": self.deltas, "version": self.version})


class Table:
    """What the engine needs of any table: name, columns, key, live()."""

    writable = False
    kind = "view"

    def __init__(self, name: str, columns: list[ColumnDef], primary_key: list[str]):
        self.name, self.columns, self.primary_key = name, columns, primary_key

    def live(self) -> DataFrame:
        raise NotImplementedError

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)


class ParquetView(Table):
    """Parquet files as a table that can only be read; they are first looked at when a statement names them."""

    def __init__(self, spark: SparkSession, name: str, path: str, primary_key: list[str] | None = None):
        self.spark, self.path, self.name, self.primary_key = spark, path, name, primary_key or []

    @cached_property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @cached_property
    def columns(self) -> list[ColumnDef]:
        return columns_of(self.df.schema)

    def live(self) -> DataFrame:
        return self.df


class FrameView(Table):
    """A DataFrame as a table that can only be read."""

    def __init__(self, name: str, df: DataFrame, primary_key: list[str] | None = None):
        self.df = df
        super().__init__(name, columns_of(df.schema), primary_key or [])

    def live(self) -> DataFrame:
        return self.df


class KeyedTable(Table):
    writable = True
    kind = "lsm"

    def __init__(self, spark: SparkSession, root: str, name: str, columns: list[ColumnDef], primary_key: list[str]):
        super().__init__(name, columns, primary_key)
        self.spark, self.root, self.files, self.lock = spark, root.rstrip("/"), Files(spark), threading.RLock()

    # -- manifests --------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        numbers = [int(n[9:-5]) for n in self.files.list(f"{self.root}/manifests") if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return Manifest()
        return Manifest(**json.loads(self.files.read(f"{self.root}/manifests/manifest-{max(numbers):012d}.json")))

    def _commit(self, m: Manifest) -> None:
        if not self.files.write_new(f"{self.root}/manifests/manifest-{m.number:012d}.json", m.text()):
            raise CommitConflict(f"table {self.name}: another writer committed")
        if m.number > 8:
            self.files.delete(f"{self.root}/manifests/manifest-{m.number - 8:012d}.json")

    # -- reading ----------------------------------------------------------------------------

    def _read(self, where: str, hidden: bool) -> DataFrame:
        schema = schema_of(self.columns)
        if hidden:
            schema = T.StructType([*schema, T.StructField(VERSION, T.LongType()), T.StructField(DELETED, T.BooleanType())])
        # Columns added later are missing from older files and read as null; dropped ones aren't asked for.
        return self.spark.read.schema(schema).parquet(f"{self.root}/{where}")

    def _newest(self, m: Manifest) -> DataFrame | None:
        """Each delta key's newest row, deleted ones too."""
        if not m.deltas:
            return None
        out = None
        for d in m.deltas:
            one = self._read(d["dir"], True)
            out = one if out is None else out.unionByName(one)
        if len(m.deltas) == 1:
            return out
        by = Window.partitionBy(*map(_c, self.primary_key)).orderBy(F.col(VERSION).desc())
        return out.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")

    def live(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest()
        names = [_c(c.name) for c in self.columns]
        newest = self._newest(m)
        base = self._read(m.base["dir"], False) if m.base else None
        if newest is None:
            return base.select(*names) if base is not None else self.spark.createDataFrame([], schema_of(self.columns))
        fresh = newest.where(~F.col(DELETED)).select(*names)
        if base is None:
            return fresh
        keys = newest.select(*[_c(k).alias(f"_k{i}") for i, k in enumerate(self.primary_key)])
        same = [_c(k) == F.col(f"_k{i}") for i, k in enumerate(self.primary_key)]
        return base.join(keys, same, "left_anti").select(*names).unionByName(fresh)

    # -- writing ----------------------------------------------------------------------------

    def checked(self, df: DataFrame) -> DataFrame:
        """Rows with the table's columns and types; a null where none may be, or a number out of range, ends the job."""
        out = []
        for c in self.columns:
            x = _c(c.name)
            if not c.nullable:
                x = F.when(x.isNull(), F.raise_error(F.lit(f"column {c.name} must not be null"))).otherwise(x)
            bounds = LOGICAL[c.logical][2] if c.logical in LOGICAL else None
            if bounds:
                x = F.when((x < bounds[0]) | (x > bounds[1]), F.raise_error(F.lit(f"value is out of range for {c.logical} column {c.name}"))).otherwise(x)
            out.append(x.cast(c.spark).alias(c.name))
        return df.select(*out, *[F.col(n) for n in (DELETED, ORDER) if n in df.columns])

    def _stage(self, df: DataFrame, version: int) -> dict:
        """Write a delta's files, which nothing names yet."""
        where = f"data/{uuid.uuid4().hex}"
        out = df.withColumn(VERSION, F.lit(version).cast("long"))
        if DELETED not in df.columns:
            out = out.withColumn(DELETED, F.lit(False))
        try:
            out.select(*[_c(c.name) for c in self.columns], VERSION, DELETED).write.option("compression", "zstd").parquet(f"{self.root}/{where}")
        except Exception as e:
            self.files.delete(f"{self.root}/{where}")
            found = next((m for m in ("must not be null", "out of range") if m in str(e)), None)
            if found:
                text = next(line for line in str(e).splitlines() if found in line)
                raise ConstraintViolation(text.split("] ")[-1].split(" SQLSTATE")[0].strip()) from None
            raise
        return {"dir": where, "rows": 0, "version": version}

    def _staged(self, delta: dict) -> DataFrame:
        return self._read(delta["dir"], True)

    def _count(self, delta: dict, condition=None) -> int:
        df = self._staged(delta)
        return (df.where(condition) if condition is not None else df).count()

    def upsert(self, df: DataFrame, order_by: str | None = None) -> int:
        """Write rows over those with the same key.  Of rows with one key the last wins: the largest ``order_by``, or the last in the frame's order."""
        with self.lock:
            m = self.manifest()
            rows = df.select(*[(_c(c.name) if c.name in df.columns else F.lit(None)).cast(c.spark).alias(c.name) for c in self.columns], (F.col(order_by) if order_by else F.monotonically_increasing_id()).alias(ORDER))
            by = Window.partitionBy(*map(_c, self.primary_key)).orderBy(F.col(ORDER).desc())
            rows = self.checked(rows).withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank", ORDER)
            delta = self._stage(rows, m.version + 1)
            return self._add(m, delta, self._count(delta))

    def insert(self, df: DataFrame) -> int:
        """Write rows whose keys are new, or none."""
        with self.lock:
            m = self.manifest()
            delta = self._stage(self.checked(df), m.version + 1)
            try:
                new = self._staged(delta)
                keys = list(map(_c, self.primary_key))
                n = new.count()
                twice = new.groupBy(*keys).count().where("count > 1").limit(1).collect()
                if twice:
                    raise PrimaryKeyConflict("a key occurs twice in the statement")
                if self._meets(self.live(m), new):
                    raise PrimaryKeyConflict()
            except Exception:
                self.files.delete(f"{self.root}/{delta['dir']}")
                raise
            return self._add(m, delta, n)

    def _near(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The rows of ``old`` whose first key column can equal one of ``new``'s: a filter that row-group statistics
        and bloom filters of the sorted base can use, so that a small insert doesn't read the keys of the whole table."""
        k = _c(self.primary_key[0])
        few = new.select(k).distinct().limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            return old.where(k.isin([r[0] for r in few]))
        ends = new.agg(F.min(k).alias("lo"), F.max(k).alias("hi")).head()
        return old.where((k >= F.lit(ends.lo)) & (k <= F.lit(ends.hi)))

    def _meets(self, old: DataFrame, new: DataFrame) -> bool:
        old = self._near(old, new)
        keys = new.select(*[_c(k).alias(f"_k{i}") for i, k in enumerate(self.primary_key)])
        same = [_c(k) == F.col(f"_k{i}") for i, k in enumerate(self.primary_key)]
        return bool(old.select(*map(_c, self.primary_key)).join(keys, same, "left_semi").limit(1).collect())

    def delete(self, condition) -> int:
        """Delete the rows that the condition holds for; all without one."""
        with self.lock:
            m = self.manifest()
            gone = self.live(m)
            if condition is not None:
                gone = gone.where(condition)
            gone = gone.select(*[(_c(c.name) if c.name in self.primary_key else F.lit(None).cast(c.spark)).alias(c.name) for c in self.columns], F.lit(True).alias(DELETED))
            delta = self._stage(gone, m.version + 1)
            return self._add(m, delta, self._count(delta))

    def update(self, condition, assignments: dict) -> int:
        """Set columns, every value from the old row; returns how many rows the condition holds for."""
        with self.lock:
            m = self.manifest()
            old = self.live(m)
            if condition is not None:
                old = old.where(condition)
            moves = any(k in assignments for k in self.primary_key)
            kept = [_c(k).alias(f"_k{i}") for i, k in enumerate(self.primary_key)] if moves else []
            new = self.checked(old.select(*[(assignments[c.name] if c.name in assignments else _c(c.name)).alias(c.name) for c in self.columns]))
            if not moves:
                delta = self._stage(new, m.version + 1)
                return self._add(m, delta, self._count(delta))
            # Old keys and new rows, written together; the new key set is checked as a whole.
            new_keys = [assignments.get(k, _c(k)).alias(f"_n{i}") for i, k in enumerate(self.primary_key)]
            pairs = old.select(*kept, *new_keys)
            first = self._stage(new, m.version + 1)
            try:
                fresh = self._staged(first)
                n = fresh.count()
                if fresh.groupBy(*map(_c, self.primary_key)).count().where("count > 1").limit(1).collect():
                    raise PrimaryKeyConflict("two rows would get one key")
                moved = pairs.where(~_same(pairs, len(self.primary_key)))
                untouched = self.live(m).join(old.select(*kept), [_c(k) == F.col(f"_k{i}") for i, k in enumerate(self.primary_key)], "left_anti")
                if self._meets(untouched, fresh):
                    raise PrimaryKeyConflict()
                left = moved.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(self.primary_key)]).join(fresh.select(*map(_c, self.primary_key)), self.primary_key, "left_anti")
                tombs = left.select(*[(_c(c.name) if c.name in self.primary_key else F.lit(None).cast(c.spark)).alias(c.name) for c in self.columns], F.lit(True).alias(DELETED))
                delta = self._stage(fresh.drop(VERSION).unionByName(tombs), m.version + 1)
            finally:
                self.files.delete(f"{self.root}/{first['dir']}")
            self._add(m, delta, self._count(delta))
            return n

    def _add(self, m: Manifest, delta: dict, rows: int) -> int:
        if not rows:
            self.files.delete(f"{self.root}/{delta['dir']}")
            return 0
        self._commit(replace(m, number=m.number + 1, version=delta["version"], deltas=[*m.deltas, {**delta, "rows": rows}]))
        self.compact_if_due()
        return rows

    # -- upkeep -----------------------------------------------------------------------------

    def compact_if_due(self) -> None:
        m = self.manifest()
        if len(m.deltas) >= MOST_DELTAS:
            changed = sum(d["rows"] for d in m.deltas)
            self.compact(whole=not m.base or changed >= REWRITE_SHARE * m.base["rows"])

    def compact(self, whole: bool = True) -> None:
        """Merge the deltas into one, or with ``whole`` all live rows into a new base, sorted by key in ranges."""
        with self.lock:
            m = self.manifest()
            if not m.deltas:
                return
            if not whole:
                where = f"data/{uuid.uuid4().hex}"
                self._newest(m).write.option("compression", "zstd").parquet(f"{self.root}/{where}")
                done = replace(m, number=m.number + 1, deltas=[{"dir": where, "rows": self.spark.read.parquet(f"{self.root}/{where}").count(), "version": m.version}])
            else:
                where = f"data/{uuid.uuid4().hex}"
                keys = list(map(_c, self.primary_key))
                writer = self.live(m).repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd")
                for k in self.primary_key:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
                writer.parquet(f"{self.root}/{where}")
                done = replace(m, number=m.number + 1, base={"dir": where, "rows": self.spark.read.parquet(f"{self.root}/{where}").count()}, deltas=[])
            self._commit(done)

    def flush(self) -> None:
        """Every commit is in files already."""

    def clean(self, grace: float = 3600.0) -> int:
        """Delete data folders that no kept manifest names and that are older than ``grace`` seconds, so
        that neither readers of recent snapshots nor statements still writing lose files; returns how many."""
        with self.lock:
            named = set()
            for n in self.files.list(f"{self.root}/manifests"):
                if n.startswith("manifest-") and n.endswith(".json"):
                    m = json.loads(self.files.read(f"{self.root}/manifests/{n}"))
                    named |= {d["dir"].split("/")[-1] for d in [*m["deltas"], *([m["base"]] if m["base"] else [])]}
            gone = [d for d in self.files.list(f"{self.root}/data") if d not in named and self.files.age(f"{self.root}/data/{d}") >= grace]
            for d in gone:
                self.files.delete(f"{self.root}/data/{d}")
            return len(gone)

    def stats(self) -> dict:
        m = self.manifest()
        return {"name": self.name, "engine": self.kind, "base_rows": m.base["rows"] if m.base else 0, "deltas": len(m.deltas), "delta_rows": sum(d["rows"] for d in m.deltas), "version": m.version}

    def alter(self, columns: list[ColumnDef]) -> None:
        if not all(any(c.name == k for c in columns) for k in self.primary_key):
            raise InvalidSchema("a primary key column cannot be dropped")
        self.columns = columns


class MemoryTable(KeyedTable):
    """The same table in a folder of the session's: gone with the session.

    Its rows are read once and kept in the executors' memory, beyond that on their disks,
    until the next commit.  The files lie in the shared folder, from which rows that a lost
    executor held are read again.
    """

    kind = "memory"

    def __init__(self, *given):
        super().__init__(*given)
        self.kept: tuple[tuple, DataFrame] | None = None

    def live(self, m: Manifest | None = None) -> DataFrame:
        m = m or self.manifest()
        at = (m.number, tuple(c.name for c in self.columns))
        with self.lock:
            if self.kept is None or self.kept[0] != at:
                self.forget()
                self.kept = (at, super().live(m).persist(StorageLevel.MEMORY_AND_DISK))
            return self.kept[1]

    def forget(self) -> None:
        """Give the memory back."""
        if self.kept is not None:
            self.kept[1].unpersist()
            self.kept = None


def _c(name: str):
    return F.col(f"`{name}`")


def _same(df: DataFrame, n: int):
    out = F.lit(True)
    for i in range(n):
        out = out & (F.col(f"_k{i}") == F.col(f"_n{i}"))
    return out
