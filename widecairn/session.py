"""The engine: statements in, responses or lazy DataFrames out."""

from __future__ import annotations

import re
import tempfile
import threading
import time
import uuid
from bisect import bisect_left
from collections import Counter, OrderedDict, deque
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .errors import AnalysisError, EngineError, ParseError, TableNotFound
from .functions.types import ColumnDef, to_json, value_for
from .operators import dml
from .plans.ast import CreateTable, Delete, Describe, DropTable, Explain, Insert, Select, ShowTables, Update
from .plans.parser import parse
from .plans.planner import Planned
from .sources.catalog import Catalog
from .sources.tables import FrameView, KeyedTable, MemoryTable, ParquetView, Table
from .streaming.group_commit import GroupCommitter


@dataclass
class Response:
    """code 0 is success; others name the stage that failed."""

    code: int = 0
    message: str = ""
    data: list[dict] | None = None
    rows: int = 0
    columns: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)  # Spark's names of the columns' types; not part of the JSON form

    def as_dict(self) -> dict:
        """The JSON form; empty members are left out."""
        out = {"code": self.code, "message": self.message, "data": self.data, "rows": self.rows, "columns": self.columns}
        return {k: v for k, v in out.items() if k == "code" or v}


PARSE_FAILED, ANALYSIS_FAILED, EXECUTION_FAILED = 1, 2, 3


def _shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where all of Spark is this one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("an engine without a root needs spark.checkpoint.dir, a folder that the driver and all executors share")
    return (found or tempfile.mkdtemp()).rstrip("/")


def _first_line(e: Exception) -> str:
    text = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
    return text.splitlines()[0] if text else type(e).__name__


class Histogram:
    """Counts of durations up to each bound, in seconds."""

    BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)

    def __init__(self):
        self.counts, self.total, self.lock = [0] * (len(self.BOUNDS) + 1), 0.0, threading.Lock()

    def add(self, seconds: float) -> None:
        with self.lock:
            self.counts[bisect_left(self.BOUNDS, seconds)] += 1
            self.total += seconds

    def lines(self, name: str) -> dict[str, float]:
        """Cumulated, as scrapers expect it."""
        with self.lock:
            sums = list(accumulate(self.counts))
            out = {f'{name}_bucket{{le="{b:g}"}}': n for b, n in zip(self.BOUNDS, sums)}
            return out | {f'{name}_bucket{{le="+Inf"}}': sums[-1], f"{name}_count": sums[-1], f"{name}_sum": self.total}


class RowCache:
    """The rows that were read last, so many at most."""

    def __init__(self, most: int):
        self.most, self.held, self.lock = most, OrderedDict(), threading.Lock()
        self.hits = self.misses = 0

    def get(self, key):
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                self.hits += 1
                return self.held[key]
            self.misses += 1
            return None

    def put(self, key, value) -> None:
        with self.lock:
            self.held[key] = value
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)


class Engine:
    """``root`` is a folder in any store that Spark reaches; without one, tables last as long as the session."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.root = (root or self.config.root or f"{_shared_dir(spark)}/widecairn-{uuid.uuid4().hex}").rstrip("/")
        self.session = uuid.uuid4().hex
        self.catalog = Catalog(spark, self.root)
        self.views: dict[str, Table] = {}
        self.open: dict[str, KeyedTable] = {}
        self.counts: Counter = Counter()
        self.seconds: Counter = Counter()
        self.slow: deque = deque(maxlen=self.config.slow_query_entries)
        self.rows = RowCache(self.config.cached_rows)
        self.times = {k: Histogram() for k in ("query", "write")}
        self.committers: dict[str, GroupCommitter] = {}
        self.lock = threading.RLock()

    # -- tables -------------------------------------------------------------------------

    def register_parquet(self, name: str, path: str, primary_key: list[str] | None = None) -> None:
        self.views[name] = ParquetView(self.spark, name, path, primary_key)

    def register(self, name: str, df: DataFrame, primary_key: list[str] | None = None) -> None:
        self.views[name] = FrameView(name, df, primary_key)

    def table(self, name: str) -> Table:
        with self.lock:
            if name in self.views:
                return self.views[name]
            if name not in self.open:
                entry = self.catalog.get(name)
                memory = entry["engine"] == "memory"
                folder = f"{self.root}/memory/{self.session}/{entry['folder']}" if memory else f"{self.root}/tables/{entry['folder']}"
                self.open[name] = (MemoryTable if memory else KeyedTable)(self.spark, folder, name, self.catalog.columns(name), entry["primary_key"])
            return self.open[name]

    def tables(self) -> list[str]:
        return sorted({*self.views, *self.catalog.names()})

    def create_table(self, name: str, columns: list[ColumnDef], primary_key: list[str], engine: str = "lsm") -> None:
        if name in self.views:
            raise AnalysisError(f"table {name} already exists")
        self.catalog.create(name, columns, primary_key, engine, f"{name}-{uuid.uuid4().hex[:12]}")

    def drop_table(self, name: str) -> None:
        with self.lock:
            if self.views.pop(name, None) is None:
                t = self.table(name)
                try:
                    self.catalog.drop(name)
                finally:
                    self.open.pop(name, None)
                if c := self.committers.pop(name, None):
                    c.close()
                if isinstance(t, MemoryTable):
                    t.forget()
                t.files.delete(t.root)

    def add_column(self, table: str, column: ColumnDef) -> None:
        self.catalog.add_column(table, column)
        self._reopen(table)

    def drop_column(self, table: str, column: str) -> None:
        self.catalog.drop_column(table, column)
        self._reopen(table)

    def _reopen(self, table: str) -> None:
        if isinstance(t := self.open.pop(table, None), MemoryTable):
            t.forget()

    def close(self) -> None:
        """Memory tables end with the session, writes that wait are committed."""
        for c in self.committers.values():
            c.close()
        self.committers.clear()
        for t in self.open.values():
            if isinstance(t, MemoryTable):
                t.forget()
                t.files.delete(t.root)
        self.open.clear()

    # -- statements -----------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """A SELECT, SHOW, DESCRIBE or EXPLAIN statement as a DataFrame."""
        return self._frame(parse(text))

    def _planned(self, s: Select) -> Planned:
        return Planned(self.spark, s, self.table(s.table).live() if s.table else None)

    def _frame(self, s) -> DataFrame:
        if isinstance(s, Select):
            return self._planned(s).df
        if isinstance(s, ShowTables):
            return self.spark.createDataFrame([(n,) for n in self.tables()], "table string")
        if isinstance(s, Describe):
            t = self.table(s.table)
            return self.spark.createDataFrame([(c.name, c.logical, c.nullable, c.name in t.primary_key) for c in t.columns], "field string, type string, null boolean, key boolean")
        if isinstance(s, Explain):
            return self.spark.createDataFrame(self._planned(s.select).explain_rows(), "id int, depth int, operation string, detail string")
        raise AnalysisError("the statement has no rows")

    def execute(self, text: str) -> int:
        """A statement that changes tables; returns the rows that it affected."""
        return self._change(parse(text))

    def _change(self, s) -> int:
        if isinstance(s, Insert):
            return dml.insert(self.spark, self.table(s.table), s)
        if isinstance(s, Update):
            return dml.update(self.table(s.table), s)
        if isinstance(s, Delete):
            return dml.delete(self.table(s.table), s)
        if isinstance(s, CreateTable):
            if s.if_not_exists and s.table in self.tables():
                return 0
            self.create_table(s.table, s.columns, s.primary_key, s.engine)
            return 0
        if isinstance(s, DropTable):
            try:
                self.drop_table(s.table)
            except TableNotFound:
                if not s.if_exists:
                    raise
            return 0
        raise AnalysisError("the statement changes nothing")

    def sql(self, text: str, source: str = "inproc") -> Response:
        """Any statement, with its rows; failures become responses with a code."""
        began = time.perf_counter()
        try:
            s = parse(text)
            if isinstance(s, (Select, ShowTables, Describe, Explain)):
                df = self._frame(s)
                if len(set(df.columns)) < len(df.columns):
                    raise AnalysisError("two result columns have one name")
                # Rows of a response stand in JSON, so they are the client's to bound with LIMIT.
                data = [{c: to_json(v) for c, v in zip(df.columns, r)} for r in df.collect()]
                out = Response(data=data, rows=len(data), columns=df.columns, types=[t for _, t in df.dtypes])
            else:
                out = Response(rows=self._change(s))
        except ParseError as e:
            out = Response(PARSE_FAILED, f"parse error: {e}")
        except AnalysisError as e:
            out = Response(ANALYSIS_FAILED, f"analyze error: {e}")
        except (EngineError, PySparkException, Py4JJavaError) as e:
            # Also a result beyond spark.driver.maxResultSize, which ends the job.
            out = Response(EXECUTION_FAILED, f"execute error: {_first_line(e)}")
        self._note("query", text, time.perf_counter() - began, out, source)
        return out

    def write(self, table: str, rows: Iterable[Mapping], source: str = "inproc") -> Response:
        """Bulk upsert of rows as JSON objects."""
        began = time.perf_counter()
        try:
            out = Response(rows=dml.write(self.spark, self.table(table), rows))
        except AnalysisError as e:
            out = Response(ANALYSIS_FAILED, f"analyze error: {e}")
        except (EngineError, PySparkException, Py4JJavaError) as e:
            out = Response(EXECUTION_FAILED, f"execute error: {_first_line(e)}")
        self._note("write", f"write {table}", time.perf_counter() - began, out, source)
        return out

    def submit(self, table: str, rows: Iterable[Mapping], source: str) -> Response:
        """A write for a server: rows that other clients write at the same time share its commit."""
        if not self.config.group_commit_ms:
            return self.write(table, rows, source)
        with self.lock:
            if table not in self.committers:
                try:
                    self.table(table)
                except AnalysisError:
                    return self.write(table, rows, source)
                self.committers[table] = GroupCommitter(lambda x: self.write(table, x, source), self.config.group_commit_ms / 1000)
            waiting = self.committers[table].submit(rows)
        return waiting.result()

    def load(self, table: str, df: DataFrame, order_by: str | None = None) -> int:
        """Bulk upsert of a DataFrame, distributed."""
        return dml.writable(self.table(table)).upsert(df, order_by)

    def get(self, table: str, **key) -> dict | None:
        """The row with a key, or None."""
        t = self.table(table)
        if set(key) != set(t.primary_key):
            raise AnalysisError(f"the key of {table} is {', '.join(t.primary_key)}")
        values = {k: value_for(t.column(k), v) for k, v in key.items()}
        # A row that was read before is good as long as nothing has been committed since.
        at = (table, t.root, t.manifest().number, *sorted(values.items())) if isinstance(t, KeyedTable) else None
        if at is not None and (hit := self.rows.get(at)) is not None:
            return dict(hit[0]) if hit[0] is not None else None
        df = t.live()
        for k, v in values.items():
            df = df.where(F.col(f"`{k}`") == F.lit(v))
        found = df.limit(1).collect()
        out = found[0].asDict() if found else None
        if at is not None:
            self.rows.put(at, (out,))
        return dict(out) if out is not None else None

    def explain(self, text: str) -> str:
        """Spark's formatted plan of a SELECT."""
        q = self.query(text)._jdf.queryExecution()
        return q.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def ping(self) -> Response:
        return Response(message="pong")

    # -- upkeep -----------------------------------------------------------------------------

    def _note(self, kind: str, text: str, seconds: float, out: Response, source: str) -> None:
        self.counts[f"{kind}_total"] += 1
        self.counts[f"{kind}_errors_total"] += out.code != 0
        self.counts[f"{kind}_rows_total"] += out.rows
        self.seconds[f"{kind}_seconds_total"] += seconds
        self.times[kind].add(seconds)
        if 0 < self.config.slow_query_ms <= seconds * 1000:
            self.counts["slow_total"] += 1
            shown = text.encode()[: self.config.slow_query_bytes].decode(errors="ignore")
            self.slow.appendleft({"sql": shown, "duration_ms": round(seconds * 1000, 3), "rows": out.rows, "code": out.code, "source": source, "time": time.time()})

    def slow_queries(self) -> list[dict]:
        """Newest first."""
        return list(self.slow)

    def stats(self) -> dict:
        tables = [self.table(n).stats() for n in self.catalog.names()]
        return {"tables": tables, "summary": {"tables": len(tables), "base_rows": sum(t["base_rows"] for t in tables), "delta_rows": sum(t["delta_rows"] for t in tables)}}

    def metrics(self) -> dict:
        out = dict(self.counts) | dict(self.seconds)
        for k, h in self.times.items():
            out |= h.lines(f"{k}_duration_seconds")
        return out | {"row_cache_hits_total": self.rows.hits, "row_cache_misses_total": self.rows.misses, "row_cache_entries": len(self.rows.held)}

    def keyed_tables(self, name: str | None = None) -> list[KeyedTable]:
        return [dml.writable(self.table(n)) for n in ([name] if name else self.catalog.names())]

    def flush(self, table: str | None = None) -> None:
        for t in self.keyed_tables(table):
            t.flush()

    def compact(self, table: str | None = None) -> None:
        for t in self.keyed_tables(table):
            t.compact()
            t.clean()
