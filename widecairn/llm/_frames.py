"""Helpers shared by the corpus operators: Arrow batch maps, tables on disk, sizes."""

from __future__ import annotations

import ctypes
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one Arrow batch that goes to a Python worker; with whole texts this bounds a worker's memory.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_widecairn_shipped", False):
        return
    root, raw = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = f"{shared_dir(spark)}/widecairn/code-{uuid.uuid4().hex}/widecairn.zip"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(raw.getvalue()))
    stream.close()
    sc.addPyFile(path)
    sc._widecairn_shipped = True


def release_memory() -> None:
    """Give freed memory back: a worker lives on after its task, beside others and the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def prepare(spark: SparkSession) -> None:
    """Ship the sources and bound the batches that Python workers get."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with plain columns: ``fn`` gets an iterator of {column: list or ndarray} and yields the same.

    ``fn`` sees one dict per batch, so it can keep state over the batches of a partition.
    """
    prepare(df.sparkSession)
    want = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns():
            for b in batches:
                if b.num_rows:
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        release_memory()

    return df.mapInArrow(run, want)


def map_rows(df: DataFrame, text_col: str, fn: Callable[[], Callable[[list], tuple]], length_col: str | None = None) -> DataFrame:
    """All columns of ``df``, some rows dropped or texts changed, without taking the other columns apart.

    ``fn()``, called once per task, gives a function from a batch's texts to (mask or None,
    texts or None); new texts also set ``length_col`` to their lengths.
    """
    prepare(df.sparkSession)
    columns, at = df.columns, df.columns.index(text_col)
    size = columns.index(length_col) if length_col in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fn()
        for b in batches:
            mask, texts = own(b.column(at).to_pylist())
            if texts is not None:
                arrays = [b.column(k) for k in range(b.num_columns)]
                arrays[at] = pa.array(texts, type=arrays[at].type)
                if size is not None:
                    arrays[size] = pa.array([None if t is None else len(t) for t in texts], type=arrays[size].type)
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b if mask is None else b.filter(pa.array(mask, type=pa.bool_()))
        release_memory()

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local one is made only where none is set and all of Spark is this one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="widecairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and lost executors can't lose it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/widecairn/{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except BaseException:
        _delete(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator: all are deleted at the end of the block, whether it ends well or not."""

    def __enter__(self) -> Scratch:
        self.tables: list[DataFrame] = []
        return self

    def __exit__(self, *_) -> None:
        discard(*self.tables)

    def stored(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]


def column(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(df: DataFrame, name: str) -> str:
    """A column's name and type, for a schema in words."""
    return f"{quoted(name)} {df.schema[name].dataType.simpleString()}"


def long_id(df: DataFrame, name: str) -> Column:
    """The id column as long; ids of another kind than integers are refused before any job runs."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"column {name} holds {kind.simpleString()}, ids are integers")
    return column(name).cast("long")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(column(col).cast("string"), F.lit(""))
