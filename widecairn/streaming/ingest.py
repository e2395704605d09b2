"""Continuous ingestion: every micro-batch of a stream is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def ingest(engine: Engine, table: str, stream: DataFrame, checkpoint: str, order_by: str | None = None, **trigger) -> StreamingQuery:
    """Write a streaming DataFrame into a keyed table.

    A batch that is run again after a failure writes the same rows over themselves, so the
    table ends up the same.  ``order_by`` says which of a batch's rows with one key is last.
    """

    def batch(df: DataFrame, _: int) -> None:
        engine.load(table, df, order_by)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
