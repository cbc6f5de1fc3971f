"""Geocoding of streams: each micro-batch runs the batch pipeline.

Ranking needs windows over a query's candidates, which streams don't have; a micro-batch does.  The file sink below is
idempotent: a batch that is replayed overwrites what it wrote before, so answers come exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def geocode_stream(queries: DataFrame, geocode, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start answering a stream of queries; ``geocode`` maps a table of queries to a table of answers."""

    def write(batch: DataFrame, number: int) -> None:
        geocode(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
