"""Helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from waymark.runtime import Scope, delete_path, release, scratch_path, shared_dir, ship, written as materialize

__all__ = ["Scope", "delete_path", "join_groups", "map_arrow", "materialize", "read_table", "release", "salted_row_number", "scratch_path", "shared_dir", "ship"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _give_back() -> None:
    """Return what a task has freed to the system: workers live on, and their next task may be of another kind."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that one Arrow batch holds, about, on its way to a worker and back; texts make batches of rows of any size.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    """Set the session's batch size, unless somebody has already asked for another than Spark's own 64 MB."""
    if spark.conf.get(_BATCH_CONF).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def map_arrow(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """mapInArrow after the package has been sent to the executors, in batches of bounded bytes."""
    ship(df.sparkSession)
    _bound_batches(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        _give_back()

    return df.mapInArrow(run, schema)


#: A group with more than this part of all rows is hot; there are fewer hot groups than this number.
HOT_PART = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with what ``groups`` (one row a ``key``, of ``size`` rows) says of their group, and no task with all rows of a hot one.

    Fewer than HOT_PART groups can hold more than 1/HOT_PART of the rows each.  Those are broadcast, so their rows stay
    where they are; all others meet in a shuffle.  Both tables are read twice and should be written ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    big = F.col(size) * HOT_PART > total
    hot, rest = F.broadcast(groups.where(big)), groups.where(~big)  # fewer than HOT_PART rows
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def salted_row_number(df: DataFrame, key: str, salt: Column, order: list[Column], out: str, parts: int) -> DataFrame:
    """Gapless numbers from 0 within ``key`` that no single task has to make.

    The rows of a key are dealt over ``parts`` salts; each salt is numbered on its own, and the sizes of the
    salts before it are added.  The offsets table has keys x salts rows, whatever the input.
    ``df`` is read twice, so it should be a written table.
    """
    from pyspark.sql import Window as W

    s, n, o = "_w_salt", "_w_n", "_w_offset"
    df = df.withColumn(s, F.pmod(salt, F.lit(parts)).cast("int"))
    sizes = df.groupBy(key, s).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(key).orderBy(s).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("_w_key"), F.col(s).alias("_w_s"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(o)
    )
    own = F.row_number().over(W.partitionBy(key, s).orderBy(*order)) - 1
    # the offsets have at most keys x parts rows
    return (
        df.withColumn(out, own.cast("long"))
        .join(offsets, F.col(key).eqNullSafe(F.col("_w_key")) & (F.col(s) == F.col("_w_s")))
        .withColumn(out, F.col(out) + F.col(o))
        .drop(s, o, "_w_key", "_w_s")
    )
