"""Exact deduplication with stateful streaming.

Keys (digest, stable identifier, content locator) stream through a keyed aggregation whose state lives in RocksDB
on disk, is versioned in the shared checkpoint folder and never expires.  Rows of one digest are reduced before
they are dealt out, so a digest that holds a third of the rows is no hot key.  Hits (digests seen more than once)
are then checked on their full bytes: rows are grouped by digest and bytes, copies within a partition meet before
anything is dealt out, and a digest with two groups stands for different texts.  Rows of such digests are grouped by
their bytes instead.  The locator is the file that holds the row that stays, for those who fetch its bytes later.

Of equal texts the row with the largest identifier stays.  Defined cases: null text counts as empty; a null
identifier loses to any other; rows that repeat the same identifier and text count in the group's size and share
its verdict (``drop_duplicates`` keeps one of them); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.llm.common import Scope, join_groups, materialize, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor holds many partitions' stores, and each takes an eighth of its write buffer at once
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streaming state is on disk."""
    own = spark.newSession()
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    for k, v in STATE_CONF.items():
        own.conf.set(k, v)
    return own


def keyed_state(stream: DataFrame) -> DataFrame:
    """The state of a stream of (doc_id, digest, locator): per digest the identifier and locator that stay, and the count."""
    newest = F.max(F.struct("doc_id", "locator")).alias("_w_top")
    return (
        stream.groupBy("digest")
        .agg(newest, F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("_w_top.doc_id").alias("keep_id"), F.col("_w_top.locator").alias("locator"), "group_size")
    )


def run_state(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stateful query; each micro-batch writes the digests that it changed, and a replay overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        keyed_state(stream)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each digest: counts only grow."""
    top = F.max(F.struct("group_size", "keep_id", "locator")).alias("_w_top")
    return spark.read.parquet(out).groupBy("digest").agg(top).select("digest", "_w_top.*")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256_of) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` makes the state's key from the text column; a weak one costs time, never a wrong result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    with Scope(spark) as scope:
        keyed = rows.select(
            "doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"), F.input_file_name().alias("locator")
        )
        keys = scope.keep(materialize(keyed, "dedup-keys"))
        if keys.isEmpty():
            return keys.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        own = state_session(spark)
        out = scratch_path(spark, "dedup-state")
        stream = own.readStream.schema(keys.schema).parquet(keys.inputFiles()[0].rsplit("/", 1)[0])
        run_state(stream, out, scratch_path(spark, "dedup-checkpoint")).awaitTermination()
        state = scope.keep(materialize(latest(spark, out), "dedup-latest"))
        groups = state.select("digest", "keep_id", "group_size")

        # full bytes on hits; a digest that was seen once has one group here as well, and no clash
        contents = rows.select(digest(F.col("text")).alias("digest"), "text").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
        mixed = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        mixed = scope.keep(materialize(mixed, "dedup-mixed"))
        clash = not mixed.isEmpty()
        if clash:
            found = rows.withColumn("digest", digest(F.col("text"))).join(mixed, "digest", "left_semi")
            found = scope.keep(materialize(found, "dedup-clashes"))
    joined = keys.withColumnRenamed("digest", "_w_digest")
    if clash:
        mixed_rows = found.join(mixed, "digest", "left_semi").withColumn("digest", F.concat("digest", F.lit("|"), F.base64(F.encode("text", "UTF-8"))))
        exact = mixed_rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = materialize(groups.join(mixed, "digest", "left_anti").unionByName(exact), "dedup-exact")
        full = rows.select(
            "doc_id", digest(F.col("text")).alias("_w_digest"), F.sha2("text", 256).alias("text_sha256"),
            F.concat(digest(F.col("text")), F.lit("|"), F.base64(F.encode("text", "UTF-8"))).alias("_w_full"),
        )
        whole = full.join(mixed.withColumnRenamed("digest", "_w_digest"), "_w_digest", "left_semi").select(
            "doc_id", F.col("_w_full").alias("_w_digest"), "text_sha256"
        )
        joined = joined.select("doc_id", "_w_digest", "text_sha256").join(mixed.withColumnRenamed("digest", "_w_digest"), "_w_digest", "left_anti")
        joined = joined.select("doc_id", "_w_digest", "text_sha256").unionByName(whole)
    groups = groups.withColumnRenamed("digest", "_w_digest")
    return join_groups(joined, groups, "_w_digest", "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, the one with the largest identifier, and all its columns."""
    with Scope(docs.sparkSession) as scope:
        kept = dedup(docs, doc_id, text).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_w_times"))
        stays = kept.select(F.col("doc_id").alias("_w_id"), F.col("text_sha256").alias("_w_sha"), "_w_times")
        stays = scope.keep(materialize(stays, "dedup-stays"))
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    out = docs.withColumn("_w_s", sha).join(stays, F.col(doc_id).cast("long").eqNullSafe(F.col("_w_id")) & (F.col("_w_s") == F.col("_w_sha")))
    if not stays.where("_w_times > 1").isEmpty():  # the same identifier and text more than once
        once, many = out.where("_w_times = 1"), out.where("_w_times > 1").dropDuplicates(["_w_id", "_w_sha"])
        out = once.unionByName(many)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
