"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / w, with u uniform from a hash of its id and w its quality weight; sorted by
key within its source, documents are a weighted sample without replacement in any prefix.  A source's target is
met by complete epochs first (every document, floor(target / size) times) and then by the prefix whose size
comes nearest to what is left.  Prefix sums run over key ranges of a source side by side, so a source that holds
a third of the rows is many tasks.

Targets share the total by weight; a source's target stops at ``max_epochs`` times its size and the excess is
reshared among the others, which is water filling: with sources sorted by cap / weight, the capped ones come first.

Defined cases: null text counts as size 0, is never counted and keeps its row; sources sort by code point with
null last; an empty table gives no rows; rows that repeat an id share its key and are taken one by one, also by
``mix_documents``; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from waymark.llm.common import Scope, materialize

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source that one window group sorts, about.
ROWS_A_RANGE = 4000
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, n_bytes, size (words) and text_hash of every row."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), n(F.octet_length(text)).alias("n_bytes"),
        n(F.regexp_count(text, F.lit(WORD))).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (one row each: source, source_size, n_rows) with sid, target, full epochs and the rest to select."""
    order = F.col("source").asc_nulls_last()
    ranked = sources.withColumn("sid", F.row_number().over(W.orderBy(order)).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("_w_weight", weight.cast("long")).withColumn("_w_cap", F.col("source_size") * max_epochs)
    ranked = ranked.withColumn("_w_ratio", F.col("_w_cap").cast("double") / F.col("_w_weight"))
    before = W.orderBy("_w_ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_w_cap").over(before), F.lit(0))
    heavy = F.sum("_w_weight").over(everything) - F.coalesce(F.sum("_w_weight").over(before), F.lit(0))
    ranked = ranked.withColumn("_w_level", left.cast("double") / heavy).withColumn("_w_capped", F.col("_w_level") > F.col("_w_ratio"))
    # the level of the first source, in this order, that isn't capped holds for all that follow
    level = F.min_by("_w_level", F.struct("_w_capped", "_w_ratio", "sid")).over(everything)
    target = F.when(F.col("_w_capped"), F.col("_w_cap").cast("double")).otherwise(level * F.col("_w_weight"))
    size = F.col("source_size")
    full = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.col("target") / size)).cast("long")
    out = ranked.withColumn("target", target).withColumn("_w_full", full)
    return out.withColumn("_w_rest", F.col("target") - F.col("_w_full") * size).select(
        "source", "source_size", "n_rows", "sid", "target", "_w_full", "_w_rest"
    )


def quality_weight() -> F.Column:
    """1 for words of six bytes on average, falling to 1/4 for texts far from it."""
    mean = F.col("n_bytes").cast("double") / F.greatest(F.col("size"), F.lit(1))
    return F.greatest(F.lit(0.25).cast("double"), F.lit(6.0) / (F.lit(6.0) + F.abs(mean - F.lit(6.0))))


def exponential_key(seed: str) -> F.Column:
    h = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.col("_w_quality")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix|", **columns: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every row, with its source, epochs (times taken), n_bytes and text_hash."""
    rows = materialize(sized(docs, **columns).withColumn("_w_quality", quality_weight()), "mix-sizes")
    plan = materialize(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), weights, max_epochs), "mix-plan"
    )
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(ROWS_A_RANGE)))
    keyed = (
        rows.withColumn("_w_key", exponential_key(seed))
        .join(plan.withColumnRenamed("source", "_w_source"), F.col("source").eqNullSafe(F.col("_w_source")))
        # grows with the key, and about even over the ranges
        .withColumn("_w_range", F.floor((F.lit(1.0) - F.exp(-F.col("_w_key") * F.lit(0.8))) * ranges * F.lit(0.999999)).cast("long"))
        .drop("_w_source")
    )
    keyed = materialize(keyed, "mix-keys")
    sums = keyed.groupBy("sid", "_w_range").agg(F.sum("size").alias("_w_sum"))
    before = W.partitionBy("sid").orderBy("_w_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("sid").alias("_w_sid"), F.col("_w_range").alias("_w_r"), F.coalesce(F.sum("_w_sum").over(before), F.lit(0)).alias("_w_offset"))
    offsets = materialize(offsets, "mix-offsets")
    own = W.partitionBy("sid", "_w_range").orderBy("_w_key", "doc_id", "size", "n_bytes", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    summed = keyed.withColumn("_w_cum", F.sum("size").over(own)).join(
        offsets, (F.col("sid") == F.col("_w_sid")) & (F.col("_w_range") == F.col("_w_r"))
    )
    total = F.col("_w_cum") + F.col("_w_offset")
    chosen = (total * 2 - F.col("size")).cast("double") <= F.col("_w_rest") * 2
    epochs = F.col("_w_full") + F.when(chosen & (F.col("size") > 0), 1).otherwise(0)
    return summed.withColumn("epochs", epochs.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).cast("long").alias("taken"), "source", "epochs", "n_bytes", "text_hash"
    )


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as many times as the mix takes it.

    Rows that repeat an id, source and text are alike, and their epochs are dealt out among them.
    """
    alike = ["_w_id", "_w_source", "_w_bytes", "_w_hash"]
    with Scope(docs.sparkSession) as scope:
        times = mix(docs, doc_id=doc_id, source=source, text=text, **options).select(
            F.col("doc_id").alias("_w_id"), F.col("source").alias("_w_source"), F.col("n_bytes").alias("_w_bytes"), F.col("text_hash").alias("_w_hash"), "epochs"
        )
        times = times.groupBy(*alike).agg(F.sum("epochs").alias("_w_times"), F.count(F.lit(1)).alias("_w_rows")).where("_w_times > 0")
        times = scope.keep(materialize(times, "mix-times"))
    own = {
        "_w_i": F.col(doc_id).cast("long"), "_w_s": F.col(source), "_w_b": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
        "_w_h": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    }
    same = F.col("_w_i").eqNullSafe(F.col("_w_id")) & F.col("_w_s").eqNullSafe(F.col("_w_source")) & (F.col("_w_b") == F.col("_w_bytes")) & (F.col("_w_h") == F.col("_w_hash"))
    found = docs.withColumns(own).join(times, same)
    taken = found.where("_w_rows = 1").withColumn("_w_n", F.col("_w_times"))
    if not times.where("_w_rows > 1").isEmpty():
        turn = F.row_number().over(W.partitionBy(*alike).orderBy(F.lit(0)))
        many = found.where("_w_rows > 1").withColumn("_w_n", F.expr("_w_times div _w_rows") + F.when(turn <= F.col("_w_times") % F.col("_w_rows"), 1).otherwise(0))
        taken = taken.unionByName(many.where("_w_n > 0"))
    taken = taken.withColumn("_w_n", F.explode(F.sequence(F.lit(1), F.col("_w_n").cast("int"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, (sid - 1) % 3 + 1 AS w, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / ((sid - 1) % 3 + 1) AS ratio FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM s2 WINDOW b AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN level > ratio THEN CAST(cap AS DOUBLE)
                 ELSE (SELECT level FROM s3 x WHERE NOT x.level > x.ratio ORDER BY x.ratio, x.sid LIMIT 1) * w END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS full_ FROM s4),
s6 AS (SELECT *, target - full_ * source_size AS rest FROM s5),
k AS (SELECT d.*, s6.source_size, s6.target, s6.full_, s6.rest, s6.sid,
        -ln((CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
        / greatest(CAST(0.25 AS DOUBLE), CAST(6.0 AS DOUBLE) / (CAST(6.0 AS DOUBLE) + abs(CAST(n_bytes AS DOUBLE) / greatest(size, 1) - 6.0))) AS key
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id, size, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k)
SELECT doc_id, size, source_size, target,
       CAST(size * (full_ + CASE WHEN size > 0 AND CAST(cum * 2 - size AS DOUBLE) <= rest * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
