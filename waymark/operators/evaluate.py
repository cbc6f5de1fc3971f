"""Scores of answers against truth: slices, intervals, paired tests and spreads."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import geo

Z = 1.959963984540054
THRESHOLD_M = 300.0


def judged(truth: DataFrame, answers: DataFrame, key: str, threshold: float = THRESHOLD_M) -> DataFrame:
    """Truth with ``hit`` and ``empty``: a missing answer is a miss."""
    a = answers.select(F.col(key), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    out = truth.join(a, key, "left")
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"), geo.METRES)
    empty = F.col("a_lat").isNull() | F.col("a_lon").isNull()
    return out.withColumn("empty", empty).withColumn("hit", ~empty & F.coalesce(far <= threshold, F.lit(False)))


def score(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Cases, hits, misses, empty answers and the hit rate for each slice, all in one pass; 'all' where a slice leaves a dimension out."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    n = F.count(F.lit(1))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(
        *[F.grouping(c).alias(f"_w_{c}") for c in dims], n.alias("cases"), F.count_if("hit").alias("hits"), F.count_if("empty").alias("empty")
    )
    shown = [F.when(F.col(f"_w_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in dims]
    return out.select(*shown, "cases", "hits", (F.col("cases") - F.col("hits")).alias("misses"), "empty", (F.col("hits") * 100.0 / F.col("cases")).alias("hit_pct"))


def wilson(hits: Column, cases: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval in per cent; null without cases."""
    n = cases.cast("double")
    p = hits / n
    low = 1.0 + Z * Z / n
    centre = (p + Z * Z / (2.0 * n)) / low
    half = Z / low * F.sqrt(p * (1.0 - p) / n + Z * Z / (4.0 * n * n))
    ok = lambda c: F.when(cases > 0, c * 100.0)
    return ok(F.greatest(F.lit(0.0), centre - half)), ok(F.least(F.lit(1.0), centre + half))


def paired(rows: DataFrame, by: list[str], one: str = "hit_a", two: str = "hit_b") -> DataFrame:
    """The two-by-two table of two engines' hits on the same cases."""
    a, b = F.col(one), F.col(two)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(a & b).alias("both_hit"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"),
        F.count_if(~a & ~b).alias("both_miss"),
    )


def mcnemar_p(only_a: int, only_b: int) -> float:
    """The exact two-sided p-value of a paired comparison, from whole numbers."""
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0
    tail = 2 * sum(math.comb(n, i) for i in range(k + 1))
    return min(1 << n, tail) / (1 << n)


def mcnemar(table: DataFrame) -> DataFrame:
    """``paired`` rows with their p-value."""
    from waymark.runtime import ship

    ship(table.sparkSession)

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(a, b, strict=True)])

    return table.withColumn("p_value", p("only_a", "only_b"))


def spread(rates: DataFrame, by: str, region: str, rate: str) -> DataFrame:
    """Best and worst region of each group, and the range between them; ties to the first name."""
    best = F.max_by(region, F.struct(F.col(rate), F.col(region)))
    worst = F.min_by(region, F.struct(F.col(rate), F.col(region)))
    return rates.groupBy(by).agg(
        best.alias("best"), F.max(rate).alias("best_rate"), worst.alias("worst"), F.min(rate).alias("worst_rate"), (F.max(rate) - F.min(rate)).alias("rate_range")
    )


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The middle element, the upper of two, never a mean.

    Values are sorted into ranges over all tasks; the sizes of the ranges say which range holds a group's middle, and
    only the rows of that range are numbered.  So no group is sorted by one task.
    """
    from pyspark.sql import Window as W

    from waymark.runtime import materialize

    known = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    # written, since ranges come from a sample; equal values share a range
    ranged = materialize(known.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "median-ranges")
    sizes = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("g")
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = F.floor(F.sum("n").over(w) / 2)
    found = sizes.select("g", "part", "n", (middle - before).alias("at")).where((F.col("at") >= 0) & (F.col("at") < F.col("n")))
    found = found.select(F.col("g").alias("_w_g"), F.col("part").alias("_w_part"), "at")
    inner = ranged.join(found, F.col("g").eqNullSafe(F.col("_w_g")) & (F.col("part") == F.col("_w_part")))
    inner = inner.withColumn("turn", F.row_number().over(W.partitionBy("g").orderBy("v")) - 1)
    return inner.where(F.col("turn") == F.col("at")).select(F.col("g").alias(by), F.col("v").alias("median"))


def filled_counts(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of every pair of the two columns' values, zero where there are none."""
    a, b = rows.select(left).distinct(), rows.select(right).distinct()
    counts = rows.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    grid = a.crossJoin(b)  # the values of two dimensions
    return grid.join(counts, [left, right], "left").select(left, right, F.coalesce("n", F.lit(0)).alias("n"))


def id_digest(rows: DataFrame, by: str, key: str) -> DataFrame:
    """SHA-256 over a group's sorted ids, one a line.

    The digest is sequential by nature: a group streams through one task in order, which holds no ids but the next.
    """
    from waymark.runtime import ship

    ship(rows.sparkSession)
    sorted_ = rows.select(F.col(by), F.col(key).cast("string").alias("id")).repartition(by).sortWithinPartitions(by, "id")
    shape = sorted_.select(by, F.lit("").alias("digest"), F.lit(0).cast("long").alias("n")).schema

    def run(batches):
        group, sha, n = None, None, 0
        kind = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([group[0]], kind), pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], [by, "digest", "n"])

        for b in batches:
            kind = b.column(0).type
            for g, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if group is None or g != group[0]:
                    if group is not None:
                        yield done()
                    group, sha, n = (g,), hashlib.sha256(), 0
                if i is not None:
                    sha.update(i.encode() + b"\n")
                n += 1
        if group is not None:
            yield done()

    return sorted_.mapInArrow(run, shape)


def truth_faults(rows: DataFrame, parts: list[str] = ()) -> DataFrame:
    """How many truth rows break each rule: one row.  With ``parts``, a query must be these columns joined by commas."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    per = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(blank("query") | blank("country")).alias("blank"), F.count_if(~geo.valid(F.col("lat"), F.col("lon"))).alias("bad_coords"),
        (F.count(F.lit(1)) - F.count_distinct("record_id")).alias("repeated_ids"),
    )
    from waymark.functions.text import address_key, compose

    key = F.struct("country", address_key(F.col("query")))
    spot = F.struct("country", F.round(F.col("lat") * 1e5), F.round(F.col("lon") * 1e5))
    more = rows.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_addresses"), (F.count(F.lit(1)) - F.count_distinct(spot)).alias("repeated_spots"))
    if parts:
        more = more.crossJoin(rows.agg(F.count_if(~F.coalesce(F.col("query") == compose(*[F.col(c) for c in parts]), F.lit(False))).alias("not_composed")))  # one row each
    return per.crossJoin(more)  # one row each
