"""Reproducible samples of truth: hash order, top n, quotas under caps."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.functions import text


def hash_order(seed: str, *parts: Column) -> Column:
    """A hexadecimal digest that orders rows at random, the same in every run."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per task before it deals rows out."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_w_n", F.row_number().over(w)).where(F.col("_w_n") <= n).drop("_w_n")


def least_record(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key: the least in the given order."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def pressure(rows: DataFrame, by: str, dims: dict[str, int]) -> DataFrame:
    """How hard each row's groups press on their caps: the largest group size over its cap."""
    parts = [F.count(F.lit(1)).over(W.partitionBy(by, d)) / F.lit(float(cap)) for d, cap in dims.items()]
    return rows.withColumn("pressure", F.greatest(*parts) if len(parts) > 1 else parts[0])


def packing_bound(rows: DataFrame, by: str, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """No selection can have more rows than this: rows, distinct keys, and groups cut to their caps."""
    base = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows_"), *[F.count_distinct(k).alias(f"d_{k}") for k in keys])
    parts = ["rows_", *[f"d_{k}" for k in keys]]
    for dim, cap in caps.items():
        cut = rows.groupBy(by, dim).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("c")).groupBy(by).agg(F.sum("c").alias(f"c_{dim}"))
        base = base.join(cut, by)
        parts.append(f"c_{dim}")
    return base.select(by, F.least(*parts).alias("bound"))


def collisions(rows: DataFrame, key: list[str], family: str) -> DataFrame:
    """Rows of keys that more than one family holds; partial counts first, so that a hot key is no hot task."""
    shared = rows.groupBy(*key).agg(F.count_distinct(family).alias("families")).where("families > 1").drop("families")
    return rows.join(shared, key, "left_semi")


def outside(rows: DataFrame, retained: DataFrame, key: str, spot: str) -> DataFrame:
    """Rows that share neither key nor spot with retained ones."""
    return rows.join(retained.select(key).distinct(), key, "left_anti").join(retained.select(spot).distinct(), spot, "left_anti")


def greedy(rows: DataFrame, by: str, quota: int, keys: list[str], caps: dict[str, int], order: list[str]) -> DataFrame:
    """Up to ``quota`` rows a group, taken in order; a row that repeats a key or exceeds a cap is passed over.

    Of rows that are alike in all keys and caps only the first can be taken, unless there are no keys: then the first
    rows up to the smallest cap.  Those are found with partial sorts; what is left of a group streams through one task
    in order, which remembers no more than the rows that it takes.
    """
    from waymark.runtime import ship

    most = 1 if keys else min([quota, *caps.values()])
    first = top_n(rows, [by, *keys, *caps], [F.col(c) for c in order], most)
    dealt = first.repartition(by).sortWithinPartitions(by, *order)
    ship(rows.sparkSession)

    def pick(batches):
        group, count, seen, used = None, 0, set(), Counter()
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in {by, *keys, *caps}}
            taken = []
            for i, g in enumerate(cols[by]):
                if i == 0 and group is None or g != group[0]:
                    group, count, seen, used = (g,), 0, set(), Counter()
                own = [(k, cols[k][i]) for k in keys]
                held = [(c, cols[c][i]) for c in caps]
                if count < quota and not any(x in seen for x in own) and all(used[x] < caps[x[0]] for x in held):
                    seen.update(own)
                    used.update(held)
                    count += 1
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    return dealt.mapInArrow(pick, rows.schema)


def first_wins(rows: DataFrame, by: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in order, without those that share any key with an earlier one that stayed."""
    return greedy(rows, by, 1 << 62, keys, {}, order)


def quota(rows: DataFrame, by: str, first: Column, order: list[Column], n: int) -> DataFrame:
    """n rows a group: those of ``first`` in order, then the others."""
    return top_n(rows.withColumn("_w_f", F.when(first, 0).otherwise(1)), [by], [F.asc("_w_f"), *order], n).drop("_w_f")


def percent_cap(quota: int, percent: float = 4.0, least: int = 8) -> int:
    """How many rows of one city, category or network a sample of ``quota`` rows may hold."""
    return max(least, math.ceil(quota * percent / 100))


def hash_sample(rows: DataFrame, seed: str, key: Column, n: int) -> DataFrame:
    """n rows at random, the same in every run: the first in hash order.  Each task keeps n, and so does the last."""
    return rows.orderBy(hash_order(seed, key), key).limit(n)


def unpacked(rows: DataFrame, column: str) -> DataFrame:
    """The structs of an array column as rows."""
    return rows.select(F.inline(column))


def marked_collisions(rows: DataFrame, retained: DataFrame, key: str, spot: str) -> DataFrame:
    """``rows`` with ``collided``: whether a retained row has their key or their spot."""
    have = lambda c: retained.select(F.col(c).alias(f"_w_{c}")).where(F.col(c).isNotNull()).distinct()
    out = rows.join(have(key), F.col(key) == F.col(f"_w_{key}"), "left").join(have(spot), F.col(spot) == F.col(f"_w_{spot}"), "left")
    return out.withColumn("collided", F.col(f"_w_{key}").isNotNull() | F.col(f"_w_{spot}").isNotNull()).drop(f"_w_{key}", f"_w_{spot}")


def duplicate_keys(record_id: Column, query: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """The three keys by which truth rows repeat each other: id, letters and digits of the query, place to five decimals."""
    at = lambda c: F.format_number(F.round(c, 5) + F.lit(0.0), 5)
    return {"id_key": record_id.cast("string"), "query_key": text.truth_key(query), "spot_key": F.concat_ws(",", at(lat), at(lon))}


def phased(rows: DataFrame, by: str, phases: dict[str, tuple[Column, int]], keys: list[str], caps: dict[str, int], order: list[str]) -> DataFrame:
    """Rows of each group taken in phases, with the name of their phase.

    A phase has a condition and a quota; it goes through its rows in order of pressure (the largest and then the sum of
    group size over cap, within the phase) and then of ``order``.  A row that repeats a key of any row taken so far, or
    exceeds a cap, is passed over; null and empty values of a capped column are not capped.

    Of a phase's rows that are alike in all keys and caps only the first can be taken, which partial sorts find; what is
    left of a group streams through one task, which remembers only what it takes.
    """
    from waymark.runtime import ship

    names = list(phases)
    quotas = [q for _, q in phases.values()]
    turns = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, (c, _) in enumerate(phases.values())]))
    out = rows.withColumn("_w_phase", F.explode(turns))
    set_ = lambda d: F.coalesce(F.col(d).cast("string"), F.lit("")) != ""
    press = [F.when(set_(d), F.count(F.lit(1)).over(W.partitionBy(by, "_w_phase", d)) / F.lit(float(cap))) for d, cap in caps.items()]
    zero = F.lit(0.0)
    out = out.withColumn("_w_most", F.coalesce(F.array_max(F.array(*press, zero)), zero)).withColumn("_w_sum", sum((F.coalesce(p, zero) for p in press), zero))
    sort = ["_w_phase", "_w_most", "_w_sum", *order]
    dealt = top_n(out, [by, "_w_phase", *keys, *caps], [F.col(c) for c in sort], 1) if keys else out
    dealt = dealt.repartition(by).sortWithinPartitions(by, *sort)
    ship(rows.sparkSession)

    def pick(batches):
        group, taken, seen, used = None, Counter(), set(), Counter()
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in {by, "_w_phase", *keys, *caps}}
            chosen = []
            for i, g in enumerate(cols[by]):
                if group is None or g != group[0]:
                    group, taken, seen, used = (g,), Counter(), set(), Counter()
                phase = cols["_w_phase"][i]
                own = [(k, cols[k][i]) for k in keys]
                held = [(c, cols[c][i]) for c in caps if cols[c][i] not in (None, "")]
                if taken[phase] < quotas[phase] and not any(x in seen for x in own) and all(used[x] < caps[x[0]] for x in held):
                    seen.update(own)
                    used.update(held)
                    taken[phase] += 1
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    got = dealt.mapInArrow(pick, dealt.schema)
    phase = F.element_at(F.array(*map(F.lit, names)), F.col("_w_phase") + 1)
    return got.withColumn("phase", phase).select(*rows.columns, "phase")


def certificate(rows: DataFrame, by: str, required: dict[str, tuple[Column, int]], keys: list[str], caps: dict[str, int]) -> DataFrame:
    """For each group and pool, whether elementary packing bounds prove that its quota can't be met.

    A row a pool: required, upper_bound, the constraints that give it, and ``infeasible``.  A capped column bounds the
    rows by the sum of its groups, each cut to the cap, and its rows without a value.
    """
    pools = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (c, _) in required.items()])))
    out = rows.withColumn("pool", pools)
    bounds = out.groupBy(by, "pool").agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(k).alias(f"{k}_keys") for k in keys])
    parts = ["rows", *[f"{k}_keys" for k in keys]]
    for d, cap in caps.items():
        free = F.coalesce(F.col(d).cast("string"), F.lit("")) == ""
        cut = out.groupBy(by, "pool", d).agg(F.count(F.lit(1)).alias("n"))
        cut = cut.groupBy(by, "pool").agg(F.sum(F.when(free, F.col("n")).otherwise(F.least("n", F.lit(cap)))).alias(f"{d}_cap"))
        bounds, parts = bounds.join(cut, [by, "pool"]), [*parts, f"{d}_cap"]
    want = F.element_at(F.create_map(*[x for n, (_, q) in required.items() for x in (F.lit(n), F.lit(q))]), F.col("pool"))
    bounds = bounds.withColumn("upper_bound", F.least(*parts)).withColumn("required", want)
    limiting = F.array_sort(F.array_compact(F.array(*[F.when(F.col(p) == F.col("upper_bound"), F.lit(p)) for p in parts])))
    return bounds.select(by, "pool", "required", "upper_bound", limiting.alias("limiting"), (F.col("upper_bound") < F.col("required")).alias("infeasible"))


def duplicate_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows, and for each key how many distinct values, and rows whose value occurs more than once."""
    parts = []
    for k in keys:
        n = rows.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        parts.append(n.agg(F.lit(k).alias("key"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    values = [F.max(F.when(F.col("key") == k, F.col(c))).alias(f"{c}_{k}") for k in keys for c in ("distinct", "repeated")]
    return whole.agg(F.max("rows").alias("rows"), *values)


def selection_profile(candidates: DataFrame, selected: DataFrame, kind: str, caps: dict[str, int]) -> DataFrame:
    """A row for each ``kind`` with its candidates and selected rows, and for each capped column the largest group and the cap."""
    n = lambda df, fact: df.groupBy(F.lit(fact).alias("fact"), F.col(kind).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = n(candidates, "candidates").unionByName(n(selected, "selected"))
    for d, cap in caps.items():
        used = selected.where(F.coalesce(F.col(d).cast("string"), F.lit("")) != "").groupBy(d).agg(F.count(F.lit(1)).alias("n"))
        most = used.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        out = out.unionByName(most.select(F.lit("largest").alias("fact"), F.lit(d).alias("name"), "n"))
        out = out.unionByName(most.select(F.lit("cap").alias("fact"), F.lit(d).alias("name"), F.lit(cap).cast("long").alias("n")))
    return out
