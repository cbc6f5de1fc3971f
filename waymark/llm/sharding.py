"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) are taken by falling size, and each enters the bin with the tightest remaining
capacity that still holds it.  Bins live in a balanced tree keyed by remaining capacity.  Groups of one size are
interchangeable, so the driver packs runs ``(size, count)``: there are at most sqrt(2 x total bytes) distinct
sizes, whatever the number of groups.  The groups themselves, their ranks within a size and the slots stay
distributed.

Defined cases: null text counts as empty (and is grouped with it); an empty table gives no rows; a group larger
than a shard's fair share gets a shard of its own; repeated rows are rows of one group.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import Scope, join_groups, materialize, salted_row_number

ROW_OVERHEAD = 16
SHARDS = 40
#: Rows that one window task numbers, about.
ROWS_A_TASK = 1_000_000
#: The least capacity is found to one part in so many, mostly at the first or second try.
TOLERANCE = 100_000


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


class BalancedTree:
    """AA tree of comparable keys: insert, delete and the least key not below a bound, each in O(log n)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t.left and t.left.level == t.level:
            l = t.left
            t.left, l.right = l.right, t
            return l
        return t

    @staticmethod
    def _split(t):
        if t.right and t.right.right and t.right.right.level == t.level:
            r = t.right
            t.right, r.left = r.left, t
            r.level += 1
            return r
        return t

    def insert(self, key) -> None:
        def go(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.left = go(t.left)
            elif key > t.key:
                t.right = go(t.right)
            return self._split(self._skew(t))

        self.root = go(self.root)

    def delete(self, key) -> None:
        level = lambda t: t.level if t else 0

        def go(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = go(t.left, key)
            elif key > t.key:
                t.right = go(t.right, key)
            elif t.left is None:
                return t.right
            elif t.right is None:
                return t.left
            else:
                heir = t.right
                while heir.left:
                    heir = heir.left
                t.key = heir.key
                t.right = go(t.right, heir.key)
            least = min(level(t.left), level(t.right)) + 1
            if least < t.level:
                t.level = least
                if t.right and t.right.level > least:
                    t.right.level = least
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            if t.right:
                t.right = self._split(t.right)
            return t

        self.root = go(self.root, key)

    def ceiling(self, bound):
        t, best = self.root, None
        while t:
            if t.key >= bound:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


@dataclass(frozen=True)
class Run:
    """Groups ``lo`` to ``hi - 1`` (ranks) of one size go to one shard."""

    size: int
    lo: int
    hi: int
    shard: int


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, first_bin: int = 0, most: int | None = None, skip: int = 0) -> tuple[list[Run], int] | None:
    """Pack ``sizes`` (size, count), sorted by falling size, into bins of ``capacity``; returns runs and bins.

    A new bin is opened when no open one fits; with ``most`` bins exceeded the result is None.  A group larger
    than the capacity fills a bin alone.  ``skip`` groups of the first size are already placed.
    """
    tree, runs, n = BalancedTree(), [], 0
    for at, (size, count) in enumerate(sizes):
        placed = skip if at == 0 else 0
        while placed < count:
            found = tree.ceiling((size, -1))
            if found is None:
                if most is not None and n >= most:
                    return None
                found = (max(capacity, size), n)
                n += 1
            else:
                tree.delete(found)
            left, bin_ = found
            take = min(count - placed, left // size) if size else count - placed
            runs.append(Run(size, placed, placed + take, first_bin + bin_))
            placed += take
            tree.insert((left - take * size, bin_))
    return runs, n


def pack_evenly(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs for exactly ``shards`` fixed-capacity bins, with the least capacity (found by bisection) that holds all.

    Groups that exceed the fair share of what is left get a shard of their own first, so that one huge group
    doesn't raise the capacity of the others.
    """
    sizes = sorted((x for x in sizes if x[1]), reverse=True)
    total, bins, runs, skip, at = sum(s * c for s, c in sizes), shards, [], 0, 0
    while at < len(sizes) and bins > 1 and sizes[at][0] * bins >= total:
        size, count = sizes[at]
        runs.append(Run(size, skip, skip + 1, shards - bins))
        total, bins, skip = total - size, bins - 1, skip + 1
        if skip == count:
            at, skip = at + 1, 0
    rest = sizes[at:]
    if not rest:
        return runs
    lo = max(-(-total // bins), rest[0][0])
    hi = lo
    step = max(1, lo // TOLERANCE)
    best = best_fit_decreasing(rest, hi, shards - bins, bins, skip)
    while best is None:
        lo, hi, step = hi + 1, hi + step, step * 4
        best = best_fit_decreasing(rest, hi, shards - bins, bins, skip)
    while hi - lo > max(1, lo // TOLERANCE):
        mid = (lo + hi) // 2
        got = best_fit_decreasing(rest, mid, shards - bins, bins, skip)
        lo, hi, best = (lo, mid, got) if got else (mid + 1, hi, best)
    return runs + best[0]


def shard_groups(rows: DataFrame, group: str, size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Columns ``group``, ``shard`` (int) and ``n_rows``, one row a group.

    ``rows`` has a row for each member, with its size.  Either the number of ``shards`` is fixed and their
    capacity is made as small as possible, or ``capacity`` is fixed and as few shards as it takes are opened.
    """
    spark = rows.sparkSession
    sums = rows.groupBy(F.col(group).alias("_w_g")).agg(F.sum(size).cast("long").alias("_w_size"), F.count(F.lit(1)).alias("n_rows"))
    sums = materialize(sums, "groups")
    found = sums.groupBy("_w_size").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most sqrt(2 x bytes) rows
    counts = list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    if shards is not None:
        runs = pack_evenly(counts, shards)
    else:
        runs, _ = best_fit_decreasing(sorted(counts, reverse=True), capacity)
    columns = zip(*[(r.size, r.lo, r.hi, r.shard) for r in runs], strict=True) if runs else [[]] * 4
    shape = pa.schema([("_w_size", pa.int64()), ("_w_lo", pa.int64()), ("_w_hi", pa.int64()), ("shard", pa.int32())])
    placed = spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, shape, strict=True)], shape))
    # a size that many groups have is dealt over as many tasks as its own number asks for
    parts = max(8, -(-max((c for _, c in counts), default=0) // ROWS_A_TASK))
    ranked = salted_row_number(sums, "_w_size", F.xxhash64("_w_g"), [F.col("_w_g")], "_w_rank", parts)
    return (
        ranked.join(placed, "_w_size")
        .where((F.col("_w_rank") >= F.col("_w_lo")) & (F.col("_w_rank") < F.col("_w_hi")))
        .select(F.col("_w_g").alias(group), "shard", "n_rows")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and its gapless slot there; equal texts share a shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    with Scope(docs.sparkSession) as scope:
        keys = materialize(
            docs.select(
                F.col(doc_id).alias("doc_id"),
                (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
                F.crc32(body.cast("binary")).alias("text_crc32"),
                F.unhex(F.sha2(body, 256)).alias("digest"),
            ),
            "shard-keys",
        )
        bins = materialize(shard_groups(keys, "digest", "size", shards), "shard-bins")
        placed = scope.keep(materialize(join_groups(keys, bins, "digest", "n_rows").drop("n_rows"), "shard-rows"))
    parts = max(8, placed.count() // (ROWS_A_TASK * shards))
    out = salted_row_number(placed, "shard", F.xxhash64("doc_id"), [F.col("doc_id"), F.col("digest")], "slot", parts)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
