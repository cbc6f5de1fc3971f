"""Exact top-k search by three-phase uniform threshold.

1. Every partition gathers a local list for each query: one product in single precision gives each score with a bound of
   its error, and what may be among the partition's k best is listed as an interval (low, high).  The k-th largest low of
   all lists is a safe cutoff: k rows score at least that much.
2. The cutoffs are broadcast, and the listed entries whose high reaches them are collected.  The lists are kept, so no
   score is computed a second time for this.
3. Only the collected entries are resolved exactly, in whole numbers, and ranked, ties to the smaller id.

Equal vectors of a chunk score alike, so all but the k + 1 with the smallest ids leave before the product; where more
than 2k others come near a partition's cutoff, as with few distinct scores, they are resolved at once and k remain.
So a list has few entries, whatever the ties.  Queries run in blocks of bounded size against all rows.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without an id take no
part; of query rows that repeat an id the least vector asks; candidates that repeat an id are separate rows, and
none is a candidate for its own id; shorter vectors count as padded with zeros; scores beyond a long are clipped; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.llm.common import map_arrow, materialize

SCALE = 1024
#: Queries of one block, about; the matrix that is broadcast has so many rows.
QUERY_BLOCK = 16_384
#: Scores held at once by a task.
CELLS = 2_000_000
#: Entries that a task holds before it drops those that its cutoff has left behind.
HELD = 4_000_000
_LIMIT = 2**63 - 1
_MOST = np.finfo(np.float64).max


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(vector)
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("x")
    )


def scaled(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of every vector as float64 integers, padded with zeros to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    with np.errstate(over="ignore"):
        out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(flat * scale), -_MOST, _MOST)
    return out


def _whole(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` with those of ``v``, one by one; exact: doubles where they hold them, else Python's integers."""
    d = min(q.shape[1], v.shape[1])
    q, v = q[:, :d], v[:, :d]
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * d < 2.0**52:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    return np.array([max(-_LIMIT - 1, min(_LIMIT, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for a, b in zip(q, v, strict=True)], dtype=np.int64)


class Queries:
    """A block of queries, ready for products."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.unit, self.norm = self._unit(x)

    @staticmethod
    def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.abs(x).max(axis=1, initial=0)
        small = x / np.where(most > 0, most, 1)[:, None]
        size = np.sqrt((small * small).sum(axis=1))
        with np.errstate(over="ignore"):
            return (small / np.where(size > 0, size, 1)[:, None]).astype(np.float32), size * most

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the (clipped) scores of every query with every row of ``v``."""
        d = min(self.x.shape[1], v.shape[1])
        unit, norm = self._unit(v)
        with np.errstate(over="ignore", invalid="ignore"):
            size = self.norm[:, None] * norm[None, :]
            got = (self.unit[:, :d] @ unit[:, :d].T).astype(np.float64) * size
            err = size * ((d + 8) * 2.0**-22)  # four times what rounding can add up to
            known = np.isfinite(size)
            return np.where(known, np.minimum(got - err, 2.0**63), -np.inf), np.where(known, np.maximum(got + err, -(2.0**63)), np.inf)


def _first_copies(ids: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` smallest ids of each distinct vector."""
    kind = np.unique(v, axis=0, return_inverse=True)[1].ravel() if len(v) > most else np.arange(len(v))
    order = np.lexsort((ids, kind))
    turn = np.arange(len(v)) - np.searchsorted(kind[order], kind[order])
    return order[turn < most]


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))  # ~ turns the order of whole numbers and can't overflow
    turn = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[turn < k]


def local_lists(batches, queries: Queries, k: int, scale: int):
    """(query position, vec_id, low, high) of what may be among the k best of these rows."""
    n = len(queries.ids)
    best = np.full((n, k), -np.inf)
    held, count = [], 0
    step = max(64, CELLS // max(1, n))

    def near(parts):
        qi, ids, low, high = map(np.concatenate, zip(*parts, strict=True))
        ok = high >= best.min(axis=1)[qi]
        return qi[ok], ids[ok], low[ok], high[ok]

    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            ids, v = part.column(0).to_numpy(), scaled(part.column(1), scale)
            own = _first_copies(ids, v, k + 1)
            ids, v = ids[own], v[own]
            low, high = queries.bounds(v)
            low[queries.ids[:, None] == ids[None, :]] = -np.inf
            best = -np.partition(-np.concatenate((best, low), axis=1), k - 1, axis=1)[:, :k]
            qi, vi = np.nonzero((high >= best.min(axis=1)[:, None]) & (queries.ids[:, None] != ids[None, :]))
            crowded = (np.bincount(qi, minlength=n) > 2 * k)[qi]
            held.append((qi[~crowded], ids[vi[~crowded]], low[qi[~crowded], vi[~crowded]], high[qi[~crowded], vi[~crowded]]))
            if crowded.any():
                qi, vi = qi[crowded], vi[crowded]
                for lo in range(0, n, step):  # bounded copies
                    some = (qi >= lo) & (qi < lo + step)
                    if some.any():
                        q, w = qi[some], vi[some]
                        exact = _whole(queries.x[q], v[w])
                        top = _first(q, exact, ids[w], k)
                        # as intervals: doubles next to the whole number
                        f = exact[top].astype(np.float64)
                        held.append((q[top], ids[w[top]], np.nextafter(f, -np.inf), np.nextafter(f, np.inf)))
            count += sum(len(x[0]) for x in held[-2:])
            if count > HELD:
                held = [near(held)]
                count = len(held[0][0])
    if held:
        yield near(held)


def _search_block(rows: DataFrame, queries: Queries, k: int, scale: int) -> DataFrame:
    """query_id, vec_id and score of every entry that may be among a query's k best."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def gather(batches):
        for qi, ids, low, high in local_lists(batches, sent.value, k, scale):
            cols = [pa.array(sent.value.ids[qi]), pa.array(ids), pa.array(low), pa.array(high)]
            for b in pa.Table.from_arrays(cols, ["query_id", "vec_id", "low", "high"]).to_batches(max_chunksize=100_000):
                yield b

    lists = materialize(map_arrow(rows, gather, "query_id long, vec_id long, low double, high double"), "topk-lists")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low")))
    cutoffs = lists.select("query_id", "low", turn.alias("n")).where(F.col("n") <= k).groupBy("query_id")
    cutoffs = cutoffs.agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(float("-inf")).alias("cutoff"))
    # a row for each query of the block
    wanted = lists.join(F.broadcast(cutoffs), "query_id").where(F.col("high") >= F.col("cutoff")).select("query_id", "vec_id").distinct()
    wanted = materialize(wanted, "topk-entries")
    vectors = rows.join(wanted.select("vec_id").distinct(), "vec_id", "left_semi")
    entries = wanted.join(vectors, "vec_id").select("query_id", "vec_id", "x")

    def resolve(batches):
        own = sent.value
        order = np.argsort(own.ids)
        for b in batches:
            if b.num_rows:
                at = order[np.searchsorted(own.ids[order], b.column(0).to_numpy())]
                score = _whole(own.x[at], scaled(b.column(2), scale))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    return materialize(map_arrow(entries, resolve, "query_id long, vec_id long, score long"), "topk-scores")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best rows of every query."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector)
    asks = materialize(usable(vectors.where(is_query), vec_id, vector).groupBy("vec_id").agg(F.min("x").alias("x")), "topk-queries")
    n = asks.count()
    parts = -(-n // QUERY_BLOCK)
    found = None
    for b in range(parts):
        own = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toArrow().combine_chunks()  # QUERY_BLOCK rows, about
        if not own.num_rows:
            continue
        part = _search_block(rows, Queries(own.column(0).to_numpy(), scaled(own.column(1).combine_chunks(), scale)), k, scale)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
