"""Near-duplicate detection with HyperMinHash registers.

A document's shingle hashes are dealt over REGISTERS buckets by their leading bits.  Each bucket keeps its least
hash, compressed to the count of leading zeros and MANTISSA bits after the leading one: two bytes.  Equal sets are
one class, and only classes go on.  BAND registers make a band; classes that share a non-empty band meet in a
bucket.  In a bucket, pairs are taken whose sizes allow the similarity and whose collision-corrected estimate
from all registers is within six standard deviations of it, and they are confirmed on full shingle sets.  Only
links that join what isn't yet joined within the bucket are written, so output grows with members, not pairs.

At a similarity of 0.8 a pair shares none of 32 bands with a probability of 5e-8.  A bucket of more than CHUNK
classes, or whose full sets take more than CHUNK_BYTES, is cut by set size into steps so wide that a link never
crosses more than one border; steps that are still too large are cut into chunks.  Each pair of chunks of one step or
of neighbouring ones is a task of its own, which holds two chunks at most, and pairs of chunks whose sizes rule out
every link never exist.  A pair that shares several bands is handled in the first.

Defined cases: null counts as empty; texts without words have an empty set, link with nothing and stay; rows that
repeat an id are rows of their own, with one verdict if their texts are equal; null ids never name a component
unless all of its ids are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from waymark.llm.common import Scope, join_groups, map_arrow, materialize
from waymark.llm.components import connected_components
from waymark.llm.shingles import mix, shingle_sets
from waymark.llm.tokens import slices

REGISTERS = 128
BAND = 4
BANDS = REGISTERS // BAND
MANTISSA = 10
_BITS = 57  # of a hash, without the 7 that choose the bucket
CHUNK = 1024
CHUNK_BYTES = 48_000_000
#: Members whose pairs a task compares at once.
ROWS_AT_ONCE = 64
_EDGES = (np.arange(REGISTERS, dtype=np.uint64)) << np.uint64(_BITS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS uint16 for each set of sorted hashes; 0 is an empty bucket."""
    least = np.zeros((len(sets), REGISTERS), dtype=np.uint64)
    full = np.zeros((len(sets), REGISTERS), dtype=bool)
    own = np.arange(REGISTERS, dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            first = s[np.minimum(np.searchsorted(s, _EDGES), len(s) - 1)]
            full[i] = (first >> np.uint64(_BITS)) == own
            least[i] = first
    x = least & np.uint64((1 << _BITS) - 1)
    # bit length without rounding: 53 bits are exact in a double
    length = np.frexp((x >> np.uint64(4)).astype(np.float64))[1]
    length = np.where(length > 0, length + 4, np.frexp(x.astype(np.float64))[1])
    lead = _BITS - length
    top = x << np.minimum(lead + 64 - _BITS, 63).astype(np.uint64)  # the leading one is the top bit
    mantissa = (top << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    packed = ((lead + 1).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return np.where(full, packed, 0).astype(np.uint16)


def zero_odds(sizes: np.ndarray) -> np.ndarray:
    """For sets of ``sizes``, the odds of each count of leading zeros in a bucket that isn't empty."""
    a = sizes[:, None] / REGISTERS
    j = np.arange(_BITS + 1)
    high, low = 2.0**-j, np.where(j < _BITS, 2.0 ** -(j + 1.0), 0)
    p = np.exp(-a * low) - np.exp(-a * high)
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def estimate(regs: np.ndarray, other: np.ndarray, odds: np.ndarray, other_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of every pair, less the matches that chance makes, and the number of buckets behind each."""
    same = ((regs[:, None, :] == other[None, :, :]) & (regs[:, None, :] != 0)).sum(axis=2)
    used = ((regs[:, None, :] | other[None, :, :]) != 0).sum(axis=2)
    chance = odds @ other_odds.T / (1 << MANTISSA)
    return (same / np.maximum(used, 1) - chance) / (1 - chance), used


def may_link(est: np.ndarray, used: np.ndarray, least: float) -> np.ndarray:
    return est >= least - 6 * np.sqrt(least * (1 - least) / np.maximum(used, 1)) - 2 / np.maximum(used, 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(both) - inter)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(k: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                sets = shingle_sets([t or b"" for t in b.column(1).to_pylist()], k)
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, regs, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "regs"],
                )

    return run


def _bands(batches):
    for b in batches:
        regs, sizes = b.column(1).to_pylist(), b.column(2)
        keys = np.frombuffer(b"".join(regs), "<u8").reshape(-1, BANDS)
        at, band = np.nonzero(keys)
        key = mix(keys[at, band] ^ mix(band.astype(np.uint64) + np.uint64(1))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(band.astype(np.int8)), b.column(0).take(at := pa.array(at)), sizes.take(at)], ["key", "band", "node", "n_shingles"])


def groups_of(batches, keys: int):
    """Tables of rows with equal first ``keys`` columns, from batches sorted by them."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[s].item() for c in cols)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def _candidates(table: pa.Table, cross: bool, band: int, percent: int):
    """Pairs (positions, estimate) of a bucket whose registers allow a link and whose first common band is ``band``."""
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    sizes = table.column("n_shingles").to_numpy()
    chunk = table.column("chunk").to_numpy()
    keys = regs.view("<u8")
    odds, n = zero_odds(sizes), len(sizes)
    rows = np.flatnonzero(chunk == chunk.min()) if cross else np.arange(n)
    cols = np.flatnonzero(chunk != chunk.min()) if cross else rows
    for s in range(0, len(rows), ROWS_AT_ONCE):
        r = rows[s : s + ROWS_AT_ONCE]
        c = cols if cross else cols[s + 1 :]
        if not len(c):
            continue
        fits = np.minimum(sizes[r][:, None], sizes[c][None, :]) * 100 >= percent * np.maximum(sizes[r][:, None], sizes[c][None, :])
        fits &= keys[r, band][:, None] == keys[c, band][None, :]
        if not cross:
            fits &= r[:, None] < c[None, :]
        if not fits.any():
            continue
        est, used = estimate(regs[r], regs[c], odds[r], odds[c])
        i, j = np.nonzero(fits & may_link(est, used, percent / 100))
        if not len(i):
            continue
        a, b = r[i], c[j]
        for lo in range(0, len(a), 100_000):
            x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
            first = ((keys[x] == keys[y]) & (keys[x] != 0)).argmax(axis=1) == band
            yield x[first], y[first], est[i[lo : lo + 100_000], j[lo : lo + 100_000]][first]


def _flag(percent: int):
    def run(batches):
        for (key, band, lo, hi), t in groups_of(batches, 4):
            if t.num_rows < 2:
                continue
            hit = np.zeros(t.num_rows, dtype=bool)
            for x, y, _ in _candidates(t, lo != hi, band, percent):
                hit[x] = hit[y] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _confirm(percent: int):
    def run(batches):
        for (key, band, lo, hi), t in groups_of(batches, 4):
            if t.num_rows < 2:
                continue
            nodes = t.column("node").to_pylist()
            sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()]
            parent = list(range(len(nodes)))

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            links = []
            for x, y, est in _candidates(t, lo != hi, band, percent):
                for p in np.argsort(-est, kind="stable"):
                    i, j = root(x[p]), root(y[p])
                    if i != j and linked(sets[x[p]], sets[y[p]], percent):
                        parent[max(i, j)] = min(i, j)
                        links.append((nodes[x[p]], nodes[y[p]]))
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _sets(k: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 0):
                sets = shingle_sets([t or b"" for t in b.column(0).to_pylist()], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]
                )

    return run


def _chunked(banded: DataFrame, percent: int) -> DataFrame:
    """Members of buckets with two classes or more, once for each task (lo, hi: chunks) that they take part in."""
    n, bytes_ = F.count(F.lit(1)), F.sum("n_shingles") * 8
    shared = banded.groupBy(F.col("key").alias("_w_key")).agg(n.alias("n"), bytes_.alias("bytes")).where("n > 1")
    shared = materialize(shared, "near-buckets").withColumn("large", (F.col("n") > CHUNK) | (F.col("bytes") > CHUNK_BYTES))
    # written: all that follows reads these few rows, and not the bands of all classes again
    members = materialize(banded.join(shared.select("_w_key", "large"), F.col("key") == F.col("_w_key")).drop("_w_key"), "near-met")
    whole = members.where("NOT large").select("key", "band", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("chunk"), "node", "n_shingles")
    if shared.where("large").isEmpty():
        return whole
    # sizes that may link differ by less than one step
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    large = members.where("large").withColumn("step", F.floor(F.log(F.col("n_shingles")) / F.lit(width)).cast("long"))
    sizes = large.groupBy("key", "step").agg(n.alias("n"), bytes_.alias("bytes"))
    sizes = sizes.withColumn("chunks", F.ceil(F.greatest(F.col("n") / F.lit(CHUNK), F.col("bytes") / F.lit(CHUNK_BYTES))))
    by = W.partitionBy("key").orderBy("step")  # a bucket's steps: some dozens
    beside = lambda f, d: F.when(f("step").over(by) == F.col("step") + d, f("chunks").over(by)).otherwise(0)
    sizes = sizes.select(F.col("key").alias("_w_key"), F.col("step").alias("_w_step"), "chunks", beside(F.lead, 1).alias("above"), beside(F.lag, -1).alias("below"))
    cell = lambda step, i: step * F.lit(1 << 32) + i
    cells = lambda count, d: F.transform(F.slice(F.sequence(F.lit(0).cast("long"), count), F.lit(1), count.cast("int")), lambda i: cell(F.col("step") + d, i))
    large = large.join(materialize(sizes, "near-steps"), (F.col("key") == F.col("_w_key")) & (F.col("step") == F.col("_w_step")))
    large = large.withColumn("chunk", cell(F.col("step"), F.pmod(F.xxhash64("node"), F.col("chunks"))))
    others = F.concat(cells(F.col("below"), -1), cells(F.col("chunks"), 0), cells(F.col("above"), 1))
    large = large.withColumn("other", F.explode(others))
    return whole.unionByName(large.select("key", "band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "n_shingles"))


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    with Scope(docs.sparkSession) as scope:
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
        signed = scope.keep(materialize(map_arrow(rows, _sign(k), "doc_id long, n_shingles long, node binary, regs binary"), "near-signatures"))
        some = signed.where("node IS NOT NULL")
        nodes = some.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.count(F.lit(1)).alias("n_rows"))
        nodes = materialize(nodes, "near-classes")

        banded = map_arrow(nodes.select("node", "regs", "n_shingles"), _bands, "key long, band byte, node binary, n_shingles long")
        met = materialize(_chunked(materialize(banded, "near-bands"), percent), "near-members")
        dealt = met.join(nodes.select(F.col("node").alias("_w_node"), "regs"), F.col("node") == F.col("_w_node")).drop("_w_node")
        order = ["key", "band", "lo", "hi"]
        shape = "key long, band byte, lo long, hi long, chunk long, node binary, n_shingles long, regs binary"
        dealt = dealt.select(*order, "chunk", "node", "n_shingles", "regs").repartition(*order).sortWithinPartitions(*order)
        flagged = materialize(map_arrow(dealt, _flag(percent), shape), "near-candidates")
        scope.discard(nodes, flagged)

        wanted = flagged.select("node").distinct().join(nodes.select("node", "least"), "node").select("node", F.col("least").alias("_w_least"))
        wanted = materialize(wanted.select("_w_least").distinct(), "near-wanted")
        texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_w_least")), "left_semi").select("text")
        sets = map_arrow(texts, _sets(k), "node binary, shingles binary").dropDuplicates(["node"])
        sets = materialize(sets.withColumnRenamed("node", "_w_node"), "near-sets")
        full = flagged.join(sets, F.col("node") == F.col("_w_node")).drop("_w_node")
        full = full.repartition(*order).sortWithinPartitions(*order)
        links = materialize(map_arrow(full, _confirm(percent), "u binary, v binary"), "near-links")

        scope.discard(nodes, links)
        stars = connected_components(links) if not links.isEmpty() else links
        roots = nodes.select("node", "least", "n_rows").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
        roots = materialize(roots.select("node", "least", "n_rows", F.coalesce("root", "node").alias("root")), "near-roots")
        named = materialize(roots.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_w_root"), "near-names")
        named = roots.join(named, F.col("root") == F.col("_w_root")).select("node", "component_id", "n_rows")
        named = scope.keep(materialize(named, "near-components"))
    out = join_groups(some, named, "node", "n_rows").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document stays."""
    with Scope(docs.sparkSession) as scope:
        stays = near_duplicates(docs, k, percent, doc_id, text).where("kept").select(F.col("doc_id").alias("_w_id")).distinct()
        stays = scope.keep(materialize(stays, "near-stays"))
    return docs.join(stays, F.col(doc_id).cast("long").eqNullSafe(F.col("_w_id")), "left_semi")
