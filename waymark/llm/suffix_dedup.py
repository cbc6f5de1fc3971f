"""Removal of long byte strings that occur more than once, with merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (in any text, or elsewhere in the
same one) goes; overlaps count and strings are judged on the input.

1. Each text is cut into runs of windows.  A window's key is the least hash of its ``gram``-byte pieces, so equal
   windows have equal keys; consecutive windows with one key are a run, and a run is a string of bytes.  Runs
   whose key has one run and one piece can hold no repeated window and go no further: nothing is lost.
2. Equal runs are counted as one string with a weight.  A weight of two settles all windows of the run.
3. Strings that share their key with other strings are gathered, whole keys to a task.  There, shards of them get
   Burrows-Wheeler transforms, which are merged by iterative interleave refinement; blocks that agree in
   ``length`` bytes are the repeated intervals, and the starts in them are repeated windows.  Stretches of windows
   whose keys by longer pieces occur once in the task are left out first.
4. A key shared by more than HOT different strings is no task of its own: its strings are cut into runs again, by
   longer pieces, down to single windows, which are counted like any run.  The results go back up the same way.
5. Every text collects its repeated windows, and the bytes under them are removed.

Runs are counted with partial sums, and the joins that bring results back are ones that Spark can split, so a
passage that a third of the texts share is no hot key.

Two hashes of 64 bits (key and content) identify a run, two of 88 bits a text; neither is cut by the number of rows.

Defined cases: null counts as empty; texts shorter than ``length`` keep all; of equal texts, all copies lose their
bytes; rows that repeat an id are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from waymark.llm.bwt import repeated_windows
from waymark.llm.common import Scope, map_arrow, materialize, release
from waymark.llm.shingles import mix
from waymark.llm.tokens import slices

LENGTH = 200
GRAM = 32
#: Pieces for the strings of hot keys, ever longer; the last is a whole window.
SPLITS = (177, 197)
HOT = 256
#: Bytes of strings whose transforms are merged at once; a task takes as many such blocks as it has.
BLOCK_BYTES = 1 << 20
CHUNK = 1 << 20
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_tables: dict[int, list[np.ndarray]] = {}


def _powers(size: int) -> list[np.ndarray]:
    if size not in _tables:
        made = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _tables[size] = made
    return _tables[size]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in linear time."""
    n = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows in all texts: text, first and last window start, key and content hash (int64), and whether the
    piece that gives the key may occur twice within these texts, as it does in a run that repeats itself."""
    width = length - gram + 1
    found: list[tuple] = []
    at = 0
    while at < len(texts):
        # whole texts up to a chunk, or a part of one text that overlaps the next by a window less one byte
        held, stop = 0, at
        while stop < len(texts) and (stop == at or held + len(texts[stop]) <= CHUNK):
            held += len(texts[stop])
            stop += 1
        if stop == at + 1 and held > CHUNK:
            t = texts[at]
            for lo in range(0, len(t) - length + 1, CHUNK):
                found += _runs([t[lo : lo + CHUNK + length - 1]], [at], lo, length, gram, width)
        else:
            found += _runs(texts[at:stop], list(range(at, stop)), 0, length, gram, width)
        at = stop
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z, np.zeros(0, dtype=bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(texts, numbers, shift, length, gram, width):
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < length:
        return []
    power, inverse = _powers(CHUNK + length + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * inverse[: len(buf) - gram + 1])
    least = _least(grams, width) if width > 1 else grams
    # pieces that give some window its key: windows reach ``width`` pieces, so a piece is in as many windows
    reach = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)])
    chosen = grams[_least(~reach, width) == ~grams] if width > 1 else grams[:0]
    value, times = np.unique(chosen, return_counts=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    some = sizes >= length
    first, last = starts[some], ends[some] - length  # window starts of each text
    change = np.ones(len(least), dtype=bool)
    change[1:] = least[1:] != least[:-1]
    heads = np.flatnonzero(change)
    heads = np.union1d(heads, first)
    text = np.searchsorted(first, heads, side="right") - 1
    keep = text >= 0
    keep[keep] = heads[keep] <= last[text[keep]]
    heads, text = heads[keep], text[keep]
    if not len(heads):
        return []
    tails = np.minimum(np.append(heads[1:], len(buf)) - 1, last[text])
    # no run is longer than a window's pieces: a text of one letter is many equal runs
    parts = (tails - heads) // width + 1
    if parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole, text = np.repeat(tails, parts), np.repeat(text, parts)
        heads = np.repeat(heads, parts) + step * width
        tails = np.minimum(heads + width - 1, whole)
    stop = tails + length
    content = mix((total[stop] - total[heads]) * inverse[heads] + (stop - heads).astype(np.uint64))
    own = np.flatnonzero(some)[text]
    back = starts[own] - shift
    twice = np.isin(least[heads], value[times > 1])
    return [(np.array(numbers, dtype=np.int64)[own], heads - back, tails - back, least[heads].view(np.int64), content.view(np.int64), twice)]


def text_key(data: bytes) -> tuple[int, int]:
    h = hashlib.sha256(data).hexdigest()
    return int(h[:15], 16), int(h[15:22], 16)


def with_key(df: DataFrame, text: str) -> DataFrame:
    """``df`` with text_key() of ``text`` as k1 and k2."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return (
        df.withColumn("_w_h", h)
        .withColumn("k1", F.conv(F.substring("_w_h", 1, 15), 16, 10).cast("long"))
        .withColumn("k2", F.conv(F.substring("_w_h", 16, 7), 16, 10).cast("int"))
        .drop("_w_h")
    )


def _scan(length: int, gram: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                texts = [t or b"" for t in b.column(1).to_pylist()]
                keys = np.array([text_key(t) for t in texts], dtype=np.int64).reshape(-1, 2)
                text, first, last, key, content, twice = runs(texts, length, gram)
                n, m = len(texts), len(text)
                # a row for each text (start -1), then its runs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([b.column(0), pa.nulls(m, pa.int64())]),
                        pa.array(np.concatenate([keys[:, 0], keys[text, 0]])),
                        pa.array(np.concatenate([keys[:, 1], keys[text, 1]]).astype(np.int32)),
                        pa.array(np.concatenate([np.full(n, -1), first]).astype(np.int64)),
                        pa.array(np.concatenate([[len(t) for t in texts], last - first + length]).astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(n, np.int64), key])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), content])),
                        pa.array(np.concatenate([np.zeros(n, bool), twice])),
                    ],
                    ["doc_id", "k1", "k2", "start", "size", "key", "content", "twice"],
                )

    return run


def _fetch(batches):
    for whole in batches:
        for b in slices(whole, 0):
            out = [], [], [], []
            for t, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for x in items:
                    for o, v in zip(out, (x["key"], x["content"], x["n"], t[x["start"] : x["start"] + x["size"]]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.binary())], ["key", "content", "n", "body"])


def _split(length: int, gram: int):
    def run(batches):
        for b in batches:
            bodies = b.column(3).to_pylist()
            text, first, last, key, content, twice = runs(bodies, length, gram)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key), pa.array(content), b.column(2).take(at), b.column(0).take(at), b.column(1).take(at), pa.array(first),
                    pa.array([bodies[i][f : l + length] for i, f, l in zip(text, first, last, strict=True)], pa.binary()), pa.array(twice),
                ],
                ["key", "content", "n", "up_key", "up_content", "shift", "body", "twice"],
            )

    return run


def _spans(hit: np.ndarray) -> list[int]:
    """First and last of each run of True, one after the other."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def pieces_to_merge(bodies: list[bytes], weights: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and last window of the pieces of ``bodies`` that may hold a repeated window.

    The strings are cut into runs by longer pieces than before; a run whose key occurs once is left out, and
    neighbouring runs that stay are one piece again.
    """
    text, first, last, key, _, twice = runs(bodies, length, gram)
    _, of = np.unique(key, return_inverse=True)
    keep = twice | (np.bincount(of, weights=weights[text])[of] >= 2) if len(of) else twice
    text, first, last = text[keep], first[keep], last[keep]
    head = np.ones(len(text), dtype=bool)
    head[1:] = (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)
    tail = np.append(head[1:], True) if len(head) else head
    return text[head], first[head], last[tail]


def _merge(length: int, gram: int, width: int):
    longer = (gram + length) // 2

    def block(rows):
        table = pa.Table.from_batches(rows)
        weights, bodies = table.column(2).to_numpy(), table.column(3).to_pylist()
        text, first, last = pieces_to_merge(bodies, weights, length, longer)
        hits = repeated_windows([bodies[i][f : l + length] for i, f, l in zip(text, first, last, strict=True)], weights[text].tolist(), length, width)
        spans: dict[int, list[int]] = {}
        for i, f, h in zip(text.tolist(), first.tolist(), hits, strict=True):
            if h.any():
                spans.setdefault(i, []).extend(f + x for x in _spans(h))
        some = pa.array(list(spans), pa.int64())
        return pa.RecordBatch.from_arrays(
            [table.column(0).take(some).combine_chunks(), table.column(1).take(some).combine_chunks(), pa.array(list(spans.values()), pa.list_(pa.int64()))],
            ["key", "content", "spans"],
        )

    def run(batches):
        """Blocks of whole keys: rows come sorted by key."""
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            ends = np.concatenate([[0], np.cumsum(pc.binary_length(b.column(3)).to_numpy())])
            start = 0
            for at in bounds:
                if size + ends[at] - ends[start] >= BLOCK_BYTES and keys[at] != last:
                    if at > start:
                        held.append(b.slice(start, at - start))
                    yield block(held)
                    held, size, start = [], 0, at
                last = keys[at]
            held.append(b.slice(start))
            size += int(ends[-1] - ends[start])
        if held:
            yield block(held)

    return run


def _remove(length: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                out = []
                for t, spans, all_ in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    t = t or b""
                    if all_ and len(t) >= length:
                        out.append((len(t), len(t), 1, b""))
                        continue
                    if not spans:
                        out.append((len(t), 0, 0, t))
                        continue
                    edge = np.zeros(len(t) + 1, dtype=np.int32)
                    for x in spans:
                        s = np.array(x["spans"], dtype=np.int64) + x["start"]
                        np.add.at(edge, s[0::2], 1)
                        np.add.at(edge, s[1::2] + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                    out.append((len(t), int(gone.sum()), n_spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)),
                        pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string()), pa.array([o[3] for o in out], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def _settled(items: DataFrame, length: int) -> DataFrame:
    """All windows of strings that occur twice or more as they are."""
    return items.where("n > 1").select("key", "content", F.array(F.lit(0).cast("long"), F.col("size") - length).alias("spans"))


def _repeats(items: DataFrame, length: int, gram: int, width: int, splits: tuple[int, ...], hot: int) -> DataFrame:
    """key, content and spans of the strings in ``items`` (key, content, n, body) that hold repeated windows."""
    sizes = items.groupBy("key").agg(F.count(F.lit(1)).alias("strings")).withColumnRenamed("key", "_w_key")
    sizes = materialize(sizes, "bwt-keys")
    cool = items.join(sizes.where(F.col("strings") <= hot), F.col("key") == F.col("_w_key")).select("key", "content", "n", "body")
    cool = cool.repartition("key").sortWithinPartitions("key")
    found = materialize(map_arrow(cool, _merge(length, gram, width), "key long, content long, spans array<long>"), "bwt-repeats")
    many = sizes.where(F.col("strings") > hot)
    if not splits or many.isEmpty():
        return found
    warm = items.join(many, F.col("key") == F.col("_w_key")).select("key", "content", "n", "body")
    kind = "key long, content long, n long, up_key long, up_content long, shift long, body binary, twice boolean"
    parts = materialize(map_arrow(warm, _split(length, splits[0]), kind), "bwt-parts")
    small = parts.groupBy("key", "content").agg(F.sum("n").alias("n"), F.first("body").alias("body"), F.bool_or("twice").alias("twice"))
    small = materialize(small, "bwt-part-strings")
    alone = small.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bool_or("twice").alias("t")).where("c > 1 OR t").select(F.col("key").alias("_w_key"))
    alone = materialize(alone, "bwt-part-keys")
    done = _settled(small.withColumn("size", F.octet_length("body")), length)
    more = small.join(alone, F.col("key") == F.col("_w_key"), "left_semi").select("key", "content", "n", "body")
    below = materialize(done.unionByName(_repeats(materialize(more, "bwt-part-items"), length, splits[0], width, splits[1:] or (length,) if splits != (length,) else (), hot)), "bwt-below")
    below = below.select(F.col("key").alias("_w_key"), F.col("content").alias("_w_content"), "spans")
    up = parts.join(below, (F.col("key") == F.col("_w_key")) & (F.col("content") == F.col("_w_content")))
    up = up.select(F.col("up_key").alias("key"), F.col("up_content").alias("content"), F.transform("spans", lambda x: x + F.col("shift")).alias("spans"))
    # a string has at most as many windows as pieces
    up = up.groupBy("key", "content").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return materialize(found.unionByName(up), "bwt-all")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = 25, doc_id: str = "doc_id", text: str = "text", splits=SPLITS, hot: int = HOT) -> DataFrame:
    """k1, k2 (the text's key), all (every window repeated) and spans: array of (start, spans), for texts with repeats."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = "doc_id long, k1 long, k2 int, start long, size long, key long, content long, twice boolean"
    scanned = materialize(map_arrow(rows, _scan(length, gram), kind), "dedup-runs")
    texts = scanned.where("start = -1").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    texts = materialize(texts, "dedup-texts")
    all_runs = scanned.where("start >= 0").drop("doc_id")
    shared = all_runs.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bool_or("twice").alias("t")).where("c > 1 OR t").select(F.col("key").alias("_w_key"))
    shared = materialize(shared, "dedup-keys")
    met = materialize(all_runs.join(shared, F.col("key") == F.col("_w_key")).drop("_w_key"), "dedup-met")
    release(docs.sparkSession)
    strings = met.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("at"), F.bool_or("twice").alias("twice"))
    strings = materialize(strings.select("key", "content", "n", "twice", "at.*"), "dedup-strings")
    several = strings.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bool_or("twice").alias("t")).where("c > 1 OR t").select(F.col("key").alias("_w_key"))
    several = materialize(several, "dedup-several")
    wanted = strings.join(several, F.col("key") == F.col("_w_key"), "left_semi")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "content", "n", "start", "size")).alias("items"))
    wanted = materialize(wanted.join(texts.drop("copies"), ["k1", "k2"]).select(F.col("doc_id").alias("_w_id"), F.col("k1").alias("_w_k1"), F.col("k2").alias("_w_k2"), "items"), "dedup-wanted")
    keyed = with_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    same = (F.col("k1") == F.col("_w_k1")) & (F.col("k2") == F.col("_w_k2")) & F.col("doc_id").eqNullSafe(F.col("_w_id"))
    bodies = map_arrow(keyed.join(wanted, same).select(F.col("text").cast("binary").alias("text"), "items"), _fetch, "key long, content long, n long, body binary")
    bodies = materialize(bodies, "dedup-bodies")
    # rows that repeat an id and text fetch the same strings more than once
    bodies = materialize(bodies.groupBy("key", "content").agg(F.max("n").alias("n"), F.first("body").alias("body")), "dedup-items")
    release(docs.sparkSession)
    found = _settled(strings, length).unionByName(_repeats(bodies, length, gram, width, splits, hot))
    # a string that is settled and also met others: either covers all of it
    found = materialize(found, "dedup-found").select(F.col("key").alias("_w_key"), F.col("content").alias("_w_content"), "spans")
    release(docs.sparkSession)
    copied = texts.where("copies > 1").select("k1", "k2")
    own = met.join(found, (F.col("key") == F.col("_w_key")) & (F.col("content") == F.col("_w_content"))).select("k1", "k2", "start", "spans")
    own = materialize(own, "dedup-own")
    once = texts.where("copies = 1").select(F.col("k1").alias("_w_k1"), F.col("k2").alias("_w_k2"))
    own = materialize(own.join(once, (F.col("k1") == F.col("_w_k1")) & (F.col("k2") == F.col("_w_k2")), "left_semi"), "dedup-once")
    spans = own.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "spans")).alias("spans")).withColumn("all", F.lit(False))
    none = F.lit(None).cast("array<struct<start:bigint,spans:array<bigint>>>")
    return materialize(spans.unionByName(copied.withColumn("spans", none).withColumn("all", F.lit(True))), "dedup-spans")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, width: int = 25, doc_id: str = "doc_id", text: str = "text", splits=SPLITS, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    with Scope(docs.sparkSession) as scope:
        spans = scope.keep(find_repeats(docs, length, gram, width, doc_id, text, splits, hot))
    spans = spans.select(F.col("k1").alias("_w_k1"), F.col("k2").alias("_w_k2"), "spans", "all")
    keyed = with_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text")
    rows = keyed.join(spans, (F.col("k1") == F.col("_w_k1")) & (F.col("k2") == F.col("_w_k2")), "left")
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "spans", F.coalesce("all", F.lit(False)).alias("all"))
    return map_arrow(rows, _remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
