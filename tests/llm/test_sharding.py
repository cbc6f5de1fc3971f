import random
import zlib
from collections import defaultdict

from waymark.llm.sharding import BalancedTree, best_fit_decreasing, pack_evenly, shard_documents


def test_tree_matches_sorted_list():
    rng, tree, keys = random.Random(1), BalancedTree(), set()
    for _ in range(3000):
        k = (rng.randrange(300), rng.randrange(3))
        if rng.random() < 0.6:
            keys.add(k)
            tree.insert(k)
        else:
            keys.discard(k)
            tree.delete(k)
        b = (rng.randrange(300), -1)
        assert tree.ceiling(b) == min((x for x in keys if x >= b), default=None)


def naive_bfd(items, capacity):
    left, out = [], []
    for s in sorted(items, reverse=True):
        fits = sorted((x, i) for i, x in enumerate(left) if x >= s)
        if fits:
            i = fits[0][1]
            left[i] -= s
        else:
            left.append(max(capacity, s) - s)
            i = len(left) - 1
        out.append((s, i))
    return sorted(out), len(left)


def test_runs_equal_one_by_one():
    rng = random.Random(2)
    for _ in range(50):
        items = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 80))]
        counts = sorted(((s, items.count(s)) for s in set(items)), reverse=True)
        runs, n = best_fit_decreasing(counts, 60)
        assert (sorted((r.size, r.shard) for r in runs for _ in range(r.lo, r.hi)), n) == naive_bfd(items, 60)


def test_even_and_oversized():
    runs = pack_evenly([(1000, 1), (10, 390), (3, 100)], 40)
    load = defaultdict(int)
    for r in runs:
        load[r.shard] += r.size * (r.hi - r.lo)
    assert sum(load.values()) == 1000 + 3900 + 300 and set(load) == set(range(40))
    small = sorted(load.values())[:-1]
    assert small[-1] - small[0] <= 13
    assert pack_evenly([], 40) == []


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["dup", "", None]) if i % 9 == 0 else "x" * rng.randrange(400) + str(i), "clash") for i in range(500)]
    rows += [(7, rows[7][1], "clash"), (None, "null id", "clash")]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string"), 6).collect()
    assert len(out) == len(rows)
    by, texts = defaultdict(list), defaultdict(set)
    want = {(i, t or "") for i, t, _ in rows}
    for r in out:
        by[r.shard].append(r)
        t = next(t for i, t in want if i == r.doc_id)
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        texts[t].add(r.shard)
    assert set(by) == set(range(6)) and all(len(x) == 1 for x in texts.values())
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    load = [sum(r.size for r in rs) for rs in by.values()]
    assert max(load) - min(load) < 500


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(df).collect() == []
