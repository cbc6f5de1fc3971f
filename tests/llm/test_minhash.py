import random
import re
from itertools import combinations

import numpy as np
import pytest

import waymark.llm.minhash as m
from waymark.llm.components import connected_components
from waymark.llm.minhash import drop_near_duplicates, estimate, near_duplicates, registers, zero_odds
from waymark.llm.shingles import shingle_sets


def words(t):
    t = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(rb"[^\x20\x09-\x0D]+", t.encode())


def sets_of(t, k):
    w = words(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent=80):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed, n=260, chain=0):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)] + ["The", "OF", "and"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 6, 9, 20, 60, 150])))
        rows.append((i, rng.choice([t, t.upper(), t.replace(" ", "\n\t")])))
    return rows + [(900, None), (901, " \n"), (7, rows[7][1]), (None, rows[8][1]), (902, "x" * 5000 + " tail"), (903, "x" * 5000 + " TAIL"), (904, "a b " * 30000)]


def test_hashed_sets_have_the_true_sizes():
    texts = [(t or "").encode() for _, t in corpus(1)]
    for k in (1, 2, 5):
        got = shingle_sets(texts, k)
        assert [len(s) for s in got] == [len(sets_of(t.decode(), k)) for t in texts]
    a = shingle_sets(["long " * 900_000 + "end", "b"], 2) if False else shingle_sets([("long " * 500_000 + "end").encode(), b"b"], 2)
    assert [len(x) for x in a] == [2, 1]


def test_estimates():
    rng = np.random.default_rng(4)
    for j in (0.0, 0.3, 0.8, 1.0):
        errors = []
        for _ in range(60):
            n = 2000
            both = rng.integers(0, 2**64, int(n * j), dtype=np.uint64)
            one, two = (np.unique(np.concatenate((both, rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64)))) for _ in range(2))
            r, o = registers([one, two]), zero_odds(np.array([len(one), len(two)]))
            est, used = estimate(r[:1], r[1:], o[:1], o[1:])
            errors.append(est[0, 0] - j)
        assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize(("seed", "k", "chunk"), [(1, 2, 1024), (2, 2, 3), (3, 5, 1024), (4, 1, 5)])
def test_brute_force(spark, monkeypatch, seed, k, chunk):
    monkeypatch.setattr(m, "CHUNK", chunk)
    monkeypatch.setattr(m, "ROWS_AT_ONCE", 2 if chunk < 9 else 64)
    monkeypatch.setattr(m, "CHUNK_BYTES", 2000 if seed == 3 else m.CHUNK_BYTES)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string")
    assert sorted(map(tuple, near_duplicates(df, k).collect()), key=str) == brute(rows, k)


def test_chunks_follow_sizes(spark, monkeypatch):
    """In a large bucket a class only meets chunks whose sizes may link; every pair that may link meets exactly once."""
    monkeypatch.setattr(m, "CHUNK", 4)
    rng = random.Random(2)
    sizes = [int(10 ** rng.uniform(0, 5)) for _ in range(150)] + [50] * 20
    banded = spark.createDataFrame([(7, 0, i.to_bytes(4, "big"), n) for i, n in enumerate(sizes)] + [(8, 1, b"x", 5), (8, 1, b"y", 900), (9, 1, b"z", 5)], "key long, band byte, node binary, n_shingles long")
    rows = m._chunked(banded, 80).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.key, r.lo, r.hi), []).append(r)
    met = [(a.node, b.node) for t in tasks.values() for a, b in combinations(sorted(t, key=lambda r: r.node), 2) if t[0].lo == t[0].hi or a.chunk != b.chunk]
    may = {(i.to_bytes(4, "big"), j.to_bytes(4, "big")) for i, j in combinations(range(len(sizes)), 2) if min(sizes[i], sizes[j]) * 100 >= 80 * max(sizes[i], sizes[j])}
    assert len(met) == len(set(met)) and may <= set(met) and (b"x", b"y") in met
    assert len(met) < 0.4 * len(sizes) ** 2 / 2 and not any(r.key == 9 for r in rows)


def test_drop(spark):
    rows = corpus(5, 80)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string")
    out = drop_near_duplicates(df, 2)
    want = {d for d, _, _, kept in brute(rows, 2) if kept}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(500, 500 + i) for i in range(40)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if x != c}
