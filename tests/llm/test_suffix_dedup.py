import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import waymark.llm.suffix_dedup as m
from waymark.llm.suffix_dedup import remove_repeats, runs


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120, scale=1):
    rng = random.Random(seed)
    words = [f"wört{i}" for i in range(300)] + list("abcdefg")
    passage = " ".join(rng.choice(words) for _ in range(12 * scale))
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(25 * scale))]
        if rng.random() < 0.5:
            w.insert(rng.randrange(len(w) + 1), passage)
        if rows and rng.random() < 0.3:
            w = (rng.choice(rows)[1] or "").split(" ")
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "a" * 150 * scale), (903, "ab" * 70 * scale), (904, "xyz" * (15 if scale == 1 else 72)), (905, "q" * (42 if scale == 1 else 203)), (4, rows[4][1]), (5, rows[6][1]), (None, rows[7][1]), (None, "n" + passage)]


def test_runs_hold_every_window_once():
    rng = random.Random(2)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50))) for _ in range(rng.randrange(1, 6))]
        length, gram = rng.choice([(8, 3), (5, 5), (12, 4), (1, 1)])
        text, first, last, key, content, twice = runs(texts, length, gram)
        got = sorted((t, p) for t, a, b in zip(text, first, last) for p in range(a, b + 1))
        assert got == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - length + 1)]
        of, what = {}, {}
        for t, a, b, k, c in zip(text, first, last, key, content):
            assert b - a < length - gram + 1
            assert what.setdefault(c, texts[t][a : b + length]) == texts[t][a : b + length]
            for p in range(a, b + 1):
                assert of.setdefault(texts[t][p : p + length], k) == k
        # a key with one run, and not marked, has no repeated window
        seen = Counter(texts[t][p : p + length] for t, p in got)
        runs_of = Counter(key.tolist())
        for t, a, b, k, w in zip(text, first, last, key, twice):
            assert w or runs_of[k] > 1 or all(seen[texts[t][p : p + length]] == 1 for p in range(a, b + 1))


def test_long_texts_are_cut_with_overlap(monkeypatch):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (5000, 30, 700)]
    a = runs(texts, 20, 5)
    m._tables.clear()
    monkeypatch.setattr(m, "CHUNK", 256)
    b = runs(texts, 20, 5)
    m._tables.clear()
    windows = lambda r: sorted((t, p, k) for t, f, l, k in zip(*r[:4]) for p in range(f, l + 1))
    assert windows(a) == windows(b)


@pytest.mark.parametrize(("seed", "length", "gram", "width", "splits", "hot"), [
    (1, 40, 8, 20, (30, 37), 256), (2, 40, 8, 4, (30, 37), 3), (3, 24, 6, 8, (18, 22), 1), (4, 200, 32, 20, (177, 197), 4),
])
def test_brute_force(spark, monkeypatch, seed, length, gram, width, splits, hot):
    monkeypatch.setattr(m, "BLOCK_BYTES", 3000)
    rows = corpus(seed, scale=5 if length == 200 else 1)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(3)
    out = remove_repeats(df, length, gram, width, splits=splits, hot=hot)
    got = sorted((tuple(r)[:5] for r in out.collect()), key=str)
    want = brute(rows, length)
    assert got == want
    assert sum(r[2] for r in got) > 0


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
