import random
import re
from collections import defaultdict

import pytest

from waymark.llm.mixing import mix, mix_documents, sized


def water(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: 3 * sizes[s] for s in over}


def test_words(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\rabé\u00a0\x1c\x85\u3000🙂") for _ in range(rng.randrange(20))) for _ in range(300)] + ["x" * 200_000]
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: r.size for r in sized(rows).collect()}
    assert got == {i: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", "b", "c", "tiny", None]), " ".join(["wörd"] * rng.randrange(60)), 0.5) for i in range(700)]
    rows += [(900, "empty", ""), (901, "empty", None), (902, "one", "w"), (5, rows[5][1], rows[5][2]), (None, "a", "x y"), (903, "long", "q " * 20000)]
    rows = [(*r, 0.5)[:4] for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target double")
    out = mix(df).collect()
    assert len(out) == len(rows)
    assert sorted(map(str, out)) == sorted(map(str, mix(df.repartition(3)).collect()))
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken <= 3 * r.size and (r.taken == r.size * r.epochs)
    want = water(dict(sizes))
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
    for s in sizes:  # complete epochs come first
        assert len({r.epochs for r in out if r.source == s and r.size}) <= 2


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_documents_are_repeated(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(["w"] * rng.randrange(30)), "clash") for i in range(200)] + [(None, "a", "x y z", "c"), (None, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, epochs string")
    want = {(r.doc_id, r.source): r.epochs for r in mix(df).collect()}
    out = mix_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert mix_documents(df.where("false")).collect() == []


def test_repeated_rows_share_their_epochs(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(12), rng.choice("ab"), " ".join(["w"] * rng.randrange(1, 4))) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want, got = defaultdict(int), defaultdict(int)
    for r in mix(df).collect():
        want[r.doc_id, r.source, r.size] += r.epochs
    for r in mix_documents(df).collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}
