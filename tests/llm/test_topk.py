import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm.topk import top_k


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in rows:
        if i is not None and i % 10 == 0 and any(i == g for g, _ in good):
            ok = [v2 for i2, v2 in rows if i2 == i and v2 is not None and all(x is not None and math.isfinite(x) for x in v2)]
            asks[i] = [math.floor(1024 * x) for x in min(ok)]
    out = []
    for q, a in asks.items():
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, v)))), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("case", ["normal", "ties", "few", "big", "huge", "vast", "negative"])
def test_brute_force(spark, case):
    rng = random.Random(case)
    n = 8 if case == "few" else 400
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(7)]
        if case == "ties":
            v = [float(rng.randrange(2)) for _ in range(7)]
        if case == "vast":
            v = [x * 1e200 for x in v]
        if case in ("big", "huge"):
            v = [x * 3e4 * (1024 if case == "huge" else 1) for x in v]
        if case == "negative":
            v = [-abs(x) if i % 10 else abs(x) for x in v]
        rows.append((i, v))
    rows += [(20, None), (30, [None, 1.0]), (1000, [float("nan")] * 7), (1010, [float("inf")] * 7), (5, rows[5][1]), (None, [9.0] * 7), (40 if n > 40 else 4, rows[3][1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()))
    assert got == brute(rows, 5)


def test_many_query_blocks(spark, monkeypatch):
    import waymark.llm.topk as m

    monkeypatch.setattr(m, "QUERY_BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 10 == 0, k=3).collect())) == brute(rows, 3)


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0).collect() == []


def test_each_score_is_computed_once_and_few_are_resolved(monkeypatch):
    """Phases 2 and 3 do less than brute force: one product of all pairs, exact scores for the collected entries only."""
    import numpy as np
    import pyarrow as pa

    import waymark.llm.topk as m

    rng = np.random.default_rng(8)
    for kind in ("spread", "few scores", "one vector"):
        n, d, nq, k = 6000, 16, 40, 10
        x = rng.normal(size=(n, d)) if kind == "spread" else rng.integers(0, 2, (n, d)).astype(float) if kind == "few scores" else np.ones((n, d))
        products = {"pairs": 0, "exact": 0}
        bounds, whole = m.Queries.bounds, m._whole
        monkeypatch.setattr(m.Queries, "bounds", lambda self, v, f=bounds, c=products: (c.update(pairs=c["pairs"] + len(self.ids) * len(v)), f(self, v))[1])
        monkeypatch.setattr(m, "_whole", lambda q, v, f=whole, c=products: (c.update(exact=c["exact"] + len(q)), f(q, v))[1])
        queries = m.Queries(np.arange(nq), np.floor(1024 * x[:nq]))
        flat = pa.array(x.ravel())
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)], ["vec_id", "x"])
        (qi, ids, low, high), = m.local_lists([batch.slice(i, 500) for i in range(0, n, 500)], queries, k, 1024)
        assert products["pairs"] <= nq * n and products["exact"] <= 0.4 * nq * n
        assert len(qi) <= nq * k * 3 * (1 if kind == "spread" else 12)  # a batch keeps what ties
        exact = np.floor(1024 * x[:nq]) @ np.floor(1024 * x).T
        for q in range(nq):
            want = sorted((i for i in range(n) if i != q), key=lambda i: (-exact[q, i], i))[:k]
            assert set(want) <= set(ids[qi == q].tolist())
        monkeypatch.undo()
