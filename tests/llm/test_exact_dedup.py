import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from waymark.llm.exact_dedup import dedup, drop_duplicates, latest, run_state, state_session


def brute(rows):
    g = defaultdict(list)
    for i, t in rows:
        g[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = g[t or ""]
        k = max((x for x in ids if x is not None), default=None)
        out.append((i, k, len(ids), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "", None, f"t{i}", "x" * 9000, f"é{i % 40}"])) for i in range(300)]
    return rows + [(3, rows[3][1]), (None, "n"), (None, "n"), (None, "a")]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in sample()], "doc_id long, text string, digest string, keep_id int")
    got = sorted(map(tuple, dedup(df).collect()), key=str)
    assert got == brute(sample())


def test_weak_digest_is_resolved_by_bytes(spark):
    df = spark.createDataFrame(sample(), "doc_id long, text string")
    got = sorted(map(tuple, dedup(df, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()), key=str)
    assert got == brute(sample())


def test_drop(spark):
    df = spark.createDataFrame([(*r, r[1]) for r in sample()], "doc_id long, text string, keep_id string")
    out = drop_duplicates(df)
    assert out.columns == df.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in sample()})
    best = {}
    for i, t in sample():
        if i is not None:
            best[t or ""] = max(best.get(t or "", -1), i)
    assert all(r.doc_id == best.get(r.text or "") for r in out.collect())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup(df).collect() == [] and drop_duplicates(df).collect() == []


def test_state_survives_restarts(spark, tmp_path):
    own = state_session(spark)
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for ids, t in ((range(4), "a"), (range(4, 9), "a"), (range(9, 11), "b")):
        spark.createDataFrame([(i, t, "") for i in ids], "doc_id long, digest string, locator string").write.mode("append").parquet(src)
        stream = own.readStream.schema("doc_id long, digest string, locator string").parquet(src)
        run_state(stream, out, ck).awaitTermination()
    assert sorted((r.digest, r.keep_id, r.group_size) for r in latest(spark, out).collect()) == [("a", 8, 9), ("b", 10, 2)]
