"""The whole pipeline against a plain version of each stage."""

import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import sentencepiece

from tests.llm.test_minhash import brute as near_brute
from waymark.llm.tokens import default_model

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def toxic(text):
    return "zumscu" in text or "vilewret" in text


def make(seed=3, n=700):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(n):
        if docs and rng.random() < 0.3:
            words = rng.choice(docs)[1].split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.randrange(1, 70))]
            if rng.random() < 0.15:
                words += ["zumscu", "vilewret"]
        docs.append((i, " ".join(words), "en", rng.choice(["a", "a", "a", "b", "c"]), 0))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic(" ".join(words)))))
    return docs, labels


def mixed(rows):
    """Times each document is taken, by the definition."""
    size = {d[0]: len(d[1].split()) for d in rows}
    per = defaultdict(int)
    for d in rows:
        per[d[3]] += size[d[0]]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(per))}
    target, free = {}, set(per)
    while True:
        left = sum(per.values()) - sum(target.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 3 * per[s]}
        if not over:
            target |= now
            break
        target |= {s: 3 * per[s] for s in over}
        free -= over
    out = {}
    for s in per:
        full = int(target[s] // per[s]) if per[s] else 0
        rest, cum = target[s] - full * per[s], 0

        def key(d):
            h = int(hashlib.md5(f"mix|{d[0]}".encode()).hexdigest()[:13], 16)
            w = max(0.25, 6 / (6 + abs(len(d[1].encode()) / max(1, size[d[0]]) - 6)))
            return -math.log((h + 0.5) / 2**52) / w

        for d in sorted((d for d in rows if d[3] == s), key=key):
            cum += size[d[0]]
            out[d[0]] = full + (size[d[0]] > 0 and 2 * cum - size[d[0]] <= 2 * rest)
    return out


def test_every_stage_takes_effect(spark, tmp_path):
    docs, labels = make()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    clean = [d for d in docs if not toxic(d[1])]
    last = {d[1]: d[0] for d in clean}
    exact = [d for d in clean if last[d[1]] == d[0]]
    keep = {d for d, _, _, kept in near_brute([(d[0], d[1]) for d in exact], 5) if kept}
    near = [d for d in exact if d[0] in keep]
    times = mixed(near)
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = Counter()
    for d in near:
        ids = lib.encode(d[1], add_bos=True, add_eos=True)
        if times[d[0]]:
            want[d[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()] = times[d[0]]
    assert len(clean) > len(exact) > len(near)
    assert {x[0] for x in got} == {x[0] for x in want}
    assert got == want


def test_columns_stay(spark, tmp_path):
    docs, labels = make(5, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.schema == df.schema, name
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0, name
