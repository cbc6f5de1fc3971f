"""Tokens' classes, truth keys and samples in phases, against plain versions."""

import hashlib
import random
import struct
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import evaluate as E, sampling as S
from waymark.operators.tagger import Tagger, labels, token_features


def model(classes=3, width=97, seed=2):
    rng = np.random.default_rng(seed)
    return b"GPML" + struct.pack("<IB", width, classes) + rng.normal(size=classes * (1 + width)).astype("<f4").tobytes()


def test_tagger(spark):
    tokens = ["12", "rue", "75001", "1234", "ab", "x1"]
    assert token_features(tokens)[3] == ["w=1234", "p=75001", "n=ab", "sfx=234", "pfx=123", "dig=1", "len=4", "pos=m", "d5=0", "d4n2=1", "pdig=1"]
    assert token_features(["a"])[0][1:3] == ["p=^", "n=$"] and token_features(["a"])[0][7] == "pos=a"
    raw = model()
    values = struct.unpack("<" + "f" * (3 * 98), raw[9:])

    def plain(tokens):
        out = []
        for own in token_features(tokens):
            at = [int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % 97 for f in own]
            sums = []
            for c in range(3):
                s = np.float32(values[c])
                for i in at:
                    s = np.float32(s + np.float32(values[3 + c * 97 + i]))
                sums.append(s)
            out.append(sums.index(max(sums)))
        return out

    rng = random.Random(3)
    rows = [[rng.choice(["rue", "de", "12", "75001", "1234", "ab", "é", "5bis"]) for _ in range(rng.randrange(7))] for _ in range(60)] + [None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = {r.i: r.l for r in df.select("i", labels(F.col("t"), raw).alias("l")).collect()}
    assert all(got[i] == plain(r or []) for i, r in enumerate(rows))
    for bad in (b"", b"GPML", raw[:-1], raw + b"\0\0\0\0", b"XXXX" + raw[4:], raw[:9] + struct.pack("<f", float("nan")) + raw[13:]):
        with pytest.raises(ValueError):
            Tagger.read(bad)


def test_truth_key(spark):
    texts = ["Rue de l'Église, 5", "  A--b__C ", "ＦＵＬＬ １２", "Straße", "ﬁn ①", "İstanbul", "", None, "日本 語", "½ x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", text.truth_key(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        want = None if t is None else " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", t.casefold())).split())
        assert got[i] == want, t


def brute(rows, phases, keys, caps):
    out, seen, used = [], set(), Counter()
    for name, (test, quota) in phases.items():
        pool = [r for r in rows if test(r)]
        size = {d: Counter(r[d] for r in pool if r[d]) for d in caps}
        press = lambda r: [size[d][r[d]] / c for d, c in caps.items() if r[d]]  # noqa: B023, E731
        n = 0
        for r in sorted(pool, key=lambda r: (max(press(r), default=0), sum(press(r)), r["turn"])):
            if n < quota and not any((k, r[k]) in seen for k in keys) and all(used[d, r[d]] < c for d, c in caps.items() if r[d]):
                seen.update((k, r[k]) for k in keys)
                used.update((d, r[d]) for d in caps if r[d])
                out.append((r["id"], name))
                n += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phases(spark, seed):
    rng = random.Random(seed)
    rows = [{"g": "g", "id": i, "turn": rng.random(), "k": rng.randrange(60), "spot": rng.randrange(90), "c": rng.choice(["", None, "x", "y", "z"]), "n": rng.choice(["p", "q", ""]), "role": rng.choice("ab")} for i in range(200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "g string, id int, turn double, k int, spot int, c string, n string, role string")
    got = S.phased(df, "g", {"one": (F.col("role") == "a", 8), "two": (F.lit(True), 25)}, ["k", "spot"], {"c": 5, "n": 9}, ["turn", "id"])
    want = brute(rows, {"one": (lambda r: r["role"] == "a", 8), "two": (lambda r: True, 25)}, ["k", "spot"], {"c": 5, "n": 9})
    assert sorted((r.id, r.phase) for r in got.collect()) == want
    assert S.phased(df.where("false"), "g", {"one": (F.lit(True), 3)}, ["k"], {}, ["turn"]).count() == 0


def test_small_parts(spark):
    assert [S.percent_cap(n) for n in (0, 100, 200, 225, 300)] == [8, 8, 8, 9, 12]
    rows = spark.createDataFrame([(1, "1 Rue X, A", "1 Rue X", "A"), (2, "Rue X, A", "", "A"), (3, "B", "x", "B")], "record_id int, query string, street string, city string")
    rows = rows.withColumns({"country": F.lit("FR"), "lat": F.lit(1.0), "lon": F.lit(1.0)})
    assert E.truth_faults(rows, ["street", "city"]).first().not_composed == 2


def test_median_over_ranges(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.random(), 0.5])) for g in ["a"] * 301 + ["b"] * 40 + ["c"] for _ in (0,)] + [(None, 3.0), ("d", None)]
    got = {r.g: r.median for r in E.upper_median(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v").collect()}
    for g in ("a", "b", "c", None):
        vs = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g] == vs[len(vs) // 2]
    assert "d" not in got
