import hashlib
import random
import struct

import pytest
import sentencepiece

from waymark.llm.pieces import Counter, Pieces
from waymark.llm.tokens import count_tokens, default_model, encode_documents, model_bytes

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n x", "x\ty", "▁", "x▁y", "<s> </s> <unk>", "<0x41>", "\x00z", "é à ü",
    "𝔘🙂 ﬁ１", "a" * 5000, " " * 77, "();\r\n", "ünïcödé   nbsp", "mixed " * 300, "日本語のテキスト", "�", "é", "tab\t\n \n",
]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def texts():
    rng = random.Random(5)
    chars = "abcdefgh  \n\t▁éß日🙂.,;(){}\r<>0123"
    return ODD + ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)]


def test_encoding_and_decoding(lib):
    p = Pieces(model_bytes(default_model()))
    for t, got in zip(texts(), p.encode_batch(texts(), True, True), strict=True):
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want, t
        assert p.decode(want).decode() == lib.decode(want), t


def test_decode_any_ids(lib):
    p, rng = Pieces(model_bytes(default_model())), random.Random(6)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 260), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert p.decode(ids).decode() == lib.decode(ids), ids


def test_counts(lib):
    c = Counter(Pieces(model_bytes(default_model())))
    assert len(c.single) > 20000
    assert c.count_batch(texts()) == [len(lib.encode(t)) for t in texts()]


def test_frames(spark, lib):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "null id", 1), (1, None, 1), (1, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in encode_documents(df, default_model()).collect()}
    for i, t in enumerate(texts()):
        if i == 1:
            continue
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    n = count_tokens(df, default_model(), limit=100).collect()
    assert len(n) == len(rows) and {(r.doc_id, r.n_tokens) for r in n if r.doc_id not in (None, 1)} == {(i, len(lib.encode(t))) for i, t in enumerate(texts()) if i != 1}
    assert sum(r.doc_id == 1 and r.n_tokens == 0 and not r.over_limit for r in n) == 2
    kept = encode_documents(df.where("doc_id = 3"), default_model(), keep=("ids", "decoded")).first()
    assert kept.decoded == "a" and kept.ids[0] == 1
    assert encode_documents(df.where("false"), default_model()).count() == 0
    assert count_tokens(df.where("false"), default_model()).count() == 0


def test_long_segments_are_checked(lib):
    p = Pieces(model_bytes(default_model()))
    for n in (63, 64, 65, 1000, 30_000):
        for t in ("日本語" * n, "ab" * n, "x " + "é" * n + "\n" + "q" * n):
            assert struct.unpack(f"<{len(p.encode_batch([t])[0]) // 4}I", p.encode_batch([t])[0]) == tuple(lib.encode(t))
            assert Counter(p).count_batch([t]) == [len(lib.encode(t))]
    long = "z" * 100
    p.merge = list  # an agenda that joins nothing
    with pytest.raises(ValueError, match="differ"):
        p.encode_batch([long])


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr("waymark.llm.pieces.CACHE_BYTES", 20_000)
    p = Pieces(model_bytes(default_model()))
    words = [f"w{i}" for i in range(3000)]
    once = p.encode_batch(words)
    for i in range(0, 3000, 100):
        assert p.encode_batch(words[i : i + 100]) == once[i : i + 100]
        assert p.cache.bytes < 20_000 + 100 * 250


def test_vocabulary_without_a_lone_line_feed_is_checked_on_whole_texts():
    p = Pieces(model_bytes(default_model()))
    p.alone = ""
    p.encode_batch(["plain text", ""])
    p.merge = list
    with pytest.raises(ValueError, match="differ"):
        p.encode_batch(["z" * 100])
