"""Encoding, decoding and counting of whole texts in Arrow batches.

Defined cases: null counts as empty; rows that repeat an id or a text are rows of their own (a text is encoded once
a slice); an empty table gives no rows; very long texts make a slice of their own; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import map_arrow
from waymark.llm.pieces import Counter, Pieces

TOKEN_LIMIT = 4096
#: Texts are handled in slices of about so many bytes, so that memory stays bounded whatever an Arrow batch holds.
SLICE_BYTES = 4_000_000
_made: dict[tuple, object] = {}


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _once(kind: str, model: bytes):
    """One vocabulary a worker."""
    key = (kind, hashlib.sha256(model).digest())
    if key not in _made:
        _made[key] = Pieces(model) if kind == "pieces" else Counter(Pieces(model))
    return _made[key]


def slices(batch: pa.RecordBatch, at: int):
    """Pieces of a batch whose texts in column ``at`` have SLICE_BYTES, or one text more."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and what ``keep`` names of ids (array<int>) and decoded (string).

    The executors get the model's bytes with the task, so the file need only exist on the driver.
    """
    model = model_bytes(model_path)
    kinds = {"ids": "array<int>", "decoded": "string"}
    schema = ", ".join(["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *[f"{k} {kinds[k]}" for k in keep]])

    def run(batches):
        p = _once("pieces", model)
        for whole in batches:
            for b in slices(whole, 1):
                ids = p.encode_batch([t or "" for t in b.column(1).to_pylist()], bos=True, eos=True)
                shas, texts = {}, {}
                for x in ids:
                    if x not in shas:
                        back = p.decode(memoryview(x).cast("I").tolist())
                        shas[x] = _sha(x), _sha(back)
                        if "decoded" in keep:
                            texts[x] = back.decode()
                sizes = [len(x) // 4 for x in ids]
                cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array([shas[x][0] for x in ids]), pa.array([shas[x][1] for x in ids])]
                for k in keep:
                    if k == "ids":
                        ends = np.cumsum([0, *sizes]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                    else:
                        cols.append(pa.array([texts[x] for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, schema)


def count_tokens(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    model = model_bytes(model_path)

    def run(batches):
        c = _once("counter", model)
        for whole in batches:
            for b in slices(whole, 1):
                n = c.count_batch([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), size.alias("n_bytes"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
