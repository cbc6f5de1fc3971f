"""From raw documents to token ids: a pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``.

Defined cases, for every stage: null texts count as empty; other columns pass through whatever their names, and only
doc_id, text and (for mixing) source are read; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import materialize, read_table
from waymark.llm.exact_dedup import drop_duplicates
from waymark.llm.minhash import drop_near_duplicates
from waymark.llm.mixing import mix_documents
from waymark.llm.tokens import default_model, encode_documents
from waymark.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.  Empty texts are clean; rows that repeat an id are judged by their own texts."""
    return keep_clean(docs, train(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest id (a null id loses to any); of rows alike in both, one."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with the smallest id.

    Texts without words have no copies here; rows that share the id which stays all stay.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the target weights of the sources take it; null is a source of its own, and texts without words go."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to; empty texts have begin and end ids only."""
    return encode_documents(docs, default_model(), keep=("ids",))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("minhash", near), ("mixing", mixture), ("sentencepiece", encode)]

#: SQL can express neither the label model nor the encoding; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
