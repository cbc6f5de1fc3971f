"""The queries of the training-data operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm.common import read_table
from waymark.llm.exact_dedup import dedup
from waymark.llm.mixing import MIX_SQL, mix
from waymark.llm.licenses import licenses_sql, scan
from waymark.llm.minhash import near_duplicates
from waymark.llm.sharding import shard_documents
from waymark.llm.suffix_dedup import remove_repeats
from waymark.llm.tokens import count_tokens, default_model, encode_documents
from waymark.llm.topk import TOPK_SQL, top_k
from waymark.llm.toxicity import score_documents, train


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), default_model())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), default_model())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source", "epochs", "n_bytes", "text_hash")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_minhash": op10_minhash,
}

#: Every 200-byte window by its digest; hexadecimal text, as two characters a byte can be cut and joined.
REPEATS_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(0, len(x) // 2 - 199)) AS p, x FROM d WHERE len(x) >= 400),
h AS (SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS k FROM w),
f AS (SELECT r, p FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, p, CASE WHEN p > lag(p) OVER q + 200 OR lag(p) OVER q IS NULL THEN 1 ELSE 0 END AS fresh FROM f WINDOW q AS (PARTITION BY r ORDER BY p)),
i AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS span FROM g),
s AS (SELECT r, span, min(p) AS lo, max(p) + 200 AS hi FROM i GROUP BY r, span),
k AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(hi ORDER BY lo) AS his, list(lo ORDER BY lo) AS los FROM s GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN los IS NULL THEN x ELSE substr(x, 1, 2 * los[1]) || array_to_string(list_transform(range(1, len(los) + 1), lambda j: CASE WHEN j < len(los) THEN substr(x, 2 * his[j] + 1, 2 * (los[j + 1] - his[j])) ELSE substr(x, 2 * his[j] + 1) END), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

#: Pairs of distinct sets that share a shingle, by an inverted index, and what each set reaches.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS sh FROM w),
h AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(sh, chr(10))) AS k, sh FROM s),
c AS (SELECT k, any_value(n) AS n, min(doc_id) AS least, any_value(sh) AS sh FROM h WHERE n > 0 GROUP BY k),
u AS (SELECT k, n, hash(x) AS x FROM (SELECT k, n, unnest(sh) AS x FROM c)),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.n <= b.n AND a.k <> b.k AND a.n * 100 >= b.n * 80 GROUP BY a.k, b.k),
e AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT k, k AS o FROM c UNION SELECT r.k, both_.b FROM r JOIN both_ ON both_.a = r.o),
m AS (SELECT r.k, min(c.least) AS component_id FROM r JOIN c ON c.k = r.o GROUP BY r.k)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM h LEFT JOIN m ON m.k = h.k AND h.n > 0
"""

SQL: dict[str, str] = {
    "op2_suffix_dedup": REPEATS_SQL,
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op5_licenses": licenses_sql(),
    "op8_mixing": MIX_SQL,
    "op9_topk": TOPK_SQL,
    "op10_minhash": NEAR_SQL,
}
