"""Candidate features of structured queries, to train a ranking on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.operators import answers as A, candidates as C
from waymark.operators.gazetteer import Gazetteer
from waymark.operators.places import lookup_communes
from waymark.operators.structured import prepared, structured_variants


def features(queries: DataFrame, gaz: Gazetteer, blocks: DataFrame) -> DataFrame:
    """query_id, street_norm and the ten features (0 or 1) of every exact candidate."""
    from waymark.runtime import materialize

    asked = materialize(prepared(queries, gaz), "features")  # read several times below
    cities = asked.join(lookup_communes(asked.select(F.col("cn").alias("phrase")), gaz).withColumnRenamed("phrase", "cn"), "cn")
    streets = gaz.streets.select("street_norm", F.col("code").alias("s_code"))
    found = cities.join(structured_variants(asked), "phrase").join(streets, (F.col("variant") == F.col("street_norm")) & (F.col("code") == F.col("s_code")))
    cands = C.merged(found.select("query_id", "street_norm", "code", *C._feature_columns(True, F.col("exact"))), ["query_id"])
    rows = cands.join(asked.select("query_id", "numero", "rep", "query_pc", F.split("phrase", " ").alias("query_words")), "query_id")
    out = A.answer(rows, gaz.streets, blocks, gaz.communes).withColumn("from_ml", F.lit(False)).withColumn("numero_present", F.col("numero").isNotNull())
    return out.select("query_id", "street_norm", F.array(*[F.col(f).cast("int") for f in A.FEATURES]).alias("features"))
