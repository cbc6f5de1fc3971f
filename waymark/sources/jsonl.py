"""Batches of queries as JSON lines, and answers as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REQUEST = "q string, street string, housenumber string, city string, postcode string"


def parse_requests(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with the request's fields; numbers count as text, blank fields as absent, and ``ok`` says whether it can be asked."""
    r = F.from_json(column, REQUEST)
    out = lines.withColumn("_w_r", r)
    field = lambda c: F.nullif(F.trim(F.col(f"_w_r.{c}")), F.lit("")).alias(c)
    out = out.select(*lines.columns, *[field(c) for c in ("q", "street", "housenumber", "city", "postcode")])
    return out.withColumn("ok", F.col("q").isNotNull() | (F.col("street").isNotNull() & F.col("city").isNotNull()))


def read_requests(spark, path: str) -> DataFrame:
    """Requests with their line number, counted within each file and ordered by file.  Lines keep their order in the answers."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("line_no", F.monotonically_increasing_id())
    return parse_requests(lines.where(F.trim("value") != ""), "value")


def to_answers(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """line_no and a JSON object with the results of each request, empty where there are none."""
    fields = [c for c in hits.columns if c not in ("line_no", "rank")]
    packed = hits.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("hit")))).alias("r"))
    packed = requests.select("line_no").join(packed, "line_no", "left")
    results = F.transform(F.coalesce("r", F.array().cast(packed.schema["r"].dataType)), lambda x: x["hit"])
    return packed.select("line_no", F.to_json(F.struct(results.alias("results"))).alias("value"))


def feature_collection(hits: DataFrame, key: str) -> DataFrame:
    """key and a GeoJSON feature collection of its answers."""
    properties = F.struct(*[c for c in hits.columns if c not in (key, "lat", "lon", "rank")])
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), properties.alias("properties"))
    packed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", feature.alias("f")))).alias("r"))
    return packed.select(key, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("r", lambda x: x["f"]).alias("features"))).alias("geojson"))


def write_answers(answers: DataFrame, requests: DataFrame, path: str) -> None:
    """Answers in the order of their lines; nothing is written if any request can't be asked."""
    bad = requests.where(~F.col("ok")).count()
    if bad:
        raise ValueError(f"{bad} requests can't be read: nothing was written")
    answers.orderBy("line_no").select("value").write.mode("errorifexists").text(path)
