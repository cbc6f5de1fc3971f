"""The engine in one object: a gazetteer, optionally a layer of points of interest, and the ways to ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions import words
from waymark.functions.rules import Rules
from waymark.operators import answers as A, reverse as R, structured as S
from waymark.operators.freeform import FreeForm, cascade
from waymark.operators.gazetteer import Gazetteer, build, check_pair
from waymark.runtime import materialize

TABLES = ("houses", "streets", "communes", "names", "words", "counts", "spelled")


class Geocoder:
    """Methods take and return tables; a query is a row."""

    def __init__(self, addresses: Gazetteer, poi: Gazetteer | None = None, rules: Rules = words.RULES, regions: DataFrame | None = None):
        if poi is not None:
            check_pair(addresses, poi)
        self.gaz, self.rules, self.regions = addresses, rules, regions
        self.blocks = materialize(A.blocks_of(addresses.houses), "blocks")
        self.nearby = R.nearby_of(addresses)
        self.free = FreeForm(addresses, rules, self.blocks)
        self.poi = FreeForm(poi, rules) if poi is not None else None

    def geocode(self, queries: DataFrame, k: int = 10, focus: bool = False) -> DataFrame:
        """Answers of free-form queries (query_id, q, and f_lat and f_lon with ``focus``)."""
        out = self.free.geocode(queries, k, focus)
        return self._regions(out if self.poi is None else cascade(out, queries.select("query_id", "q"), self.poi, k))

    def geocode_structured(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Answers of queries (query_id, street, number, city, postcode)."""
        out = S.geocode(queries, self.gaz, k, self.rules, self.blocks)
        if self.poi is not None:
            line = F.concat_ws(" ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("street", "number", "postcode", "city")])
            out = cascade(out, queries.select("query_id", line.alias("q")), self.poi, k)
        return self._regions(out)

    def reverse(self, points: DataFrame, k: int = 3) -> DataFrame:
        """The nearest addresses of points (point_id, lat, lon)."""
        return self._regions(R.reverse(points, self.gaz, k, self.nearby))

    def _regions(self, answers: DataFrame) -> DataFrame:
        if self.regions is None:
            return answers
        from waymark.operators.places import admin_regions

        return admin_regions(answers, self.regions)

    def batch(self, requests: DataFrame, k: int = 10) -> DataFrame:
        """Answers (line_no, ...) of parsed requests: structured where street and city are given, else free-form."""
        ok = requests.where("ok").withColumn("query_id", F.col("line_no"))
        whole = F.col("street").isNotNull() & F.col("city").isNotNull()
        one = self.geocode_structured(ok.where(whole).select("query_id", "street", F.col("housenumber").alias("number"), "city", "postcode"), k)
        two = self.geocode(ok.where(~whole).select("query_id", "q"), k)
        return one.unionByName(two).withColumnRenamed("query_id", "line_no")

    def save(self, path: str, meta: dict[str, str] | None = None) -> None:
        """The gazetteer's tables and its description under ``path``."""
        from waymark.sources.files import write_table

        spark = self.gaz.houses.sparkSession
        for t in TABLES:
            write_table(getattr(self.gaz, t), f"{path}/{t}")
        facts = {"country": self.gaz.country, "layer": self.gaz.layer, **(meta or {})}
        if len(facts) > 1024:
            raise ValueError("a gazetteer has at most 1024 facts")
        rows = [(k, v) for k, v in sorted(facts.items()) if v is not None]
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def set_meta(spark: SparkSession, path: str, meta: dict[str, str]) -> None:
    """Replace a saved gazetteer's description, and none of its data."""
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/meta").collect()}


def load(spark: SparkSession, path: str, layer: str | None = None) -> Gazetteer:
    """A saved gazetteer; with ``layer`` one of another layer is refused."""
    meta = read_meta(spark, path)
    if layer and meta.get("layer") not in (None, layer):
        raise ValueError(f"expected a layer of {layer}, got {meta['layer']!r}")
    return Gazetteer(*(spark.read.parquet(f"{path}/{t}") for t in TABLES), meta.get("country"), meta.get("layer"))


def build_geocoder(rows: DataFrame, poi: DataFrame | None = None, **options) -> Geocoder:
    return Geocoder(build(rows), build(poi, layer="poi") if poi is not None else None, **options)


def register_views(spark: SparkSession, gaz: Gazetteer, prefix: str = "gazetteer_") -> None:
    """The gazetteer's tables as temporary views, for SQL."""
    for t in TABLES:
        getattr(gaz, t).createOrReplaceTempView(prefix + t)


def geocode_sql(spark: SparkSession, geocoder: Geocoder, table: str, key: str, text: str) -> DataFrame:
    """key and the best answer as JSON ('{}' where there is none, null for null), for a table or view known to SQL."""
    rows = spark.table(table).select(F.col(key).alias("query_id"), F.col(text).alias("q"))
    best = geocoder.geocode(rows.where("q IS NOT NULL"), 1)
    best = best.select("query_id", F.to_json(F.struct(*[c for c in best.columns if c not in ("query_id", "rank")])).alias("answer"))
    out = rows.join(best, "query_id", "left")
    return out.select(F.col("query_id").alias(key), F.when(F.col("q").isNotNull(), F.coalesce("answer", F.lit("{}"))).alias("answer"))


def reverse_sql(spark: SparkSession, geocoder: Geocoder, table: str, key: str, lat: str, lon: str) -> DataFrame:
    """key and the nearest address as JSON ('{}' where none is near, null where a coordinate is null), for a table or view known to SQL."""
    rows = spark.table(table).select(F.col(key).alias("point_id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    asked = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    best = geocoder.reverse(rows.where(asked), 1)
    best = best.select("point_id", F.to_json(F.struct(*[c for c in best.columns if c not in ("point_id", "rank")])).alias("answer"))
    out = rows.join(best, "point_id", "left")
    return out.select(F.col("point_id").alias(key), F.when(asked, F.coalesce("answer", F.lit("{}"))).alias("answer"))
