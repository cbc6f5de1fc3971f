"""Readers and writers of registries, rules and tables.  Schemas are fixed: a missing column is an error, not a guess."""

from __future__ import annotations

import io
import tarfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from waymark.functions.rules import RULES_NUMBERS, Rules
from waymark.runtime import delete_path

REGISTRY = ("id", "numero", "rep", "nom_voie", "code_postal", "code_insee", "nom_commune", "lon", "lat")
CANON = ("street_norm", "code", "street", "commune", "commune_norm", "numero", "rep", "postcode", "lat", "lon")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A national register: semicolons, a header, plain or gzip.  All columns are text; rows that can't be read go."""
    df = spark.read.csv(path, sep=";", header=True, inferSchema=False, mode="DROPMALFORMED")
    missing = sorted(set(REGISTRY) - set(df.columns))
    if missing:
        raise ValueError(f"the register lacks columns: {missing}")
    return df.withColumn("lon", F.col("lon").try_cast("double")).withColumn("lat", F.col("lat").try_cast("double"))


def read_geonames(spark: SparkSession, path: str, columns: int = 19) -> DataFrame:
    """A headerless dump with tabs and no quotes; columns are _c0, _c1 and so on."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(columns)])
    return spark.read.csv(path, sep="\t", quote="", schema=schema)


def read_nested(spark: SparkSession, path: str, country: str) -> DataFrame:
    """Parquet with nested address levels; the filter on the country reaches the scan."""
    from waymark.operators.canon import nested_addresses

    return nested_addresses(spark.read.parquet(path), country)


MAX_UNPACKED, MAX_RATIO = 32 << 30, 100


def check_unpacked(spark: SparkSession, path: str, max_bytes: int = MAX_UNPACKED, max_ratio: int = MAX_RATIO) -> None:
    """Refuse text files that unpack to more than ``max_bytes`` together, or a .gz to over ``max_ratio`` times its size.

    The files stream through the executors, line by line; nothing of them is kept.
    """
    lines = spark.read.text(path).select(F.octet_length("value") + 1, "_metadata.file_path", "_metadata.file_size").toDF("n", "file", "size")
    per = lines.groupBy("file").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    worst = per.agg(F.sum("n").alias("n"), F.max(F.when(F.col("file").endswith(".gz"), F.col("n") / F.col("size"))).alias("ratio")).first()
    if (worst.n or 0) > max_bytes:
        raise ValueError(f"{path} unpacks to {worst.n} bytes, more than {max_bytes}")
    if (worst.ratio or 0) > max_ratio:
        raise ValueError(f"{path} unpacks to {worst.ratio:.0f} times its size, more than {max_ratio}")


def read_canon(spark: SparkSession, path: str, max_bytes: int | None = None, max_ratio: int | None = None) -> DataFrame:
    """Canonical address rows from CSV (plain or gzip) with a header; ``max_bytes`` bounds the files' size, and with ``max_ratio`` what they unpack to."""
    if max_bytes is not None and folder_bytes(spark, path) > max_bytes:
        raise ValueError(f"{path} holds more than {max_bytes} bytes")
    if max_ratio is not None:
        check_unpacked(spark, path, max_bytes or MAX_UNPACKED, max_ratio)
    df = spark.read.csv(path, header=True, inferSchema=False)
    missing = sorted(set(CANON) - set(df.columns))
    if missing:
        raise ValueError(f"address rows lack columns: {missing}")
    return df


def folder_bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features, one a file or one a line, as regions with a bounding box and rings in whole 1e-7 degrees.

    Polygons and multipolygons are read; files that can't be read are left out.
    """
    return regions_of(spark.read.text(path, wholetext=True))


def read_region_tars(spark: SparkSession, path: str, max_member: int = 64 << 20) -> DataFrame:
    """``read_regions`` from the GeoJSON files in tar archives, plain or compressed; an archive is read by one task, file by file.

    Members larger than ``max_member`` bytes, links and whatever isn't GeoJSON are left out; nothing is unpacked to disk.
    """
    def members(batches):
        for batch in batches:
            for content in batch.column(0):
                found = []
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r|*") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".geojson") and m.size <= max_member:
                            found.append(tar.extractfile(m).read().decode("utf-8", "replace"))
                            if len(found) == 64:
                                yield pa.RecordBatch.from_arrays([pa.array(found)], ["value"])
                                found = []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    return regions_of(spark.read.format("binaryFile").load(path).select("content").mapInArrow(members, "value string"))


def regions_of(raw: DataFrame) -> DataFrame:
    """Regions from GeoJSON texts (value); features that say their kind of place count only if it is a region."""
    kind = "struct<properties: struct<name: string, `wof:name`: string, `wof:placetype`: string>, geometry: struct<type: string, coordinates: string>>"
    parsed = raw.select(F.from_json("value", kind).alias("f")).where("f.geometry.coordinates IS NOT NULL")
    flat = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    deep = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", flat).when(F.col("f.geometry.type") == "MultiPolygon", deep)
    point = lambda p: F.struct(F.round(F.get(p, F.lit(1)) * 1e7).cast("long").alias("lat"), F.round(F.get(p, F.lit(0)) * 1e7).cast("long").alias("lon"))
    parsed = parsed.where(F.coalesce(F.col("f.properties.`wof:placetype`") == "region", F.lit(True)))
    name = F.coalesce("f.properties.`wof:name`", "f.properties.name")
    out = parsed.select(name.alias("name"), F.transform(rings, lambda r: F.transform(r, point)).alias("rings")).where("rings IS NOT NULL AND name IS NOT NULL")
    points = F.flatten("rings")
    side = lambda f, c, a: f(F.transform(points, lambda p: p[c])).alias(a)
    from pyspark.sql import Window as W

    out = out.select("name", "rings", side(F.array_min, "lat", "min_lat"), side(F.array_max, "lat", "max_lat"), side(F.array_min, "lon", "min_lon"), side(F.array_max, "lon", "max_lon"))
    return out.withColumn("region_no", F.row_number().over(W.orderBy("name")))  # a country has few regions


def read_rules(spark: SparkSession, paths: dict[str, str], base: Rules | None = None) -> Rules:
    """Rules from files named by class: key and value by tabs, # begins a comment; pairs of abbreviations have two keys."""
    rows = []
    schema = "a string, b string, c string"
    for name, path in paths.items():
        number = RULES_NUMBERS.get(name)
        if number is None:
            raise ValueError(f"rules have no class {name!r}")
        for a, b, c in spark.read.csv(path, sep="\t", comment="#", quote="", schema=schema).where("a IS NOT NULL").collect():
            rows.append((number, f"{a} {b}", c) if c else (number, a, b or ""))
    return (base or Rules()).extended(rows)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_interchange(df: DataFrame, path: str) -> None:
    """Sorted, compressed CSV for other builders; a total order, so that the files are the same in every run."""
    keys = ["street_norm", "code", "numero", "rep", "lon", "lat"]
    df.orderBy(*keys).write.mode("overwrite").csv(path, header=True, compression="gzip")


def publish(df: DataFrame, path: str, check) -> None:
    """Write beside the place, check what was written with ``check(df)``, then put it there: readers see old or new, never half."""
    spark = df.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    write_table(df, staged)
    try:
        check(spark.read.parquet(staged))
    except Exception:
        delete_path(spark, staged)
        raise
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(staged), at(path))
    delete_path(spark, old)


def cached_extract(spark: SparkSession, path: str, release: str, make) -> DataFrame:
    """An extract kept with its release: made if absent, refused if it is of another release."""
    meta = f"{path}.meta"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        write_table(make(), path)
        spark.createDataFrame([(release, spark.read.parquet(path).count())], "release string, n_rows long").write.mode("overwrite").json(meta)
    elif not fs.exists(at(meta)):
        raise ValueError(f"{path} has no record of its release")
    else:
        have = spark.read.json(meta).first()["release"]
        if have != release:
            raise ValueError(f"{path} is of release {have}, wanted is {release}")
    return spark.read.parquet(path)
