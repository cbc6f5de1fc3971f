"""A gazetteer, queries and points made from the star-schema tables, which hold no addresses of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.operators.gazetteer import Gazetteer, build

TYPES = ("Rue ", "Avenue ", "Boulevard ", "Place ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical address rows: a house for each part, in the commune of a nation."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (key % 4 + 1).cast("int"))
    rows = part.join(nation, F.col("n_nationkey") == (key * 7) % 25)
    return rows.select(
        F.concat(kind, "p_name").alias("street"), F.lower(F.concat(kind, "p_name")).alias("street_norm"), F.col("p_size").alias("numero"),
        F.when(key % 10 == 0, "bis").when(key % 10 == 1, "a").otherwise("").alias("rep"),
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), F.col("n_name").alias("commune"), F.lower("n_name").alias("commune_norm"),
        (F.lit(10000) + F.col("n_nationkey") * 1000 + key % 3).cast("string").alias("postcode"),
        ((F.lit(40) + F.col("n_nationkey") * F.lit(0.5)).cast("double") + (key % 97) / F.lit(10000.0)).alias("lat"),
        ((F.lit(2) + F.col("n_nationkey") * F.lit(0.4)).cast("double") + (key % 89) / F.lit(10000.0)).alias("lon"),
        key.alias("part"),
    )


ADDRESSES = """addresses AS (
SELECT CASE p_partkey % 4 WHEN 0 THEN 'Rue ' WHEN 1 THEN 'Avenue ' WHEN 2 THEN 'Boulevard ' ELSE 'Place ' END || p_name AS street,
       lower(CASE p_partkey % 4 WHEN 0 THEN 'Rue ' WHEN 1 THEN 'Avenue ' WHEN 2 THEN 'Boulevard ' ELSE 'Place ' END || p_name) AS street_norm,
       p_size AS numero, CASE p_partkey % 10 WHEN 0 THEN 'bis' WHEN 1 THEN 'a' ELSE '' END AS rep,
       lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_name AS commune, lower(n_name) AS commune_norm,
       CAST(10000 + n_nationkey * 1000 + p_partkey % 3 AS VARCHAR) AS postcode,
       CAST(40 + n_nationkey * 0.5 AS DOUBLE) + (p_partkey % 97) / 10000.0 AS lat,
       CAST(2 + n_nationkey * 0.4 AS DOUBLE) + (p_partkey % 89) / 10000.0 AS lon, p_partkey AS part
FROM part JOIN nation ON n_nationkey = (p_partkey * 7) % 25)"""

#: Tables of the gazetteer, for oracles.
GAZETTEER = f"""{ADDRESSES},
houses AS (SELECT street_norm, code, street, commune, commune_norm, numero, rep, postcode, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7,
                  CAST(round(lon * 1e7) AS BIGINT) AS lon_e7 FROM addresses),
pcs AS (SELECT street_norm, code, postcode, count(*) AS n FROM houses GROUP BY ALL),
major AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY street_norm, code ORDER BY n DESC, postcode) AS rn FROM pcs WHERE postcode <> '') WHERE rn = 1),
kinds AS (SELECT street_norm, code, count(*) > 1 AND bool_or(postcode <> '') AS pc_ambiguous FROM pcs GROUP BY ALL),
streets AS (SELECT h.street_norm, h.code, min(street) AS street, min(commune) AS commune, min(commune_norm) AS commune_norm, count(*) AS houses,
                   CAST(round(CAST(sum(lat_e7) AS DOUBLE) / count(*)) AS BIGINT) AS lat_e7, CAST(round(CAST(sum(lon_e7) AS DOUBLE) / count(*)) AS BIGINT) AS lon_e7,
                   CAST(any_value(m.postcode) AS INTEGER) AS pc_num, any_value(pc_ambiguous) AS pc_ambiguous,
                   CASE WHEN any_value(pc_ambiguous) THEN '' ELSE any_value(m.postcode) END AS postcode
            FROM houses h JOIN major m USING (street_norm, code) JOIN kinds USING (street_norm, code) GROUP BY h.street_norm, h.code),
communes AS (SELECT code, min(commune) AS commune, min(commune_norm) AS commune_norm, CAST(sum(houses) AS BIGINT) AS prominence,
                    CAST(round(CAST(sum(lat_e7 * houses) AS DOUBLE) / sum(houses)) AS BIGINT) AS lat_e7,
                    CAST(round(CAST(sum(lon_e7 * houses) AS DOUBLE) / sum(houses)) AS BIGINT) AS lon_e7 FROM streets GROUP BY code)"""

_built: dict[tuple[str, str], Gazetteer] = {}


def gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """The gazetteer of a folder of tables, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = build(addresses(spark, sf_dir))
    return _built[key]


def structured_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each order: an address of the gazetteer, with its number as it is, a little off, far off or missing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    rows = addresses(spark, sf_dir)
    count = rows.agg(F.count(F.lit(1)).alias("n_parts"))
    key = F.col("o_orderkey")
    picked = orders.join(count).withColumn("part", (key * 31) % F.col("n_parts") + 1)  # the count is one row
    number = F.col("numero")
    text = (
        F.when(key % 5 == 0, F.concat(number.cast("string"), "rep")).when(key % 5 == 1, (number + 1).cast("string"))
        .when(key % 5 == 2, (number + 200).cast("string")).when(key % 5 == 3, number.cast("string"))
    )
    return picked.join(rows, "part").select(
        key.alias("query_id"), F.when(key % 2 == 0, F.upper("street")).otherwise(F.col("street")).alias("street"), text.alias("number"),
        F.col("commune").alias("city"), F.when(key % 3 != 0, F.col("postcode")).alias("postcode"), "lat", "lon",
    )


STRUCTURED = """asked AS (
SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(a.street) ELSE a.street END AS street,
       CASE o_orderkey % 5 WHEN 0 THEN CAST(numero AS VARCHAR) || rep WHEN 1 THEN CAST(numero + 1 AS VARCHAR) WHEN 2 THEN CAST(numero + 200 AS VARCHAR)
            WHEN 3 THEN CAST(numero AS VARCHAR) END AS number,
       a.commune AS city, CASE WHEN o_orderkey % 3 <> 0 THEN a.postcode END AS postcode, a.lat, a.lon
FROM orders JOIN addresses a ON a.part = (o_orderkey * 31) % (SELECT count(*) FROM addresses) + 1)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event, near the houses of a commune."""
    e, u = F.col("event_id"), F.col("user_id") % 25
    lat = (u * 5000 + e % 101 + 400_000) / F.lit(10000.0)
    lon = (u * 4000 + e % 103 + 20_000) / F.lit(10000.0)
    return table(spark, sf_dir, "events").select(e.alias("point_id"), lat.alias("lat"), lon.alias("lon"))


POINTS = """points AS (SELECT event_id AS point_id, CAST((user_id % 25) * 5000 + event_id % 101 + 400000 AS DOUBLE) / 10000.0 AS lat,
       CAST((user_id % 25) * 4000 + event_id % 103 + 20000 AS DOUBLE) / 10000.0 AS lon FROM events)"""


def freeform_queries(spark: SparkSession, sf_dir: str, typos: bool = True) -> DataFrame:
    """Free text for each order, in six styles: plain, capitals, punctuated, abbreviated, with a letter missing, city first; or without missing letters, and city first only before a number."""
    q = structured_queries(spark, sf_dir)
    number, city, street = F.coalesce("number", F.lit("")), F.col("city"), F.col("street")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(street), "^avenue ", "av "), "^boulevard ", "bd "), "^place ", "pl ")
    typo = F.concat(F.substring(street, F.lit(1), F.length(street) - 3), F.substring(street, F.length(street) - 1, F.lit(2)))
    pc = F.coalesce("postcode", F.lit(""))
    line = lambda *p: F.trim(F.regexp_replace(F.concat_ws(" ", *p), " +", " "))
    turn = F.floor(F.col("query_id") / 5) % 5
    style = F.col("query_id") % 6 if typos else F.when(turn < 4, turn).when(F.col("number").isNotNull(), 5).otherwise(0)
    text = (
        F.when(style == 0, line(number, street, pc, city)).when(style == 1, F.upper(line(number, street, pc, city)))
        .when(style == 2, F.concat(line(number, street), F.lit(", "), pc, F.lit(" ("), city, F.lit(")"))).when(style == 3, line(number, short, pc, city))
        .when(style == 4, line(number, typo, city)).otherwise(line(city, street, number))
    )
    return q.select("query_id", text.alias("q"), "lat", "lon", F.col("city").alias("truth_city"))
