"""From canonical address rows to the tables that answers are looked up in.

Canonical rows: street_norm, code, street, commune, commune_norm, numero, rep, postcode, lat, lon and optionally
aliases (names separated by |).  Rows without a usable street, code, number or coordinates are dropped and counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.functions import geo, text

WORD_CAP = 16_384
PREFIX_CAP = 40


@dataclass(frozen=True)
class Gazetteer:
    """houses (a row each), streets, communes, names (of communes, many to many), words (of streets), their counts, and streets with all their words."""

    houses: DataFrame
    streets: DataFrame
    communes: DataFrame
    names: DataFrame
    words: DataFrame
    counts: DataFrame
    spelled: DataFrame
    country: str | None = None
    layer: str | None = None


def clean(rows: DataFrame) -> DataFrame:
    """Usable rows; a missing number is 0 (a row for the street), a number that isn't one drops the row."""
    number = F.when(F.coalesce(F.trim(F.col("numero").cast("string")), F.lit("")) == "", F.lit(0)).otherwise(F.col("numero").cast("string").try_cast("int"))
    lat, lon = (F.col(c).cast("string").try_cast("double") for c in ("lat", "lon"))
    postcode = F.coalesce(F.col("postcode"), F.lit(""))
    rows = rows.withColumn("numero", number).withColumn("lat", lat).withColumn("lon", lon)
    rows = rows.withColumn("postcode", F.when(postcode == "0", "").otherwise(postcode)).withColumn("rep", F.coalesce("rep", F.lit("")))
    return rows.where((F.col("street_norm") != "") & (F.col("code") != "") & geo.valid(F.col("lat"), F.col("lon")) & F.col("numero").isNotNull())


def rejected(rows: DataFrame) -> DataFrame:
    """How many rows clean() drops, by reason: one row."""
    lat, lon = (F.col(c).cast("string").try_cast("double") for c in ("lat", "lon"))
    key = (F.coalesce(F.col("street_norm"), F.lit("")) == "") | (F.coalesce(F.col("code"), F.lit("")) == "")
    coords = ~key & ~geo.valid(lat, lon)
    raw = F.coalesce(F.trim(F.col("numero").cast("string")), F.lit(""))
    number = ~key & ~coords & (raw != "") & raw.try_cast("int").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(key).alias("bad_key"), F.count_if(coords).alias("bad_coords"), F.count_if(number).alias("bad_number")
    )


def houses_of(rows: DataFrame) -> DataFrame:
    e7 = lambda c: F.round(F.col(c) * 1e7).cast("long")
    return rows.select(
        "street_norm", "code", "street", "commune", "commune_norm", "numero", "rep", "postcode", e7("lat").alias("lat_e7"), e7("lon").alias("lon_e7")
    )


def postcode_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "^[0-9]+", 0).try_cast("int"), F.lit(0))


def majority_postcode(houses: DataFrame) -> DataFrame:
    """Per street its most frequent known postcode, ties to the smallest, and whether its houses differ."""
    counts = houses.groupBy("street_norm", "code", "postcode").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("postcode") != ""
    best = F.min_by(F.when(known, F.col("postcode")), F.when(known, F.struct(-F.col("n"), F.col("postcode"))))
    out = counts.groupBy("street_norm", "code").agg(
        F.coalesce(best, F.lit("")).alias("major"), F.count(F.lit(1)).alias("kinds"), F.bool_or(known).alias("known")
    )
    ambiguous = F.col("known") & (F.col("kinds") > 1)
    return out.select("street_norm", "code", F.col("major").alias("postcode_major"), postcode_number(F.col("major")).alias("pc_num"), ambiguous.alias("pc_ambiguous"))


def streets_of(houses: DataFrame) -> DataFrame:
    """A row for each (street_norm, code): centroid, houses, postcode facts and grid cell."""
    mean = lambda c: F.round(F.sum(c) / F.count(F.lit(1))).cast("long")
    base = houses.groupBy("street_norm", "code").agg(
        F.min("street").alias("street"), F.min("commune").alias("commune"), F.min("commune_norm").alias("commune_norm"),
        F.count(F.lit(1)).alias("houses"), mean("lat_e7").alias("lat_e7"), mean("lon_e7").alias("lon_e7"),
    )
    out = base.join(majority_postcode(houses), ["street_norm", "code"])
    shown = F.when(F.col("pc_ambiguous"), "").otherwise(F.col("postcode_major"))
    return out.select(
        *base.columns, "pc_num", "pc_ambiguous", shown.alias("postcode"), geo.cell_of(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7).alias("cell")
    )


def communes_of(streets: DataFrame) -> DataFrame:
    """Per code: display name, prominence (houses) and the centroid of its streets weighted by houses."""
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("houses")).cast("double") / F.sum("houses")).cast("long")
    return streets.groupBy("code").agg(
        F.min("commune").alias("commune"), F.min("commune_norm").alias("commune_norm"), F.sum("houses").alias("prominence"),
        weighted("lat_e7").alias("lat_e7"), weighted("lon_e7").alias("lon_e7"),
    )


def names_of(rows: DataFrame) -> DataFrame:
    """name, code: each commune under its own name and its aliases."""
    own = rows.select(F.col("commune_norm").alias("name"), "code").distinct()
    if "aliases" not in rows.columns:
        return own
    more = rows.select(F.explode(F.split(F.coalesce("aliases", F.lit("")), r"\|")).alias("name"), "code").where("name <> ''")
    return own.unionByName(more.distinct()).distinct()


def words_of(streets: DataFrame) -> DataFrame:
    """word, street_norm, code: words of three letters or more, and ~ with their phonetic key where it differs."""
    word = F.explode(F.array_distinct(F.split("street_norm", r"[^\p{L}\p{N}]+")))
    words = streets.select("street_norm", "code", word.alias("word")).where(F.length("word") >= 3)
    sound = text.phonetic(F.col("word"))
    sounds = words.withColumn("sound", sound).where((F.length("sound") >= 3) & (F.col("sound") != F.col("word"))).select("street_norm", "code", F.concat(F.lit("~"), "sound").alias("word"))
    return words.select("word", "street_norm", "code").unionByName(sounds.select("word", "street_norm", "code")).distinct()


def prefixes_of(names: DataFrame, cap: int = PREFIX_CAP) -> DataFrame:
    """prefix, code: for each beginning of a commune's name the first ``cap`` communes in name order."""
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    spread = names.withColumn("prefix", starts)
    order = W.partitionBy("prefix").orderBy("name", "code")
    return spread.withColumn("_w_n", F.row_number().over(order)).where(F.col("_w_n") <= cap).select("prefix", "code").distinct()


def counts_of(words: DataFrame) -> DataFrame:
    """word, n: how many streets have it."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def spelled_of(words: DataFrame) -> DataFrame:
    """street_norm, code, own: a street with all its words."""
    return words.groupBy("street_norm", "code").agg(F.collect_set("word").alias("own"))


def build(rows: DataFrame, country: str | None = None, layer: str | None = None) -> Gazetteer:
    """All tables, each written once to the shared folder."""
    from waymark.runtime import materialize

    rows = clean(rows)
    houses = materialize(houses_of(rows), "houses")
    streets = materialize(streets_of(houses), "streets")
    words = materialize(words_of(streets), "words")
    return Gazetteer(
        houses, streets, materialize(communes_of(streets), "communes"), materialize(names_of(rows), "names"), words,
        materialize(counts_of(words), "counts"), materialize(spelled_of(words), "spelled"), country, layer,
    )


def check_pair(addresses: Gazetteer, poi: Gazetteer) -> None:
    """An address gazetteer and a layer of points of interest must be of one country, and be what they are used as."""
    if addresses.country and poi.country and addresses.country != poi.country:
        raise ValueError(f"the points of interest are of {poi.country!r}, the addresses of {addresses.country!r}")
    for g, want in ((addresses, "addresses"), (poi, "poi")):
        if g.layer and g.layer != want:
            raise ValueError(f"expected a layer of {want}, got {g.layer!r}")
