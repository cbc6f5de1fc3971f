"""Names of places: which communes a name stands for, and the point of a place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from waymark.functions import geo, words
from waymark.functions.rules import Rules
from waymark.operators.gazetteer import PREFIX_CAP, Gazetteer, prefixes_of

MERGE_KM = 40.0


def lookup_communes(phrases: DataFrame, gaz: Gazetteer, rules: Rules = words.RULES, prefixes: bool = True) -> DataFrame:
    """phrase, code, exact: the communes of each distinct ``phrase``, by the first key that is a name, else by prefix."""

    @F.pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda p: words.commune_keys(p, rules))

    # not deterministic: else Spark filters by it below the distinct, once a row
    asked = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("keys", keys.asNondeterministic()("phrase"))
    tried = asked.select("phrase", F.posexplode("keys").alias("turn", "name"))
    hit = tried.join(gaz.names, "name")
    first = F.min("turn").over(W.partitionBy("phrase"))
    exact = hit.withColumn("first", first).where("turn = first").select("phrase", "code", F.lit(True).alias("exact")).distinct()
    if not prefixes:
        return exact
    rest = asked.join(exact.select("phrase").distinct(), "phrase", "left_anti")
    # the name itself, then with articles
    rest = rest.select("phrase", F.posexplode(F.slice("keys", 1, 5)).alias("turn", "prefix")).join(prefixes_of(gaz.names, PREFIX_CAP), "prefix")
    rest = rest.withColumn("first", first).where("turn = first").select("phrase", "code", F.lit(False).alias("exact")).distinct()
    return exact.unionByName(rest)


def resolve_exact(asked: DataFrame, gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """phrase, lat, lon, name, prominence for distinct phrases in one script.

    Communes of the name: the most prominent one, merged with those of the same display name within MERGE_KM,
    weighted by prominence; else all communes whose name goes on after the phrase and a space.
    """
    found = lookup_communes(asked, gaz, rules, prefixes=False).join(gaz.communes, "code")
    found = found.where("lat_e7 <> 0 OR lon_e7 <> 0").withColumn("lat", F.col("lat_e7") / 1e7).withColumn("lon", F.col("lon_e7") / 1e7)
    top = F.max_by(F.struct("commune", "lat", "lon"), F.struct("prominence", F.col("code"))).over(W.partitionBy("phrase"))
    near = found.withColumn("top", top).where(
        (F.col("commune") == F.col("top.commune")) & (geo.haversine(F.col("top.lat"), F.col("top.lon"), F.col("lat"), F.col("lon")) <= MERGE_KM)
    )
    weight = F.greatest("prominence", F.lit(1))
    mean = lambda c: F.sum(F.col(c) * weight) / F.sum(weight)
    exact = near.groupBy("phrase").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), F.min("commune").alias("name"), F.sum(weight).alias("prominence"))
    rest = asked.select("phrase").where("phrase <> ''").distinct().join(exact.select("phrase"), "phrase", "left_anti")
    under = prefixes_of(gaz.names.where(F.col("name").contains(" ")), PREFIX_CAP).where(F.col("prefix").endswith(" "))
    under = rest.join(under, F.concat("phrase", F.lit(" ")) == F.col("prefix")).join(gaz.communes, "code").where("lat_e7 <> 0 OR lon_e7 <> 0")
    under = under.withColumn("lat", F.col("lat_e7") / 1e7).withColumn("lon", F.col("lon_e7") / 1e7)
    umbrella = under.groupBy("phrase").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), F.min("phrase").alias("name"), F.sum(weight).alias("prominence"))
    return exact.unionByName(umbrella)


def resolve(asked: DataFrame, gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """resolve_exact() of the phrase as it is, else of its transliterations in turn."""

    @F.pandas_udf("array<string>")
    def forms(s: pd.Series) -> pd.Series:
        def of(p):
            ways = (words.cyrillic_to_latin, words.cyrillic_to_latin_english, words.latin_to_cyrillic)
            return list(dict.fromkeys([p, *(words.normalize(w(p)) for w in ways)]))

        return s.map(of)

    asked = asked.select("phrase").where("phrase <> ''").distinct()
    tried = asked.select("phrase", F.posexplode(forms("phrase")).alias("turn", "form"))
    found = resolve_exact(tried.select(F.col("form").alias("phrase")), gaz, rules).withColumnRenamed("phrase", "form")
    best = tried.join(found, "form").groupBy("phrase").agg(F.min_by(F.struct("lat", "lon", "name", "prominence"), "turn").alias("p"))
    return best.select("phrase", "p.*")


def capital_anchor(gaz: Gazetteer, rules: Rules = words.RULES) -> DataFrame:
    """One row at most (lat, lon): the listed capital with the most houses, unless it is tiny, else the most prominent commune."""
    capitals = gaz.communes.sparkSession.createDataFrame([(c,) for c in rules.capitals], "capital string")
    own = gaz.names.join(F.broadcast(capitals), (F.col("name") == F.col("capital")) | F.col("name").startswith(F.concat("capital", F.lit(" "))))  # a few words
    own = own.join(gaz.communes, "code").where("lat_e7 <> 0 OR lon_e7 <> 0")
    mean = lambda c: F.sum(F.col(c) / 1e7 * F.col("prominence")) / F.sum("prominence")
    groups = own.groupBy("capital").agg(F.sum("prominence").alias("total"), mean("lat_e7").alias("lat"), mean("lon_e7").alias("lon"))
    best = groups.agg(F.max_by(F.struct("lat", "lon", "total"), "total").alias("c"))
    order = F.struct(F.col("prominence"), F.col("code"))
    top = gaz.communes.agg(F.max_by(F.struct((F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), "prominence"), order).alias("t"))
    both = top.crossJoin(best)  # one row each
    large = F.coalesce(F.col("c.total") >= F.col("t.prominence") / 20, F.lit(False))
    pick = F.when(large, F.struct("c.lat", "c.lon")).otherwise(F.struct("t.lat", "t.lon"))
    return both.select(pick.alias("p")).select("p.lat", "p.lon").where("lat IS NOT NULL AND (lat <> 0 OR lon <> 0)")


def admin_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """``points`` (lat, lon) with the name of the first region (by ``region_no``) that they lie in, or null.

    Regions have a bounding box and rings in whole 1e-7 degrees; their number is that of a country's regions, and
    the join compares boxes before rings.
    """
    lat, lon = (F.col(c).cast("decimal(20,10)") * 10_000_000 for c in ("lat", "lon"))
    keyed = points.withColumn("_w_id", F.monotonically_increasing_id()).withColumn("_w_la", lat.cast("long")).withColumn("_w_lo", lon.cast("long"))
    box = F.col("_w_la").between(F.col("min_lat"), F.col("max_lat")) & F.col("_w_lo").between(F.col("min_lon"), F.col("max_lon"))
    hits = keyed.join(regions.select("region_no", F.col("name").alias("region"), "min_lat", "max_lat", "min_lon", "max_lon", "rings"), box, "left")
    inside = F.when(geo.inside_rings(F.col("_w_la"), F.col("_w_lo"), F.col("rings")), F.struct("region_no", "region"))
    out = hits.groupBy("_w_id", *points.columns).agg(F.min(inside).alias("r"))
    return out.select(*points.columns, F.col("r.region").alias("region"))
