"""From raw registers to canonical address rows: filters, names, communes and their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.functions import geo, text
from waymark.plans.grid import grid_join


def registry(raw: DataFrame) -> DataFrame:
    """Rows of a national register: named street, coordinates and a whole house number are needed."""
    number = F.col("numero").cast("string").try_cast("int")
    ok = (F.coalesce(F.trim("nom_voie"), F.lit("")) != "") & F.col("lon").isNotNull() & F.col("lat").isNotNull() & number.isNotNull()
    return raw.where(ok).select(
        "id", number.alias("numero"), F.nullif(F.lower(F.trim("rep")), F.lit("")).alias("rep"), "nom_voie", text.norm(F.col("nom_voie")).alias("nom_voie_norm"),
        F.col("code_postal").cast("string").alias("code_postal"), F.col("code_insee").cast("string").alias("code_insee"), "nom_commune",
        text.norm(F.col("nom_commune")).alias("nom_commune_norm"),
        F.concat(text.norm(F.col("nom_voie")), F.lit("|"), F.col("code_insee").cast("string")).alias("street_key"),
        F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"),
    )


def nested_addresses(raw: DataFrame, country: str) -> DataFrame:
    """Rows with nested address levels (array of struct with value), of one country: the last level is the commune."""
    level = lambda i: F.coalesce(F.try_element_at("address_levels", F.lit(i))["value"], F.lit(""))
    return raw.where((F.col("country") == country) & F.col("street").isNotNull() & F.col("number").isNotNull()).select(
        "id", F.col("street").alias("nom_voie"), F.col("number").alias("number_raw"), F.coalesce("postcode", F.lit("")).alias("postcode_raw"),
        level(-1).alias("nom_commune"), F.when(F.size("address_levels") >= 2, level(-2)).otherwise("").alias("provincia"), "lon", "lat",
    )


def with_codes(rows: DataFrame, keys: list[Column], letter: str = "L", width: int = 6, tile: str = "") -> DataFrame:
    """``rows`` with a commune code: the dense rank of its key.

    The rank is taken over the distinct keys, not over all rows, since a window without partitions is one task.
    """
    names = [f"_w_k{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
    rank = F.dense_rank().over(W.orderBy(*names))
    ranks = keyed.select(*names).distinct().withColumn("code", F.concat(F.lit(letter + tile), F.lpad(rank.cast("string"), width, "0")))
    same = None
    for n in names:
        one = keyed[n].eqNullSafe(ranks[n])
        same = one if same is None else same & one
    joined = keyed.join(ranks, same)
    return joined.select(*[keyed[c] for c in rows.columns], ranks["code"])


def osm_rows(raw: DataFrame) -> DataFrame:
    """Tagged points or outlines to typed rows; absurd numbers and one-letter streets go.

    ``raw`` has nom_voie, number_raw, postcode_raw, nom_commune, lat and lon.
    """
    number = text.any_number(F.col("number_raw"))
    rows = raw.where(F.col("nom_voie").isNotNull() & (F.col("nom_commune") != "")).select(
        "nom_voie", text.norm(F.col("nom_voie")).alias("nom_voie_norm"), number.alias("numero"), text.either_suffix(F.col("number_raw")).alias("rep"),
        F.coalesce(F.nullif(F.regexp_extract("postcode_raw", "[0-9]+", 0), F.lit("")), F.lit("0")).alias("code_postal"), "postcode_raw", "nom_commune",
        text.norm(F.col("nom_commune")).alias("nom_commune_norm"), "lat", "lon",
    )
    rows = rows.where(F.col("numero").between(1, 99999) & (F.length("nom_voie_norm") >= 2))
    cell = lambda c: F.coalesce(F.round(F.col(c) / 2).cast("int"), F.lit(999999))
    return with_codes(rows, [F.col("nom_commune_norm"), cell("lat"), cell("lon")])


def tagged(osm: DataFrame, kind: str, key: str, values: list[str] | None = None) -> DataFrame:
    """Elements of a kind with a tag, of given values where any are given."""
    tag = F.col("tags")[key]
    return osm.where((F.col("kind") == kind) & (tag.isin(values) if values else tag.isNotNull()))


def centroids(ways: DataFrame, nodes: DataFrame, how: str = "mean") -> DataFrame:
    """id, lat, lon of each way from the nodes that its refs name: the mean, or the median for relations."""
    refs = ways.select(F.col("id").alias("way"), F.explode("refs").alias("ref"))
    used = nodes.join(refs.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")
    points = refs.join(used, F.col("ref") == F.col("id"))
    f = F.avg if how == "mean" else F.median
    return points.groupBy("way").agg(f("lat").alias("lat"), f("lon").alias("lon")).withColumnRenamed("way", "id")


def name_variants(tags: DataFrame, keys: list[str], low: int = 2, high: int = 80) -> DataFrame:
    """nm, lat, lon: each distinct name that an element's tags give."""
    names = F.array(*[F.col("tags")[k] for k in keys])
    usable = F.filter(names, lambda x: x.isNotNull() & F.length(x).between(low, high))
    return tags.select(F.explode(F.array_distinct(usable)).alias("nm"), "lat", "lon")


def new_names(names: DataFrame, known: DataFrame, column: str = "nm") -> DataFrame:
    """Names that aren't among the ``known`` ones, whatever their case; unknown known ones hide nothing."""
    have = known.where(F.col(column).isNotNull()).select(F.lower(column).alias("_w_k")).distinct()
    return names.join(have, F.lower(F.col(column)) == F.col("_w_k"), "left_anti")


def gaps(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (number, name) whose number no known row has with a name that holds theirs, or is held by it."""
    k = known.select(F.col("number").alias("_w_n"), F.col("name").alias("_w_s")).distinct()
    alike = F.col("_w_s").contains(F.col("name")) | F.col("name").contains(F.col("_w_s"))
    return candidates.join(k, (F.col("number") == F.col("_w_n")) & alike, "left_anti")


def stitched(houses: DataFrame, aliases: DataFrame, scale: float = 3.0) -> DataFrame:
    """Houses under another name of their street: same name key, and at most a grid cell apart."""
    cell = lambda c: F.round(F.col(c) * F.lit(scale)).cast("long")
    a = aliases.select(F.col("name_norm").alias("_w_name"), "variant", cell("lat").alias("_w_a"), cell("lon").alias("_w_b")).distinct()
    near = (F.abs(cell("lat") - F.col("_w_a")) <= 1) & (F.abs(cell("lon") - F.col("_w_b")) <= 1)
    out = houses.join(a, (F.col("name_norm") == F.col("_w_name")) & near)
    return out.select(*houses.columns, "variant").distinct()


def nearest(rows: DataFrame, places: DataFrame, key: str, scale: float = 10.0, ring: int = 1, by_size: bool = False) -> DataFrame:
    """key, nm: the nearest place in the cells around; with ``by_size`` a place of many people reaches further."""
    joined = grid_join(rows.select(key, "lat", "lon"), places, scale, ring)
    d = geo.squared(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    if by_size:
        d = d / (F.lit(1.0) + F.log(F.lit(1.0) + F.col("r_pop")))
    best = F.min_by("r_nm", F.struct(d, "r_nm", "r_lat", "r_lon"))
    return joined.groupBy(key).agg(best.alias("nm"))


def umbrellas(rows: DataFrame, places: DataFrame, key: str, scale: float = 10.0, ring: int = 3) -> DataFrame:
    """key, aliases: the weightiest place around and the nearest major one, joined by | where they differ."""
    one = nearest(rows, places, key, scale, ring, by_size=True).withColumnRenamed("nm", "u1")
    two = nearest(rows, places.where("major"), key, scale, ring).withColumnRenamed("nm", "u2")
    both = rows.select(key).join(one, key, "left").join(two, key, "left")
    return both.select(key, F.concat_ws("|", "u1", F.nullif("u2", "u1")).alias("aliases"))


def geonames(raw: DataFrame) -> DataFrame:
    """Places from headerless columns (_c0 ...): seats with their Latin and Cyrillic names, population and rank."""
    names = F.concat(F.array("_c1", "_c2"), F.split(F.coalesce("_c3", F.lit("")), ","))
    fit = F.filter(
        names, lambda x: x.isNotNull() & F.length(x).between(2, 40) & x.rlike(r"^[\p{IsLatin}\p{IsCyrillic} .'-]+$") & ~((F.upper(x) == x) & (F.length(x) <= 4))
    )
    seats = raw.where((F.col("_c6") == "P") & F.col("_c7").isin("PPLC", "PPLA", "PPLA2", "PPLA3"))
    return seats.select(
        F.array_join(F.array_distinct(fit), "|").alias("nm"), F.coalesce(F.col("_c14").try_cast("long"), F.lit(0)).alias("pop"),
        F.col("_c7").isin("PPLC", "PPLA", "PPLA2").alias("major"), F.col("_c4").cast("double").alias("lat"), F.col("_c5").cast("double").alias("lon"),
    )


def poi_rows(raw: DataFrame) -> DataFrame:
    """Points of interest as streets with the number 1: a row for each distinct name, in arrondissements where the postcode says so."""
    names = F.concat(F.coalesce("name_common", F.array().cast("array<string>")), F.array("name_primary", "brand_name"))
    names = F.array_distinct(F.filter(names, lambda x: x.isNotNull() & F.length(x).between(4, 80)))
    rows = raw.where((F.col("confidence") >= 0.30) & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rows = rows.select(F.explode(names).alias("street"), "locality", "postcode", "lon", "lat")
    commune = text.arrondissement(F.coalesce("postcode", F.lit("")), F.coalesce("locality", F.lit("")))
    rows = rows.select(
        text.fit_bytes(F.col("street")).alias("street"), text.norm(F.col("street")).alias("street_norm"), commune.alias("commune"),
        text.norm(commune).alias("commune_norm"), F.lit("1").alias("numero"), F.lit("").alias("rep"), F.regexp_extract("postcode", "[0-9]+", 0).alias("postcode"), "lat", "lon",
    ).where("street_norm <> ''")
    half = lambda c: F.floor(F.col(c) * 2).cast("long")
    return with_codes(rows, [F.col("commune_norm"), half("lat"), half("lon")], letter="P")


def license_gate(sources: list[dict]) -> None:
    """No source may ask that what is made from it be shared alike."""
    bad = [s for s in sources if any(w in s.get("license", "").lower() for w in ("odbl", "gpl", "share-alike", "sharealike", "cc-by-sa", "cc by-sa"))]
    if bad:
        raise ValueError(f"sources with share-alike licences: {[s.get('name') for s in bad]}")


# fixed values: the tags that name a street, a town and a kind of place, the first that is there counts
STREET_TAGS = ("addr:street", "addr:place")
TOWN_TAGS = ("addr:city", "addr:town", "addr:village", "addr:municipality", "addr:district", "addr:suburb")
KIND_TAGS = ("amenity", "shop", "office", "tourism", "craft", "leisure", "healthcare")
NETWORK_TAGS = ("brand", "network", "operator")
GONE_TAGS = ("disused", "abandoned", "demolished")


def first_tag(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.trim(F.coalesce(*[tags[k] for k in keys]))


def tag_used(tags: Column, keys: tuple[str, ...]) -> Column:
    """The first key whose value isn't blank, else the last."""
    which = F.lit(keys[-1])
    for k in reversed(keys[:-1]):
        which = F.when(F.trim(tags[k]) != "", k).otherwise(which)
    return which


def category(tags: Column) -> Column:
    """key:value of the first kind of place that isn't blank, else empty."""
    value = lambda k: F.trim(F.regexp_replace(tags[k], r"\s+", " "))
    return F.coalesce(*[F.when(value(k) != "", F.concat(F.lit(f"{k}:"), value(k))) for k in KIND_TAGS], F.lit(""))


def address_candidates(osm: DataFrame) -> DataFrame:
    """Nodes with a house number, a street and a town that still stand, as addresses that truth can be drawn from."""
    t = F.col("tags")
    kept = osm.where((F.col("kind") == "node") & F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    kept = kept.where((F.trim(t["addr:housenumber"]) != "") & (first_tag(t, STREET_TAGS) != "") & (first_tag(t, TOWN_TAGS) != ""))
    for k in GONE_TAGS:
        kept = kept.where(t[k].isNull())
    text_of = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return kept.select(
        F.col("id").alias("object_id"), first_tag(t, STREET_TAGS).alias("street"), tag_used(t, STREET_TAGS).alias("street_tag"),
        F.trim(t["addr:housenumber"]).alias("house_number"), text_of(t["addr:postcode"]).alias("postcode"), first_tag(t, TOWN_TAGS).alias("municipality"),
        tag_used(t, TOWN_TAGS).alias("municipality_tag"), text_of(t["addr:country"]).alias("tagged_country"), category(t).alias("category"),
        F.coalesce(*[F.trim(t[k]) for k in NETWORK_TAGS], F.lit("")).alias("network"), "lat", "lon",
    )


def total_rows(*tables: DataFrame) -> DataFrame:
    """One row: how many rows all tables have."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")) for t in tables]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.agg(F.sum("n").alias("n"))
