"""From candidate streets to ranked answers: houses, scores, confidence, flags and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waymark.functions import geo, text

# fixed values: weights of the confidence
BIAS = -2.748
BY_PRECISION = {"house": 0.965, "interp": 0.158, "near": -0.412, "street": -0.222, "city": -0.506}
BY_FEATURE = {
    "street_exact": 0.899, "street_fuzzy": -0.410, "commune_exact": 2.360, "commune_prefix": 1.240, "rep_exact": 1.280, "pc_exact": 0.738,
    "pc_dept": -0.515,
}
TIGHT_GAP, TIGHT_KM = 12, 0.3
FEATURES = ("street_exact", "street_fuzzy", "commune_exact", "commune_prefix", "pc_exact", "pc_dept", "from_ml", "house_found", "rep_exact", "numero_present")


def blocks_of(houses: DataFrame) -> DataFrame:
    """A row for each street with its numbers in order, so that a lookup is one join and no explosion.

    A number has the first house of each suffix and the last house of all: no others are ever answers, so a block is as long
    as the street has numbers, however many rows the register has for them.
    """
    spot = lambda f: f(F.struct("lon_e7", "lat_e7", "postcode"))
    house = lambda c: F.struct("numero", "rep", f"{c}.lon_e7", f"{c}.lat_e7", f"{c}.postcode")
    street = ["street_norm", "code"]
    each = houses.groupBy(*street, "numero", "rep").agg(spot(F.min).alias("first"), spot(F.max).alias("last"))
    numbers = each.groupBy(*street, "numero").agg(F.array_sort(F.collect_list(house("first"))).alias("houses"), F.max(house("last")).alias("last"))
    return numbers.groupBy(*street).agg(F.array_sort(F.collect_list(F.struct("numero", "houses", "last"))).alias("block"))


def turn_in(block: Column, numero: Column) -> Column:
    """How many numbers of the block come before ``numero``."""
    return F.size(F.filter(block, lambda g: g["numero"] < numero))


def find_house(block: Column, turn: Column, numero: Column, rep: Column) -> Column:
    """The house for a number, its turn in the block, and suffix: struct(kind, lat, lon, numero, rep, own_postcode), or null.

    kind 2: number and suffix; 1: number; 3: between tight neighbours; 0: the nearest number, ties to the lower.
    """
    here = F.get(block, turn)
    upper = F.get(here["houses"], F.lit(0))
    found = F.coalesce(here["numero"] == numero, F.lit(False))
    exact = F.get(F.filter(here["houses"], lambda h: h["rep"] == rep), F.lit(0))
    lower = F.get(block, turn - 1)["last"]
    deg = lambda h, c: h[c] / 1e7

    def at(h: Column, kind: int) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), deg(h, "lat_e7").alias("lat"), deg(h, "lon_e7").alias("lon"), h["numero"].alias("numero"),
            h["rep"].alias("rep"), h["postcode"].alias("own_postcode"),
        )

    gap = upper["numero"] - lower["numero"]
    tight = (gap <= TIGHT_GAP) & (geo.haversine(deg(lower, "lat_e7"), deg(lower, "lon_e7"), deg(upper, "lat_e7"), deg(upper, "lon_e7")) < TIGHT_KM)
    part = (numero - lower["numero"]).cast("double") / gap.cast("double")
    between = lambda c: deg(lower, c) + part * (deg(upper, c) - deg(lower, c))
    middle = F.struct(
        F.lit(3).alias("kind"), between("lat_e7").alias("lat"), between("lon_e7").alias("lon"), numero.alias("numero"), rep.alias("rep"),
        F.when(lower["postcode"] == upper["postcode"], lower["postcode"]).otherwise("").alias("own_postcode"),
    )
    nearest = F.when(numero - lower["numero"] <= upper["numero"] - numero, at(lower, 0)).otherwise(at(upper, 0))
    return (
        F.when(numero.isNull(), None).when(found, F.when(exact.isNotNull(), at(exact, 2)).otherwise(at(upper, 1)))
        .when(lower.isNotNull() & upper.isNotNull(), F.when(tight, middle).otherwise(nearest))
        .when(lower.isNotNull(), at(lower, 0)).when(upper.isNotNull(), at(upper, 0))
    )


def legacy(houses: bool = True) -> Column:
    """The hand-set score of a candidate's features, before or after its house is known."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    c = F.col
    score = (
        one(c("street_exact"), 3) + one(c("street_fuzzy") & ~c("street_exact"), 2) + one(c("commune_exact"), 3)
        + one(c("commune_prefix") & ~c("commune_exact"), 2) + one(c("pc_exact"), 2)
    )
    return score + F.when(c("rep_exact"), 2).when(c("house_found"), 1).otherwise(0) if houses else score


def linear_score(bias: float, weights: list[float]) -> Column:
    """A trained score instead of legacy(): bias plus the weights of the features that hold."""
    if len(weights) != len(FEATURES):
        raise ValueError(f"{len(FEATURES)} weights are needed")
    return sum((F.when(F.col(f), F.lit(w)).otherwise(0.0) for f, w in zip(FEATURES, weights, strict=True)), F.lit(bias))


def confidence() -> Column:
    """Calibrated probability of a hit, to hundredths."""
    z = F.lit(BIAS)
    precision = F.lit(BY_PRECISION["city"])
    for name, w in BY_PRECISION.items():
        precision = F.when(F.col("precision") == name, F.lit(w)).otherwise(precision)
    z = z + precision
    for name, w in BY_FEATURE.items():
        z = z + F.when(F.col(name), F.lit(w)).otherwise(0.0)
    return F.round(F.lit(100.0) / (F.lit(1.0) + F.exp(-z))) / 100.0


def flags() -> Column:
    c = F.col
    on = [
        F.when(c("street_exact"), "street_exact"), F.when(c("street_fuzzy"), "street_fuzzy"),
        F.when(c("commune_exact"), "commune_exact").when(c("commune_prefix"), "commune_prefix"), F.when(c("rep_exact"), "house_rep"),
        F.when(c("pc_exact"), "pc_exact").when(c("pc_dept"), "pc_dept"),
    ]
    return F.array_compact(F.array(*on))


def name_words(name: Column) -> Column:
    return F.filter(F.split(text.norm(name), " "), lambda w: w != "")


def name_similarity(name: Column, query_words: Column) -> Column:
    """The best likeness (0 to 100) of a word of the name to a word of the query."""
    return likeness(name_words(name), query_words)


def likeness(ws: Column, query_words: Column) -> Column:
    """The best likeness (0 to 100) of a word of both lists: 100 without comparing letters where they share one."""

    def like(w: Column, q: Column) -> Column:
        most = F.greatest(F.length(w), F.length(q), F.lit(1))
        return F.lit(100) - F.floor(F.levenshtein(w, q) * 100 / most).cast("int")

    best = F.array_max(F.transform(ws, lambda w: F.array_max(F.transform(query_words, lambda q: like(w, q)))))
    return F.when(F.arrays_overlap(ws, query_words), 100).otherwise(F.coalesce(F.greatest(best, F.lit(0)), F.lit(0)))


def postcode_features(query_pc: Column, street_pc: Column) -> tuple[Column, Column]:
    known = F.coalesce(query_pc.isNotNull() & (street_pc != 0), F.lit(False))
    same = lambda c: F.coalesce(known & c, F.lit(False))
    return same(street_pc == query_pc), same(F.floor(street_pc / 1000) == F.floor(query_pc / 1000))


def answer(cands: DataFrame, streets: DataFrame, blocks: DataFrame, communes: DataFrame) -> DataFrame:
    """Candidates (street_norm, code, features, numero, rep, query_pc, query_words) with point, precision, score, confidence and flags."""
    info = streets.select("street_norm", "code", "street", "commune", F.col("lat_e7").alias("s_lat"), F.col("lon_e7").alias("s_lon"), "pc_num", "pc_ambiguous", F.col("postcode").alias("s_postcode"), name_words(F.col("street")).alias("name_words"))
    out = cands.join(info, ["street_norm", "code"]).join(blocks, ["street_norm", "code"]).join(communes.select("code", "prominence"), "code")
    exact, dept = postcode_features(F.col("query_pc"), F.col("pc_num"))
    out = out.withColumn("pc_exact", exact).withColumn("pc_dept", dept).withColumn("_w_turn", turn_in(F.col("block"), F.col("numero")))
    out = out.withColumn("house", find_house(F.col("block"), F.col("_w_turn"), F.col("numero"), F.col("rep"))).drop("block", "_w_turn")
    kind = F.col("house.kind")
    precision = F.when(kind == 3, "interp").when(kind >= 1, "house").when(kind == 0, "near").otherwise("street")
    out = out.withColumn("precision", precision).withColumn("house_found", F.col("precision") == "house").withColumn("rep_exact", F.coalesce(kind == 2, F.lit(False)))
    snap = F.when(kind == 0, F.abs(F.col("numero") - F.col("house.numero"))).when(kind.isNull() & F.col("numero").isNotNull(), F.lit(2**31 - 1)).otherwise(0)
    postcode = F.when(~F.col("pc_ambiguous"), F.col("s_postcode")).otherwise(F.coalesce("house.own_postcode", F.lit("")))
    out = (
        out.withColumn("lat", F.coalesce("house.lat", F.col("s_lat") / 1e7)).withColumn("lon", F.coalesce("house.lon", F.col("s_lon") / 1e7))
        .withColumn("housenumber", F.concat(F.col("house.numero").cast("string"), F.col("house.rep"))).withColumn("postcode", postcode)
        .withColumn("snap", snap.cast("int")).withColumn("score", legacy() + F.when(F.col("house_found"), 1).otherwise(0))
        .withColumn("name_sim", likeness(F.col("name_words"), F.col("query_words")))
        .withColumn("confidence", F.when(F.col("score") < 0, F.least(confidence(), F.lit(0.4))).otherwise(confidence())).withColumn("flags", flags())
    )
    return out.drop("house", "s_lat", "s_lon", "s_postcode", "name_words")


def order_by(focus: bool = False) -> list[Column]:
    """The order of answers.  An answer without a known postcode comes after those with one, where the query has a postcode."""
    shown = F.regexp_extract("postcode", "^[0-9]+$", 0).try_cast("int")
    away = F.when(F.col("query_pc").isNotNull() & (shown > 0), F.abs(shown - F.col("query_pc")))
    return [
        F.desc("score"), F.desc("name_sim"), away.asc_nulls_last(), F.asc("snap"), *([F.asc_nulls_last("focus_km")] if focus else []),
        F.asc_nulls_first("anchor_km"), F.desc("prominence"), F.asc("street_norm"), F.asc("code"),
    ]


def ranked(answers: DataFrame, keys: list[str], k: int, focus: bool = False, capital: bool = True) -> DataFrame:
    """The k best answers of each query, with rank, after the capital prior and the margin rule.

    ``answers`` has anchor_km (distance to the named city or the capital) and named (whether a city is named).
    """
    w = W.partitionBy(*keys).orderBy(*order_by(focus))
    whole = W.partitionBy(*keys)
    out = answers.withColumn("rank", F.row_number().over(w))
    if capital:
        top = F.min_by(F.struct("anchor_km", text.word_key(F.col("street_norm")).alias("key")), "rank").over(whole)
        out = out.withColumn("_w_top", top)
        fits = F.col("street_exact") & (text.word_key(F.col("street_norm")) == F.col("_w_top.key")) & (F.col("anchor_km") < 40)
        lifted = F.min(F.when(fits & ~F.col("named") & (F.col("_w_top.anchor_km") > 60), F.col("rank"))).over(whole)
        out = out.withColumn("_w_lift", lifted)
        moved = F.when(F.col("rank") == F.col("_w_lift"), 1).when(F.col("rank") < F.col("_w_lift"), F.col("rank") + 1).otherwise(F.col("rank"))
        out = out.withColumn("rank", moved).drop("_w_top", "_w_lift")
    out = out.where(F.col("rank") <= max(k, 2))
    return margin(out, keys).where(F.col("rank") <= k)


def margin(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Where the first two answers score alike but lie far apart, the first is no longer confident and says so."""
    w = W.partitionBy(*keys).orderBy("rank")
    nxt = F.lead(F.struct("score", "lat", "lon")).over(w)
    out = answers.withColumn("_w_next", nxt)
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("_w_next.lat"), F.col("_w_next.lon")) > 50
    unsure = F.coalesce((F.col("rank") == 1) & (F.col("score") - F.col("_w_next.score") < 1) & far, F.lit(False))
    return (
        out.withColumn("confidence", F.when(unsure, F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence")))
        .withColumn("flags", F.when(unsure, F.array_append("flags", F.lit("ambiguous_far"))).otherwise(F.col("flags"))).drop("_w_next")
    )


def monotone(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence never rises down the list."""
    w = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return answers.withColumn("confidence", F.min("confidence").over(w))


def weak() -> Column:
    """May a point of interest replace this first answer?"""
    exact = (F.col("precision") == "house") & F.array_contains("flags", "street_exact")
    fuzzy = F.array_contains("flags", "street_fuzzy") & (F.col("confidence") < 0.60)
    return ~exact & ((F.col("precision") == "city") | (F.col("confidence") < 0.30) | fuzzy)
