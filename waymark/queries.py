"""Queries of the address engine over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from waymark import fixtures as X
from waymark.functions import geo, text
from waymark.operators import answers as A, boxes, canon, evaluate as E, gazetteer as G, places, reverse as R, sampling as S, structured
from waymark.operators.freeform import FreeForm, cascade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# text

CLASS = "[-''’`./,;()ʻʼ‘]"


def sql_plain(c: str) -> str:
    return f"replace(strip_accents(lower({c})), 'đ', 'd')"


def sql_norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql_plain(c)}, '{CLASS}', ' ', 'g'), ' +', ' ', 'g'))"


@query("norm_text", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.norm(F.col("text")).alias("norm"))


_RANGES = "text"
for _ in range(4):
    _RANGES = f"regexp_replace({_RANGES}, '([0-9])-[0-9]+', '\\1', 'g')"
_BLOCKS = f"regexp_replace({_RANGES}, '(^|[^\\p{{L}}\\p{{N}}])(\\p{{L}})-([0-9])', '\\1\\2\\3', 'g')"
_BLANK = CLASS[:-1] + r"\s\p{Cc}\p{Z}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{FE00}-\x{FE0F}\x{2190}-\x{2BFF}\x{1F000}-\x{1FFFF}]"


@query("normalize_query", f"""
SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace({sql_plain(_BLOCKS)}, '{_BLANK}', ' ', 'g'), ' +', ' ', 'g')), '([0-9]{{4,}})(\\p{{L}})', '\\1 \\2', 'g') AS norm
FROM conversations""")
def normalize_query(spark, sf_dir):
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize(F.col("text")).alias("norm"))


def sql_phonetic(c: str) -> str:
    out = f"translate({c}, 'aoueiyqkxhwv', 'oooiiikkhhvv')"
    for x in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{x}+', '{x}', 'g')"
    return out


@query("phonetic_key", f"SELECT p_partkey, {sql_phonetic(sql_norm('p_name'))} AS sound FROM part")
def phonetic_key(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", text.phonetic(text.norm(F.col("p_name"))).alias("sound"))


_RAW_NUMBER = "CASE p_partkey % 8 WHEN 0 THEN p_size || 'bis' WHEN 1 THEN p_size || ' - B' WHEN 2 THEN 'K18' || p_size WHEN 3 THEN p_size || '/2' WHEN 4 THEN 'abc' WHEN 5 THEN '' ELSE CAST(p_size AS VARCHAR) END"


def raw_numbers(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = (
        F.when(k % 8 == 0, F.concat(n, F.lit("bis"))).when(k % 8 == 1, F.concat(n, F.lit(" - B"))).when(k % 8 == 2, F.concat(F.lit("K18"), n))
        .when(k % 8 == 3, F.concat(n, F.lit("/2"))).when(k % 8 == 4, "abc").when(k % 8 == 5, "").otherwise(n)
    )
    return X.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query("house_number_split", f"""
WITH r AS (SELECT p_partkey, {_RAW_NUMBER} AS raw FROM part)
SELECT p_partkey, raw, TRY_CAST(regexp_extract(raw, '^[0-9]+') AS INTEGER) AS leading, TRY_CAST(regexp_extract(raw, '[0-9]+') AS INTEGER) AS first_number,
       nullif(lower(trim(regexp_replace(regexp_extract(raw, '^[0-9]+(.*)$', 1), '^[\\s/\\-]+', ''))), '') AS suffix,
       nullif(lower(regexp_replace(CASE WHEN regexp_matches(raw, '^[0-9]') THEN regexp_extract(raw, '^[0-9]+(.*)$', 1) ELSE regexp_extract(raw, '^([^0-9]{{1,4}})', 1) END,
                                   '[\\s\\-/\\.ʻʼ‘]', '', 'g')), '') AS either FROM r""")
def house_number_split(spark, sf_dir):
    raw = F.col("raw")
    return raw_numbers(spark, sf_dir).select(
        "p_partkey", "raw", text.leading_number(raw).alias("leading"), text.any_number(raw).alias("first_number"), text.trailing_suffix(raw).alias("suffix"),
        text.either_suffix(raw).alias("either"),
    )


@query("title_case", """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN upper(left(p_name, 3)) ELSE p_name END AS nm FROM part)
SELECT p_partkey, CASE WHEN nm = upper(nm) AND length(nm) > 3
       THEN array_to_string(list_transform(string_split(lower(nm), ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE nm END AS title FROM n""")
def title_case(spark, sf_dir):
    k = F.col("p_partkey")
    nm = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.upper(F.left("p_name", F.lit(3)))).otherwise(F.col("p_name"))
    return X.table(spark, sf_dir, "part").select("p_partkey", text.title_case(nm).alias("title"))


@query("text_functions", """
WITH r AS (SELECT c_custkey AS k, c_name AS nm, c_mktsegment AS seg FROM customer)
SELECT k, regexp_matches(CAST(10000 + k AS VARCHAR) || CASE WHEN k % 3 = 0 THEN '-x' ELSE '' END, '^[0-9][0-9A-Za-z ]{0,7}$') AS plausible,
       regexp_replace(lower(nm), '[^\\p{L}\\p{N}]', '', 'g') AS address_key,
       concat_ws(', ', nullif(trim(nm), ''), nullif(trim(CASE WHEN k % 2 = 0 THEN '' ELSE seg END), ''), 'FR') AS composed,
       array_to_string(list_sort(string_split(lower(seg) || ' rue de la', ' ')), ' ') AS word_key,
       trim(regexp_replace(regexp_replace('rue 12bis ' || seg || ' 7', '\\b\\d+[\\w/-]*\\b', ' ', 'g'), ' +', ' ', 'g')) AS no_numbers,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(40 + (k % 50) * 0.5 AS DOUBLE) END AS lat
FROM r""")
def text_functions(spark, sf_dir):
    k, nm, seg = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    pc = F.concat((k + 10000).cast("string"), F.when(k % 3 == 0, "-x").otherwise(""))
    near = F.concat((F.lit(40) + (k % 50) * 0.5).cast("string"), F.when(k % 4 == 0, ",7,1").otherwise(",7"))
    return X.table(spark, sf_dir, "customer").select(
        k.alias("k"), text.plausible_postcode(pc).alias("plausible"), text.address_key(nm).alias("address_key"),
        text.compose(nm, F.when(k % 2 == 0, "").otherwise(seg), F.lit("FR")).alias("composed"),
        text.word_key(F.concat(F.lower(seg), F.lit(" rue de la"))).alias("word_key"), text.without_numbers(F.concat(F.lit("rue 12bis "), seg, F.lit(" 7"))).alias("no_numbers"),
        text.lat_lon(near)["lat"].alias("lat"),
    )


@query("arrondissement_display", """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 75000 + o_orderkey % 23 WHEN 1 THEN 69000 + o_orderkey % 12 WHEN 2 THEN 13000 + o_orderkey % 19 ELSE 35000 END AS p FROM orders)
SELECT k, CASE WHEN p BETWEEN 75001 AND 75020 THEN 'Paris ' || p % 100 || CASE WHEN p = 75001 THEN 'er' ELSE 'e' END || ' Arrondissement'
               WHEN p BETWEEN 69001 AND 69009 THEN 'Lyon ' || p % 100 || CASE WHEN p = 69001 THEN 'er' ELSE 'e' END || ' Arrondissement'
               WHEN p BETWEEN 13001 AND 13016 THEN 'Marseille ' || p % 100 || CASE WHEN p = 13001 THEN 'er' ELSE 'e' END || ' Arrondissement' ELSE 'Rennes' END AS commune FROM r""")
def arrondissement_display(spark, sf_dir):
    k = F.col("o_orderkey")
    p = F.when(k % 4 == 0, k % 23 + 75000).when(k % 4 == 1, k % 12 + 69000).when(k % 4 == 2, k % 19 + 13000).otherwise(35000)
    return X.table(spark, sf_dir, "orders").select(k.alias("k"), text.arrondissement(F.concat(p.cast("string"), F.lit(" x")), F.lit("Rennes")).alias("commune"))


@query("unglue_variant", """
SELECT p_partkey, CASE WHEN regexp_matches('c' || p_size, '^\\p{L}{1,2}[0-9]{1,4}$') THEN 'kiet c ' || p_size || ' ' || p_name END AS unglued FROM part""")
def unglue_variant(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", text.unglue(F.concat(F.lit("kiet c"), F.col("p_size").cast("string"), F.lit(" "), "p_name")).alias("unglued"))


_PHONES = """SELECT c_custkey, 'anna ' || array_to_string(list_transform(range(0, c_custkey % 9), lambda i: CASE WHEN c_custkey % 11 = 0 AND i = 2 THEN 'bis' ELSE CAST((c_custkey * (i + 3)) % 1103 AS VARCHAR) END), ' ') || ' visser' || CASE WHEN c_custkey % 4 = 0 THEN ' 06 81 22 64' ELSE ' 12345 6' END AS raw FROM customer"""


@query("strip_phone_runs", f"SELECT c_custkey, trim(regexp_replace(regexp_replace(raw || ' ', '(^| )(?:[0-9]{{1,4}} ){{4,}}', '\\1', 'g'), ' +', ' ', 'g')) AS stripped FROM ({_PHONES})")
def strip_phone_runs(spark, sf_dir):
    """Runs of four short numbers or more go, wherever they stand."""
    k = F.col("c_custkey")
    part = lambda i: F.when((k % 11 == 0) & (i == 2), "bis").otherwise(((k * (i + 3)) % 1103).cast("string"))
    groups = F.transform(F.slice(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")), F.lit(1), (k % 9).cast("int")), part)
    raw = F.concat(F.lit("anna "), F.array_join(groups, " "), F.lit(" visser"), F.when(k % 4 == 0, " 06 81 22 64").otherwise(" 12345 6"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", text.strip_phone_runs(raw).alias("stripped"))


_LIKE = "100 - CAST(floor(levenshtein(w, q) * 100 / greatest(length(w), length(q), 1)) AS INTEGER)"


@query("name_similarity", f"""
WITH pairs AS (SELECT a.p_partkey, a.p_name AS nm, b.p_name AS qq FROM part a JOIN part b ON b.p_partkey = a.p_partkey % 97 + 1),
e AS (SELECT p_partkey, w, q FROM (SELECT p_partkey, unnest(string_split(nm, ' ')) AS w, qq FROM pairs) CROSS JOIN LATERAL (SELECT unnest(string_split(qq, ' ')) AS q))
SELECT p_partkey, max({_LIKE}) AS sim FROM e GROUP BY p_partkey""")
def name_similarity(spark, sf_dir):
    part = X.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey")).alias("o_key"), F.col("p_name").alias("qq"))
    return part.join(other, F.col("o_key") == F.col("p_partkey") % 97 + 1).select("p_partkey", A.name_similarity(F.col("p_name"), F.split("qq", " ")).alias("sim"))


# geometry

_HAV = "2.0 * {r} * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def sql_km(a: str, c: str, b: str, d: str, r: float = geo.KM) -> str:
    """Haversine of (a, c) and (b, d) as (lat, lon)."""
    return _HAV.format(a=a, b=b, c=c, d=d, r=r)


@query("distances", f"""
WITH {X.POINTS} SELECT point_id, round({sql_km('lat', 'lon', '45.0', '6.0')}, 6) AS km, round({sql_km('lat', 'lon', '45.0', '6.0', geo.METRES)}, 3) AS metres,
 round(sqrt(pow((45.0 - lat) * 111320.0, 2) + pow((6.0 - lon) * 111320.0 * greatest(cos(radians(lat)), 0.01), 2)), 3) AS flat,
 CAST(floor((lat + 90.0) / 0.01) AS BIGINT) * 36000 + CAST(floor((lon + 180.0) / 0.01) AS BIGINT) AS cell FROM points""")
def distances(spark, sf_dir):
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(6.0)
    return X.points(spark, sf_dir).select(
        "point_id", F.round(geo.haversine(lat, lon, a, b), 6).alias("km"), F.round(geo.haversine(lat, lon, a, b, geo.METRES), 3).alias("metres"),
        F.round(geo.flat_metres(lat, lon, a, b), 3).alias("flat"), geo.cell_of(lat, lon).alias("cell"),
    )


def regions(spark, sf_dir):
    """A rectangle of rings for each nation, which may overlap: the first region counts."""
    n = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")
    la, lo = F.lit(400_000_000) + F.col("n") * 5_000_000, F.lit(20_000_000) + F.col("n") * 4_000_000
    corner = lambda a, b: F.struct(a.cast("long").alias("lat"), b.cast("long").alias("lon"))
    top, right = la + 60_000 + F.col("n") * 1000, lo + 70_000
    ring = F.array(corner(la, lo), corner(top, lo), corner(top, right), corner(la, right))
    return n.select(
        F.col("n").alias("region_no"), F.col("n_name").alias("name"), la.alias("min_lat"), top.alias("max_lat"), lo.alias("min_lon"), right.alias("max_lon"), F.array(ring).alias("rings")
    )


@query("point_in_polygon", f"""
WITH {X.POINTS}, p AS (SELECT point_id, CAST(trunc(CAST(lat AS DECIMAL(20,10)) * 10000000) AS BIGINT) AS la, CAST(trunc(CAST(lon AS DECIMAL(20,10)) * 10000000) AS BIGINT) AS lo FROM points),
r AS (SELECT n_nationkey AS n, n_name, 400000000 + n_nationkey * 5000000 AS a, 20000000 + n_nationkey * 4000000 AS b FROM nation)
SELECT point_id, (SELECT min_by(n_name, n) FROM r WHERE la >= a AND la < a + 60000 + n * 1000 AND lo >= b AND lo < b + 70000) AS region FROM p""")
def point_in_polygon(spark, sf_dir):
    return places.admin_regions(X.points(spark, sf_dir), regions(spark, sf_dir)).select("point_id", "region")


# building the gazetteer

def broken_rows(spark, sf_dir):
    k = F.col("part")
    rows = X.addresses(spark, sf_dir)
    return (
        rows.withColumn("numero", F.when(k % 7 == 0, "abc").when(k % 7 == 1, "").otherwise(F.col("numero").cast("string")))
        .withColumn("lat", F.when(k % 11 == 0, F.lit(999.0)).when(k % 13 == 0, F.lit(float("nan"))).otherwise(F.col("lat")))
        .withColumn("code", F.when(k % 17 == 0, "").otherwise(F.col("code")))
    )


_BROKEN = f"""{X.ADDRESSES}, broken AS (SELECT * REPLACE (CASE part % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '' ELSE CAST(numero AS VARCHAR) END AS numero,
  CASE WHEN part % 11 = 0 THEN 999.0 WHEN part % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE lat END AS lat, CASE WHEN part % 17 = 0 THEN '' ELSE code END AS code) FROM addresses)"""


@query("canon_filter", f"""
WITH {_BROKEN} SELECT part, CASE WHEN numero = '' THEN 0 ELSE CAST(numero AS INTEGER) END AS numero, lat, lon FROM broken
WHERE code <> '' AND lat BETWEEN -90 AND 90 AND NOT isnan(lat) AND (numero = '' OR TRY_CAST(numero AS INTEGER) IS NOT NULL)""")
def canon_filter(spark, sf_dir):
    return G.clean(broken_rows(spark, sf_dir)).select("part", "numero", "lat", "lon")


@query("builder_rejects", f"""
WITH {_BROKEN} SELECT count(*) AS n_rows, count(*) FILTER (code = '') AS bad_key, count(*) FILTER (code <> '' AND (lat > 90 OR isnan(lat))) AS bad_coords,
 count(*) FILTER (code <> '' AND NOT (lat > 90 OR isnan(lat)) AND numero = 'abc') AS bad_number FROM broken""")
def builder_rejects(spark, sf_dir):
    return G.rejected(broken_rows(spark, sf_dir))


@query("registry_rows", f"""
WITH {X.ADDRESSES} SELECT part AS id, numero, nullif(lower(trim(CASE WHEN part % 2 = 0 THEN upper(rep) ELSE rep END)), '') AS rep, street AS nom_voie, {sql_norm('street')} AS nom_voie_norm,
 {sql_norm('street')} || '|' || code AS street_key FROM addresses WHERE part % 9 <> 0""")
def registry_rows(spark, sf_dir):
    k = F.col("part")
    raw = X.addresses(spark, sf_dir).select(
        k.alias("id"), F.when(k % 9 == 0, "n/a").otherwise(F.col("numero").cast("string")).alias("numero"), F.when(k % 2 == 0, F.upper("rep")).otherwise(F.col("rep")).alias("rep"),
        F.col("street").alias("nom_voie"), F.col("postcode").alias("code_postal"), F.col("code").alias("code_insee"), F.col("commune").alias("nom_commune"), "lon", "lat",
    )
    return canon.registry(raw).select("id", "numero", "rep", "nom_voie", "nom_voie_norm", "street_key")


@query("street_agg", f"WITH {X.GAZETTEER} SELECT street_norm, code, street, commune, commune_norm, houses, lat_e7, lon_e7, pc_num, pc_ambiguous, postcode FROM streets")
def street_agg(spark, sf_dir):
    return X.gazetteer(spark, sf_dir).streets.drop("cell")


@query("commune_prominence", f"WITH {X.GAZETTEER} SELECT code, commune, commune_norm, prominence FROM communes")
def commune_prominence(spark, sf_dir):
    return X.gazetteer(spark, sf_dir).communes.select("code", "commune", "commune_norm", "prominence")


@query("commune_centroid", f"WITH {X.GAZETTEER} SELECT code, lat_e7, lon_e7 FROM communes")
def commune_centroid(spark, sf_dir):
    return X.gazetteer(spark, sf_dir).communes.select("code", "lat_e7", "lon_e7")


@query("majority_postcode", f"WITH {X.GAZETTEER} SELECT street_norm, code, m.postcode AS postcode_major, CAST(m.postcode AS INTEGER) AS pc_num, pc_ambiguous FROM major m JOIN kinds USING (street_norm, code)")
def majority_postcode(spark, sf_dir):
    return G.majority_postcode(X.gazetteer(spark, sf_dir).houses)


@query("postcode_ambiguous", f"WITH {X.GAZETTEER} SELECT code, count(*) FILTER (pc_ambiguous) AS ambiguous, count(*) AS streets FROM streets GROUP BY code")
def postcode_ambiguous(spark, sf_dir):
    return X.gazetteer(spark, sf_dir).streets.groupBy("code").agg(F.count_if("pc_ambiguous").alias("ambiguous"), F.count(F.lit(1)).alias("streets"))


@query("commune_code_dense_rank", f"""
WITH {X.ADDRESSES}, k AS (SELECT DISTINCT commune_norm, CAST(round(lat / 2) AS INTEGER) AS a, CAST(round(lon / 2) AS INTEGER) AS b FROM addresses),
r AS (SELECT *, 'L' || lpad(CAST(dense_rank() OVER (ORDER BY commune_norm, a, b) AS VARCHAR), 6, '0') AS code FROM k)
SELECT part, r.code FROM addresses x JOIN r ON r.commune_norm = x.commune_norm AND r.a = CAST(round(x.lat / 2) AS INTEGER) AND r.b = CAST(round(x.lon / 2) AS INTEGER)""")
def commune_code_dense_rank(spark, sf_dir):
    cell = lambda c: F.round(F.col(c) / 2).cast("int")
    rows = X.addresses(spark, sf_dir).select("part", "commune_norm", "lat", "lon")
    return canon.with_codes(rows, [F.col("commune_norm"), cell("lat"), cell("lon")]).select("part", "code")


@query("osm_rows", f"""
WITH {X.ADDRESSES}, r AS (SELECT part, street, street_norm, commune, lat, lon, CASE part % 3 WHEN 0 THEN 'vl ' || numero WHEN 1 THEN numero || '-' || rep ELSE CAST(numero * 5000 AS VARCHAR) END AS raw FROM addresses)
SELECT street_norm AS nom_voie_norm, TRY_CAST(regexp_extract(raw, '[0-9]+') AS INTEGER) AS numero,
  nullif(lower(regexp_replace(CASE WHEN regexp_matches(raw, '^[0-9]') THEN regexp_extract(raw, '^[0-9]+(.*)$', 1) ELSE regexp_extract(raw, '^([^0-9]{{1,4}})', 1) END, '[\\s\\-/\\.ʻʼ‘]', '', 'g')), '') AS rep, lat, lon
FROM r WHERE TRY_CAST(regexp_extract(raw, '[0-9]+') AS INTEGER) BETWEEN 1 AND 99999""")
def osm_rows(spark, sf_dir):
    k, n = F.col("part"), F.col("numero")
    raw = F.when(k % 3 == 0, F.concat(F.lit("vl "), n.cast("string"))).when(k % 3 == 1, F.concat(n.cast("string"), F.lit("-"), "rep")).otherwise((n * 5000).cast("string"))
    rows = X.addresses(spark, sf_dir).select(F.col("street").alias("nom_voie"), raw.alias("number_raw"), F.col("postcode").alias("postcode_raw"), F.col("commune").alias("nom_commune"), "lat", "lon")
    return canon.osm_rows(rows).select("nom_voie_norm", "numero", "rep", "lat", "lon")


@query("word_postings", f"""
WITH {X.GAZETTEER}, w AS (SELECT DISTINCT street_norm, code, unnest(regexp_split_to_array(street_norm, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM streets),
l AS (SELECT * FROM w WHERE length(word) >= 3), s AS (SELECT street_norm, code, word, {sql_phonetic('word')} AS sound FROM l)
SELECT word, street_norm, code FROM l UNION SELECT '~' || sound, street_norm, code FROM s WHERE length(sound) >= 3 AND sound <> word""")
def word_postings(spark, sf_dir):
    return X.gazetteer(spark, sf_dir).words


@query("alias_explode", """
WITH r AS (SELECT n_nationkey AS k, [lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'umbrella ' || n_regionkey END, 'x', lower(n_name)] AS names FROM nation)
SELECT k, unnest(list_distinct(list_filter(names, lambda x: x IS NOT NULL AND length(x) BETWEEN 2 AND 80))) AS nm FROM r""")
def alias_explode(spark, sf_dir):
    tags = F.create_map(
        F.lit("name"), F.lower("n_name"), F.lit("name:ru"), F.when(F.col("n_nationkey") % 2 != 0, F.concat(F.lit("umbrella "), F.col("n_regionkey").cast("string"))), F.lit("alt"), F.lit("x"),
        F.lit("old"), F.lower("n_name"),
    )
    rows = X.table(spark, sf_dir, "nation").select(tags.alias("tags"), F.col("n_nationkey").alias("lat"), F.lit(0.0).alias("lon"))
    return canon.name_variants(rows, ["name", "name:ru", "alt", "old"]).select(F.col("lat").alias("k"), "nm")


@query("anti_not_in", "SELECT p_partkey, p_name AS nm FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_name LIKE 's%')")
def anti_not_in(spark, sf_dir):
    part = X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("nm"))
    return canon.new_names(part, part.where("nm LIKE 's%'").select(F.upper("nm").alias("nm")))


@query("anti_not_exists_like", """
WITH a AS (SELECT p_partkey, p_size AS number, p_name AS name FROM part), k AS (SELECT DISTINCT p_size AS number, split_part(p_name, ' ', 1) AS name FROM part WHERE p_partkey % 7 = 1)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.number = a.number AND (k.name LIKE '%' || a.name || '%' OR a.name LIKE '%' || k.name || '%'))""")
def anti_not_exists_like(spark, sf_dir):
    part = X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("number"), F.col("p_name").alias("name"))
    return canon.gaps(part, part.where("p_partkey % 7 = 1").select("number", F.substring_index("name", " ", 1).alias("name")))


@query("name_stitching", f"""
WITH {X.ADDRESSES}, al AS (SELECT DISTINCT street_norm, 'Улица ' || split_part(street, ' ', 2) AS variant, CAST(round(lat * 3) AS BIGINT) AS a, CAST(round(lon * 3) AS BIGINT) AS b FROM addresses WHERE part % 3 = 0)
SELECT DISTINCT x.part, al.variant FROM addresses x JOIN al ON al.street_norm = x.street_norm AND abs(CAST(round(x.lat * 3) AS BIGINT) - al.a) <= 1 AND abs(CAST(round(x.lon * 3) AS BIGINT) - al.b) <= 1""")
def name_stitching(spark, sf_dir):
    rows = X.addresses(spark, sf_dir)
    al = rows.where("part % 3 = 0").select(F.col("street_norm").alias("name_norm"), F.concat(F.lit("Улица "), F.get(F.split("street", " "), F.lit(1))).alias("variant"), "lat", "lon")
    return canon.stitched(rows.select("part", F.col("street_norm").alias("name_norm"), "lat", "lon"), al).select("part", "variant")


_WAYS = "ways AS (SELECT l_orderkey AS id, list(l_partkey) AS refs FROM lineitem GROUP BY l_orderkey)"


def ways_and_nodes(spark, sf_dir):
    ways = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("refs"))
    nodes = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 40.0).alias("lat"), (F.col("p_partkey") % 89).cast("double").alias("lon"))
    return ways, nodes


@query("semi_referenced", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def semi_referenced(spark, sf_dir):
    refs = X.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(refs, "id", "left_semi")


@query("way_centroids", f"""
WITH {_WAYS}, u AS (SELECT id, unnest(refs) AS ref FROM ways), pts AS (SELECT u.id, CAST(p_size + 40.0 AS DOUBLE) AS lat, CAST(p_partkey % 89 AS DOUBLE) AS lon FROM u JOIN part ON p_partkey = ref)
SELECT id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(median(lat), 6) AS mid_lat, round(median(lon), 6) AS mid_lon FROM pts GROUP BY id""")
def way_centroids(spark, sf_dir):
    ways, nodes = ways_and_nodes(spark, sf_dir)
    mean, mid = canon.centroids(ways, nodes), canon.centroids(ways, nodes, "median")
    r = lambda c, a: F.round(c, 6).alias(a)
    out = mean.select("id", r("lat", "lat"), r("lon", "lon"))
    return out.join(mid.select("id", r("lat", "mid_lat"), r("lon", "mid_lon")), "id")


def settlements(spark, sf_dir):
    g = X.gazetteer(spark, sf_dir)
    return g.communes.select(
        F.col("commune").alias("nm"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), (F.col("prominence") * 1000).alias("pop"),
        (F.col("code").cast("int") % 3 == 0).alias("major"),
    )


_SETTLED = "settled AS (SELECT commune AS nm, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, prominence * 1000 AS pop, CAST(code AS INTEGER) % 3 = 0 AS major FROM communes)"
_SHIFTED = "shifted AS (SELECT point_id, lat + (point_id % 7) * 0.07 AS lat, lon + (point_id % 5) * 0.05 AS lon FROM points)"


def shifted(spark, sf_dir):
    k = F.col("point_id")
    return X.points(spark, sf_dir).select("point_id", (F.col("lat") + (k % 7) * F.lit(0.07)).alias("lat"), (F.col("lon") + (k % 5) * F.lit(0.05)).alias("lon"))


def sql_nearest(name: str, where: str, divide: str, scale: int, ring: int) -> str:
    d = f"((x.lat - p.lat) * (x.lat - p.lat) + ((x.lon - p.lon) * cos(radians(x.lat))) * ((x.lon - p.lon) * cos(radians(x.lat)))){divide}"
    near = " AND ".join(f"CAST(round(p.{c} * {scale}) AS BIGINT) BETWEEN CAST(round(x.{c} * {scale}) AS BIGINT) - {ring} AND CAST(round(x.{c} * {scale}) AS BIGINT) + {ring}" for c in ("lat", "lon"))
    return f"{name} AS (SELECT point_id, nm FROM (SELECT point_id, nm, row_number() OVER (PARTITION BY point_id ORDER BY {d}, nm, p.lat, p.lon) AS rn FROM shifted x JOIN settled p ON {near} {where}) WHERE rn = 1)"


@query("nearest_in_grid", f"WITH {X.GAZETTEER}, {X.POINTS}, {_SETTLED}, {_SHIFTED}, {sql_nearest('n1', '', '', 2, 1)} SELECT point_id, nm FROM n1")
def nearest_in_grid(spark, sf_dir):
    return canon.nearest(shifted(spark, sf_dir), settlements(spark, sf_dir), "point_id", 2.0, 1)


@query("umbrella_weighted", f"""
WITH {X.GAZETTEER}, {X.POINTS}, {_SETTLED}, {_SHIFTED}, {sql_nearest('u1', '', ' / (1 + ln(1 + p.pop))', 10, 9)}, {sql_nearest('u2', 'AND p.major', '', 10, 9)}
SELECT point_id, concat_ws('|', u1.nm, nullif(u2.nm, u1.nm)) AS aliases FROM shifted LEFT JOIN u1 USING (point_id) LEFT JOIN u2 USING (point_id)""")
def umbrella_weighted(spark, sf_dir):
    return canon.umbrellas(shifted(spark, sf_dir), settlements(spark, sf_dir), "point_id", 10.0, 9)


@query("poi_layer", f"""
WITH raw AS (SELECT s_suppkey AS k, 'Cafe ' || s_name AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'Brand ' || s_nationkey ELSE NULL END AS b, 'NATION_' || s_nationkey AS loc,
  40 + s_nationkey * 0.5 AS lat, 2 + s_nationkey * 0.4 AS lon, 75000 + s_suppkey % 30 AS pc, (s_suppkey % 10) / 10.0 AS conf FROM supplier),
e AS (SELECT unnest(list_distinct(list_filter(['Bar', a, b], lambda x: x IS NOT NULL AND length(x) BETWEEN 4 AND 80))) AS street, * FROM raw WHERE conf >= 0.30),
c AS (SELECT street, {sql_norm('street')} AS street_norm, CASE WHEN pc BETWEEN 75001 AND 75020 THEN 'Paris ' || pc % 100 || CASE WHEN pc = 75001 THEN 'er' ELSE 'e' END || ' Arrondissement' ELSE loc END AS commune, lat, lon, CAST(pc AS VARCHAR) AS postcode FROM e)
SELECT street, street_norm, commune, postcode, 'P' || lpad(CAST(dense_rank() OVER (ORDER BY {sql_norm('commune')}, floor(lat * 2), floor(lon * 2)) AS VARCHAR), 6, '0') AS code FROM c""")
def poi_layer(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    raw = X.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Cafe "), "s_name").alias("name_primary"), F.array(F.lit("Bar")).alias("name_common"), F.when(s % 2 == 0, F.concat(F.lit("Brand "), n.cast("string"))).alias("brand_name"),
        F.concat(F.lit("NATION_"), n.cast("string")).alias("locality"), (F.lit(40) + n * 0.5).alias("lat"), (F.lit(2) + n * 0.4).alias("lon"),
        (s % 30 + 75000).cast("string").alias("postcode"), ((s % 10) / 10.0).alias("confidence"),
    )
    return canon.poi_rows(raw).select("street", "street_norm", "commune", "postcode", "code")


# geocoding

_PICK = "{'n': numero, 'r': rep, 'x': lon_e7, 'y': lat_e7, 'p': h.postcode}"
_MATCHED = f"""{X.GAZETTEER}, {X.STRUCTURED},
m AS (SELECT query_id, s.street_norm, s.code, s.street, s.commune, s.pc_num, s.pc_ambiguous, s.postcode AS s_pc, s.lat_e7 AS s_lat, s.lon_e7 AS s_lon,
   CAST(nullif(regexp_extract(a.number, '^[0-9]+'), '') AS INTEGER) AS num, coalesce(regexp_extract(a.number, '^[0-9]+(.*)$', 1), '') AS nrep, CAST(a.postcode AS INTEGER) AS q_pc
   FROM asked a JOIN streets s ON s.street_norm = lower(a.street) AND s.commune_norm = lower(a.city)),
f AS (SELECT query_id, min({_PICK}) FILTER (numero = num AND rep = nrep) AS ex, min({_PICK}) FILTER (numero = num) AS sm, max({_PICK}) FILTER (numero < num) AS lo, min({_PICK}) FILTER (numero > num) AS up
   FROM m JOIN houses h USING (street_norm, code) GROUP BY query_id),
k AS (SELECT m.*, f.ex, f.sm, f.lo, f.up, CASE WHEN num IS NULL THEN NULL WHEN ex IS NOT NULL THEN 2 WHEN sm IS NOT NULL THEN 1
     WHEN lo IS NOT NULL AND up IS NOT NULL THEN CASE WHEN up.n - lo.n <= 12 AND {sql_km('lo.y / 1e7', 'lo.x / 1e7', 'up.y / 1e7', 'up.x / 1e7')} < 0.3 THEN 3 ELSE 0 END ELSE 0 END AS kind,
     CASE WHEN ex IS NOT NULL THEN ex WHEN sm IS NOT NULL THEN sm WHEN lo IS NULL THEN up WHEN up IS NULL THEN lo WHEN num - lo.n <= up.n - num THEN lo ELSE up END AS h FROM m JOIN f USING (query_id)),
g AS (SELECT *, CASE kind WHEN 3 THEN 'interp' WHEN 2 THEN 'house' WHEN 1 THEN 'house' WHEN 0 THEN 'near' ELSE 'street' END AS precision,
     CASE WHEN kind = 3 THEN lo.y / 1e7 + CAST(num - lo.n AS DOUBLE) / (up.n - lo.n) * (up.y / 1e7 - lo.y / 1e7) WHEN kind IS NULL THEN s_lat / 1e7 ELSE h.y / 1e7 END AS lat,
     CASE WHEN kind = 3 THEN lo.x / 1e7 + CAST(num - lo.n AS DOUBLE) / (up.n - lo.n) * (up.x / 1e7 - lo.x / 1e7) WHEN kind IS NULL THEN s_lon / 1e7 ELSE h.x / 1e7 END AS lon,
     CASE WHEN kind = 3 THEN num || nrep WHEN kind IS NULL THEN NULL ELSE h.n || h.r END AS housenumber,
     CASE WHEN NOT pc_ambiguous THEN s_pc WHEN kind IS NULL THEN '' WHEN kind = 3 THEN CASE WHEN lo.p = up.p THEN lo.p ELSE '' END ELSE h.p END AS postcode,
     coalesce(pc_num <> 0 AND pc_num = q_pc, FALSE) AS pc_exact, coalesce(pc_num <> 0 AND pc_num // 1000 = q_pc // 1000, FALSE) AS pc_dept FROM k),
z AS (SELECT *, 6 + CASE WHEN pc_exact THEN 2 ELSE 0 END + CASE kind WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS score,
     round(100.0 / (1.0 + exp(-(-2.748 + CASE precision WHEN 'house' THEN 0.965 WHEN 'interp' THEN 0.158 WHEN 'near' THEN -0.412 ELSE -0.222 END + 0.899 + 2.360
       + CASE WHEN kind = 2 THEN 1.280 ELSE 0 END + CASE WHEN pc_exact THEN 0.738 ELSE 0 END + CASE WHEN pc_dept THEN -0.515 ELSE 0 END)))) / 100.0 AS confidence,
     'street_exact,commune_exact' || CASE WHEN kind = 2 THEN ',house_rep' ELSE '' END || CASE WHEN pc_exact THEN ',pc_exact' WHEN pc_dept THEN ',pc_dept' ELSE '' END AS flags FROM g)"""
_HIT = "query_id, precision, score, confidence, street, housenumber, commune, postcode, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7, CAST(round(lon * 1e7) AS BIGINT) AS lon_e7, flags"
_blocks: dict = {}


def blocks(spark, sf_dir):
    """Houses by street, written once a session."""
    from waymark.runtime import materialize

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _blocks:
        _blocks[key] = materialize(A.blocks_of(X.gazetteer(spark, sf_dir).houses), "blocks")
    return _blocks[key]


def cells(spark, sf_dir):
    """Houses and boxes by grid cell, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, "cells")
    if key not in _blocks:
        _blocks[key] = R.nearby_of(X.gazetteer(spark, sf_dir))
    return _blocks[key]


def hits(rows: DataFrame) -> DataFrame:
    e7 = lambda c: F.round(F.col(c) * 1e7).cast("long").alias(f"{c}_e7")
    return rows.select("query_id", "precision", "score", "confidence", "street", "housenumber", "commune", "postcode", e7("lat"), e7("lon"), F.concat_ws(",", "flags").alias("flags"))


def answered(spark, sf_dir) -> DataFrame:
    return structured.geocode(X.structured_queries(spark, sf_dir), X.gazetteer(spark, sf_dir), 1, blocks=blocks(spark, sf_dir))


@query("structured_geocode", f"WITH {_MATCHED} SELECT {_HIT} FROM z")
def structured_geocode(spark, sf_dir):
    return hits(answered(spark, sf_dir))


@query("house_match", f"WITH {_MATCHED} SELECT query_id, precision, housenumber, postcode FROM z WHERE precision IN ('house', 'near')")
def house_match(spark, sf_dir):
    return answered(spark, sf_dir).where(F.col("precision").isin("house", "near")).select("query_id", "precision", "housenumber", "postcode")


@query("house_interpolate", f"WITH {_MATCHED} SELECT {_HIT} FROM z WHERE precision = 'interp'")
def house_interpolate(spark, sf_dir):
    return hits(answered(spark, sf_dir).where("precision = 'interp'"))


@query("street_level", f"WITH {_MATCHED} SELECT {_HIT} FROM z WHERE precision = 'street'")
def street_level(spark, sf_dir):
    return hits(answered(spark, sf_dir).where("precision = 'street'"))


@query("weak_answers", f"""
WITH {_MATCHED} SELECT query_id, NOT (precision = 'house' AND flags LIKE '%street_exact%') AND (precision = 'city' OR confidence < 0.30 OR (flags LIKE '%street_fuzzy%' AND confidence < 0.60)) AS weak FROM z""")
def weak_answers(spark, sf_dir):
    return answered(spark, sf_dir).select("query_id", A.weak().alias("weak"))


_HOMONYMS = f"""{X.GAZETTEER}, q AS (SELECT DISTINCT street_norm AS phrase, street_norm || '|' || CAST(10000 + (length(street_norm) % 25) * 1000 AS VARCHAR) AS query_id, 10000 + (length(street_norm) % 25) * 1000 AS pc FROM streets),
c AS (SELECT q.query_id, s.*, m.prominence, 3 + CASE WHEN s.pc_num = pc THEN 2 ELSE 0 END AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY s.code) AS n FROM q JOIN streets s ON s.street_norm = q.phrase JOIN communes m USING (code))"""


def homonyms(spark, sf_dir):
    """Each street name asked without a commune, with a postcode of its own."""
    g = X.gazetteer(spark, sf_dir)
    q = g.streets.select(F.col("street_norm").alias("phrase")).distinct().select("phrase", F.concat_ws("|", "phrase", (F.lit(10000) + (F.length("phrase") % 25) * 1000).cast("string")).alias("query_id"))
    q = q.withColumn("pc", F.lit(10000) + (F.length("phrase") % 25) * 1000)
    return q.join(g.streets, F.col("street_norm") == F.col("phrase")).join(g.communes.select("code", "prominence"), "code").withColumn("score", F.lit(3) + F.when(F.col("pc_num") == F.col("pc"), 2).otherwise(0))


@query("department_filter", f"WITH {_HOMONYMS} SELECT query_id, code FROM c JOIN q USING (query_id) WHERE pc_num = 0 OR pc_num // 1000 = pc // 1000")
def department_filter(spark, sf_dir):
    """What the free-form search keeps of its candidates: none of another department."""
    rows = homonyms(spark, sf_dir).select("query_id", F.lit(0).alias("attempt"), "code", "street_norm", "pc_num", F.col("pc").alias("query_pc"), F.col("score").alias("legacy"))
    return freeform(spark, sf_dir)._cut(rows, structured.MAX_K).select("query_id", "code")


@query("homonym_rank", f"""
WITH {_HOMONYMS}, o AS (SELECT c.*, CASE WHEN c.postcode = '' THEN NULL ELSE abs(CAST(c.postcode AS INTEGER) - q.pc) END AS away FROM c JOIN q USING (query_id))
SELECT query_id, code, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, away ASC NULLS LAST, prominence DESC, code) AS INTEGER) AS rank FROM o QUALIFY rank <= 5""")
def homonym_rank(spark, sf_dir):
    """The engine's order, where names, houses and anchors are alike: score, postcode, prominence, code."""
    rows = homonyms(spark, sf_dir).withColumns({
        "query_pc": F.col("pc"), "name_sim": F.lit(100), "snap": F.lit(0), "anchor_km": F.lit(0.0), "confidence": F.lit(0.5), "lat": F.col("lat_e7") / 1e7, "lon": F.col("lon_e7") / 1e7,
        "flags": F.array().cast("array<string>"), "street_exact": F.lit(True), "named": F.lit(True),
    })
    return A.ranked(rows, ["query_id"], 5, capital=False).select("query_id", "code", "score", "rank")


def ranked_homonyms(spark, sf_dir):
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("prominence"), "code")
    rows = homonyms(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    return (
        rows.withColumn("confidence", (F.lit(90) - (F.col("pc_num") * 7 + F.length("query_id")) % 80) / 100.0).withColumn("lat", F.col("lat_e7") / 1e7)
        .withColumn("lon", F.col("lon_e7") / 1e7).withColumn("flags", F.array().cast("array<string>"))
    )


_RANKED = f"""{_HOMONYMS}, r AS (SELECT query_id, code, score, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, (90 - (pc_num * 7 + length(query_id)) % 80) / 100.0 AS confidence, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prominence DESC, code) AS INTEGER) AS rank FROM c),
l AS (SELECT *, lead(score) OVER w AS s2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM r WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
u AS (SELECT *, coalesce(rank = 1 AND score - s2 < 1 AND {sql_km('lat', 'lon', 'lat2', 'lon2')} > 50, FALSE) AS unsure FROM l)"""


@query("margin_flag", f"WITH {_RANKED} SELECT query_id, code, rank, CASE WHEN unsure THEN least(confidence, 0.2) ELSE confidence END AS confidence, unsure AS ambiguous FROM u WHERE rank <= 2")
def margin_flag(spark, sf_dir):
    out = A.margin(ranked_homonyms(spark, sf_dir), ["query_id"]).where("rank <= 2")
    return out.select("query_id", "code", "rank", "confidence", F.array_contains("flags", "ambiguous_far").alias("ambiguous"))


@query("monotone_confidence", f"WITH {_RANKED} SELECT query_id, code, rank, min(confidence) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS confidence FROM r")
def monotone_confidence(spark, sf_dir):
    return A.monotone(ranked_homonyms(spark, sf_dir), ["query_id"]).select("query_id", "code", "rank", "confidence")


def phrases_of_streets(spark, sf_dir, change):
    """Every street asked by a changed name, with its commune."""
    g = X.gazetteer(spark, sf_dir)
    return g.streets.select(F.concat_ws("|", "street_norm", "code").alias("query_id"), F.lit(1).alias("c"), change(F.col("street_norm")).alias("phrase"), F.col("commune_norm").alias("commune_phrase"), F.lit(None).cast("int").alias("query_pc"))


@query("fuzzy_street", f"""
WITH {X.GAZETTEER}, q AS (SELECT street_norm || '|' || code AS query_id, code, left(street_norm, length(street_norm) - 3) || right(street_norm, 2) AS phrase FROM streets),
p AS (SELECT q.query_id, q.code, q.phrase, s.street_norm, levenshtein(q.phrase, s.street_norm) AS d, length(q.phrase) AS n, length(s.street_norm) AS m FROM q JOIN streets s ON s.code = q.code),
e AS (SELECT *, d = 1 AND (m = n - 1 OR (m >= n AND n <= 26)) OR (m = n AND d = 2 AND len(list_filter(range(1, n), lambda i: left(phrase, i - 1) || phrase[i + 1] || phrase[i] || substr(phrase, i + 2) = street_norm)) > 0) AS edit,
   len(list_filter(range(CASE WHEN n <= 11 THEN n - 1 ELSE n - 2 END, CASE WHEN n <= 11 THEN n + 2 ELSE n + 3 END), lambda k: levenshtein(left(street_norm, k), phrase) <= CASE WHEN n <= 11 THEN 1 ELSE 2 END)) > 0
   AND len(list_filter(string_split(phrase, ' '), lambda w: length(w) >= 3 AND w NOT IN ('rue', 'avenue', 'boulevard', 'place')
       AND len(list_filter(string_split(street_norm, ' '), lambda v: levenshtein(w, v) <= 1)) > 0)) > 0 AS start_ FROM p WHERE n >= 5),
b AS (SELECT *, bool_or(edit) OVER (PARTITION BY query_id) AS edits FROM e)
SELECT query_id, street_norm, code FROM b WHERE CASE WHEN edits THEN edit ELSE start_ END""")
def fuzzy_street(spark, sf_dir):
    from waymark.operators.candidates import typos

    drop = lambda s: F.concat(F.left(s, F.length(s) - 3), F.right(s, F.lit(2)))
    return typos(phrases_of_streets(spark, sf_dir, drop), ["query_id"], X.gazetteer(spark, sf_dir)).select("query_id", "street_norm", "code")


@query("word_subset", f"""
WITH {X.GAZETTEER}, q AS (SELECT street_norm || '|' || code AS query_id, code, split_part(street_norm, ' ', -1) AS word FROM streets),
c AS (SELECT q.query_id, s.street_norm, s.code, count(*) OVER (PARTITION BY q.query_id) AS n FROM q JOIN streets s ON s.code = q.code AND list_contains(string_split(s.street_norm, ' '), q.word))
SELECT query_id, street_norm, code FROM c WHERE n <= 8""")
def word_subset(spark, sf_dir):
    from waymark.operators.candidates import parts

    last = lambda s: F.substring_index(s, " ", -1)
    return parts(phrases_of_streets(spark, sf_dir, last), ["query_id"], X.gazetteer(spark, sf_dir)).select("query_id", "street_norm", "code")


def plain_lines(spark, sf_dir):
    q = X.structured_queries(spark, sf_dir)
    line = F.trim(F.regexp_replace(F.concat_ws(" ", F.coalesce("number", F.lit("")), "street", F.coalesce("postcode", F.lit("")), "city"), " +", " "))
    return q.select("query_id", line.alias("q"))


def freeform(spark, sf_dir) -> FreeForm:
    return FreeForm(X.gazetteer(spark, sf_dir), blocks=blocks(spark, sf_dir))


@query("freeform_plain", f"WITH {_MATCHED} SELECT {_HIT} FROM z")
def freeform_plain(spark, sf_dir):
    """Number, street, postcode and city in one line: the answer is that of the structured query."""
    return hits(freeform(spark, sf_dir).geocode(plain_lines(spark, sf_dir), 1))


_STYLES = _MATCHED.replace("CAST(a.postcode AS INTEGER) AS q_pc", "CAST(CASE WHEN (query_id // 5) % 5 <> 4 OR a.number IS NULL THEN a.postcode END AS INTEGER) AS q_pc")
assert _STYLES != _MATCHED


@query("freeform_styles", f"WITH {_STYLES} SELECT {_HIT} FROM z")
def freeform_styles(spark, sf_dir):
    """Plain, in capitals, punctuated, abbreviated, and city first with a number: always the answer of the structured query."""
    return hits(freeform(spark, sf_dir).geocode(X.freeform_queries(spark, sf_dir, typos=False).select("query_id", "q"), 1))


@query("freeform_geocode")
def freeform_geocode(spark, sf_dir):
    return hits(freeform(spark, sf_dir).geocode(X.freeform_queries(spark, sf_dir).select("query_id", "q"), 1))


@query("focus_geocode", f"""
WITH {X.GAZETTEER}, {X.STRUCTURED},
m AS (SELECT a.query_id, s.*, {sql_km('a.lat', 'a.lon', 's.lat_e7 / 1e7', 's.lon_e7 / 1e7')} AS km, p.prominence FROM asked a JOIN streets s ON s.street_norm = lower(a.street) JOIN communes p USING (code)),
r AS (SELECT *, row_number() OVER w AS n, lead(lat_e7 / 1e7) OVER w AS lat2, lead(lon_e7 / 1e7) OVER w AS lon2 FROM m WINDOW w AS (PARTITION BY query_id ORDER BY km, prominence DESC, code))
SELECT query_id, 'street' AS precision, 3 AS score, round(100.0 / (1.0 + exp(2.748 + 0.222 - 0.899))) / 100.0 AS confidence, street, CAST(NULL AS VARCHAR) AS housenumber, commune, postcode,
 lat_e7, lon_e7, 'street_exact' || CASE WHEN coalesce({sql_km('lat_e7 / 1e7', 'lon_e7 / 1e7', 'lat2', 'lon2')} > 50, FALSE) THEN ',ambiguous_far' ELSE '' END AS flags FROM r WHERE n = 1""")
def focus_geocode(spark, sf_dir):
    """Street names without a city, near a point: the point decides between homonyms."""
    q = X.structured_queries(spark, sf_dir).select("query_id", F.col("street").alias("q"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    return hits(freeform(spark, sf_dir).geocode(q, 1, focus=True))


def poi_gazetteer(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    raw = X.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Cafe "), "s_name").alias("name_primary"), F.array().cast("array<string>").alias("name_common"), F.lit(None).cast("string").alias("brand_name"),
        F.concat(F.lit("NATION_"), n.cast("string")).alias("locality"), (F.lit(40) + n * 0.5).alias("lat"), (F.lit(2) + n * 0.4).alias("lon"), F.lit("").alias("postcode"), F.lit(0.9).alias("confidence"),
    )
    return G.build(canon.poi_rows(raw), layer="poi")


@query("poi_cascade", f"""
WITH {_MATCHED} SELECT -query_id - 1 AS {_HIT} FROM z UNION ALL
SELECT s_suppkey, 'street', 6, round(100.0 / (1.0 + exp(2.748 + 0.222 - 0.899 - 2.360))) / 100.0, 'Cafe ' || s_name, NULL, 'NATION_' || s_nationkey, '', 400000000 + s_nationkey * 5000000, 20000000 + s_nationkey * 4000000,
 'street_exact,commune_exact,poi_layer' FROM supplier""")
def poi_cascade(spark, sf_dir):
    """Names of suppliers and addresses: the first are found in the layer of points of interest only, the others keep their answers."""
    s = X.table(spark, sf_dir, "supplier")
    q = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("cafe "), F.lower("s_name"), F.lit(" nation_"), F.col("s_nationkey").cast("string")).alias("q"))
    q = q.unionByName(plain_lines(spark, sf_dir).select((-F.col("query_id") - 1).alias("query_id"), "q"))
    first = freeform(spark, sf_dir).geocode(q, 1)
    return hits(cascade(first, q, FreeForm(poi_gazetteer(spark, sf_dir)), 1))


@query("reverse_geocode", f"""
WITH {X.GAZETTEER}, {X.POINTS}, pc AS (SELECT *, CAST(floor((lat + 90.0) / 0.01) AS BIGINT) AS pr, CAST(floor((lon + 180.0) / 0.01) AS BIGINT) AS pk FROM points),
sc AS (SELECT *, CAST(floor((lat_e7 / 1e7 + 90.0) / 0.01) AS BIGINT) AS sr, CAST(floor((lon_e7 / 1e7 + 180.0) / 0.01) AS BIGINT) AS sk FROM streets),
d AS (SELECT unnest(range(-4, 5)) AS dr), near_ AS (SELECT p.point_id, p.lat, p.lon, s.*, greatest(abs(p.pr - s.sr), abs(p.pk - s.sk)) AS ring FROM pc p CROSS JOIN d JOIN sc s ON s.sr = p.pr + d.dr AND s.sk BETWEEN p.pk - 4 AND p.pk + 4),
w AS (SELECT *, count(*) FILTER (ring <= 1) OVER (PARTITION BY point_id) AS n1, count(*) FILTER (ring <= 2) OVER (PARTITION BY point_id) AS n2 FROM near_),
u AS (SELECT * FROM w WHERE ring <= CASE WHEN n1 >= 3 THEN 1 WHEN n2 >= 3 THEN 2 ELSE 4 END),
h AS (SELECT u.point_id, u.street_norm, u.code, u.street, u.commune, u.pc_ambiguous, u.postcode AS s_pc, h.numero, h.rep, h.postcode, h.lat_e7 AS hy, h.lon_e7 AS hx,
   floor(sqrt(((h.lon_e7 / 1e7 - u.lon) * 111320.0 * greatest(cos(radians(u.lat)), 0.01)) * ((h.lon_e7 / 1e7 - u.lon) * 111320.0 * greatest(cos(radians(u.lat)), 0.01)) + ((h.lat_e7 / 1e7 - u.lat) * 111320.0) * ((h.lat_e7 / 1e7 - u.lat) * 111320.0)) * 1e6 + 0.5) / 1e6 AS dist
   FROM u JOIN houses h USING (street_norm, code)),
o AS (SELECT *, row_number() OVER (PARTITION BY point_id, street_norm, code, numero, rep ORDER BY dist, hx, hy, postcode) AS dup FROM h),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY dist, hx, hy, street_norm, code, numero, rep) AS INTEGER) AS rank FROM o WHERE dup = 1)
SELECT point_id, rank, CASE WHEN dist <= 50 THEN 'house' WHEN dist <= 250 THEN 'near' ELSE 'approximate' END AS precision, street, numero || rep AS housenumber, commune,
  CASE WHEN pc_ambiguous THEN postcode ELSE s_pc END AS postcode, hy AS lat_e7, hx AS lon_e7, dist AS distance_m, greatest(least(0.97 - dist / 500.0, 0.95), 0.1) AS confidence FROM r WHERE rank <= 3""")
def reverse_geocode(spark, sf_dir):
    out = R.reverse(X.points(spark, sf_dir), X.gazetteer(spark, sf_dir), 3, cells(spark, sf_dir))
    return out.select(
        "point_id", "rank", "precision", "street", "housenumber", "commune", "postcode", F.round(F.col("lat") * 1e7).cast("long").alias("lat_e7"),
        F.round(F.col("lon") * 1e7).cast("long").alias("lon_e7"), "distance_m", "confidence",
    )


@query("reverse_bands", SQL["reverse_geocode"].replace("SELECT point_id, rank, CASE", "SELECT CASE").split(", street, numero || rep")[0] + ", count(*) AS n FROM r WHERE rank <= 3 GROUP BY 1")
def reverse_bands(spark, sf_dir):
    return R.reverse(X.points(spark, sf_dir), X.gazetteer(spark, sf_dir), 3, cells(spark, sf_dir)).groupBy("precision").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_place", f"WITH {X.GAZETTEER} SELECT commune_norm AS phrase, round(lat_e7 / 1e7, 6) AS lat, round(lon_e7 / 1e7, 6) AS lon, commune AS name, prominence FROM communes")
def resolve_place(spark, sf_dir):
    g = X.gazetteer(spark, sf_dir)
    asked = X.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("phrase"))
    return places.resolve(asked, g).select("phrase", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name", "prominence")


@query("capital_anchor", f"WITH {X.GAZETTEER} SELECT lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon FROM communes ORDER BY prominence DESC, code DESC LIMIT 1")
def capital_anchor(spark, sf_dir):
    return places.capital_anchor(X.gazetteer(spark, sf_dir))


# evaluation and sampling

_TRUTH = f"""{X.ADDRESSES}, {X.STRUCTURED}, truth AS (SELECT query_id, lat, lon, city AS country, CASE query_id % 3 WHEN 0 THEN 'outside' WHEN 1 THEN 'upstream' ELSE 'unknown' END AS lineage, 'src' || query_id % 2 AS source FROM asked),
ja AS (SELECT *, query_id % 5 = 4 AS empty, query_id % 5 <> 4 AND {sql_km('lat', 'lon', 'lat + (query_id % 5) * 0.0011', 'lon', geo.METRES)} <= 300 AS hit FROM truth),
jb AS (SELECT query_id, query_id % 7 <> 6 AND {sql_km('lat', 'lon', 'lat + (query_id % 7) * 0.0009', 'lon', geo.METRES)} <= 300 AS hit_b FROM truth)"""


def truth(spark, sf_dir):
    k = F.col("query_id")
    return X.structured_queries(spark, sf_dir).select(
        "query_id", "lat", "lon", F.col("city").alias("country"), F.when(k % 3 == 0, "outside").when(k % 3 == 1, "upstream").otherwise("unknown").alias("lineage"),
        F.concat(F.lit("src"), (k % 2).cast("string")).alias("source"),
    )


def engine(spark, sf_dir, classes: int, step: float):
    k = F.col("query_id")
    t = truth(spark, sf_dir).where(k % classes != classes - 1)
    return t.select("query_id", (F.col("lat") + (k % classes) * F.lit(step)).alias("lat"), "lon")


def judged(spark, sf_dir):
    return E.judged(truth(spark, sf_dir), engine(spark, sf_dir, 5, 0.0011), "query_id")


_SETS = [[], ["country"], ["lineage"], ["source"], ["country", "lineage"], ["country", "source"], ["source", "lineage"], ["country", "source", "lineage"]]


@query("score_grouping_sets", f"""
WITH {_TRUTH} SELECT CASE WHEN grouping(country) = 1 THEN 'all' ELSE country END AS country, CASE WHEN grouping(lineage) = 1 THEN 'all' ELSE lineage END AS lineage, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source,
 count(*) AS cases, count(*) FILTER (hit) AS hits, count(*) - count(*) FILTER (hit) AS misses, count(*) FILTER (empty) AS empty, count(*) FILTER (hit) * 100.0 / count(*) AS hit_pct FROM ja
GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in _SETS)})""")
def score_grouping_sets(spark, sf_dir):
    return E.score(judged(spark, sf_dir), _SETS)


@query("wilson_interval", f"""
WITH {_TRUTH}, c AS (SELECT country, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS p FROM ja GROUP BY country)
SELECT country, round(100.0 * greatest(0.0, (p + {E.Z}*{E.Z} / (2 * n)) / (1 + {E.Z}*{E.Z} / n) - {E.Z} / (1 + {E.Z}*{E.Z} / n) * sqrt(p * (1 - p) / n + {E.Z}*{E.Z} / (4 * n * n))), 6) AS low,
 round(100.0 * least(1.0, (p + {E.Z}*{E.Z} / (2 * n)) / (1 + {E.Z}*{E.Z} / n) + {E.Z} / (1 + {E.Z}*{E.Z} / n) * sqrt(p * (1 - p) / n + {E.Z}*{E.Z} / (4 * n * n))), 6) AS high FROM c""")
def wilson_interval(spark, sf_dir):
    c = E.score(judged(spark, sf_dir), [["country"]])
    low, high = E.wilson(F.col("hits"), F.col("cases"))
    return c.select("country", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def compared(spark, sf_dir):
    a = judged(spark, sf_dir).select("query_id", "country", F.col("hit").alias("hit_a"))
    b = E.judged(truth(spark, sf_dir), engine(spark, sf_dir, 7, 0.0009), "query_id").select("query_id", F.col("hit").alias("hit_b"))
    return a.join(b, "query_id")


_PAIRED = "count(*) AS cases, count(*) FILTER (hit AND hit_b) AS both_hit, count(*) FILTER (hit AND NOT hit_b) AS only_a, count(*) FILTER (NOT hit AND hit_b) AS only_b, count(*) FILTER (NOT hit AND NOT hit_b) AS both_miss"


@query("paired_contingency", f"WITH {_TRUTH} SELECT country, {_PAIRED} FROM ja JOIN jb USING (query_id) GROUP BY country")
def paired_contingency(spark, sf_dir):
    return E.paired(compared(spark, sf_dir), ["country"])


@query("mcnemar_exact", f"""
WITH {_TRUTH}, p AS (SELECT country, {_PAIRED} FROM ja JOIN jb USING (query_id) GROUP BY country), b AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM p)
SELECT country, cases, both_hit, only_a, only_b, both_miss,
 round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 8) AS p_value FROM b""")
def mcnemar_exact(spark, sf_dir):
    return E.mcnemar(E.paired(compared(spark, sf_dir), ["country"])).withColumn("p_value", F.round("p_value", 8))


@query("region_spread", f"""
WITH {_TRUTH}, r AS (SELECT country, source || '-' || lineage AS region, count(*) FILTER (hit) * 100.0 / count(*) AS rate FROM ja GROUP BY ALL)
SELECT country, arg_max(region, (rate, region)) AS best, max(rate) AS best_rate, arg_min(region, (rate, region)) AS worst, min(rate) AS worst_rate, max(rate) - min(rate) AS rate_range FROM r GROUP BY country""")
def region_spread(spark, sf_dir):
    r = judged(spark, sf_dir).groupBy("country", F.concat_ws("-", "source", "lineage").alias("region")).agg((F.count_if("hit") * 100.0 / F.count(F.lit(1))).alias("rate"))
    return E.spread(r, "country", "region", "rate")


@query("upper_median", """
WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)
SELECT g, v AS median FROM r WHERE n = c // 2 + 1""")
def upper_median(spark, sf_dir):
    return E.upper_median(X.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v")), "g", "v")


@query("filled_counts", """
WITH o AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, n_name AS nm, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
x AS (SELECT DISTINCT d FROM o), y AS (SELECT DISTINCT nm FROM o) SELECT d, nm, coalesce(n, 0) AS n FROM x CROSS JOIN y LEFT JOIN o USING (d, nm)""")
def filled_counts(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").join(X.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    o = o.join(X.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return E.filled_counts(o.select(F.col("o_orderdate").cast("date").cast("string").alias("d"), F.col("n_name").alias("nm")), "d", "nm")


@query("id_digest", "SELECT o_orderstatus AS g, sha256(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), chr(10)) || chr(10)) AS digest, count(*) AS n FROM orders GROUP BY o_orderstatus")
def id_digest(spark, sf_dir):
    return E.id_digest(X.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), "o_orderkey"), "g", "o_orderkey")


@query("hash_topn_per_group", f"WITH {X.ADDRESSES} SELECT code, part FROM addresses QUALIFY row_number() OVER (PARTITION BY code ORDER BY sha256('seed|' || part || '|' || code), part) <= 5")
def hash_topn_per_group(spark, sf_dir):
    return S.top_n(X.addresses(spark, sf_dir).select("code", "part"), ["code"], [S.hash_order("seed", F.col("part").cast("string"), F.col("code")), F.col("part")], 5)


@query("least_record", f"WITH {X.ADDRESSES} SELECT street_norm, code, min((numero, rep, part)).numero AS numero, min((numero, rep, part)).part AS part FROM (SELECT street_norm, code, {{'numero': numero, 'rep': rep, 'part': part}} AS r, numero, rep, part FROM addresses) GROUP BY ALL".replace("min((numero, rep, part))", "min(r)"))
def least_record(spark, sf_dir):
    rows = X.addresses(spark, sf_dir).select("street_norm", "code", "numero", "rep", "part")
    return S.least_record(rows, ["street_norm", "code"], ["numero", "rep", "part"]).select("street_norm", "code", "numero", "part")


@query("constraint_pressure", f"WITH {X.ADDRESSES} SELECT part, round(greatest(count(*) OVER (PARTITION BY code, street_norm) / 2.0, count(*) OVER (PARTITION BY code, numero) / 3.0), 6) AS pressure FROM addresses")
def constraint_pressure(spark, sf_dir):
    return S.pressure(X.addresses(spark, sf_dir), "code", {"street_norm": 2, "numero": 3}).select("part", F.round("pressure", 6).alias("pressure"))


@query("packing_bound", f"""
WITH {X.ADDRESSES}, a AS (SELECT code, count(*) AS n, count(DISTINCT street_norm) AS d FROM addresses GROUP BY code), b AS (SELECT code, sum(c) AS s FROM (SELECT code, least(count(*), 3) AS c FROM addresses GROUP BY code, numero) GROUP BY code)
SELECT code, CAST(least(n, d, s) AS BIGINT) AS bound FROM a JOIN b USING (code)""")
def packing_bound(spark, sf_dir):
    return S.packing_bound(X.addresses(spark, sf_dir), "code", ["street_norm"], {"numero": 3})


@query("cross_source_collision", f"""
WITH {X.ADDRESSES}, r AS (SELECT part, code, street_norm, numero, part % 3 AS family FROM addresses)
SELECT part FROM (SELECT *, count(DISTINCT family) OVER (PARTITION BY code, street_norm, numero) AS f FROM r) WHERE f > 1""")
def cross_source_collision(spark, sf_dir):
    rows = X.addresses(spark, sf_dir).select("part", "code", "street_norm", "numero", (F.col("part") % 3).alias("family"))
    return S.collisions(rows, ["code", "street_norm", "numero"], "family").select("part")


@query("universe_collision", f"""
WITH {X.ADDRESSES}, r AS (SELECT part, street_norm || '|' || code || '|' || numero AS key, round(lat * 1e5) || ',' || round(lon * 1e5) AS spot FROM addresses), u AS (SELECT * FROM r WHERE part % 4 = 0)
SELECT part FROM r WHERE part % 4 <> 0 AND key NOT IN (SELECT key FROM u) AND spot NOT IN (SELECT spot FROM u)""")
def universe_collision(spark, sf_dir):
    spot = F.concat_ws(",", F.round(F.col("lat") * 1e5).cast("string"), F.round(F.col("lon") * 1e5).cast("string"))
    rows = X.addresses(spark, sf_dir).select("part", F.concat_ws("|", "street_norm", "code", F.col("numero").cast("string")).alias("key"), spot.alias("spot"))
    return S.outside(rows.where("part % 4 <> 0"), rows.where("part % 4 = 0"), "key", "spot").select("part")


@query("truth_faults", f"""
WITH {X.ADDRESSES}, t AS (SELECT part % 4000 AS record_id, CASE WHEN part % 50 = 0 THEN ' ' ELSE street || ', ' || commune END AS query, 'FR' AS country, CASE WHEN part % 60 = 0 THEN 99 ELSE lat END AS lat, lon FROM addresses)
SELECT count(*) AS n_rows, count(*) FILTER (trim(query) = '') AS blank, count(*) FILTER (lat > 90) AS bad_coords, count(*) - count(DISTINCT record_id) AS repeated_ids,
 count(*) - count(DISTINCT (country, regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS repeated_addresses, count(*) - count(DISTINCT (country, round(lat * 1e5), round(lon * 1e5))) AS repeated_spots FROM t""")
def truth_faults(spark, sf_dir):
    k = F.col("part")
    rows = X.addresses(spark, sf_dir).select(
        (k % 4000).alias("record_id"), F.when(k % 50 == 0, " ").otherwise(F.concat_ws(", ", "street", "commune")).alias("query"), F.lit("FR").alias("country"),
        F.when(k % 60 == 0, F.lit(99.0)).otherwise(F.col("lat")).alias("lat"), "lon",
    )
    return E.truth_faults(rows)


@query("greedy_quota", f"""
WITH RECURSIVE {X.ADDRESSES}, r AS (SELECT code, part, street_norm, numero, row_number() OVER (PARTITION BY code ORDER BY sha256('greedy|' || part)) AS n FROM addresses),
g AS (SELECT DISTINCT code, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS streets, CAST([] AS BIGINT[]) AS numbers, CAST([] AS BIGINT[]) AS parts FROM r
 UNION ALL SELECT code, n, CASE WHEN ok THEN list_append(streets, street_norm) ELSE streets END, CASE WHEN ok THEN list_append(numbers, numero) ELSE numbers END, CASE WHEN ok THEN list_append(parts, part) ELSE parts END
 FROM (SELECT g.code, r.n, g.streets, g.numbers, g.parts, r.street_norm, r.numero, r.part,
   len(g.parts) < 30 AND NOT list_contains(g.streets, r.street_norm) AND len(list_filter(g.numbers, lambda x: x = r.numero)) < 2 AS ok FROM g JOIN r ON r.code = g.code AND r.n = g.n + 1))
SELECT code, unnest(parts) AS part FROM g QUALIFY n = max(n) OVER (PARTITION BY code)""")
def greedy_quota(spark, sf_dir):
    """Thirty rows a commune: no street twice, at most two of a number, in hash order."""
    rows = X.addresses(spark, sf_dir).select("code", "part", "street_norm", "numero").withColumn("turn", S.hash_order("greedy", F.col("part").cast("string")))
    return S.greedy(rows, "code", 30, ["street_norm"], {"numero": 2}, ["turn"]).select("code", "part")


@query("quota_select", f"WITH {X.ADDRESSES} SELECT code, part FROM addresses QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE WHEN rep = '' THEN 0 ELSE 1 END, sha256('q|' || part), part) <= 8")
def quota_select(spark, sf_dir):
    rows = X.addresses(spark, sf_dir).select("code", "part", "rep")
    return S.quota(rows, "code", F.col("rep") == "", [S.hash_order("q", F.col("part").cast("string")), F.col("part")], 8).select("code", "part")


@query("lineage_class", """
WITH r AS (SELECT s_suppkey AS k, [CASE s_suppkey % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'meta' ELSE 'gov' END, 'extra'] AS sources, s_suppkey % 5 = 0 AS direct FROM supplier)
SELECT k, CASE WHEN list_contains(sources, 'osm') THEN 'common_upstream' WHEN direct AND len(list_filter(sources, lambda s: s IN ('gov', 'extra'))) = len(sources) THEN 'outside_chain' ELSE 'unknown_lineage' END AS lineage FROM r""")
def lineage_class(spark, sf_dir):
    from waymark.operators.lineage import lineage

    k = F.col("s_suppkey")
    src = F.array(F.when(k % 4 == 0, "osm").when(k % 4 == 1, "meta").otherwise("gov"), F.lit("extra"))
    rows = X.table(spark, sf_dir, "supplier").select(k.alias("k"), src.alias("sources"), (k % 5 == 0).alias("direct"))
    return rows.select("k", lineage(F.col("sources"), F.col("direct"), upstream=["osm"], independent=["gov", "extra"]).alias("lineage"))


@query("json_batch", f"""
WITH {_MATCHED} SELECT query_id, to_json({{'precision': precision, 'street': street, 'commune': commune, 'score': score}}) AS answer FROM z""")
def json_batch(spark, sf_dir):
    """Requests as JSON lines, answers as JSON."""
    from waymark.sources.jsonl import parse_requests

    q = X.structured_queries(spark, sf_dir)
    lines = q.select("query_id", F.to_json(F.struct("street", F.col("number").alias("housenumber"), "city", "postcode")).alias("line"))
    asked = parse_requests(lines, "line").select("query_id", "street", F.col("housenumber").alias("number"), "city", "postcode")
    out = structured.geocode(asked, X.gazetteer(spark, sf_dir), 1, blocks=blocks(spark, sf_dir))
    return out.select("query_id", F.to_json(F.struct("precision", "street", "commune", "score")).alias("answer"))


@query("dump_features", f"""
WITH {_MATCHED} SELECT query_id, street_norm, [1, 0, 1, 0, CAST(pc_exact AS INTEGER), CAST(pc_dept AS INTEGER), 0, CAST(precision = 'house' AS INTEGER), CAST(coalesce(kind = 2, FALSE) AS INTEGER), CAST(num IS NOT NULL AS INTEGER)] AS features FROM z""")
def dump_features(spark, sf_dir):
    """Candidate features in their fixed order, for training a ranking."""
    from waymark.operators.features import features

    return features(X.structured_queries(spark, sf_dir), X.gazetteer(spark, sf_dir), blocks(spark, sf_dir))


# more adapters and lookups

@query("fit_bytes", """
WITH d AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) <= 255 THEN t ELSE left(t, list_max(list_filter(range(0, 256), lambda n: strlen(left(t, n)) <= 255))) END AS short FROM d""")
def fit_bytes(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", text.fit_bytes(F.col("text")).alias("short"))


@query("nested_levels", """
SELECT 's' || s_suppkey AS id, 'Rue ' || s_name AS nom_voie, CAST(s_suppkey % 90 + 1 AS VARCHAR) AS number_raw, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(10000 + s_suppkey AS VARCHAR) END AS postcode_raw,
 n_name AS nom_commune, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE r_name END AS provincia
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 5 <> 0""")
def nested_levels(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = X.table(spark, sf_dir, "supplier").join(X.table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = rows.join(X.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    level = lambda c: F.struct(F.col(c).alias("value"))
    raw = rows.select(
        F.concat(F.lit("s"), s.cast("string")).alias("id"), F.concat(F.lit("Rue "), "s_name").alias("street"), (s % 90 + 1).cast("string").alias("number"),
        F.when(s % 4 != 0, (s + 10000).cast("string")).alias("postcode"), F.when(s % 3 == 0, F.array(level("n_name"))).otherwise(F.array(level("r_name"), level("n_name"))).alias("address_levels"),
        F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"), F.when(s % 5 == 0, "XX").otherwise("FR").alias("country"),
    )
    return canon.nested_addresses(raw, "FR").select("id", "nom_voie", "number_raw", "postcode_raw", "nom_commune", "provincia")


@query("commune_lookup", f"""
WITH {X.GAZETTEER}, p AS (SELECT DISTINCT left(lower(n_name), 8) AS phrase FROM nation UNION SELECT 'nation' UNION SELECT 'nowhere'),
e AS (SELECT phrase, code, TRUE AS exact FROM p JOIN communes ON commune_norm = phrase),
x AS (SELECT phrase, code, FALSE AS exact, row_number() OVER (PARTITION BY phrase ORDER BY commune_norm, code) AS n FROM p JOIN communes ON starts_with(commune_norm, phrase) WHERE phrase NOT IN (SELECT phrase FROM e))
SELECT phrase, code, exact FROM e UNION ALL SELECT phrase, code, exact FROM x WHERE n <= 40""")
def commune_lookup(spark, sf_dir):
    nation = X.table(spark, sf_dir, "nation").select(F.left(F.lower("n_name"), F.lit(8)).alias("phrase"))
    asked = nation.unionByName(spark.createDataFrame([("nation",), ("nowhere",)], "phrase string"))
    return places.lookup_communes(asked, X.gazetteer(spark, sf_dir))


@query("hash_shards", f"WITH {X.ADDRESSES} SELECT left(sha256('shard|' || part), 2) AS shard, count(*) AS n FROM addresses GROUP BY 1")
def hash_shards(spark, sf_dir):
    shard = F.left(S.hash_order("shard", F.col("part").cast("string")), F.lit(2))
    return X.addresses(spark, sf_dir).groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("registry_stats", f"""
WITH {X.ADDRESSES} SELECT count(*) AS n_rows, count(DISTINCT code) AS communes, count(DISTINCT street_norm || '|' || code) AS streets, count(DISTINCT postcode) AS postcodes,
 min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM addresses""")
def registry_stats(spark, sf_dir):
    return X.addresses(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("communes"), F.count_distinct(F.concat_ws("|", "street_norm", "code")).alias("streets"),
        F.count_distinct("postcode").alias("postcodes"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
    )


# boxes, extracts and samples of truth

_BOX, _HOLES = (2.3, 40.2, 8.0, 47.5), [(3.2, 41.5, 3.2045, 41.505), (5.0, 43.0, 6.0, 44.6)]
_SQL_IN = lambda b: f"(lon >= {b[0]} AND lon <= {b[2]} AND lat >= {b[1]} AND lat <= {b[3]})"


@query("box_region", f"WITH {X.POINTS} SELECT point_id FROM points WHERE {_SQL_IN(_BOX)} AND NOT {_SQL_IN(_HOLES[0])} AND NOT {_SQL_IN(_HOLES[1])}")
def box_region(spark, sf_dir):
    return boxes.region(X.points(spark, sf_dir), _BOX, _HOLES).select("point_id")


_COUNTRIES = {"NATION_3": (3.2, 41.5, 3.205, 41.51), "NATION_7": (0.0, 0.0, 90.0, 90.0), "NATION_9": (0.0, 0.0, 1.0, 1.0)}


@query("country_boxes", f"""WITH {X.ADDRESSES} SELECT part FROM addresses WHERE {' OR '.join(f"(commune = '{n}' AND lon - 0.0005 <= {b[2]} AND lon + 0.0005 >= {b[0]} AND lat - 0.0005 <= {b[3]} AND lat + 0.0005 >= {b[1]})" for n, b in _COUNTRIES.items())}""")
def country_boxes(spark, sf_dir):
    side = lambda c, d: (F.col(c) + F.lit(d)).cast("double")
    box = F.struct(side("lon", -0.0005).alias("xmin"), side("lat", -0.0005).alias("ymin"), side("lon", 0.0005).alias("xmax"), side("lat", 0.0005).alias("ymax"))
    rows = X.addresses(spark, sf_dir).select("part", F.lower("commune").alias("country"), box.alias("bbox"))
    return boxes.of_countries(rows, _COUNTRIES).select("part")


@query("osm_candidates", """
WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE ' ' || p_size END AS hn, CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' ' END AS st, CASE WHEN p_partkey % 2 = 0 THEN 'Square ' || p_partkey END AS pl,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE ' City' END AS city, 'Village' AS vil, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'cafe' END AS am, CASE WHEN p_partkey % 6 < 3 THEN 'book  store' END AS shop,
  CASE WHEN p_partkey % 11 = 0 THEN 'yes' END AS gone, CASE WHEN p_partkey % 9 = 0 THEN 'Net' END AS net, 50.0 + p_size AS lat, CASE WHEN p_partkey % 13 <> 0 THEN 5.0 END AS lon FROM part)
SELECT id AS object_id, trim(coalesce(st, pl)) AS street, CASE WHEN trim(coalesce(st, '')) <> '' THEN 'addr:street' ELSE 'addr:place' END AS street_tag, trim(hn) AS house_number, trim(coalesce(city, vil)) AS municipality,
 CASE WHEN city IS NULL THEN 'addr:village' ELSE 'addr:city' END AS municipality_tag, CASE WHEN am <> '' THEN 'amenity:cafe' WHEN shop IS NOT NULL THEN 'shop:book store' ELSE '' END AS category, coalesce(net, '') AS network
FROM t WHERE trim(hn) <> '' AND trim(coalesce(st, pl)) <> '' AND trim(coalesce(city, vil)) <> '' AND gone IS NULL AND lon IS NOT NULL""")
def osm_candidates(spark, sf_dir):
    k, s = F.col("p_partkey"), F.lit
    tags = {
        "addr:housenumber": F.when(k % 7 == 0, " ").otherwise(F.concat(s(" "), F.col("p_size").cast("string"))), "addr:street": F.when(k % 3 != 0, F.concat("p_name", s(" "))),
        "addr:place": F.when(k % 2 == 0, F.concat(s("Square "), k.cast("string"))), "addr:city": F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise(" City"), "addr:village": s("Village"),
        "amenity": F.when(k % 4 == 0, "").otherwise("cafe"), "shop": F.when(k % 6 < 3, "book  store"), "disused": F.when(k % 11 == 0, "yes"), "network": F.when(k % 9 == 0, "Net"),
    }
    made = F.map_filter(F.create_map(*[x for n, c in tags.items() for x in (s(n), c)]), lambda _, v: v.isNotNull())
    osm = X.table(spark, sf_dir, "part").select(s("node").alias("kind"), k.alias("id"), made.alias("tags"), (F.col("p_size") + 50.0).alias("lat"), F.when(k % 13 != 0, 5.0).alias("lon"))
    return canon.address_candidates(osm).select("object_id", "street", "street_tag", "house_number", "municipality", "municipality_tag", "category", "network")


@query("reverse_for_sql", SQL["reverse_geocode"].split("SELECT point_id, rank, CASE")[0] + "SELECT point_id, street, numero || rep AS housenumber, commune, CASE WHEN dist <= 50 THEN 'house' WHEN dist <= 250 THEN 'near' ELSE 'approximate' END AS precision FROM r WHERE rank = 1")
def reverse_for_sql(spark, sf_dir):
    """The nearest address as JSON, for a view that SQL knows."""
    from waymark.api import Geocoder, reverse_sql

    X.points(spark, sf_dir).createOrReplaceTempView("waymark_points")
    out = reverse_sql(spark, Geocoder(X.gazetteer(spark, sf_dir)), "waymark_points", "point_id", "lat", "lon")
    field = lambda c: F.get_json_object("answer", f"$.{c}").alias(c)
    return out.select("point_id", field("street"), field("housenumber"), field("commune"), field("precision"))


@query("collided_ids", f"""
WITH {X.ADDRESSES}, r AS (SELECT part, street_norm || '|' || code || '|' || numero AS key, round(lat * 1e5) || ',' || round(lon * 1e5) AS spot FROM addresses), u AS (SELECT * FROM r WHERE part % 4 = 0)
SELECT part, key IN (SELECT key FROM u) OR spot IN (SELECT spot FROM u) AS collided FROM r WHERE part % 4 <> 0""")
def collided_ids(spark, sf_dir):
    spot = F.concat_ws(",", F.round(F.col("lat") * 1e5).cast("string"), F.round(F.col("lon") * 1e5).cast("string"))
    rows = X.addresses(spark, sf_dir).select("part", F.concat_ws("|", "street_norm", "code", F.col("numero").cast("string")).alias("key"), spot.alias("spot"))
    return S.marked_collisions(rows.where("part % 4 <> 0"), rows.where("part % 4 = 0"), "key", "spot").select("part", "collided")


@query("phased_quota", f"""
WITH RECURSIVE {X.ADDRESSES}, b AS (SELECT code, part, street_norm, numero, 0 AS phase FROM addresses WHERE rep = 'bis' UNION ALL SELECT code, part, street_norm, numero, 1 FROM addresses),
p AS (SELECT *, count(*) OVER (PARTITION BY code, phase, numero) / 2.0 AS press FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY phase, press, sha256('phase|' || part)) AS n FROM p),
g AS (SELECT DISTINCT code, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS streets, CAST([] AS BIGINT[]) AS numbers, CAST([] AS BIGINT[]) AS one, CAST([] AS BIGINT[]) AS two FROM r
 UNION ALL SELECT code, n, CASE WHEN ok THEN list_append(streets, street_norm) ELSE streets END, CASE WHEN ok THEN list_append(numbers, numero) ELSE numbers END,
  CASE WHEN ok AND phase = 0 THEN list_append(one, part) ELSE one END, CASE WHEN ok AND phase = 1 THEN list_append(two, part) ELSE two END
 FROM (SELECT g.code, r.n, g.streets, g.numbers, g.one, g.two, r.street_norm, r.numero, r.part, r.phase, CASE r.phase WHEN 0 THEN len(g.one) < 3 ELSE len(g.two) < 20 END
   AND NOT list_contains(g.streets, r.street_norm) AND len(list_filter(g.numbers, lambda x: x = r.numero)) < 2 AS ok FROM g JOIN r ON r.code = g.code AND r.n = g.n + 1)),
z AS (SELECT * FROM g QUALIFY n = max(n) OVER (PARTITION BY code))
SELECT code, unnest(one) AS part, 'bis' AS phase FROM z UNION ALL SELECT code, unnest(two), 'rest' FROM z""")
def phased_quota(spark, sf_dir):
    """Three rows with a suffix first, then twenty of all: no street twice, at most two of a number over both phases."""
    rows = X.addresses(spark, sf_dir).select("code", "part", "street_norm", "numero", "rep").withColumn("turn", S.hash_order("phase", F.col("part").cast("string")))
    return S.phased(rows, "code", {"bis": (F.col("rep") == "bis", 3), "rest": (F.lit(True), 20)}, ["street_norm"], {"numero": 2}, ["turn"]).select("code", "part", "phase")


@query("feasibility", f"""
WITH {X.ADDRESSES}, b AS (SELECT code, street_norm, numero, 'all' AS pool, 70 AS required FROM addresses UNION ALL SELECT code, street_norm, numero, 'bis', 8 FROM addresses WHERE rep = 'bis'),
c AS (SELECT code, pool, CAST(sum(least(n, 1)) AS BIGINT) AS numero_cap FROM (SELECT code, pool, numero, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL),
a AS (SELECT code, pool, any_value(required) AS required, count(*) AS rows, count(DISTINCT street_norm) AS street_norm_keys FROM b GROUP BY code, pool),
u AS (SELECT *, least(rows, street_norm_keys, numero_cap) AS upper_bound FROM a JOIN c USING (code, pool))
SELECT code, pool, required, upper_bound, concat_ws(',', CASE WHEN numero_cap = upper_bound THEN 'numero_cap' END, CASE WHEN rows = upper_bound THEN 'rows' END, CASE WHEN street_norm_keys = upper_bound THEN 'street_norm_keys' END) AS limiting,
 upper_bound < required AS infeasible FROM u""")
def feasibility(spark, sf_dir):
    rows = X.addresses(spark, sf_dir).select("code", "street_norm", "numero", "rep")
    out = S.certificate(rows, "code", {"all": (F.lit(True), 70), "bis": (F.col("rep") == "bis", 8)}, ["street_norm"], {"numero": 1})
    return out.withColumn("limiting", F.array_join("limiting", ","))


@query("duplicate_profile", f"""
WITH {X.ADDRESSES}, t AS (SELECT CAST(part % 1900 AS VARCHAR) AS id_key, trim(regexp_replace(lower(numero || ' ' || street || ', ' || commune), '[^a-z0-9]+', ' ', 'g')) AS query_key, printf('%.5f', lat) || ',' || printf('%.5f', lon) AS spot_key FROM addresses)
SELECT CAST((SELECT count(*) FROM t) AS BIGINT) AS rows, {', '.join(f"(SELECT count(DISTINCT {k}) FROM t) AS distinct_{k}, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM t GROUP BY {k}) WHERE n > 1) AS repeated_{k}" for k in ("id_key", "query_key", "spot_key"))}""")
def duplicate_profile(spark, sf_dir):
    query_ = F.concat(F.col("numero").cast("string"), F.lit(" "), "street", F.lit(", "), "commune")
    keys = S.duplicate_keys(F.col("part") % 1900, query_, F.col("lat"), F.col("lon"))
    return S.duplicate_profile(X.addresses(spark, sf_dir).select(*[c.alias(n) for n, c in keys.items()]), list(keys))


@query("selection_profile", f"""
WITH {X.ADDRESSES}, s AS (SELECT * FROM addresses QUALIFY row_number() OVER (PARTITION BY code ORDER BY sha256('profile|' || part)) <= 6)
SELECT 'candidates' AS fact, rep AS name, count(*) AS n FROM addresses GROUP BY rep UNION ALL SELECT 'selected', rep, count(*) FROM s GROUP BY rep
UNION ALL SELECT 'largest', 'numero', (SELECT max(n) FROM (SELECT count(*) AS n FROM s GROUP BY numero)) UNION ALL SELECT 'cap', 'numero', 8""")
def selection_profile(spark, sf_dir):
    rows = X.addresses(spark, sf_dir).select("code", "part", "numero", "rep")
    chosen = S.top_n(rows, ["code"], [S.hash_order("profile", F.col("part").cast("string"))], 6)
    return S.selection_profile(rows, chosen, "rep", {"numero": S.percent_cap(150)})


@query("hash_sample", f"WITH {X.ADDRESSES} SELECT part FROM addresses ORDER BY sha256('reservoir|' || part), part LIMIT 500")
def hash_sample(spark, sf_dir):
    return S.hash_sample(X.addresses(spark, sf_dir).select("part"), "reservoir", F.col("part").cast("string"), 500)


@query("unpacked_structs", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def unpacked_structs(spark, sf_dir):
    """Lists of structs by order, back to rows."""
    item = F.struct("l_orderkey", "l_partkey", "l_quantity")
    return S.unpacked(X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items")), "items")


@query("total_rows", "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) AS n")
def total_rows(spark, sf_dir):
    return canon.total_rows(*(X.table(spark, sf_dir, t) for t in ("part", "orders", "nation")))
