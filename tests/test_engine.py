"""Golden cases on small hand-written gazetteers."""

import json

import pytest

from waymark.api import Geocoder, geocode_sql, load, read_meta, set_meta
from waymark.operators import answers as A
from waymark.operators.gazetteer import build, check_pair, rejected

COLUMNS = "street_norm string, code string, street string, commune string, commune_norm string, numero string, rep string, postcode string, lat double, lon double, aliases string"


def rows(spark, data):
    """(street, commune, number, suffix, postcode, lat, lon); codes follow communes."""
    codes = {}
    out = []
    for street, commune, n, rep, pc, lat, lon, *alias in data:
        code = codes.setdefault(commune, f"{len(codes) + 1:05}")
        out.append((street.lower(), code, street, commune, commune.lower(), n, rep, pc, lat, lon, alias[0] if alias else ""))
    return spark.createDataFrame(out, COLUMNS)


DATA = [
    ("Damrak", "Amsterdam", "1", "", "1012AA", 52.370, 4.890), ("Damrak", "Amsterdam", "3", "", "1012AB", 52.3702, 4.8902),
    ("Damrak", "Amsterdam", "12", "a", "1012AA", 52.3703, 4.8903), ("Damrak", "Amsterdam", "12", "b", "1012AB", 52.3704, 4.8904),
    ("Rue de la Paix", "Paris 2e Arrondissement", "10", "", "75002", 48.8690, 2.3310, "paris"), ("Rue de la Paix", "Paris 2e Arrondissement", "20", "", "75002", 48.8695, 2.3315, "paris"),
    ("Rue de la Paix", "Paris 2e Arrondissement", "30", "bis", "75002", 48.8699, 2.3319, "paris"),
    ("Rue Longue", "Lyon", "10", "", "69001", 45.70, 4.80), ("Rue Longue", "Lyon", "30", "", "69002", 45.80, 4.80),
    ("Rue Longue", "Nice", "11", "", "06000", 43.70, 7.25), ("Avenue Charles de Gaulle", "Lyon", "5", "", "69003", 45.76, 4.85),
    ("Улица Ленина", "Братск", "60", "", "665700", 56.15, 101.63),
]


@pytest.fixture(scope="module")
def geo(spark):
    return Geocoder(build(rows(spark, DATA)))


def ask(spark, geo, *texts, k=1):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, q string")
    out = {}
    for r in geo.geocode(q, k).collect():
        out.setdefault(r.query_id, []).append(r)
    return [sorted(out.get(i, []), key=lambda r: r.rank) for i in range(len(texts))]


def test_free_form(spark, geo):
    got = ask(
        spark, geo, "Damrak 3, Amsterdam", "12b Damrak amsterdam", "15 rue de la paix paris", "rue de la paix 30 bis 75002 paris", "rue longue 17 lyon",
        "10 r longue lyon", "10 de la paix paris", "av charles de gaule 5 lyon", "gaulle lyon", "Lyon", "bratsk lenina 60", "hotel xyz 10 rue de la paix",
        "", "zzz qqq", "10 rue longue nice", "Amsterdam Damrak 1",
    )
    top = [g[0] if g else None for g in got]
    assert (top[0].housenumber, top[0].postcode, top[0].precision) == ("3", "1012AB", "house")
    assert (top[1].housenumber, top[1].postcode) == ("12b", "1012AB")
    assert (top[2].precision, top[2].housenumber, top[2].postcode) == ("interp", "15", "75002")
    assert top[2].lat == pytest.approx(48.86925)
    assert (top[3].housenumber, "house_rep" in top[3].flags) == ("30bis", True)
    assert (top[4].precision, top[4].housenumber) == ("near", "10")
    assert (top[5].street, top[5].precision, top[5].postcode) == ("Rue Longue", "house", "69001")
    assert top[6].street == "Rue de la Paix" and top[6].precision == "house"
    assert top[7].street == "Avenue Charles de Gaulle" and "street_fuzzy" in top[7].flags
    assert top[8].street == "Avenue Charles de Gaulle" and top[8].precision == "street"
    assert top[9].precision == "city" and top[9].commune == "Lyon" and top[9].confidence == 0.05
    assert top[10].commune == "Братск" and top[10].precision == "house"
    assert top[11].precision == "house" and "dropped_prefix" in top[11].flags and top[11].confidence <= 0.6
    assert top[12] is None and top[13] is None
    assert (top[14].commune, top[14].housenumber, top[14].precision) == ("Nice", "11", "near")
    assert (top[15].housenumber, top[15].precision) == ("1", "house")


def test_lists(spark, geo):
    hits = ask(spark, geo, "rue longue 11", k=5)[0]
    assert [h.rank for h in hits] == list(range(1, len(hits) + 1)) and len(hits) == 2
    conf = [h.confidence for h in hits]
    assert conf == sorted(conf, reverse=True)
    assert ask(spark, geo, "rue longue 11", k=0) == [[]]


def test_structured(spark, geo):
    q = spark.createDataFrame(
        [(1, "Damrak", "1", "AMSTERDAM", None), (2, "rue longe", "30", "lyon", "69002"), (3, "paix", "10", "paris", None), (4, None, "1", "lyon", None), (5, "Damrak", "99", "Nowhere", None), (6, "Damrak", None, "Amsterdam", None)],
        "query_id int, street string, number string, city string, postcode string",
    )
    got = {r.query_id: r for r in geo.geocode_structured(q, 1).collect()}
    assert got[1].postcode == "1012AA" and got[2].housenumber == "30" and got[3].street == "Rue de la Paix" and 4 not in got and 5 not in got
    assert got[6].precision == "street" and got[6].postcode == ""


def test_focus(spark, geo):
    q = spark.createDataFrame([(1, "rue longue", 43.7, 7.25), (2, "rue longue", 45.75, 4.8)], "query_id int, q string, f_lat double, f_lon double")
    got = {r.query_id: r.commune for r in geo.geocode(q, 1, focus=True).collect()}
    assert got == {1: "Nice", 2: "Lyon"}


def test_reverse(spark, geo):
    p = spark.createDataFrame([(1, 52.3702, 4.8902), (2, 48.8690, 2.3340), (3, 10.0, 10.0)], "point_id int, lat double, lon double")
    got = {}
    for r in geo.reverse(p, 2).collect():
        got.setdefault(r.point_id, []).append(r)
    first = min(got[1], key=lambda r: r.rank)
    assert first.precision == "house" and first.housenumber == "3" and first.distance_m == 0 and first.confidence == 0.95 and first.postcode == "1012AB"
    assert min(got[2], key=lambda r: r.rank).precision == "near" and 3 not in got and len(got[1]) == 2
    bad = spark.createDataFrame([(1, 99.0, 0.0)], "point_id int, lat double, lon double")
    with pytest.raises(Exception, match="out of range"):
        geo.reverse(bad).collect()


def test_reverse_counts_addresses_once(spark):
    g = build(rows(spark, [("A", "X", "1", "", "", 50.0, 5.0), ("A", "X", "1", "", "", 50.0001, 5.0), ("A", "X", "1", "a", "", 50.0002, 5.0), ("A", "X", "2", "", "", 50.003, 5.0)]))
    p = spark.createDataFrame([(1, 50.0, 5.0)], "point_id int, lat double, lon double")
    out = sorted(Geocoder(g).reverse(p, 3).collect(), key=lambda r: r.rank)
    assert [(r.housenumber, r.precision) for r in out] == [("1", "house"), ("1a", "house"), ("2", "approximate")]


def test_poi_cascade(spark):
    poi = build(rows(spark, [("Cafe Central", "Lyon", "1", "", "", 45.75, 4.84)]), layer="poi")
    g = Geocoder(build(rows(spark, DATA)), poi)
    got = ask(spark, g, "cafe central lyon", "Damrak 3, Amsterdam")
    assert got[0][0].street == "Cafe Central" and "poi_layer" in got[0][0].flags
    assert got[1][0].street == "Damrak" and "poi_layer" not in got[1][0].flags
    with pytest.raises(ValueError, match="layer"):
        check_pair(poi, poi)
    with pytest.raises(ValueError, match="'fr'"):
        check_pair(build(rows(spark, DATA), country="fr"), build(rows(spark, DATA), country="it", layer="poi"))


def test_rejected_rows(spark):
    bad = [("A", "X", "abc", "", "", 50.0, 5.0), ("A", "X", "", "", "", 50.0, 5.0), ("A", "X", "2", "", "", 95.0, 5.0), ("A", "X", "2", "", "", float("nan"), 5.0), ("", "X", "2", "", "", 50.0, 5.0)]
    df = rows(spark, bad)
    assert tuple(rejected(df).first()) == (5, 1, 2, 1)
    g = build(df)
    assert [(r.numero, r.rep) for r in g.houses.collect()] == [(0, "")]


def test_missing_postcodes_stay_empty(spark):
    g = Geocoder(build(rows(spark, [("Damrak", "A", "1", "", "", 52.37, 4.89), ("Damrak", "A", "3", "", "1012AA", 52.3702, 4.8902)])))
    q = spark.createDataFrame([(1, "Damrak", "1", "A", None), (2, "Damrak", "3", "A", None), (3, "Damrak", "2", "A", None)], "query_id int, street string, number string, city string, postcode string")
    assert {r.query_id: r.postcode for r in g.geocode_structured(q, 1).collect()} == {1: "", 2: "1012AA", 3: ""}


def test_many_homonyms_need_a_focus(spark):
    data = [("Markt", f"Town{i:03}", "1", "", "", 50.0 + i / 100, 5.0) for i in range(305)]
    g = Geocoder(build(rows(spark, data)))
    assert len(ask(spark, g, "markt 1", k=100)[0]) <= 100
    q = spark.createDataFrame([(1, "markt 1", 50.0 + 304 / 100, 5.0)], "query_id int, q string, f_lat double, f_lon double")
    assert g.geocode(q, 1, focus=True).first().commune == "Town304"


def test_order_is_the_same_under_repartitioning(spark, geo):
    texts = [(i, t) for i, t in enumerate(["rue longue", "rue longue 11", "damrak", "paix paris"] * 3)]
    q = spark.createDataFrame(texts, "query_id int, q string")
    a, b = (sorted(map(str, geo.geocode(x, 5).collect())) for x in (q, q.repartition(7)))
    assert a == b


def test_batch_save_and_sql(spark, geo, tmp_path):
    from waymark.sources.jsonl import feature_collection, read_requests, to_answers, write_answers

    src = tmp_path / "in.jsonl"
    src.write_text('{"q": "Damrak 3, Amsterdam"}\n{"street": "Damrak", "housenumber": 1, "city": "Amsterdam"}\n{"q": "nowhere at all"}\n')
    req = read_requests(spark, str(src)).cache()
    out = geo.batch(req, 1)
    write_answers(to_answers(out, req), req, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert [len(x["results"]) for x in lines] == [1, 1, 0] and lines[0]["results"][0]["housenumber"] == "3"
    (tmp_path / "bad.jsonl").write_text('{"q": "Damrak"}\nnot json\n')
    bad = read_requests(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(ValueError, match="nothing was written"):
        write_answers(to_answers(out, bad), bad, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    shape = json.loads(feature_collection(out, "line_no").first().geojson)
    assert shape["type"] == "FeatureCollection" and shape["features"][0]["geometry"]["type"] == "Point"

    geo.save(str(tmp_path / "g"), {"license": "open"})
    assert read_meta(spark, str(tmp_path / "g"))["license"] == "open"
    set_meta(spark, str(tmp_path / "g"), {"layer": "poi"})
    with pytest.raises(ValueError, match="addresses"):
        load(spark, str(tmp_path / "g"), "addresses")
    again = Geocoder(load(spark, str(tmp_path / "g")))
    assert ask(spark, again, "Damrak 3, Amsterdam")[0][0].housenumber == "3"
    spark.createDataFrame([(1, "Damrak 3, Amsterdam"), (2, None), (3, "nowhere at all")], "id int, t string").createOrReplaceTempView("asked")
    got = {r.id: r.answer for r in geocode_sql(spark, geo, "asked", "id", "t").collect()}
    assert json.loads(got[1])["housenumber"] == "3" and got[2] is None and got[3] == "{}"


def test_linear_score(spark):
    df = spark.createDataFrame([(True, False) * 5], ", ".join(f"{f} boolean" for f in A.FEATURES))
    assert df.select(A.linear_score(0.5, [1.0] * 10).alias("s")).first().s == 5.5
    with pytest.raises(ValueError, match="weights"):
        A.linear_score(0.0, [1.0])


def test_arrondissements_bind(spark):
    data = [
        ("Rue de Rivoli", "Paris 1er Arrondissement", "1", "", "75001", 48.860, 2.340, "paris"), ("Rue de Rivoli", "Paris 4e Arrondissement", "1", "", "75004", 48.855, 2.360, "paris"),
        ("Rue Quelconque", "Paris 4e Arrondissement", "2", "", "75004", 48.855, 2.361, "paris"),
    ]
    g = Geocoder(build(rows(spark, data), country="fr"))
    got = ask(spark, g, "1 rue de rivoli 75004 paris", "75001 paris", "75001 paris 4e", "2 rue quelconque paris 1er", "1 rue de rivoli paris 4eme")
    assert got[0][0].commune == "Paris 4e Arrondissement" and got[1][0].precision == "city" and got[1][0].commune == "Paris 1er Arrondissement"
    assert got[2] == [] and got[3] == [] and got[4][0].commune == "Paris 4e Arrondissement"


def test_homonyms_with_a_qualifier(spark):
    data = [
        ("Via Roma", "Bergamo", "1", "", "", 45.70, 9.67), ("Via Roma", "Lecce", "1", "", "", 40.35, 18.17), ("Via Verdi", "Altrove", "1", "", "", 43.0, 12.0),
    ]
    df = rows(spark, data)
    extra = [("via dante", "90001", "Via Dante", "Castro", "castro", "3", "", "", 45.80, 10.06, ""), ("via dante", "90002", "Via Dante", "Castro", "castro", "3", "", "", 40.00, 18.42, "")]
    g = Geocoder(build(df.unionByName(spark.createDataFrame(extra, COLUMNS)), country="it"))
    got = ask(spark, g, "via dante 3 castro bergamo", "via dante 3 castro lecce", "via dante 3 castro altrove")
    assert got[0][0].lat == pytest.approx(45.80) and "geo_qualifier" in got[0][0].flags and "ambiguous_far" not in got[0][0].flags
    assert got[1][0].lat == pytest.approx(40.00) and got[2] == []
