import pytest

from waymark.functions.rules import Rules
from waymark.sources import files as S
from waymark.sources.osm import OsmDataSource
from waymark.streaming.geocoding import geocode_stream


def test_registry(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("id;numero;rep;nom_voie;code_postal;code_insee;nom_commune;lon;lat\n1;5;bis;Rue X;75001;75101;Paris;2.3;48.8\n2;x;;Rue Y;75001;75101;Paris;2.3;48.8\n")
    from waymark.operators.canon import registry

    assert [(r.id, r.numero, r.rep, r.street_key) for r in registry(S.read_registry(spark, str(p))).collect()] == [("1", 5, "bis", "rue x|75101")]
    p.write_text("id;numero\n1;2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        S.read_registry(spark, str(p))


def test_rules_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("# comment\nden haag\tother\nmy town\tyour town\n")
    (tmp_path / "b.tsv").write_text("p\tzz\tpiazza\n")
    r = S.read_rules(spark, {"commune_alias": str(tmp_path / "a.tsv"), "abbrev_pairs": str(tmp_path / "b.tsv")})
    assert isinstance(r, Rules) and r.commune_alias["my town"] == "your town" and r.abbrev_pairs["p zz"] == "piazza"


def test_osm(spark, tmp_path):
    (tmp_path / "x.osm").write_text(
        '<osm><node id="1" lat="50.0" lon="5.0"><tag k="addr:housenumber" v="7"/></node><node id="2" lat="50.2" lon="5.2"/>'
        '<way id="9"><nd ref="1"/><nd ref="2"/><nd ref="2"/><tag k="name" v="Rue X"/></way></osm>'
    )
    from waymark.operators.canon import centroids, tagged

    spark.dataSource.register(OsmDataSource)
    df = spark.read.format("osm_xml").load(str(tmp_path / "x.osm"))
    assert tagged(df, "node", "addr:housenumber").count() == 1
    ways, nodes = df.where("kind = 'way'"), df.where("kind = 'node'").select("id", "lat", "lon")
    mean, mid = centroids(ways, nodes).first(), centroids(ways, nodes, "median").first()
    assert mean.lat == pytest.approx(50.1333333) and mid.lat == 50.2


def test_regions(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"properties": {"name": "Box"}, "geometry": {"type": "Polygon", "coordinates": [[[5, 50], [6, 50], [6, 51], [5, 51]], [[5.4, 50.4], [5.6, 50.4], [5.6, 50.6], [5.4, 50.6]]]}}')
    (tmp_path / "b.geojson").write_text("not json")
    from waymark.operators.places import admin_regions

    regions = S.read_regions(spark, str(tmp_path))
    points = spark.createDataFrame([(1, 50.2, 5.2), (2, 50.5, 5.5), (3, 10.0, 10.0)], "id int, lat double, lon double")
    assert {r.id: r.region for r in admin_regions(points, regions).collect()} == {1: "Box", 2: None, 3: None}


def test_publish_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    S.publish(spark.range(3), path, lambda df: None)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        S.publish(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3
    S.publish(spark.range(4), path, lambda df: None)
    assert spark.read.parquet(path).count() == 4
    cache = str(tmp_path / "c")
    assert S.cached_extract(spark, cache, "r1", lambda: spark.range(2)).count() == 2
    assert S.cached_extract(spark, cache, "r1", lambda: spark.range(5)).count() == 2
    with pytest.raises(ValueError, match="release"):
        S.cached_extract(spark, cache, "r2", lambda: spark.range(5))


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("s", "o", "k"))
    spark.range(5).write.parquet(src)
    q = geocode_stream(spark.readStream.schema("id long").parquet(src), lambda df: df.selectExpr("id", "id * 2 AS twice"), out, ck)
    q.awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8]
