"""Binary extracts, archives, bounded fetches and the service."""

import gzip
import io
import json
import struct
import tarfile
import threading
import urllib.error
import urllib.request
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from waymark.sources import fetch as H, files as S, service
from waymark.sources.osm import OsmPbfDataSource, blobs_of, unpacked


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n):
    return varint(n * 2 if n >= 0 else -n * 2 - 1)


def put(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values, strict=False))


def blob(kind, data, zipped=True, says=None):
    body = put(2, len(data) if says is None else says) + put(3, zlib.compress(data)) if zipped else put(1, data)
    head = put(1, kind) + put(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def extract(first_id, n, zipped=True):
    words = [b"", b"addr:housenumber", b"name", b"Rue \xc3\xa9", *[str(i).encode() for i in range(n)]]
    ids = [first_id + i for i in range(n)]
    tags = b"".join(varint(1) + varint(4 + i) + (varint(0) if i % 2 else varint(2) + varint(3) + varint(0)) for i in range(n))
    dense = put(1, deltas(ids)) + put(8, deltas([505_000_000 - i * 10 for i in range(n)])) + put(9, deltas([-55_000_000 + i for i in range(n)])) + put(10, tags)
    node = put(1, 0)[:1] + zig(-7) + put(2, varint(2)) + put(3, varint(3)) + varint(8 << 3) + zig(100_000_000) + varint(9 << 3) + zig(-200_000_000)
    way = put(1, 900 + first_id) + put(2, varint(2)) + put(3, varint(3)) + put(8, deltas(ids))
    relation = put(1, 950 + first_id) + put(8, varint(0)) + put(9, deltas([900 + first_id])) + put(10, varint(1))
    table = b"".join(put(1, w) for w in words)
    block = put(1, table) + put(2, put(2, dense)) + put(2, put(1, node)) + put(2, put(3, way) + put(4, relation))
    return blob(b"OSMData", block, zipped)


def test_binary_extract(spark, tmp_path):
    p = tmp_path / "x.osm.pbf"
    p.write_bytes(blob(b"OSMHeader", put(4, b"DenseNodes")) + b"".join(extract(1 + 100 * i, 30, i % 2 == 0) for i in range(40)))
    assert len(blobs_of(str(p))) == 40
    spark.dataSource.register(OsmPbfDataSource)
    df = spark.read.format("osm_pbf").load(str(p))
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    nodes = {r.id: r for r in rows if r.kind == "node" and r.id > 0}
    assert len(nodes) == 1200 and len(rows) == 40 * 33
    assert nodes[103].lat == pytest.approx(50.499998) and nodes[103].lon == pytest.approx(-5.4999998) and nodes[103].tags == {"addr:housenumber": "2", "name": "Rue é"}
    assert nodes[2].tags == {"addr:housenumber": "1"} and nodes[2].refs is None
    lone = next(r for r in rows if r.id == -7)
    assert (lone.lat, lone.lon, lone.tags) == (10.0, -20.0, {"name": "Rue é"})
    way = next(r for r in rows if r.kind == "way" and r.id == 901)
    assert way.refs == list(range(1, 31)) and way.tags == {"name": "Rue é"} and way.lat is None
    assert next(r for r in rows if r.kind == "relation" and r.id == 951).refs == [901]


def test_bad_extracts(tmp_path):
    p = tmp_path / "x.pbf"
    whole = extract(1, 5)
    for bad in (whole[:-3], b"\x7f\xff\xff\xff" + whole, whole + b"\0\0"):
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            blobs_of(str(p))
    p.write_bytes(blob(b"OSMData", b"x" * 100_000, says=10))
    at, size = blobs_of(str(p))[0]
    with pytest.raises(ValueError, match="size"):
        unpacked(p.read_bytes()[at : at + size])


def test_unpacked_size_is_bounded(spark, tmp_path):
    head = ",".join(S.CANON) + "\n"
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress((head + "x,1,X,C,c,1,,,1,1\n").encode()))
    assert S.read_canon(spark, str(tmp_path / "a.csv.gz"), max_ratio=100).count() == 1
    (tmp_path / "bomb.csv.gz").write_bytes(gzip.compress((head + ("0" * 999 + "\n") * 3000).encode()))
    with pytest.raises(ValueError, match="times its size"):
        S.read_canon(spark, str(tmp_path / "bomb.csv.gz"), max_ratio=100)
    with pytest.raises(ValueError, match="more than"):
        S.read_canon(spark, str(tmp_path / "bomb.csv.gz"), max_bytes=100_000, max_ratio=10_000)


def test_regions_in_archives(spark, tmp_path):
    def feature(name, kind, x):
        ring = [[x, 50], [x + 1, 50], [x + 1, 51], [x, 51]]
        return json.dumps({"properties": {"wof:name": name, "wof:placetype": kind}, "geometry": {"type": "Polygon", "coordinates": [ring]}}).encode()

    with tarfile.open(tmp_path / "xx.tar.gz", "w:gz") as tar:
        for name, data in (("d/1.geojson", feature("One", "region", 5)), ("d/2.geojson", feature("Town", "locality", 6)), ("3.geojson", b"not json"), ("4.txt", feature("Text", "region", 7)), ("5.geojson", feature("Two", "region", 8))):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("6.geojson")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    assert [r.name for r in S.read_region_tars(spark, str(tmp_path / "xx.tar.gz")).orderBy("name").collect()] == ["One", "Two"]
    assert S.read_region_tars(spark, str(tmp_path / "xx.tar.gz"), max_member=20).count() == 0


def test_partitioned_parquet_is_pruned(spark, tmp_path):
    from waymark.operators.canon import nested_addresses

    rows = spark.range(40).selectExpr(
        "cast(id AS string) AS id", "'Rue' AS street", "'1' AS number", "'75001' AS postcode", "array(named_struct('value', 'Paris')) AS address_levels", "2.0D AS lon", "48.0D AS lat",
        "CASE WHEN id % 4 = 0 THEN 'FR' ELSE 'IT' END AS country",
    )
    rows.write.partitionBy("country").parquet(str(tmp_path / "a"))
    out = S.read_nested(spark, str(tmp_path / "a"), "FR")
    assert out.count() == 10 == nested_addresses(rows, "FR").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country" in plan


class Web(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        Web.seen.append(self.path)
        if self.path.startswith("/flaky") and len([p for p in Web.seen if p == self.path]) < 3:
            return self.send_error(503)
        if self.path.startswith("/gone"):
            return self.send_error(404)
        body = b"x" * 5000 if self.path.startswith("/big") else json.dumps({"path": self.path}).encode()
        self.send_response(200)
        if not self.path.startswith("/big-silent"):
            self.send_header("Content-Length", str(len(body) + 10 * self.path.startswith("/short")))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        Web.seen.append(body)
        data = json.dumps({"results": {"bindings": [{"a": {"value": "1"}, "b": {"value": "é"}}, {"a": {"value": "2"}}]}}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def web():
    Web.seen = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Web)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetches_are_bounded(web, tmp_path):
    assert json.loads(H.fetch(web + "/a")) == {"path": "/a"}
    assert H.fetch(web + "/big", str(tmp_path / "big")) == str(tmp_path / "big") and (tmp_path / "big").stat().st_size == 5000
    for path in ("/big", "/big-silent"):
        with pytest.raises(H.TooLarge):
            H.fetch(web + path, str(tmp_path / "none"), max_bytes=4000)
    with pytest.raises(OSError):
        H.fetch(web + "/short", str(tmp_path / "none"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["big"]


def test_archives_are_bounded(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/a.csv", "a,b\n")
        z.writestr("readme.txt", "x")
    assert open(H.unzip_one(str(tmp_path / "a.zip"), str(tmp_path / "a.csv"))).read() == "a,b\n"
    with pytest.raises(ValueError, match="members"):
        H.unzip_one(str(tmp_path / "a.zip"), str(tmp_path / "b"), ending=".json")
    with zipfile.ZipFile(tmp_path / "bomb.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "0" * 5_000_000)
    with pytest.raises(H.TooLarge):
        H.unzip_one(str(tmp_path / "bomb.zip"), str(tmp_path / "c"))
    assert not (tmp_path / "c").exists() and not (tmp_path / "c.part").exists()


def test_retries_and_query_results(spark, web):
    waits = []
    assert json.loads(H.retried(lambda: H.fetch(web + "/flaky"), sleep=waits.append))["path"] == "/flaky" and waits == [1.0, 2.0]
    with pytest.raises(urllib.error.HTTPError):
        H.retried(lambda: H.fetch(web + "/gone"), sleep=waits.append)
    assert len(waits) == 2
    assert [tuple(r) for r in H.sparql(spark, web + "/sparql", "SELECT ?a", ["a", "b"]).collect()] == [("1", "é"), ("2", None)]


def test_answers_are_cached_and_throttled(spark, web, tmp_path):
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    c = H.CachedAnswers(str(tmp_path / "kept"), web + "/geo", wait=2.0, sleep=sleep, clock=lambda: now[0])
    assert c.ask(q="a", limit="1") == {"path": "/geo?limit=1&q=a"}
    c.ask(q="b")
    c.ask(limit="1", q="a")
    assert waits == [2.0] and len(Web.seen) == 2
    again = H.CachedAnswers(str(tmp_path / "kept"), web + "/geo")
    again.ask(q="b")
    assert len(Web.seen) == 2 and c.table(spark).count() == 2


def test_service(spark):
    from waymark.api import Geocoder
    from waymark.operators.gazetteer import build

    rows = [("rue de la paix", "75101", "Rue de la Paix", "Paris", "paris", str(n), "", "75001", 48.86 + n / 1e4, 2.33) for n in (1, 2, 5)]
    g = Geocoder(build(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in S.CANON[:8]) + ", lat double, lon double")))
    server = service.serve(spark, g, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("/health") == (200, {"status": "ok"})
    status, found = ask("/api?q=5+rue+de+la+paix+paris&limit=2")
    assert status == 200 and found["features"][0]["properties"]["housenumber"] == "5" and found["features"][0]["geometry"]["coordinates"] == [2.33, 48.8605]
    status, found = ask("/reverse?lat=48.8602&lon=2.33&limit=1")
    assert status == 200 and len(found["features"]) == 1 and found["features"][0]["properties"]["housenumber"] == "2"
    assert ask("/reverse?lat=10&lon=10") == (200, {"type": "FeatureCollection", "features": []})
    for bad in ("/api", "/api?q=", "/api?q=a&q=b", "/api?q=a&lat=1", "/api?q=a&limit=0", "/api?q=a&x=1", "/reverse?lat=91&lon=0", "/reverse?lat=nan&lon=0", "/api?q=" + "a" * 1025):
        assert ask(bad)[0] == 400, bad
    assert ask("/else")[0] == 404
    server.shutdown()
