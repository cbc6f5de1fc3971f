"""Steps that must not grow faster than their tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark import runtime
from waymark.functions import geo
from waymark.operators import answers as A, places as P, reverse as R, structured as S
from waymark.operators.gazetteer import build
from waymark.operators.freeform import FreeForm
from waymark.runtime import materialize

HOUSES = "street_norm string, code string, numero int, rep string, lon_e7 long, lat_e7 long, postcode string"


def test_tables_of_many_like_rows_are_not_broadcast(spark):
    many = materialize(spark.range(300_000).select((F.col("id") % 1000).alias("id"), F.lit("a long and common text " * 10).alias("t")), "many")
    join = spark.range(5_000_000).join(many, "id").select("id", "t")
    assert "BroadcastHashJoin" not in join._jdf.queryExecution().executedPlan().toString()
    few = materialize(spark.range(10), "few")
    assert "BroadcastHashJoin" in spark.range(5_000_000).join(few, "id")._jdf.queryExecution().executedPlan().toString()


def test_names_around_a_focus(spark):
    at = [(48.85, 2.35), (89.999, 2.0), (-90.0, -180.0), (50.0, 179.999), (0.0, 0.0)]
    streets = [(f"s{i % 2}", f"{i:05}", lat + dy / 100, lon + dx / 100) for i, (lat, lon) in enumerate(at) for dy in range(-6, 7) for dx in range(-6, 7)]
    streets = [s for s in streets if -90 <= s[2] <= 90 and -180 <= s[3] <= 180]
    table = spark.createDataFrame(streets, "street_norm string, code string, lat double, lon double").select("street_norm", "code", F.lit(0).alias("pc_num"), geo.cell_of(F.col("lat"), F.col("lon")).alias("cell"))
    asked = spark.createDataFrame([(s, *p) for s in ("s0", "s1") for p in at], "street_norm string, lat double, lon double")
    asked = asked.withColumn("row", geo.cell_row(F.col("lat"))).withColumn("column", geo.cell_column(F.col("lon")))
    free = FreeForm.__new__(FreeForm)
    free.gaz = type("G", (), {"streets": table})
    got = sorted(map(tuple, free._around(asked.select("street_norm", "row", "column").distinct()).collect()))
    cells = asked.select("street_norm", "row", "column", F.explode(geo.cells_around(F.col("lat"), F.col("lon"), 4)).alias("c")).select("street_norm", "row", "column", "c.cell").distinct()
    want = sorted(map(tuple, cells.join(table, ["street_norm", "cell"]).select("street_norm", "row", "column", "code", "pc_num").collect()))
    assert got == want and len(want) > 200


def plain(block, n, rep):
    """The house by all rows in order."""
    rows = sorted(block)
    same = [h for h in rows if h[0] == n]
    exact = [h for h in same if h[1] == rep]
    if exact or same:
        return (2, exact[0]) if exact else (1, same[0])
    lower, upper = [h for h in rows if h[0] < n], [h for h in rows if h[0] > n]
    if lower and upper:
        return (0, lower[-1] if n - lower[-1][0] <= upper[0][0] - n else upper[0])
    return (0, lower[-1] if lower else upper[0])


def test_blocks_are_as_long_as_a_street_has_numbers(spark):
    rows = [("s", "1", 10 * (1 + i % 3), ("", "a", "b")[i // 3 % 3], 10_000_000 * (i * 7 % 11), 10_000_000 * (i % 5), f"{i % 2}") for i in range(300)]
    rows = [r for r in rows if (r[2], r[3]) != (20, "a")]
    block = A.blocks_of(spark.createDataFrame(rows, HOUSES)).first().block
    assert [g.numero for g in block] == [10, 20, 30] and sum(len(g.houses) for g in block) == 8
    asked = [(n, rep) for n in (1, 10, 14, 15, 16, 20, 29, 30, 31) for rep in ("", "a", "b", "c")]
    q = spark.createDataFrame(asked, "numero int, rep string").join(A.blocks_of(spark.createDataFrame(rows, HOUSES)))
    turn = A.turn_in(F.col("block"), F.col("numero"))
    got = {(r.numero, r.rep): r.h for r in q.select("numero", "rep", A.find_house(F.col("block"), turn, F.col("numero"), F.col("rep")).alias("h")).collect()}
    for n, rep in asked:
        kind, (numero, own, lon, lat, pc) = plain([r[2:] for r in rows], n, rep)
        h = got[n, rep]
        assert (h.kind, h.numero, h.rep, h.lon, h.lat, h.own_postcode) == (kind, numero, own, lon / 1e7, lat / 1e7, pc)


def test_likeness_of_a_shared_word(spark):
    df = spark.createDataFrame([(["rue", "paix"], ["paix"]), (["rue"], ["rua", "x"]), ([], ["a"]), (["a"], [])], "w array<string>, q array<string>")
    assert [r[0] for r in df.select(A.likeness(F.col("w"), F.col("q"))).collect()] == pytest.approx([100, 67, 0, 0])


def test_reverse_of_dense_places_equals_all_distances(spark):
    """Many addresses at few points, some with several positions: levels of boxes and kept turns lose none."""
    pick = random.Random(5)
    rows = []
    for _ in range(6000):
        street, n = f"s{pick.randrange(12):02}", pick.randrange(1, 60)
        lat, lon = 500_010_000 + 200 * pick.randrange(150), 50_010_000 + 200 * pick.randrange(150)
        rows.append((street, "00001", n, "", lon, lat, str(pick.randrange(3))))
    houses = spark.createDataFrame(rows, HOUSES)
    centre = geo.cell_of(F.lit(50.005), F.lit(5.005))
    streets = houses.select("street_norm", "code").distinct().withColumn("cell", centre)
    streets = streets.select("*", F.col("street_norm").alias("street"), F.lit("x").alias("commune"), F.lit(True).alias("pc_ambiguous"), F.lit("").alias("postcode"))
    gaz = type("G", (), {"houses": houses, "streets": streets})
    nearby = R.nearby_of(gaz)
    assert len(nearby.boxes) > 1
    at = [(50.001 + pick.random() * 0.003, 5.001 + pick.random() * 0.003) for _ in range(25)] + [(50.0013, 5.0013)] * 3
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "point_id int, lat double, lon double")
    got = {}
    for r in R.reverse(points, gaz, 3, nearby).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = (r.distance_m, r.street, r.housenumber, r.postcode)
    for i, (lat, lon) in enumerate(at):
        best = {}
        for street, code, n, rep, x, y, pc in rows:
            dx, dy = (x / 1e7 - lon) * 111_320.0 * math.cos(math.radians(lat)), (y / 1e7 - lat) * 111_320.0
            spot = (math.floor(math.sqrt(dx * dx + dy * dy) * 1e6 + 0.5) / 1e6, x, y, pc)
            best[street, n] = min(best.get((street, n), spot), spot)
        want = sorted((b[:3], *a, b[3]) for a, b in best.items())[:3]
        assert [got[i][j + 1][1:] for j in range(3)] == [(s, str(n), pc) for _, s, n, pc in want]
        assert [got[i][j + 1][0] for j in range(3)] == pytest.approx([w[0][0] for w in want])


def test_reverse_ties_go_by_name_and_not_by_postcode(spark):
    rows = [("b", "00001", 1, "", 50_000_000, 500_000_000, "1"), ("a", "00001", 1, "", 50_000_000, 500_000_000, "2"), ("c", "00001", 1, "", 50_000_000, 500_000_000, "0")]
    houses = spark.createDataFrame(rows, HOUSES)
    streets = houses.select("street_norm", "code", geo.cell_of(F.lit(50.0), F.lit(5.0)).alias("cell"), F.col("street_norm").alias("street"), F.lit("x").alias("commune"), F.lit(True).alias("pc_ambiguous"), F.lit("").alias("postcode"))
    out = R.reverse(spark.createDataFrame([(1, 50.0, 5.0)], "point_id int, lat double, lon double"), type("G", (), {"houses": houses, "streets": streets}), 3)
    assert [r.street for r in out.orderBy("rank").collect()] == ["a", "b", "c"]


ADDRESS = "street_norm string, code string, street string, commune string, commune_norm string, numero int, rep string, postcode string, lat double, lon double"


@pytest.fixture(scope="module")
def village(spark):
    rows = [(f"rue {n}", c, f"Rue {n}", v, v.lower(), i, "", f"1000{i % 2}", 48.0 + i / 1e4, 2.0) for n in ("haute", "basse") for c, v in (("1", "Aville"), ("2", "Beville")) for i in (1, 3, 9)]
    return build(spark.createDataFrame(rows, ADDRESS))


def plans_of(monkeypatch, run):
    """The optimized plans of the scratch tables that ``run`` writes, by name."""
    plans, own = {}, runtime.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return own(df, name)

    monkeypatch.setattr(runtime, "written", written)
    run()
    return plans


def python_in(plan):
    return [i for i, line in enumerate(plan) if "EvalPython" in line or "MapInArrow" in line]


ASKED = "query_id long, street string, number string, city string, postcode string"


def test_structured_queries_are_prepared_once_and_after_they_are_dealt(spark, village, monkeypatch):
    q = spark.createDataFrame([(i, "Rue Haute", "3", "Aville", None) for i in range(10)], ASKED)
    plan = plans_of(monkeypatch, lambda: S.geocode(q, village).collect())["structured"]
    dealt = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert len(python_in(plan)) == 1 and python_in(plan) < dealt


def test_json_lines_are_parsed_once(spark, village, monkeypatch):
    from waymark.sources.jsonl import parse_requests

    line = '{"street": "Rue Haute", "housenumber": 3, "city": "Aville", "postcode": " "}'
    asked = parse_requests(spark.createDataFrame([(i, line) for i in range(10)], "query_id long, line string"), "line").withColumnRenamed("housenumber", "number")
    plan = plans_of(monkeypatch, lambda: S.geocode(asked, village).collect())["structured"]
    assert "\n".join(plan).count("from_json(") == 1


def test_keys_and_variants_are_made_of_distinct_phrases(spark, village):
    phrases = spark.createDataFrame([("aville",)] * 10, "phrase string")
    for df in (P.lookup_communes(phrases, village), S.structured_variants(phrases)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert python_in(plan) and all("Aggregate" in plan[i + 1] for i in python_in(plan))


def test_what_is_asked_alike_is_answered_once(spark, village, monkeypatch):
    kinds = [("Rue Haute", "3", "Aville", "10001"), ("RUE HAUTE", "3", "AVILLE", "10001"), ("Rue Basse", None, "Beville", None), ("Rue Basse", "5", "Beville", None), ("Rue Base", "1", "Beville", None)]
    q = spark.createDataFrame([(i * 10 + j, *kind) for i in range(20) for j, kind in enumerate(kinds)], ASKED)
    rows, own = [], A.answer

    def answer(cands, *tables):
        rows.append(cands.count())
        return own(cands, *tables)

    monkeypatch.setattr(A, "answer", answer)
    got = {}
    for r in S.geocode(q, village, 1).collect():
        got.setdefault(r.query_id % 10, []).append((r.street, r.commune, r.housenumber, r.precision, r.postcode))
    assert rows[0] < 20
    want = [("Rue haute", "Aville", "3", "house", "10001")] * 2 + [("Rue basse", "Beville", n, kind, "10001") for n, kind in ((None, "street"), ("5", "interp"), ("1", "house"))]
    assert {j: set(v) for j, v in got.items()} == {j: {w} for j, w in enumerate(want)} and all(len(v) == 20 for v in got.values())


def test_what_a_task_has_read_in_one_batch_is_not_read_in_the_next(monkeypatch):
    import pyarrow as pa

    read, own = [], S.words.normalize
    monkeypatch.setattr(S.words, "normalize", lambda s: read.append(s) or own(s))

    def prepared(n, asked):
        kinds = pa.schema({"query_id": pa.int64(), **dict.fromkeys(like, pa.string())})
        batch = lambda i: pa.RecordBatch.from_pydict({"query_id": [i], **{c: [v] for c, v in asked(i).items()}}, kinds)
        read.clear()
        out = S._prepare(frozenset(), frozenset({"bis"}), S.words.RULES)(map(batch, range(n)))
        return [tuple(r.values()) for b in out for r in b.to_pylist()]

    like = {"street": "Rue Haute", "number": "3 bis", "city": "Aville", "postcode": "10001"}
    assert prepared(50, lambda i: like) == [(i, "rue haute", "aville", "aville", 3, "bis", 10001) for i in range(50)]
    assert len(read) <= 4
    # what is kept is bounded, and the results don't depend on it
    monkeypatch.setattr(S, "KEPT_CHARS", 300)
    other = lambda i: like | {"street": f"Rue {i % 7}", "number": None if i % 5 == 0 else f"{i % 5}"}
    assert prepared(50, other) == [(i, f"rue {i % 7}", "aville", "aville", i % 5 or None, "", 10001) for i in range(50)]
    kept = S._Kept(str.upper)
    assert [kept[f"x{i}"] for i in range(1000)] == [f"X{i}" for i in range(1000)] and len(kept) < 5
