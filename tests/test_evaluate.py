import pytest
from pyspark.sql import functions as F

from waymark.operators import evaluate as E, lineage as L, sampling as S


def test_published_intervals_and_p_values(spark):
    df = spark.createDataFrame([(140, 230), (0, 0), (1026, 1200)], "hits int, cases int")
    low, high = E.wilson(F.col("hits"), F.col("cases"))
    got = [(a and round(a, 1), b and round(b, 1)) for a, b in df.select(low, high).collect()]
    assert got[0] == (54.4, 66.9) and got[1] == (None, None)
    assert round(E.mcnemar_p(24, 12), 4) == 0.0652 and round(E.mcnemar_p(40, 16), 4) == 0.0018 and E.mcnemar_p(0, 0) == 1.0
    t = E.mcnemar(spark.createDataFrame([(24, 12)], "only_a long, only_b long")).first()
    assert round(t.p_value, 4) == 0.0652


def test_missing_answers_are_misses(spark):
    truth = spark.createDataFrame([(1, 50.0, 5.0), (2, 50.0, 5.0), (3, 50.0, 5.0)], "id int, lat double, lon double")
    answers = spark.createDataFrame([(1, 50.001, 5.0), (2, 51.0, 5.0)], "id int, lat double, lon double")
    got = {r.id: (r.hit, r.empty) for r in E.judged(truth, answers, "id").collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, True)}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", 7.0), ("b", None)], "g string, v double")
    assert {r.g: r.median for r in E.upper_median(df, "g", "v").collect()} == {"a": 3.0, "b": 7.0}


def test_greedy(spark):
    rows = [("x", i, k, c) for i, (k, c) in enumerate([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 2)])]
    df = spark.createDataFrame(rows, "g string, turn int, k string, c int")
    assert sorted(r.turn for r in S.greedy(df, "g", 3, ["k"], {"c": 2}, ["turn"]).collect()) == [0, 2, 4]
    assert sorted(r.turn for r in S.first_wins(df, "g", ["k"], ["turn"]).collect()) == [0, 2, 3, 4]


def test_lineage(spark):
    df = spark.createDataFrame([(["osm", "x"], True), (["gov"], True), (["gov"], None), ([], True)], "s array<string>, d boolean")
    got = [r[0] for r in df.select(L.lineage(F.col("s"), F.col("d"), ["osm"], ["gov"])).collect()]
    assert got == ["common_upstream", "outside_chain", "unknown_lineage", "unknown_lineage"]
    u = spark.createDataFrame([("https://Example.org/a", "rue de la paix"), ("bad", "x")], "u string, t string")
    assert [tuple(r) for r in u.select(L.host_is(F.col("u"), ["example.org"]), L.contains_tokens(F.col("t"), F.lit("la paix"))).collect()] == [(True, True), (False, False)]


@pytest.mark.parametrize("n", [0, 3])
def test_top_n(spark, n):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    assert S.top_n(df, ["g"], [S.hash_order("s", F.col("id").cast("string"))], n).count() == 2 * n
