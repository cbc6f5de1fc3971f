"""What the plans look like: pushed filters, no products of rows, no Python in the column functions."""

import re

import pytest
from pyspark.sql import functions as F

from waymark import queries as Q
from waymark.operators.canon import nearest
from waymark.plans.grid import grid_join, staged

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_join_has_equal_keys(spark):
    a = spark.createDataFrame([(i, 50.0 + i / 50, 5.0) for i in range(20)], "id int, lat double, lon double")
    b = spark.createDataFrame([(f"p{i}", 50.0 + i / 20, 5.0) for i in range(8)], "nm string, lat double, lon double")
    got = {r.id: r.nm for r in nearest(a, b, "id", 10.0, 1).collect()}
    for i in range(20):
        lat = 50.0 + i / 50
        near = [j for j in range(8) if abs(round((50.0 + j / 20) * 10) - round(lat * 10)) <= 1]
        best = min(near, key=lambda j: (round(abs(50.0 + j / 20 - lat), 9), f"p{j}"), default=None)
        assert got.get(i) is None and best is None or abs(abs(50.0 + int(got[i][1:]) / 20 - lat) - abs(50.0 + best / 20 - lat)) < 1e-9
    assert not re.search("CartesianProduct|NestedLoop", plan(grid_join(a, b, 10.0, 1)))


@pytest.mark.parametrize("name", ["structured_geocode", "fuzzy_street", "reverse_geocode", "street_agg", "nearest_in_grid", "name_stitching", "anti_not_exists_like", "cross_source_collision"])
def test_no_products_of_rows(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(Q.QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["norm_text", "normalize_query", "reverse_geocode", "house_number_split", "distances", "score_grouping_sets", "wilson_interval"])
def test_no_python_in_column_functions(spark, name):
    assert not re.search("Python|Arrow", plan(Q.QUERIES[name](spark, SF)))


def test_scans_read_only_what_they_need(spark):
    p = plan(Q.QUERIES["semi_referenced"](spark, SF))
    assert "ReadSchema: struct<p_partkey:bigint>" in p and "ReadSchema: struct<l_partkey:bigint>" in p


def test_staged(spark):
    q = spark.range(6).withColumnRenamed("id", "k")
    out = staged(q, "k", [lambda d: d.where("k < 2").withColumn("s", F.lit(1)), lambda d: d.where("k < 4").withColumn("s", F.lit(2)), lambda d: d.withColumn("s", F.lit(3))])
    assert {r.k: r.s for r in out.collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
