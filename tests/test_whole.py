import duckdb
import pytest

from waymark import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["filled_counts", "semi_referenced", "anti_not_in", "anti_not_exists_like", "greedy_quota", "strip_phone_runs", "department_filter", "homonym_rank"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "part", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(con.sql(Q.SQL[name]).select(*df.columns).fetchall())
    assert got, "a query that returns nothing proves nothing"
    if name == "filled_counts":
        n = [r[2] for r in got]
        assert sum(n) == con.execute("SELECT count(*) FROM orders").fetchone()[0] and 0 in n
