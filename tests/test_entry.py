import __spark_entry__ as entry


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "structured_geocode" in q
    assert entry.entry(spark).count() > 0
