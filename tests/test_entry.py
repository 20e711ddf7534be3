import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["local_only", "remote_only", "local_newer", "remote_newer", "content_differs", "identical"]
    assert df.count() == 1


def test_registration():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) and s.strip() for s in oracles.values())
