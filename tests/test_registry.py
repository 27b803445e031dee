import __spark_entry__ as entry


def test_every_twin_has_its_query():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_uid", "score", "rank"] and df.count() > 0
