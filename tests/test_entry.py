import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == E.entry(spark).columns


def test_every_query_has_oracle():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    from ricefield.plans import catalog

    assert set(catalog.queries()) <= set(sql)
