def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert len(rows) == 1500 and {r.path for r in rows} >= {"GRAPH,GRAPH", "TEXT,GRAPH", ""}
