import __spark_entry__ as entry

SMALL = entry.SMALLEST


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 30


def test_flagship_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["row", "col", "val"]
    assert frame.count() > 0


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    for name in ("base_composition", "graph_edges", "harwell_boeing_pointers"):
        got = entry.queries()[name](spark, SMALL)
        want = con.sql(entry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall())
