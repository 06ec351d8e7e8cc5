import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["database", "n_records"]
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_oracles_are_duckdb_parsable():
    import duckdb
    con = duckdb.connect()
    from curata.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")
