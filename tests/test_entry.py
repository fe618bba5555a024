import __spark_entry__ as E


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"id", "level", "risk_score"} <= set(df.columns)


def test_every_sql_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_some_queries_against_duckdb(spark):
    import duckdb
    from tools.oracle_check import TABLES, digest
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oq = E.queries(), E.oracle_sql()
    for k in ("velocity_user", "risk_rates_all", "eval_summary", "lift_chart", "drift_report", "split_rates"):
        a = digest(qs[k](spark, sf).toPandas())
        b = digest(con.execute(oq[k]).df())
        assert a[:2] == b[:2], k
