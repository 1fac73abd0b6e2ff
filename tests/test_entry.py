import __spark_entry__ as E


def test_entry_runs_with_stable_schema(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert a.count() >= 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80


def test_oracle_runs_in_duckdb_for_a_sample():
    import duckdb
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "orders", "events", "part", "embeddings", "documents", "labels", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    o = E.oracle_sql()
    for name in ("recall_followed", "label_strong_match", "knn_multi", "tfidf_weights", "cf_topk"):
        con.execute(o[name]).fetchall()


def test_registry_needs_no_session():
    """queries() and oracle_sql() must be callable before any session exists."""
    import subprocess
    import sys
    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "print(len(E.queries()), len(E.oracle_sql()))" % root)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd="/tmp")
    assert out.returncode == 0, out.stderr
    n_q, n_o = map(int, out.stdout.split())
    assert n_q >= 80 and n_o >= 60
