import os

from pyspark.sql import functions as F

from citeflow.operators.embed import HashingEmbedder, RandomProjectionEmbedder
from citeflow.streaming.incremental import read_quarantine, run_incremental


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_incremental_appends_only_new_ids(spark, tmp_dir):
    src, table, ckpt = (os.path.join(tmp_dir, x) for x in ("src", "table", "ckpt"))
    write(os.path.join(src, "d1", "a.json"),
          '{"_id":"a","id_of_mysql":1,"ts":"2001-01-01 00:00:00","title":"Graph mining"}\n'
          '{"_id":"b","id_of_mysql":2,"ts":"2001-01-02 00:00:00","title":"Deep nets"}\n')
    assert run_incremental(spark, os.path.join(src, "*"), table, ckpt) == 2
    write(os.path.join(src, "d2", "b.json"),
          '{"_id":"b2","id_of_mysql":2,"ts":"2001-01-03 00:00:00","title":"Deep nets again"}\n'
          '{"_id":"c","id_of_mysql":3,"ts":"2001-01-04 00:00:00","title":"Streams"}\n'
          '{"id_of_mysql":4,"title":"no text id"}\n{"_id":"torn","id_')
    assert run_incremental(spark, os.path.join(src, "*"), table, ckpt) == 1
    assert run_incremental(spark, os.path.join(src, "*"), table, ckpt) == 0
    stored = spark.read.parquet(table)
    assert sorted(r["pid"] for r in stored.collect()) == [1, 2, 3]


def test_embedders_are_unit_length(spark):
    df = spark.createDataFrame([(1, "graph neural networks"), (2, ""), (3, None)], "id long, text string")
    for emb in (HashingEmbedder(dim=16), RandomProjectionEmbedder(dim=8)):
        rows = {r["id"]: r["vec"] for r in emb.transform(df, "id", "text").collect()}
        assert set(rows) == {1, 2, 3}
        n = sum(x * x for x in rows[1]) ** 0.5
        assert abs(n - 1.0) < 1e-9


def test_torn_lines_are_quarantined_once(spark, tmp_dir):
    src, table, ckpt, bad = (os.path.join(tmp_dir, x) for x in ("src", "table", "ckpt", "bad"))
    good = '{"_id":"a","id_of_mysql":%d,"ts":"2001-01-01 00:00:00","title":"Graph mining"}'
    write(os.path.join(src, "d1", "a.json"), good % 1 + '\n\n{"_id":"torn","id_\n' + good % 2 + "\n")
    write(os.path.join(src, "d1", "b.json"), 'no json\n')
    lines = lambda: sorted(r["_corrupt_record"] for r in read_quarantine(spark, bad).collect())
    assert lines() == []
    assert run_incremental(spark, os.path.join(src, "*"), table, ckpt, quarantine=bad) == 2
    assert lines() == ["no json", '{"_id":"torn","id_']
    # a crash between the batch and its commit: the batch is run again
    for kind in ("commits",):
        for f in os.listdir(os.path.join(ckpt, kind)):
            os.remove(os.path.join(ckpt, kind, f))
    assert run_incremental(spark, os.path.join(src, "*"), table, ckpt, quarantine=bad) == 0
    assert lines() == ["no json", '{"_id":"torn","id_']
    write(os.path.join(src, "d2", "c.json"), '[1\n')
    run_incremental(spark, os.path.join(src, "*"), table, ckpt, quarantine=bad)
    assert lines() == ["[1", "no json", '{"_id":"torn","id_']
