import datetime as dt

from pyspark.sql import functions as F

from citeflow.operators import label as L

RUN = dt.datetime(2001, 8, 1)


def test_match_keeps_order_repeats_and_empty(spark):
    papers = spark.createDataFrame(
        [("a", ["Deep-Learning ", "x", " graph  theory", "deep learning"]),
         ("b", []), ("c", None), ("d", ["-x-", None])],
        "paper_id string, keywords array<string>")
    vocab = spark.createDataFrame([("deep learning",), ("graph  theory",), ("x",), ("",)], "word string")
    got = {r["pub_id"]: r["labels"] for r in L.match_keywords(papers, vocab).collect()}
    assert got == {"a": ["deep learning", "x", "graph  theory", "deep learning"],
                   "b": [], "c": [], "d": ["x"]}


def test_lookup_each_paper_once_unknown_dropped(spark):
    ids = spark.createDataFrame([("1",), ("1",), ("404",)], "paper_id string")
    papers = spark.createDataFrame([(1, ["k"]), (2, ["z"])], "paper_id long, keywords array<string>")
    got = L.lookup(ids, papers, ["keywords"]).collect()
    assert [(r["paper_id"], r["keywords"]) for r in got] == [("1", ["k"])]


def test_upsert_keeps_create_time_and_is_idempotent(spark):
    old = spark.createDataFrame(
        [("p1", ["a"], dt.datetime(2000, 1, 1), dt.datetime(2000, 6, 1)),
         ("p2", ["b"], dt.datetime(2000, 1, 1), dt.datetime(2000, 6, 1))],
        "pub_id string, labels array<string>, create_time timestamp, modify_time timestamp")
    new = spark.createDataFrame([("p1", ["z"]), ("p3", []), ("p3", [])], "pub_id string, labels array<string>")
    ts = F.lit(RUN).cast("timestamp")
    once = L.upsert(old, new, ts)
    twice = L.upsert(once, new, ts)
    a = sorted(tuple(r) for r in once.collect())
    b = sorted(tuple(r) for r in twice.collect())
    assert a == b
    got = {r["pub_id"]: r for r in once.collect()}
    assert got["p1"]["labels"] == ["z"] and got["p1"]["create_time"] == dt.datetime(2000, 1, 1)
    assert got["p1"]["modify_time"] == RUN
    assert got["p2"]["modify_time"] == dt.datetime(2000, 6, 1)
    assert got["p3"]["create_time"] == RUN and got["p3"]["labels"] == []


def test_nearest_subjects_order(spark):
    papers = spark.createDataFrame([(7, [0.0, 0.1])], "pub_id long, vec array<double>")
    subjects = spark.createDataFrame(
        [(0, "far", [5.0, 5.0]), (1, "near", [0.0, 0.0]), (2, "mid", [1.0, 1.0])],
        "subject_id long, word string, embedding array<double>")
    got = L.nearest_subjects(papers, subjects, 2).first()
    assert got["labels"] == ["near", "mid"]
