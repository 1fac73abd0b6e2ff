import pathlib

from pyspark.sql import functions as F

from citeflow.operators import cf
from citeflow.operators import pairs as P
from citeflow.session import scratch_path
from citeflow.sinks.nested import nest_recall, write_recall_json


def _rows(df, cols):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_blocks_take_turns_with_the_same_pairs(spark, monkeypatch):
    data = sorted({(g, (g * i) % 53 + i) for g in range(150) for i in range(1, 20)} | {(500, m) for m in range(80)})
    m = spark.createDataFrame(data, "g long, m long")
    cols = ["a", "b", "W", "score", "rk"]
    want = _rows(P.pair_topk(m, 4, "one", True, hot=10**9), cols)
    monkeypatch.setattr(P, "ROUND", 1)
    monkeypatch.setattr(P, "SENT", 4)
    turns, made = [], P._block_best
    monkeypatch.setattr(P, "_block_best", lambda *a: turns.append(1) or made(*a))
    monkeypatch.setattr(P, "WORK", 800)
    assert _rows(P.pair_topk(m, 4, "one", True, hot=5, block=8), cols) == want and len(turns) > 3


def test_nothing_but_the_related_items_of_a_kind_stays(spark):
    clicks = spark.createDataFrame([(u, kind, (u * 7 + i) % 30) for u in range(60) for i in range(20) for kind in ("paper", "topic")],
                                   "user_id long, kind string, item long")
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {*folder.iterdir()}
    got = cf.item_topk_by_kind(clicks, ("paper", "topic"), k=3, hot=5)
    left = [f.name for f in {*folder.iterdir()} - before if any(f.name.startswith(x) for x in ("memberships", "members", "light", "related"))]
    assert len(left) == 2 and all(x.startswith("related") for x in left)
    assert got.groupBy("kind").count().count() == 2 and got.where("rk = 1").count() == 60


def test_json_lines_are_compressed_and_the_same_in_slices(spark):
    flat = spark.range(400).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 5).alias("followed_id"), F.lit("a").alias("name_of_followed_author"),
        F.lit("作").alias("chinese_name_of_followed_author"), F.when(F.col("id") % 2 == 0, "high").otherwise("latest").alias("pool"),
        F.lit("followed_scholar").alias("label"), F.col("id").alias("rank"), F.col("id").alias("paper_id"), F.lit(0.5).alias("distance"),
        F.lit(False).alias("new"), F.lit(3).alias("n_citation"), F.col("id").alias("author_id"), F.lit("n").alias("author_name_en"),
        F.lit("").alias("author_name_zh"), F.lit(1).alias("pv"), F.array(F.lit("R")).alias("zone"))
    nested = nest_recall(flat)
    one, cut = scratch_path(spark, "json-one"), scratch_path(spark, "json-cut")
    write_recall_json(nested, one)
    write_recall_json(nested, cut, slices=3)
    lines = _rows(spark.read.text(one), ["value"])
    assert len(lines) == 7 and lines == _rows(spark.read.text(cut), ["value"]) and "作" in lines[0][0]
    files = [f for f in pathlib.Path(one).iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".gz") for f in files)
    assert sum(f.stat().st_size for f in files) < sum(len(x[0]) for x in lines) / 4
