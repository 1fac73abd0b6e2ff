import datetime as dt
import os

from pyspark.sql import functions as F

from citeflow.sources import papers as SP
from citeflow.sources import pools as P
from citeflow.sources import vocab as VS


def write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_scholar_pool_torn_line_and_both_id_names(spark, tmp_dir):
    d = os.path.join(tmp_dir, "scholar", "day=2024-01-02")
    write(d, "a.json", '{"u1":[{"pub_id":"p1"},{"event_pub_id":"p2"},{"other":"x"}]}\n{"u2":[]}\n{"u3":[{"pub_')
    got = P.read_scholar(spark, os.path.join(tmp_dir, "scholar")).collect()
    assert sorted((r["scholar_id"], r["paper_id"]) for r in got) == [("u1", "p1"), ("u1", "p2")]


def test_latest_pool_bom_missing_path_and_day_filter(spark, tmp_dir):
    root = os.path.join(tmp_dir, "latest")
    write(os.path.join(root, "day=2024-01-01"), "a.json", '﻿{"pub_id":"a"}\n{"title":"no id"}\n')
    write(os.path.join(root, "day=2024-01-05"), "b.json", '{"pub_id":"b"}\n')
    got = P.read_latest(spark, root).collect()
    assert sorted(r["paper_id"] for r in got) == ["a", "b"]
    one = P.read_latest(spark, root, dt.date(2024, 1, 2), dt.date(2024, 1, 9)).collect()
    assert [r["paper_id"] for r in one] == ["b"]
    assert P.read_latest(spark, os.path.join(tmp_dir, "nope")).count() == 0


def test_route_by_file_name(spark, tmp_dir):
    write(os.path.join(tmp_dir, "p", "latest"), "x.json", '{"pub_id":"l1"}\n')
    write(os.path.join(tmp_dir, "p", "scholar"), "x.json", '{"s":[{"pub_id":"s1"}]}\n')
    write(os.path.join(tmp_dir, "p", "high"), "x.json", '{"_id":"h1"}\n{"x":1}\n')
    write(os.path.join(tmp_dir, "p", "other"), "x.json", '{"_id":"zzz"}\n')
    got = P.route(spark, [os.path.join(tmp_dir, "p")]).collect()
    assert sorted((r["pool"], r["paper_id"]) for r in got) == [("high", "h1"), ("latest", "l1"), ("scholar", "s1")]


def test_vocab_documents(spark, tmp_dir):
    write(tmp_dir, "v.json", '{"words": [{"name": "graph"}, {"name": ""}, {"x": 1}, {"name": "graph"}]}')
    got = VS.read_vocab(spark, os.path.join(tmp_dir, "v.json")).collect()
    assert [r["word"] for r in got] == ["graph"]
    assert VS.read_vocab(spark, os.path.join(tmp_dir, "missing.json")).count() == 0


def test_paper_scan_quarantine_and_last_wins(spark, tmp_dir):
    write(tmp_dir, "pub.json",
          '{"_id":"a","id_of_mysql":1,"title":"old"}\n'
          '{"id_of_mysql":2,"title":"no text id"}\n'
          '{"_id":"c","title":"no numeric id"}\n'
          '{"_id":"a2","id_of_mysql":1,"title":"new"}\n'
          '{"_id":"torn","id_of')
    good, bad = SP.split_corrupt(SP.read_papers_raw(spark, os.path.join(tmp_dir, "pub.json")))
    assert bad.count() == 1
    kept = SP.keep_identified(good)
    assert kept.count() == 2
    latest = SP.last_wins(kept).collect()
    assert [(r["id_of_mysql"], r["title"]) for r in latest] == [(1, "new")]


def test_day_range_drops_last(spark):
    r = spark.range(1).select(P.day_range(dt.date(2024, 1, 1), dt.date(2024, 1, 3), drop_last=True).alias("d")).first()
    assert r["d"] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]


def test_paper_records_gather_the_lines_of_documents_only(spark, sf_small):
    """Line items and orders without a document are left out before they are joined and gathered."""
    from citeflow.fixtures import Fixtures
    from citeflow.plans import text_job
    papers = text_job.paper_info(Fixtures(spark, sf_small))
    plan = papers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
    assert papers.count() == Fixtures(spark, sf_small).table("documents").count()
