import hashlib
import re

import awkward
import pytest
from pyspark.sql import functions as F

from citeflow.llm import exact_dedup as X


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    out = []
    for r, n in zip(rows, norm):
        ids = [x[0] for x, m in zip(rows, norm) if m == n]
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows_match_brute_force(spark):
    got = X.exact_dedup(awkward.documents(spark)).drop("locator").collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got], key=str) \
        == brute(awkward.rows())


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    weak = lambda c: F.substring(X.sha256(c), 1, 1)
    got = X.exact_dedup(awkward.documents(spark), digest=weak).drop("locator").collect()
    assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got], key=str) \
        == brute(awkward.rows())


def test_empty_table(spark):
    assert X.exact_dedup(awkward.empty(spark)).count() == 0


def test_state_goes_on_over_a_growing_feed(spark, tmp_dir):
    feed, state = f"{tmp_dir}/feed", f"{tmp_dir}/state"
    rows = lambda *r: spark.createDataFrame(list(r), X.FEED_SCHEMA).coalesce(1).write.mode("append").parquet(feed)
    rows((5, "d1", "d1", "f1"), (6, "d2", "d2", "f1"))
    assert {(r.digest, r.keep_id, r.group_size) for r in X.run_state(spark, feed, state).collect()} == {("d1", 5, 1), ("d2", 6, 1)}
    rows((3, "d1", "d1", "f2"), (9, "d3", "d3", "f2"))
    assert {(r.digest, r.keep_id, r.locator, r.group_size) for r in X.run_state(spark, feed, state).collect()} \
        == {("d1", 3, "f2", 2), ("d2", 6, "f1", 1), ("d3", 9, "f2", 1)}
    assert X.run_state(spark, feed, state).count() == 3         # nothing new: nothing changes


def test_stage_keeps_columns(spark):
    docs = awkward.documents(spark)
    out = X.drop_copies(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == sorted(
        [1, 2, 4, 5, 7, 8, 9, 10, 11, 13, 14, *range(20, 60)])


def test_stage_keeps_one_of_repeated_rows_and_null_ids(spark):
    rows = [(3, "a b", "x"), (3, "a b", "x"), (None, "a  b", "y"), (5, "c", "x"), (None, "c", "x"), (None, "d", "x"), (None, "d", "x"),
            (6, "e", "x"), (6, "f", "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, (r.text or "").split()) for r in X.drop_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(3, ["a", "b"]), (5, ["c"]), (None, ["d"]), (6, ["e"]), (6, ["f"]), (None, [])], key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_two_calls_on_one_state(spark, tmp_dir, weak):
    """Groups go over both calls; with digests that collide, texts of the first call are compared, too."""
    digest = (lambda c: F.substring(X.sha256(c), 1, 1)) if weak else X.sha256
    first = [(5, "a b"), (6, "c"), (7, "d"), (7, "d"), *[(100 + i, f"text {i}") for i in range(40)]]
    second = [(3, "a  b"), (9, "c"), (10, "e"), (None, "d"), (11, None), *[(200 + i, f"text {i // 2}") for i in range(40)]]
    keep = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    seen = []
    for k, rows in enumerate((first, second)):
        path = f"{tmp_dir}/docs {k}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
        got = X.exact_dedup(spark.read.parquet(path), digest=digest, state_dir=f"{tmp_dir}/state").select(*keep).collect()
        seen += rows
        sha = lambda text: hashlib.sha256(re.sub("[ ]+", " ", text or "").encode()).hexdigest()
        own = {(r[0], sha(r[1])) for r in rows}
        want = {w for w in brute(seen) if (w[0], w[4]) in own}
        assert {tuple(g) for g in got} == want and len(got) == len(rows)
