import numpy as np
import pytest

from citeflow.operators import knn as K


def brute(q, c, k, metric, exclude_self):
    out = {}
    for i, qv in enumerate(q):
        s = []
        for j, cv in enumerate(c):
            if exclude_self and i == j:
                continue
            if metric == "l2":
                v = float(np.sum((qv - cv) ** 2))
            elif metric == "dot":
                v = float(qv @ cv)
            else:
                v = float(qv @ cv / (np.linalg.norm(qv) * np.linalg.norm(cv)))
            s.append((v, j))
        s.sort(key=lambda x: (x[0] if metric == "l2" else -x[0], x[1]))
        out[i] = [j for _, j in s[:k]]
    return out


def by_query(got):
    out = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r["cid"])
    return out


HOWS = [{"block": 32}, {"small": "queries"}, {"small": "corpus"}]


@pytest.mark.parametrize("how", HOWS)
def test_ties_rank_by_id(spark, how):
    """400 equal vectors: the three smallest ids, not whichever a key keeps."""
    c = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)], "cid long, vec array<double>").repartition(4)
    q = spark.createDataFrame([(i, [1.0, 2.0, float(i)]) for i in range(3)], "qid long, vec array<double>")
    assert by_query(K.knn(q, c, 3, **how).collect()) == {i: [0, 1, 2] for i in range(3)}


@pytest.mark.parametrize("how", HOWS)
def test_large_offsets_do_not_cancel(spark, how):
    c = spark.createDataFrame([(i, [1e9 + 0.25 * i, 1e9]) for i in range(200)], "cid long, vec array<double>")
    q = spark.createDataFrame([(1, [1e9 + 50.0, 1e9])], "qid long, vec array<double>")
    assert by_query(K.knn(q, c, 3, **how).collect()) == {1: [199, 198, 197]}


@pytest.mark.parametrize("how", HOWS + [{"exact": False, "n_cells": 4}])
def test_zero_vectors_and_empty_sides(spark, how):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, None)], "cid long, vec array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "qid long, vec array<double>")
    got = K.knn(q, c, 5, metric="cosine", **how).collect()
    assert [(r.qid, r.cid, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(9, 1, 0.0, 1), (9, 2, -1.0, 2)]
    assert K.knn(q, c.where("cid > 9"), 5, **how).count() == 0 and K.knn(q.where("qid > 9"), c, 5, **how).count() == 0
    assert K.knn_lsh(q, c.where("cid > 9"), 5).count() == 0


def test_a_side_declared_small_must_be(spark, monkeypatch):
    monkeypatch.setattr(K, "SMALL", 10)
    c = spark.createDataFrame([(i, [float(i)]) for i in range(11)], "cid long, vec array<double>")
    with pytest.raises(ValueError):
        K.knn(c.withColumnRenamed("cid", "qid").limit(1), c, 1, small="corpus")


def test_groups_of_the_block_join_are_bounded(spark):
    """One crowded cell: every group of both sides stays near the block size."""
    from pyspark.sql import functions as F
    rows = lambda n, key: spark.range(n).select(
        F.col("id").alias(key), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("vec"), F.lit(0).cast("long").alias("cell"))
    got = K._block_join(rows(500, "qid"), rows(4000, "cid"), 2, "l2", True, 256)
    assert got.count() == 500 * 2 * 16          # two rows for every query and corpus block


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 8)) * 4
    pts = np.vstack([centers[i % 4] + rng.normal(size=8) for i in range(120)])
    return pts


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_exact_knn_equals_brute_force(spark, vectors, metric):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    c = spark.createDataFrame(rows, "cid long, vec array<double>")
    q = c.withColumnRenamed("cid", "qid")
    for how in ({"block": 16}, {"small": "queries"}, {"small": "corpus"}):
        got = K.knn(q, c, 5, metric=metric, exclude_self=True, **how).collect()
        assert by_query(got) == brute(vectors, vectors, 5, metric, True)


def test_probing_all_cells_is_exact(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    c = spark.createDataFrame(rows, "cid long, vec array<double>")
    cells = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(6)], "c long, embedding array<double>")
    index = K.cells_from_table(cells, "l2")
    got = K.knn(c.withColumnRenamed("cid", "qid"), c, 3, exact=False, nprobe=6, cells=index).collect()
    assert by_query(got) == brute(vectors, vectors, 3, "l2", False)


def test_fewer_than_k_candidates(spark):
    c = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "cid long, vec array<double>")
    q = spark.createDataFrame([(9, [0.5, 0.5])], "qid long, vec array<double>")
    got = K.knn(q, c, 5, metric="l2").collect()
    assert sorted(r["cid"] for r in got) == [1, 2]


def test_lsh_recall_and_candidates(spark):
    """Noisy copies are found, and few pairs meet in a bucket."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 32))
    pts = np.vstack([base, base + 0.1 * rng.normal(size=base.shape)])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "cid long, vec array<double>")
    got = K.knn_lsh(c.withColumnRenamed("cid", "qid"), c, 3, exclude_self=True).collect()
    top = {q: ids[0] for q, ids in by_query(got).items()}
    assert sum(top.get(i) == (i + 300) % 600 for i in range(600)) >= 0.99 * 600
    assert all(r["qid"] != r["cid"] for r in got) and max(r["rank"] for r in got) <= 3
    signs = np.sign(pts @ np.random.default_rng(7).normal(size=(32, 84))).reshape(600, 12, 7)
    met = np.zeros((600, 600), bool)
    for t in range(12):
        met |= (signs[:, None, t] == signs[None, :, t]).all(axis=2)
    assert (met.sum() - 600) / (600 * 599) < 0.15


def test_probing_recall(spark, vectors):
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "cid long, vec array<double>")
    got = by_query(K.knn(c.withColumnRenamed("cid", "qid"), c, 5, exclude_self=True, exact=False, n_cells=12, nprobe=4).collect())
    want = brute(vectors, vectors, 5, "l2", True)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * 5 * len(want)


def test_blocks_grow_where_they_would_be_many(spark):
    """From SPREAD blocks of a side on a row isn't sent to more of them."""
    from pyspark.sql import functions as F
    rows = lambda n, key: spark.range(n).select(
        F.col("id").alias(key), F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("vec"), F.lit(0).cast("long").alias("cell"))
    got = K._block_join(rows(500, "qid"), rows(4000, "cid"), 2, "l2", True, 16)
    assert got.count() == 500 * 2 * K.SPREAD
