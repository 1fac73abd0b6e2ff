import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.operators.cell_store import CellStore
from citeflow.operators import knn as K


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), i % 3) for i, v in enumerate(x)], "cid long, vec array<double>, kind int").repartition(3)


def clustered(n, clusters=30, d=8, spread=0.05, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, d)) * 3
    return centres[r.integers(0, clusters, n)] + r.normal(size=(n, d)) * spread


def brute(x, q, k, metric, exclude_self):
    out = []
    for i, v in enumerate(q):
        if metric == "l2":
            score = np.cumsum((v - x) ** 2, axis=1)[:, -1]
        else:
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
            score = np.divide(x @ v, size, out=np.zeros(len(x)), where=size > 0)
        order = [j for j in np.lexsort((np.arange(len(x)), score if metric == "l2" else -np.round(score, 12))) if not (exclude_self and i == j)]
        out += [(i, int(j), rank) for rank, j in enumerate(order[:k], 1)]
    return sorted(out)


def found(hits):
    return sorted((r.qid, r.cid, r["rank"]) for r in hits.collect())


def queries(df):
    return df.select(F.col("cid").alias("qid"), "vec")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_exact_search_equals_brute_force(spark, tmp_dir, metric):
    r = np.random.default_rng(1)
    x = np.concatenate([clustered(300), r.normal(size=(60, 8)), np.zeros((3, 8)), np.ones((20, 8)), 1e6 + clustered(40) * 1e-3])
    if metric == "cosine":
        x = x[:383]
    df = frame(spark, x)
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(df.where("cid % 4 <> 0"), metric)
    store.append(df.where("cid % 4 = 0"))
    assert found(store.search_exact(queries(df), 5, exclude_self=True)) == brute(x, x, 5, metric, True)
    assert found(store.search_exact(queries(df).where("qid < 40"), 7)) == brute(x, x[:40], 7, metric, False)
    assert store.search_exact(queries(df).where("qid = 3"), 10_000).count() == len(x)       # fewer than k


def test_exact_search_on_clusters_meets_few_pairs(spark, tmp_dir):
    x = clustered(1500, clusters=40)
    df = frame(spark, x)
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(df, "l2", n_cells=60)
    hits, passes = store._exact_hits(queries(df), 5, True, None, K.BLOCK)
    assert found(K.top_k(hits, 5, "l2")) == brute(x, x, 5, "l2", True)
    assert store.pairs_met(passes) < 0.2 * len(x) ** 2


def test_append_and_replay(spark, tmp_dir):
    x = clustered(200)
    df = frame(spark, x)
    store = CellStore(spark, f"{tmp_dir}/index")
    assert store.current() is None
    store.build(df.where("cid < 120"), "l2")
    assert store.current().cells == round(120 ** 0.5)
    for _ in range(2):
        store.append(df.where("cid >= 100").unionByName(df.where("cid = 150")))
    rows = store.lists().collect()
    assert sorted(r.cid for r in rows) == list(range(200)) and all(r.kind == r.cid % 3 for r in rows)
    ids, centres = store._centres(store.current().build)
    for r in rows:
        d = np.linalg.norm(centres - np.array(r.vec), axis=1)
        assert d[list(ids).index(r.cell)] == pytest.approx(d.min()) and r.far == pytest.approx(d.min())
    store.rebuild()
    assert store.current().version == 2 and store.current().cells == round(200 ** 0.5)
    assert sorted(r.cid for r in store.lists().collect()) == list(range(200))


def test_search_with_given_cells_reads_probed_lists_only(spark, tmp_dir):
    x = clustered(300)
    df = frame(spark, x)
    centres = spark.createDataFrame([(100 + i, x[i].tolist()) for i in range(20)], "c long, embedding array<double>")
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(df, "l2", cells=centres)
    cell = {i: 100 + int(np.argmin(((v - x[:20]) ** 2).sum(axis=1))) for i, v in enumerate(x)}
    assert {r.cid: r.cell for r in store.lists().collect()} == cell
    few = queries(df).where("qid < 4")
    hits = store.search(few, 6, nprobe=2, where="kind <> 1", small="queries")
    want = []
    for i in range(4):
        near = np.argsort(((x[i] - x[:20]) ** 2).sum(axis=1), kind="stable")[:2] + 100
        rows = [(float(np.cumsum((x[i] - x[j]) ** 2)[-1]), j) for j in range(300) if cell[j] in near and j % 3 != 1]
        want += [(i, j, rank) for rank, (_, j) in enumerate(sorted(rows)[:6], 1)]
    assert found(hits) == sorted(want)
    plan = hits._jdf.queryExecution().toString()
    assert any("cell#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert found(store.search(few, 6, nprobe=2, where="kind <> 1")) == sorted(want)


def test_empty_and_null(spark, tmp_dir):
    none = spark.createDataFrame([(1, None, 0)], "cid long, vec array<double>, kind int")
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(none, "l2")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "qid long, vec array<double>")
    assert store.search(q, 3).collect() == [] and store.search_exact(q, 3).collect() == []
    with pytest.raises(ValueError):
        CellStore(spark, f"{tmp_dir}/other").build(none, "hamming")


def test_dot_products_are_refused_by_the_exact_search(spark, tmp_dir):
    df = frame(spark, clustered(30))
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(df, "dot")
    assert store.search(queries(df), 3).count() == 90
    with pytest.raises(ValueError):
        store.search_exact(queries(df), 3)


def test_a_query_is_sent_to_shelves_not_to_every_cell(spark, tmp_dir, monkeypatch):
    """Vectors without clusters, of which every query reaches nearly all cells."""
    x = np.random.default_rng(5).normal(size=(600, 16))
    df = frame(spark, x)
    store = CellStore(spark, f"{tmp_dir}/index")
    store.build(df, "l2", n_cells=60)
    sent, join = [], K._block_join
    monkeypatch.setattr(K, "_block_join", lambda q, *a, **b: sent.append(q.count()) or join(q, *a, **b))
    hits, passes = store._exact_hits(queries(df), 5, True, None, 64)
    assert found(K.top_k(hits, 5, "l2")) == brute(x, x, 5, "l2", True)
    assert passes[1].count() > 40 * len(x) and sent[1] <= 10 * len(x)
