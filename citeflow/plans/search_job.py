"""Vector build and search jobs.

Vector roles come from the data: topics are the newest vector of each label,
cells for the probing search are the first vector of each label, vectors are
dated by the order with the same key, and only labelled documents have a
paper id.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..fixtures import Fixtures
from ..functions import text as T
from ..functions import vector as V
from ..operators import incremental as INC
from ..operators.embed import HashingEmbedder
from ..operators import knn as K
from ..operators import knn_graph as G
from ..operators.cell_store import CellStore
from ..session import scratch_path, written
from ..sources.papers import existing_ids, last_wins

R = 9  # rounding of reported scores


def _since(as_of: _dt.date, days: int):
    return F.unix_timestamp(F.lit(as_of - _dt.timedelta(days=days)).cast("timestamp"))


def corpus(fx: Fixtures, recent_days: int | None = None) -> DataFrame:
    """``(cid, vec)``; with ``recent_days`` only vectors stamped in that span."""
    since = None if recent_days is None else fx.as_of - _dt.timedelta(days=recent_days)
    v = fx.vec(since)
    return v.select(F.col("pid").alias("cid"), F.col("embedding").alias("vec"))


def topics(fx: Fixtures) -> DataFrame:
    return fx.topics().select(F.col("q").alias("qid"), F.col("embedding").alias("vec"))


def _out(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("qid").alias("q"), F.col("cid").alias("pid"),
                       F.round("score", R).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def q_knn_cosine(spark, sf):
    """Cosine top 10 of every topic."""
    fx = Fixtures(spark, sf)
    return _out(K.knn(topics(fx), corpus(fx), C.SEARCH_TOPK, metric="cosine", small="queries"))


def q_knn_dot(spark, sf):
    """Dot-product top 10 over normalised vectors."""
    fx = Fixtures(spark, sf)
    q = topics(fx).select("qid", V.normalize("vec").alias("vec"))
    c = corpus(fx).select("cid", V.normalize("vec").alias("vec"))
    return _out(K.knn(q, c, C.SEARCH_TOPK, metric="dot", small="queries"))


def q_knn_topic(spark, sf):
    """J10 (one query): the newest topic, L2, last 365 days."""
    fx = Fixtures(spark, sf)
    t = topics(fx)
    one = t.orderBy(F.col("qid").desc()).limit(1)
    return _out(K.knn(one, corpus(fx, C.SEARCH_SPAN_DAYS), C.SEARCH_TOPK, metric="l2", small="queries"))


def q_knn_multi(spark, sf):
    """J10 (many queries, D14): every vector's 10 nearest others by L2, exact."""
    fx = Fixtures(spark, sf)
    c = corpus(fx)
    return _out(K.knn(c.withColumnRenamed("cid", "qid"), c, C.SEARCH_TOPK, metric="l2",
                      exclude_self=True))


def q_knn_recent(spark, sf):
    """Topics against vectors of the last 365 days only (filter before ranking)."""
    fx = Fixtures(spark, sf)
    return _out(K.knn(topics(fx), corpus(fx, C.SEARCH_SPAN_DAYS), C.SEARCH_TOPK, metric="l2", small="queries"))


def q_knn_mapped(spark, sf):
    """Map hits to paper ids after the top-k; unmapped hits drop out."""
    fx = Fixtures(spark, sf)
    hits = K.knn(topics(fx), corpus(fx, C.SEARCH_SPAN_DAYS), C.SEARCH_TOPK, metric="l2", small="queries")
    m = fx.vec_id_map().withColumnRenamed("pid", "cid")
    return hits.join(m, "cid").select(F.col("qid").alias("q"), "paper_id",
                                      F.round("score", R).alias("score"),
                                      F.col("rank").cast("bigint").alias("rank"))


def q_topic_search(spark, sf):
    """B8 from text: topics (missing ones fall back to ``unknown``) are encoded, searched among the encoded
    papers of the last 365 days, and hits mapped to paper ids; hits without one drop out."""
    from . import io_job, text_job
    fx = Fixtures(spark, sf)
    topic = text_job.paper_info(fx).select(T.topic_or_unknown("venue").alias("topic")).distinct()
    qs = INC.dense_index(topic, "topic").select(F.col("idx").alias("qid"), "topic")
    since = fx.as_of - _dt.timedelta(days=C.SEARCH_SPAN_DAYS)
    recent = fx.table("orders").where(F.col("o_orderdate") >= F.lit(since).cast("timestamp")).select(F.col("o_orderkey").alias("doc_id"))
    vecs = io_job.encode_papers(fx).join(recent, "doc_id", "left_semi").select(F.col("doc_id").alias("cid"), "vec")
    hits = K.knn(HashingEmbedder().transform(qs, "qid", "topic"), vecs, C.SEARCH_TOPK, metric="cosine", small="queries")
    ids = fx.vec_id_map().withColumnRenamed("pid", "cid")
    return hits.join(ids, "cid").join(qs, "qid").select("topic", "paper_id", F.round("score", R).alias("score"),
                                                        F.col("rank").cast("bigint").alias("rank"))


def q_knn_ivf(spark, sf):
    """V2: approximate search probing the 10 nearest of the fixed cells, every vector a query."""
    fx = Fixtures(spark, sf)
    c = corpus(fx)
    cells = K.cells_from_table(fx.centroid(), "l2")
    hits = K.knn(c.withColumnRenamed("cid", "qid"), c, C.SEARCH_TOPK, metric="l2",
                 exact=False, nprobe=C.SEARCH_NPROBE, cells=cells)
    return _out(hits)


def vector_store(spark, sf: str) -> CellStore:
    """The stored cell index over the dated vectors, with the fixed cells: built from the vectors older
    than the search span, the newer ones appended (twice: the second time adds nothing)."""
    fx = Fixtures(spark, sf)
    since = _since(fx.as_of, C.SEARCH_SPAN_DAYS)
    rows = fx.vec().select(F.col("pid").alias("cid"), F.col("embedding").alias("vec"), "ts")
    store = CellStore(spark, scratch_path(spark, "cell-index"))
    store.build(rows.where(F.col("ts") < since), "l2", cells=fx.centroid())
    for _ in range(2):
        store.append(rows.where(F.col("ts") >= since))
    return store


def q_cell_index_lists(spark, sf):
    """V2/K4: the inverted lists after a build, an append and its replay."""
    return vector_store(spark, sf).lists().select(F.col("cid").alias("pid"), "cell", "ts", F.round("far", R).alias("far"))


def q_cell_index_search(spark, sf):
    """Topics against the stored index, vectors of the last 365 days in the 10 nearest cells."""
    fx = Fixtures(spark, sf)
    recent = F.col("ts") >= _since(fx.as_of, C.SEARCH_SPAN_DAYS)
    return _out(vector_store(spark, sf).search(topics(fx), C.SEARCH_TOPK, C.SEARCH_NPROBE, where=recent, small="queries"))


def q_knn_pruned(spark, sf):
    """Every vector's 10 nearest others by L2, exact, from an index with trained cells and their radii."""
    fx = Fixtures(spark, sf)
    store = CellStore(spark, scratch_path(spark, "cell-index"))
    store.build(corpus(fx), "l2")
    return _out(store.search_exact(corpus(fx).withColumnRenamed("cid", "qid"), C.SEARCH_TOPK, exclude_self=True))


def q_knn_lsh(spark, sf):
    """V3: approximate cosine neighbours by random-projection buckets."""
    fx = Fixtures(spark, sf)
    c = corpus(fx)
    return _out(K.knn_lsh(c.withColumnRenamed("cid", "qid"), c, C.SEARCH_TOPK, exclude_self=True))


def q_knn_graph(spark, sf):
    """V3: every vector's 10 nearest others by cosine, from the neighbour graph."""
    return _out(G.neighbours(G.build(corpus(Fixtures(spark, sf))), C.SEARCH_TOPK))


def q_knn_graph_topics(spark, sf):
    """Topics, which the graph doesn't hold as queries, by beam search."""
    fx = Fixtures(spark, sf)
    return _out(G.search(G.build(corpus(fx)), topics(fx), C.SEARCH_TOPK))


def q_knn_graph_recall(spark, sf):
    """V3: recall@10 of the graph, the beam search and the sign buckets against the exact search, and for the
    graph the pairs scored for each vector (the exact search scores as many as there are vectors)."""
    fx = Fixtures(spark, sf)
    c = corpus(fx)
    graph = G.build(c)
    own = c.withColumnRenamed("cid", "qid")
    exact = written(K.knn(own, c, C.SEARCH_TOPK, metric="cosine", exclude_self=True), "exact")     # the truth of two methods
    exact_topics = K.knn(topics(fx), c, C.SEARCH_TOPK, metric="cosine", small="queries")
    work = F.lit(round(graph.scored / max(1, graph.rows), 1))
    parts = [("graph", G.neighbours(graph, C.SEARCH_TOPK), exact, work),
             ("beam", G.search(graph, topics(fx), C.SEARCH_TOPK), exact_topics, F.lit(None).cast("double")),
             ("sign buckets", K.knn_lsh(own, c, C.SEARCH_TOPK, exclude_self=True), exact, F.lit(None).cast("double"))]
    out = None
    for name, hits, truth, pairs in parts:
        found = truth.select("qid", "cid").join(hits.select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
        row = found.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).select(
            F.lit(name).alias("method"), "wanted", F.round(F.col("found") / F.col("wanted"), 4).alias("recall"),
            pairs.alias("pairs_per_row"))
        out = row if out is None else out.unionByName(row)
    return out


def q_vec_normalise(spark, sf):
    e = Fixtures(spark, sf).table("embeddings")
    return e.select("vec_id", F.transform(V.normalize("embedding"), lambda x: F.round(x, R)).alias("vec"))


def q_vec_concat(spark, sf):
    """a paper's vector followed by the vector of its label's subject."""
    fx = Fixtures(spark, sf)
    e = fx.table("embeddings").select("vec_id", "label", "embedding")
    s = fx.subject().select(F.col("subject_id").alias("label"), F.col("embedding").alias("sv"))
    j = e.join(s, "label")
    return j.select("vec_id", F.transform(V.concat_vectors("embedding", "sv"),
                                          lambda x: F.round(x, R)).alias("vec"))


def q_vector_index(spark, sf):
    """Dense 0-based index -> id map of the vector table."""
    fx = Fixtures(spark, sf)
    ids = fx.table("embeddings").select(F.col("vec_id").alias("pid"))
    return INC.dense_index(ids, "pid").select("idx", "pid")


def incoming_records(fx: Fixtures) -> DataFrame:
    """Incoming paper records: every line item is a record of its order; the
    highest line number is the latest record (explicit sequence, D2)."""
    li = fx.table("lineitem")
    # line numbers repeat within an order: the other fields break ties
    order = F.struct("l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")
    return li.select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("seq"),
                     "l_quantity", "l_shipdate", "l_returnflag", order.alias("ord"))


def stored_vectors(fx: Fixtures) -> DataFrame:
    return fx.vec().select("pid", "embedding", "ts")


def q_vector_existing_ids(spark, sf):
    return existing_ids(stored_vectors(Fixtures(spark, sf)))


def q_paper_last_wins(spark, sf):
    return last_wins(incoming_records(Fixtures(spark, sf)), key="pid", seq="ord").drop("ord")


def q_incremental_new(spark, sf):
    """Incoming ids (last record wins) that the vector table lacks."""
    fx = Fixtures(spark, sf)
    new = INC.new_records(incoming_records(fx), existing_ids(stored_vectors(fx)), seq="ord")
    return new.select("pid", "seq", "l_quantity", "l_returnflag")


QUERIES = {
    "knn_cosine": q_knn_cosine,
    "knn_dot": q_knn_dot,
    "knn_topic": q_knn_topic,
    "knn_multi": q_knn_multi,
    "knn_recent": q_knn_recent,
    "knn_mapped": q_knn_mapped,
    "topic_search": q_topic_search,
    "knn_ivf": q_knn_ivf,
    "cell_index_lists": q_cell_index_lists,
    "cell_index_search": q_cell_index_search,
    "knn_pruned": q_knn_pruned,
    "knn_lsh": q_knn_lsh,
    "knn_graph": q_knn_graph,
    "knn_graph_topics": q_knn_graph_topics,
    "knn_graph_recall": q_knn_graph_recall,
    "vec_normalise": q_vec_normalise,
    "vec_concat": q_vec_concat,
    "vector_index": q_vector_index,
    "vector_existing_ids": q_vector_existing_ids,
    "paper_last_wins": q_paper_last_wins,
    "incremental_new": q_incremental_new,
}

# ---- oracle -----------------------------------------------------------------
from .oracle_views import VIEWS as _V, cossql, dsql, l2sql, nsql  # noqa: E402

_RECENT = "c.ts >= epoch(TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 365 DAY)"


def _knn_sql(score: str, order: str, q: str, where: str = "TRUE", k: int = 10) -> str:
    return f"""
        SELECT q, pid, ROUND(score, 9) AS score, rank FROM (
          SELECT q, pid, score, row_number() OVER (PARTITION BY q ORDER BY score {order}, pid) AS rank
          FROM (SELECT t.q, c.pid, {score} AS score FROM {q} t JOIN vec c ON {where}))
        WHERE rank <= {k}"""


def _nrm(x: str) -> str:
    return f"list_transform(CAST({x} AS DOUBLE[]), lambda v: v / {nsql(x)})"


_V.update({
    "vec": """
        SELECT e.vec_id AS pid, e.embedding, CAST(epoch(o.o_orderdate) AS BIGINT) AS ts, e.label
        FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id""",
    "topic": """
        SELECT CAST(e.label AS BIGINT) AS q, e.embedding
        FROM embeddings e JOIN (SELECT label, MAX(vec_id) AS m FROM embeddings GROUP BY label) r
          ON r.label = e.label AND r.m = e.vec_id""",
    "cell": """
        SELECT CAST(e.label AS BIGINT) AS c, e.embedding
        FROM embeddings e JOIN (SELECT label, MIN(vec_id) AS m FROM embeddings GROUP BY label) r
          ON r.label = e.label AND r.m = e.vec_id""",
    "probe_cell": """
        SELECT vec_id AS c, embedding FROM (
          SELECT vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)
        WHERE r <= 8""",
    "vq": "SELECT pid AS q, embedding FROM vec",
    "assign": f"""
        SELECT pid, c FROM (
          SELECT v.pid, cc.c, row_number() OVER (PARTITION BY v.pid ORDER BY {l2sql('v.embedding', 'cc.embedding')}, cc.c) AS r
          FROM vec v JOIN probe_cell cc ON TRUE) WHERE r = 1""",
    "probe": f"""
        SELECT q, c FROM (
          SELECT v.pid AS q, cc.c, row_number() OVER (PARTITION BY v.pid ORDER BY {l2sql('v.embedding', 'cc.embedding')}, cc.c) AS r
          FROM vec v JOIN probe_cell cc ON TRUE) WHERE r <= 10""",
})

ORACLE = {
    "knn_cosine": _knn_sql(cossql("t.embedding", "c.embedding"), "DESC", "topic"),
    "knn_dot": _knn_sql(dsql(_nrm("t.embedding"), _nrm("c.embedding")), "DESC", "topic"),
    "knn_topic": _knn_sql(l2sql("t.embedding", "c.embedding"), "ASC",
                          "(SELECT * FROM topic ORDER BY q DESC LIMIT 1)", _RECENT),
    "knn_multi": _knn_sql(l2sql("t.embedding", "c.embedding"), "ASC", "vq", "t.q <> c.pid"),
    "knn_recent": _knn_sql(l2sql("t.embedding", "c.embedding"), "ASC", "topic", _RECENT),
    "knn_mapped": f"""
        SELECT h.q, 'p' || CAST(h.pid AS VARCHAR) AS paper_id, h.score, h.rank FROM (
          {_knn_sql(l2sql("t.embedding", "c.embedding"), "ASC", "topic", _RECENT)}) h
        WHERE h.pid IN (SELECT doc_id FROM labels)""",
    "knn_ivf": f"""
        SELECT q, pid, ROUND(score, 9) AS score, rank FROM (
          SELECT q, pid, score, row_number() OVER (PARTITION BY q ORDER BY score, pid) AS rank
          FROM (SELECT p.q, a.pid, {l2sql('t.embedding', 'c.embedding')} AS score
                FROM probe p JOIN assign a ON a.c = p.c
                JOIN vec t ON t.pid = p.q JOIN vec c ON c.pid = a.pid))
        WHERE rank <= 10""",
    "cell_index_lists": f"""
        SELECT a.pid, a.c AS cell, v.ts, ROUND(sqrt({l2sql('v.embedding', 'cc.embedding')}), 9) AS far
        FROM assign a JOIN vec v ON v.pid = a.pid JOIN probe_cell cc ON cc.c = a.c""",
    "cell_index_search": f"""
        WITH pr AS (
          SELECT q, c, embedding FROM (
            SELECT t.q, cc.c, t.embedding,
                   row_number() OVER (PARTITION BY t.q ORDER BY {l2sql('t.embedding', 'cc.embedding')}, cc.c) AS r
            FROM topic t JOIN probe_cell cc ON TRUE) WHERE r <= 10)
        SELECT q, pid, ROUND(score, 9) AS score, rank FROM (
          SELECT q, pid, score, row_number() OVER (PARTITION BY q ORDER BY score, pid) AS rank
          FROM (SELECT t.q, a.pid, {l2sql('t.embedding', 'c.embedding')} AS score
                FROM pr t JOIN assign a ON a.c = t.c JOIN vec c ON c.pid = a.pid AND {_RECENT}))
        WHERE rank <= 10""",
    "vec_normalise": f"SELECT vec_id, list_transform({_nrm('embedding')}, lambda x: ROUND(x, 9)) AS vec FROM embeddings",
    "vec_concat": """
        SELECT e.vec_id, list_transform(list_concat(CAST(e.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])),
                                        lambda x: ROUND(x, 9)) AS vec
        FROM embeddings e JOIN cell s ON s.c = e.label""",
    "vector_index": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, vec_id AS pid FROM embeddings",
    "vector_existing_ids": "SELECT pid FROM vec WHERE pid > 0",
    "paper_last_wins": """
        SELECT l_orderkey AS pid, l_linenumber AS seq, l_quantity, l_shipdate, l_returnflag FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_quantity DESC, l_returnflag DESC) AS r FROM lineitem)
        WHERE r = 1""",
    "incremental_new": """
        SELECT l_orderkey AS pid, l_linenumber AS seq, l_quantity, l_returnflag FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_quantity DESC, l_returnflag DESC) AS r FROM lineitem)
        WHERE r = 1 AND l_orderkey NOT IN (SELECT pid FROM vec WHERE pid > 0)""",
}
ORACLE["knn_pruned"] = ORACLE["knn_multi"]
