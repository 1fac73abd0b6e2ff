"""Scholar graph: collaborator edges (J15) and similar-scholar edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as C
from . import knn as K
from . import pairs as P


def coauthor_edges(authorship: DataFrame, top: int = C.COAUTHOR_TOP,
                   focus: DataFrame | None = None, hot: int = P.DEFAULT_HOT, once: bool = False) -> DataFrame:
    """Top collaborators per scholar -> (f, t, w, rk).

    ``w`` is the number of shared papers; the cut keeps ``top`` per ``f`` by
    ``w desc, t``. With ``focus`` only those scholars' edges are built.
    Papers with more than ``hot`` authors never emit all their pairs (see
    :mod:`citeflow.operators.pairs`). ``once``: no row of ``authorship`` is repeated.
    """
    m = authorship.select(F.col("paper_id").alias("g"), F.col("author_id").alias("m"))
    fm = focus.select(F.col("author_id").alias("m")) if focus is not None else None
    top_pairs = P.pair_topk(m, top, group_weight="one", hot=hot, focus=fm, once=once)
    return top_pairs.select(F.col("a").alias("f"), F.col("b").alias("t"),
                            F.col("W").cast("bigint").alias("w"), "rk")


def similar_edges(scholar_vec: DataFrame, top: int = C.SIMILAR_TOP,
                  focus: DataFrame | None = None) -> DataFrame:
    """Top similar scholars by cosine of their vectors -> (f, t, sim, rk).

    ``scholar_vec(author_id, vec)``. Exact k-NN in blocks of fixed size, the
    scholar itself excluded.
    """
    corpus = scholar_vec.select(F.col("author_id").alias("cid"), "vec")
    q = scholar_vec
    if focus is not None:
        q = q.join(focus.select("author_id").distinct(), "author_id", "left_semi")
    queries = q.select(F.col("author_id").alias("qid"), "vec")
    hits = K.knn(queries, corpus, top, metric="cosine", exclude_self=True)
    return hits.select(F.col("qid").alias("f"), F.col("cid").alias("t"),
                       F.col("score").alias("sim"), F.col("rank").cast("bigint").alias("rk"))
