"""Follow recall: scholar lists, collaborator and similar-scholar expansion.

Data model (all DataFrames):

* ``authorship(paper_id, author_id)``
* ``paper(paper_id, ts, n_citation)``
* a pool: ``(paper_id)``
* edges: ``(f, t)``: scholar ``f`` expands to scholar ``t``

Plan shape. A recall list depends only on the *followed scholar*, so lists are
computed once per scholar and joined to users last. Every list is cut to
``n`` by ``(score desc, paper_id, author_id)``. Because a candidate in the
cut list of ``f`` must also be in the cut list of the scholar it came from,
the collaborator and similar lists are built from the per-scholar cut lists
(at most ``10 x n`` rows per ``f``), never from all papers of all
collaborators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as C
from ..functions.score import distance_from_score, score_int
from ..session import cut_lineage, written


def rank_order():
    return (F.col("score").desc(), F.col("paper_id").asc(), F.col("author_id").asc())


def scholar_papers(authorship: DataFrame, pool: DataFrame) -> DataFrame:
    """Each scholar's distinct papers in the pool -> (author_id, paper_id)."""
    return authorship.join(pool.select("paper_id"), "paper_id", "left_semi") \
                     .select("author_id", "paper_id").distinct()


def scored(pairs: DataFrame, paper: DataFrame) -> DataFrame:
    """Attach the integer score and citations -> (author_id, paper_id, score, n_citation)."""
    p = paper.select("paper_id", score_int("ts", "n_citation").alias("score"), "n_citation")
    return pairs.join(p, "paper_id").select("author_id", "paper_id", "score", "n_citation")


def top_per_scholar(cands: DataFrame, n: int) -> DataFrame:
    """Cut each scholar's candidates to ``n`` -> adds ``rank``.

    ``row_number() <= n`` is planned as a WindowGroupLimit, so a partial
    top-n runs before the shuffle on ``author_id``.
    """
    w = Window.partitionBy("author_id").orderBy(*rank_order())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def expand(edges: DataFrame, per_scholar: DataFrame, n: int) -> DataFrame:
    """List of ``f`` built from the cut lists of its expanded scholars.

    Repeats of a paper through two scholars stay (distinct on the whole
    candidate, A3); the cut is taken once over all expanded scholars.
    """
    e = edges.select("f", F.col("t").alias("author_id")).distinct()
    c = per_scholar.select("author_id", "paper_id", "score", "n_citation")
    joined = e.join(c, "author_id")
    w = Window.partitionBy("f").orderBy(*rank_order())
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def edge_sets(coauthors: DataFrame | None, similar: DataFrame | None,
              focus: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
    """The expansions of the focus scholars by label.

    At most 10 rows per scholar, used by every pool and by ``needed``: written
    once to the shared folder, nothing stays in memory.
    """
    out = [(lab, e.select("f", "t")) for lab, e in ((C.LABEL_COOPERATION, coauthors), (C.LABEL_SIMILAR, similar))
           if e is not None]
    if focus is not None:
        f = focus.select(F.col("author_id").alias("f")).distinct()
        out = [(lab, e.join(f, "f", "left_semi")) for lab, e in out]
    return [(lab, cut_lineage(e)) for lab, e in out]


def needed(focus: DataFrame, edges: list[tuple[str, DataFrame]]) -> DataFrame:
    """Scholars whose own cut list is needed: the focus and its expansions."""
    out = focus.select("author_id")
    for _, e in edges:
        out = out.unionByName(e.select(F.col("t").alias("author_id")))
    return cut_lineage(out.distinct())


def recall_lists(authorship: DataFrame, paper: DataFrame, pools: dict[str, DataFrame],
                 focus: DataFrame | None = None,
                 edges: list[tuple[str, DataFrame]] = (),
                 sizes: dict[str, int] | None = None) -> DataFrame:
    """All recall lists of the focus scholars (all scholars when ``focus`` is None).

    With a focus, ``authorship`` need only hold the ``needed`` scholars and
    ``paper`` and the pools their papers.
    Returns ``(followed_id, pool, label, rank, paper_id, score, n_citation, author_id)``
    where ``author_id`` is the scholar the paper came from.
    """
    sizes = sizes or {C.POOL_HIGH: C.RECALL_HIGH, C.POOL_LATEST: C.RECALL_LATEST}
    if focus is not None:
        focus = focus.select(F.col("author_id").alias("f")).distinct()
    out = []
    for pool_name, pool in pools.items():
        n = sizes[pool_name]
        # at most n rows per scholar, read by every label: cut once
        per_scholar = written(top_per_scholar(scored(scholar_papers(authorship, pool), paper), n), "cut-lists")
        own = per_scholar
        if focus is not None:
            own = own.join(focus.select(F.col("f").alias("author_id")), "author_id", "left_semi")
        out.append(own.select(F.col("author_id").alias("followed_id"),
                              F.lit(pool_name).alias("pool"),
                              F.lit(C.LABEL_FOLLOWED).alias("label"),
                              "rank", "paper_id", "score", "n_citation", "author_id"))
        for label, e in edges:
            lst = expand(e, per_scholar, n)
            out.append(lst.select(F.col("f").alias("followed_id"),
                                  F.lit(pool_name).alias("pool"),
                                  F.lit(label).alias("label"),
                                  "rank", "paper_id", "score", "n_citation", "author_id"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def enrich(lists: DataFrame, author: DataFrame, newest: DataFrame,
           pv: DataFrame, zone: DataFrame) -> DataFrame:
    """The ten output fields of a recalled paper.

    Names default to "", views to 0, zone to []; ``new`` marks papers of the
    newest pool. Dimension joins are left joins; AQE turns them into
    broadcast joins at run time when the dimension is small.
    """
    names = author.select("author_id",
                          F.coalesce("name_en", F.lit("")).alias("author_name_en"),
                          F.coalesce("name_zh", F.lit("")).alias("author_name_zh"))
    new = newest.select("paper_id").distinct().withColumn("is_new", F.lit(True))
    return (lists
            .join(names, "author_id", "left")
            .join(new, "paper_id", "left")
            .join(pv.select("paper_id", "pv"), "paper_id", "left")
            .join(zone.select("paper_id", "zone"), "paper_id", "left")
            .select("followed_id", "pool", "label", "rank", "paper_id",
                    F.round(distance_from_score(F.col("score")), 9).alias("distance"),
                    F.coalesce("is_new", F.lit(False)).alias("new"),
                    "n_citation", "author_id",
                    F.coalesce("author_name_en", F.lit("")).alias("author_name_en"),
                    F.coalesce("author_name_zh", F.lit("")).alias("author_name_zh"),
                    F.coalesce(F.col("pv"), F.lit(0).cast("bigint")).alias("pv"),
                    F.coalesce(F.col("zone"), F.array().cast("array<string>")).alias("zone")))


def followed_names(follow: DataFrame, author: DataFrame) -> DataFrame:
    """Followed scholars with an English or Chinese name, each falling back to the other."""
    a = author.where(F.col("name_en").isNotNull() | F.col("name_zh").isNotNull())
    return follow.join(a, "author_id").select(
        "user_id", F.col("author_id").alias("followed_id"),
        F.coalesce("name_en", "name_zh").alias("name_of_followed_author"),
        F.coalesce("name_zh", "name_en").alias("chinese_name_of_followed_author"))
