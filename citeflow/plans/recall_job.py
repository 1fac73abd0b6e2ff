"""Follow-recall job (B1-B3) and its parts as named queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..fixtures import Fixtures
from ..functions.score import distance_from_score, score_int
from ..operators import graph, recall
from ..session import cut_lineage, finished, written
from ..sinks.nested import nest_recall


def _pools(fx: Fixtures, paper: DataFrame) -> dict[str, DataFrame]:
    return {C.POOL_HIGH: fx.pool_high(paper=paper), C.POOL_LATEST: fx.pool_latest(paper=paper)}


def scholar_vectors(fx: Fixtures) -> DataFrame:
    """Scholar vectors: the embedding rows whose id is a scholar id."""
    e = fx.table("embeddings").select(F.col("vec_id").alias("author_id"),
                                      F.col("embedding").alias("vec"))
    return e.join(fx.author().select("author_id"), "author_id", "left_semi")


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("followed_id", "pool", "label", F.col("rank").cast("bigint").alias("rank"),
                        "paper_id",
                        F.round(distance_from_score(F.col("score")), 9).alias("distance"),
                        "n_citation", "author_id")


def lists_for(fx: Fixtures, focus: DataFrame | None, labels=("followed", "cooperation", "similar")) -> DataFrame:
    """Recall lists; with a focus only the papers of the scholars involved are aggregated."""
    return _lists_and_papers(fx, focus, labels)[0]


def _lists_and_papers(fx: Fixtures, focus: DataFrame | None, labels=("followed", "cooperation", "similar")) -> tuple[DataFrame, DataFrame]:
    """(recall lists, the papers they were made from).

    Authorship and the paper aggregate are written once per job: the edges, both pools and the scores read them.
    """
    authorship = written(fx.authorship(), "authorship")
    co = graph.coauthor_edges(authorship, focus=focus, once=True) if "cooperation" in labels else None
    sim = graph.similar_edges(scholar_vectors(fx), focus=focus) if "similar" in labels else None
    edges = recall.edge_sets(co, sim, focus)
    ids = None
    if focus is not None:
        authorship = written(authorship.join(recall.needed(focus, edges), "author_id", "left_semi"), "authorship")
        ids = authorship.select("paper_id").distinct()
    paper = written(fx.paper(ids), "papers")
    lists = recall.recall_lists(authorship, paper, _pools(fx, paper), focus, edges)
    if "followed" not in labels:
        lists = lists.where(F.col("label") != C.LABEL_FOLLOWED)
    return lists, paper


# ---- named queries (spark, sf_dir) -> DataFrame -----------------------------

def q_distance_score(spark: SparkSession, sf: str) -> DataFrame:
    p = Fixtures(spark, sf).paper()
    s = score_int("ts", "n_citation")
    return p.select("paper_id", s.alias("score"),
                    F.round(distance_from_score(s), 9).alias("distance"))


def q_active_users(spark, sf):
    return Fixtures(spark, sf).active()


def q_follow_of_active(spark, sf):
    fx = Fixtures(spark, sf)
    return fx.follow().join(fx.active(), "user_id", "left_semi")


def q_scholar_papers(spark, sf):
    fx = Fixtures(spark, sf)
    return recall.scholar_papers(fx.authorship(), fx.pool_high())


def q_scholar_papers_scored(spark, sf):
    fx = Fixtures(spark, sf)
    s = recall.scored(recall.scholar_papers(fx.authorship(), fx.pool_latest()), fx.paper())
    return s.select("author_id", "paper_id", "score", "n_citation")


def _author_index(fx: Fixtures, pool: DataFrame) -> DataFrame:
    """Author -> set of pool papers, kept as an edge table.

    One row per (author, paper) with the author's paper count; a prolific
    author's set is never gathered into a single array (or task).
    """
    pairs = recall.scholar_papers(fx.authorship(), pool)
    n = pairs.groupBy("author_id").agg(F.count(F.lit(1)).alias("n_papers"))
    return pairs.join(n, "author_id")


def q_author_index_high(spark, sf):
    fx = Fixtures(spark, sf)
    return _author_index(fx, fx.pool_high())


def q_author_index_latest(spark, sf):
    fx = Fixtures(spark, sf)
    return _author_index(fx, fx.pool_latest())


def q_coauthor_edges(spark, sf):
    return graph.coauthor_edges(Fixtures(spark, sf).authorship(), once=True)


def q_similar_edges(spark, sf):
    e = graph.similar_edges(scholar_vectors(Fixtures(spark, sf)))
    return e.select("f", "t", F.round("sim", 9).alias("sim"), "rk")


def q_recall_followed(spark, sf):
    return _flat(lists_for(Fixtures(spark, sf), None, labels=("followed",)))


def q_recall_coauthor(spark, sf):
    return _flat(lists_for(Fixtures(spark, sf), None, labels=("cooperation",)))


def q_recall_similar(spark, sf):
    return _flat(lists_for(Fixtures(spark, sf), None, labels=("similar",)))


def q_recall_all(spark, sf):
    """U4: the three label lists of every scholar, both pools."""
    return _flat(lists_for(Fixtures(spark, sf), None))


def _enriched(fx: Fixtures, focus: DataFrame | None) -> DataFrame:
    """The lists with their dimensions, which are aggregated for the recalled papers only."""
    lists, paper = _lists_and_papers(fx, focus)
    lists = written(lists, "lists")
    ids = written(lists.select("paper_id").distinct(), "recalled")
    out = recall.enrich(lists, fx.author(), fx.pool_newest(paper=paper), fx.paper_pv(ids), fx.paper_zone(ids))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def q_recall_enrich(spark, sf):
    return _enriched(Fixtures(spark, sf), None)


def q_recall_new_flag(spark, sf):
    e = _enriched(Fixtures(spark, sf), None)
    return e.select("followed_id", "pool", "label", "rank", "paper_id", "new")


def q_followed_names(spark, sf):
    fx = Fixtures(spark, sf)
    return recall.followed_names(fx.follow(), fx.author())


def recall_user_flat(fx: Fixtures, users: DataFrame | None = None) -> DataFrame:
    """B1 flat: active user -> followed scholar (named) -> enriched lists."""
    users = fx.active() if users is None else users
    # the followed scholars of the users, read by several branches of the plan
    follows = cut_lineage(recall.followed_names(fx.follow().join(users, "user_id", "left_semi"), fx.author()))
    focus = follows.select(F.col("followed_id").alias("author_id")).distinct()
    rows = finished(fx.spark, lambda: _enriched(fx, focus), "enriched")
    # a given number of partitions, which Spark doesn't merge: small sides, but a list for every follow
    n = int(fx.spark.conf.get("spark.sql.shuffle.partitions"))
    return follows.repartition(n, "followed_id").join(rows.repartition(n, "followed_id"), "followed_id")


def q_recall_user(spark, sf):
    return recall_user_flat(Fixtures(spark, sf))


def q_recall_one_user(spark, sf):
    """B2: the same job for one user: the active user with the most follows."""
    fx = Fixtures(spark, sf)
    act = fx.follow().join(fx.active(), "user_id", "left_semi")
    one = (act.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), F.col("user_id").asc()).limit(1).select("user_id"))
    return recall_user_flat(fx, one)


def q_recall_nested(spark, sf):
    """A4: one nested row per active user with at least one recalled paper."""
    return nest_recall(recall_user_flat(Fixtures(spark, sf)))


QUERIES = {
    "distance_score": q_distance_score,
    "active_users": q_active_users,
    "follow_of_active": q_follow_of_active,
    "scholar_papers": q_scholar_papers,
    "scholar_papers_scored": q_scholar_papers_scored,
    "author_index_high": q_author_index_high,
    "author_index_latest": q_author_index_latest,
    "coauthor_edges": q_coauthor_edges,
    "similar_edges": q_similar_edges,
    "recall_followed": q_recall_followed,
    "recall_coauthor": q_recall_coauthor,
    "recall_similar": q_recall_similar,
    "recall_all": q_recall_all,
    "recall_enrich": q_recall_enrich,
    "recall_new_flag": q_recall_new_flag,
    "followed_names": q_followed_names,
    "recall_user": q_recall_user,
    "recall_one_user": q_recall_one_user,
    "recall_nested": q_recall_nested,
}

_FLAT = "followed_id, pool, label, rank, paper_id, {d} AS distance, n_citation, author_id"
_D = "ROUND(EXP(CAST(score AS DOUBLE) / 10000.0 - 1.0), 9)"

_USER_FLAT = """
    SELECT u.user_id, u.followed_id, u.name_of_followed_author, u.chinese_name_of_followed_author,
           e.pool, e.label, e.rank, e.paper_id, e.distance, e.new, e.n_citation, e.author_id,
           e.author_name_en, e.author_name_zh, e.pv, e.zone
    FROM followed_named u JOIN enriched e ON e.followed_id = u.followed_id
    WHERE u.user_id IN ({users})"""

ORACLE = {
    "distance_score": f"""SELECT paper_id, {{s}} AS score, ROUND(EXP(CAST({{s}} AS DOUBLE) / 10000.0 - 1.0), 9) AS distance FROM paper""",
    "active_users": "SELECT user_id FROM active",
    "follow_of_active": "SELECT user_id, author_id FROM follow WHERE user_id IN (SELECT user_id FROM active)",
    "scholar_papers": "SELECT DISTINCT author_id, paper_id FROM authorship WHERE paper_id IN (SELECT paper_id FROM pool_high)",
    "scholar_papers_scored": "SELECT author_id, paper_id, score, n_citation FROM cand WHERE pool = 'latest'",
    "author_index_high": """
        SELECT author_id, paper_id, COUNT(*) OVER (PARTITION BY author_id) AS n_papers
        FROM authorship WHERE paper_id IN (SELECT paper_id FROM pool_high)""",
    "author_index_latest": """
        SELECT author_id, paper_id, COUNT(*) OVER (PARTITION BY author_id) AS n_papers
        FROM authorship WHERE paper_id IN (SELECT paper_id FROM pool_latest)""",
    "coauthor_edges": "SELECT f, t, w, rk FROM coauthor",
    "similar_edges": "SELECT f, t, ROUND(sim, 9) AS sim, rk FROM sim_edges",
    "recall_followed": f"SELECT {_FLAT.format(d=_D)} FROM lists_followed",
    "recall_coauthor": f"SELECT {_FLAT.format(d=_D)} FROM lists_coauthor",
    "recall_similar": f"SELECT {_FLAT.format(d=_D)} FROM lists_similar",
    "recall_all": f"SELECT {_FLAT.format(d=_D)} FROM lists_all",
    "recall_enrich": "SELECT * FROM enriched",
    "recall_new_flag": "SELECT followed_id, pool, label, rank, paper_id, new FROM enriched",
    "followed_names": "SELECT * FROM followed_named",
    "recall_user": _USER_FLAT.format(users="SELECT user_id FROM active"),
    "recall_one_user": _USER_FLAT.format(users="""
        SELECT user_id FROM (SELECT user_id, COUNT(*) AS n FROM follow
                             WHERE user_id IN (SELECT user_id FROM active)
                             GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1)"""),
}
ORACLE["distance_score"] = ORACLE["distance_score"].replace(
    "{s}", "(GREATEST(0, COALESCE(CAST(FLOOR(date_diff('day', DATE '2000-01-01', ts) / 12.0) AS BIGINT), 0)) + LEAST(COALESCE(n_citation, 0), 8000))")
