"""Paper labelling: exact keyword match (J8, P9), nearest subjects (J9, J12), upsert (K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as C
from ..functions.text import format_keyword
from . import knn as K
from .embed import Embedder, HashingEmbedder
from .incremental import dense_index


def lookup(ids: DataFrame, papers: DataFrame, columns: list[str]) -> DataFrame:
    """Papers of the given ids, each once, only the asked columns.

    A semi join replaces batched id lookups; unknown ids drop out.
    """
    want = ids.select(F.col("paper_id").cast("string").alias("k")).distinct()
    p = papers.select(F.col("paper_id").cast("string").alias("k"), *columns)
    return p.join(want, "k", "left_semi").withColumnRenamed("k", "paper_id")


def match_keywords(papers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Keywords (formatted, F2) found in the vocabulary; input order and repeats kept.

    ``papers(paper_id, keywords)``, ``vocab(word)`` -> ``(pub_id, labels)``; a
    paper without keywords or matches gets ``[]`` (P9).
    """
    words = vocab.select(F.col("word")).where(F.length("word") > 0).distinct()
    kw = (papers.select("paper_id", F.posexplode_outer("keywords").alias("pos", "raw"))
          .where(F.col("raw").isNotNull())
          .select("paper_id", "pos", format_keyword("raw").alias("word")))
    hit = kw.join(words, "word", "left_semi")
    agg = (hit.groupBy("paper_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))),
                            lambda x: x["word"]).alias("labels")))
    return (papers.select("paper_id").distinct().join(agg, "paper_id", "left")
            .select(F.col("paper_id").alias("pub_id"),
                    F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))


def nearest_subjects(papers: DataFrame, subjects: DataFrame, k: int = C.LABEL_TOPK) -> DataFrame:
    """J9 + J12: the ``k`` nearest subjects of each paper by L2, nearest first.

    The subjects are declared small: they are shipped, papers stay where they lie.
    ``papers(pub_id, vec)``, ``subjects(subject_id, word, embedding)`` ->
    ``(pub_id, labels)``.
    """
    q = papers.select(F.col("pub_id").alias("qid"), "vec")
    c = subjects.select(F.col("subject_id").alias("cid"), F.col("embedding").alias("vec"))
    hits = K.knn(q, c, k, metric="l2", small="corpus")
    named = hits.join(subjects.select(F.col("subject_id").alias("cid"), "word"), "cid")
    return (named.groupBy(F.col("qid").alias("pub_id"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                             lambda x: x["word"]).alias("labels")))


def titled(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers with a title, those without)."""
    has = F.coalesce(F.length(F.trim("title")) > 0, F.lit(False))
    return papers.where(has), papers.where(~has)


def label_by(way: str, papers: DataFrame, words: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Labels of ``papers`` from the vocabulary ``words(word)``, by the given way.

    ``strong``: keywords that are vocabulary words (``papers(paper_id, keywords)``).
    ``nearest``: the words whose vectors lie nearest to the title's
    (``papers(paper_id, title)``); untitled papers get no row.
    """
    if way == "strong":
        return match_keywords(papers, words)
    if way != "nearest":
        raise ValueError(f"unknown way of labelling: {way}")
    embedder = embedder or HashingEmbedder()
    named = words.select("word").where(F.length("word") > 0).distinct()
    subjects = dense_index(named, "word").select(F.col("idx").alias("subject_id"), "word")
    vectors = embedder.transform(subjects, "subject_id", "word").withColumnRenamed("vec", "embedding")
    have, _ = titled(papers)
    numbered = dense_index(have.select("paper_id", "title").distinct(), "paper_id")
    vecs = embedder.transform(numbered.select("idx", "title"), "idx", "title")
    found = nearest_subjects(vecs.select(F.col("idx").alias("pub_id"), "vec"), subjects.join(vectors, "subject_id"))
    return (found.withColumnRenamed("pub_id", "idx").join(numbered.select("idx", "paper_id"), "idx")
                 .select(F.col("paper_id").alias("pub_id"), "labels"))


def upsert(old: DataFrame, new: DataFrame, run_ts: Column) -> DataFrame:
    """K3: set labels and modify_time; create_time only on insert.

    ``old(pub_id, labels, create_time, modify_time)``, ``new(pub_id, labels)``.
    Repeated ids in ``new`` carry the same labels, so one row per id is kept.
    """
    n = new.select("pub_id", F.col("labels").alias("nl")).dropDuplicates(["pub_id"])
    o = old.select("pub_id", F.col("labels").alias("ol"), "create_time", "modify_time")
    j = o.join(n, "pub_id", "full_outer")
    has_new = F.col("nl").isNotNull()
    return j.select(
        "pub_id",
        F.when(has_new, F.col("nl")).otherwise(F.col("ol")).alias("labels"),
        F.coalesce(F.col("create_time"), run_ts).alias("create_time"),
        F.when(has_new, run_ts).otherwise(F.col("modify_time")).alias("modify_time"))
