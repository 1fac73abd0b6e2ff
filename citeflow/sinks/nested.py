"""Nested recall output (A4, W9, P8) and its JSON-lines sink (K1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import shuffles_removed

PAPER_FIELDS = ("paper_id", "distance", "label", "new", "n_citation", "author_id",
                "author_name_en", "author_name_zh", "pv", "zone")


def nest_recall(flat: DataFrame) -> DataFrame:
    """user -> followed scholars -> two pools -> ordered papers.

    List order: followed, cooperation, similar (W9), then rank. An empty pool
    leaves its field null (omitted in JSON); users without rows never appear.
    The rows are dealt by user once; both grouping levels work on a user's rows where they are.
    """
    lab = F.create_map(*[x for k, v in C.LABEL_ORDER.items() for x in (F.lit(k), F.lit(v))])
    paper = F.struct(*[F.col(c) for c in PAPER_FIELDS])

    def papers(pool: str):
        own = F.collect_list(F.when(F.col("pool") == pool, F.col("o")))
        return F.when(F.size(own) > 0, F.transform(F.array_sort(own), lambda x: x["p"]))

    per_author = (flat.repartition("user_id")
                  .withColumn("o", F.struct(lab[F.col("label")].alias("lo"),
                                            F.col("rank").alias("rk"), paper.alias("p")))
                  .groupBy("user_id", "followed_id", "name_of_followed_author",
                           "chinese_name_of_followed_author")
                  .agg(papers(C.POOL_HIGH).alias("highly_cited_papers"),
                       papers(C.POOL_LATEST).alias("latest_papers")))
    followed = F.struct(
        F.col("followed_id").alias("id_of_followed_author"),
        "name_of_followed_author", "chinese_name_of_followed_author",
        F.struct("highly_cited_papers", "latest_papers").alias("papers"))
    return (per_author
            .groupBy("user_id")
            .agg(F.array_sort(F.collect_list(followed)).alias("followed")))


def write_recall_json(nested: DataFrame, path: str, slices: int = 1) -> None:
    """One JSON object per user ``{user_id: [...]}``, in gzip files; non-ASCII kept as is.

    The users are written in ``slices``, and the shuffle files of one go before the next.
    """
    line = F.to_json(F.create_map(F.col("user_id").cast("string"), F.col("followed")))
    with shuffles_removed(nested.sparkSession):
        for i in range(slices):
            some = nested if slices == 1 else nested.where(F.pmod(F.xxhash64("user_id"), F.lit(slices)) == i)
            (some.select(line.alias("value")).write.mode("append" if i else "overwrite")
                 .option("compression", "gzip").text(path))
