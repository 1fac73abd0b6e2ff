"""Paper-record sources.

Paper records are JSON lines with a declared schema (never inferred).
A malformed or torn line does not end the read: with ``PERMISSIVE`` parsing
it lands in ``_corrupt_record`` and is split off to a quarantine frame (D1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

PAPER_SCHEMA = ("`_id` string, id_of_mysql bigint, ts string, title string, abstract string, "
                "keywords array<string>, venue string, authors array<string>, "
                "affiliations array<string>, tags array<string>, _corrupt_record string")


def read_papers_raw(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the paper files; bad lines keep only ``_corrupt_record``.

    ``seq`` orders records by (file modification time, file, split offset,
    line order within the split): the last-wins order of D2, never a tie.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    # parsed as an expression: the corrupt column needs no cached scan
    df = lines.withColumn("r", F.from_json("value", PAPER_SCHEMA, options))
    return (df.select("r.*", F.col("_metadata.file_path").alias("file"), "_metadata")
            .withColumn("seq", F.struct(F.col("_metadata.file_modification_time").alias("t"),
                                        F.col("_metadata.file_path").alias("f"),
                                        F.col("_metadata.file_block_start").alias("b"),
                                        F.monotonically_increasing_id().alias("i")))
              .drop("_metadata"))


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined bad lines)."""
    bad = raw.where(F.col("_corrupt_record").isNotNull()).select("file", "_corrupt_record")
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good, bad


def keep_identified(papers: DataFrame) -> DataFrame:
    """Rows holding both ids (the text id and the numeric id)."""
    return papers.where(F.col("_id").isNotNull() & (F.col("_id") != "")
                        & F.col("id_of_mysql").isNotNull())


def last_wins(papers: DataFrame, key: str = "id_of_mysql", seq: str = "seq") -> DataFrame:
    """A5: one record per ``key``, the one with the largest ``seq``."""
    cols = [c for c in papers.columns if c != key]
    latest = papers.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r"))
    return latest.select(key, "r.*")


def first_n(papers: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` kept rows (``n = -1``: all) in a stable order."""
    if n is None or n < 0:
        return papers
    return papers.orderBy(*(order or ("seq",))).limit(n)


def existing_ids(vectors: DataFrame) -> DataFrame:
    """Ids already stored (``pid > 0``), one column."""
    return vectors.where(F.col("pid") > 0).select("pid")
