"""Vocabulary and subject-index sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCAB_SCHEMA = "words array<struct<name: string>>"


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """S9 + P10: words of ``{"words": [{"name": ...}, ...]}`` documents.

    Each file holds one document (``multiLine``); entries without a name or
    with an empty name are skipped; an unreadable path gives an empty set.
    """
    try:
        docs = spark.read.schema(VOCAB_SCHEMA).option("multiLine", "true").json(path)
    except AnalysisException:
        return spark.createDataFrame([], "word string")
    return (docs.select(F.explode("words").alias("w"))
            .select(F.col("w.name").alias("word"))
            .where(F.col("word").isNotNull() & (F.length("word") > 0))
            .distinct())


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Vocabulary as ``{"words": [...]}`` documents, one per initial letter (one file each)."""
    grouped = (vocab.withColumn("initial", F.substring("word", 1, 1))
               .groupBy("initial")
               .agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("word").alias("name")))
                                       .alias("words"))).alias("value")))
    grouped.repartition("initial").write.mode("overwrite").partitionBy("initial").text(path)


def read_subject_index(spark: SparkSession, path: str) -> DataFrame:
    """``{"<number>": "<subject>"}`` objects -> ``(subject_id bigint, word)``."""
    t = spark.read.format("text").load(path)
    return (t.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "word"))
            .select(F.col("k").cast("bigint").alias("subject_id"), "word"))


def write_subject_index(subjects: DataFrame, path: str) -> None:
    line = F.to_json(F.create_map(F.col("subject_id").cast("string"), F.col("word")))
    subjects.select(line.alias("value")).write.mode("overwrite").text(path)
