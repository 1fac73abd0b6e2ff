"""Incremental embedding of a growing paper folder with Structured Streaming.

``readStream`` over JSON-lines paper files (declared schema) ->
``trigger(availableNow=True)`` -> ``foreachBatch``:

0. torn and malformed lines go to the quarantine table (S2), a folder per
   batch, so a replayed batch writes them to the same place,
1. rows holding both ids (P1), last record per numeric id wins (A5),
2. ids already in the vector table are dropped (left anti join, J7),
3. the text (title + abstract, F3) is encoded (plug-in embedder),
4. rows are appended to the vector table (K4).

Step 2 reads the table as it is when the batch runs, so a replayed batch
(after a failure between the append and the offset commit) appends nothing.
When no new file arrived, no batch runs and nothing is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import paper_text, text_to_epoch
from ..operators.embed import Embedder, HashingEmbedder
from ..operators.incremental import append_vectors
from ..session import read_or_none
from ..sources.papers import PAPER_SCHEMA, keep_identified, last_wins, split_corrupt

QUARANTINE_SCHEMA = "file string, _corrupt_record string, stream string, batch long"


def embed_new(batch: DataFrame, table: str, embedder: Embedder, model: str) -> DataFrame:
    spark = batch.sparkSession
    papers = keep_identified(batch).withColumn(
        "seq", F.struct(F.col("_metadata_t"), F.col("_metadata_f"), F.monotonically_increasing_id()))
    latest = last_wins(papers.drop("_metadata_t", "_metadata_f"), key="id_of_mysql", seq="seq")
    stored = read_or_none(spark, table)
    new = latest
    if stored is not None:
        ids = stored.where(F.col("model") == model).select(F.col("pid").alias("id_of_mysql"))
        new = latest.join(ids, "id_of_mysql", "left_anti")
    texts = new.select(F.col("id_of_mysql").alias("pid"),
                       paper_text("title", "abstract").alias("text"),
                       text_to_epoch("ts").alias("ts"))
    vecs = embedder.transform(texts.select("pid", "text"), "pid", "text")
    return vecs.join(texts.select("pid", "ts"), "pid").select(
        "pid", F.col("vec").alias("embedding"), "ts")


def run_incremental(spark: SparkSession, source: str, table: str, checkpoint: str,
                    embedder: Embedder | None = None, model: str = "hashing",
                    max_files: int | None = None, quarantine: str | None = None) -> int:
    """Process every file not seen yet; returns the number of rows appended.

    Bad lines are kept under ``quarantine`` (by default beside the checkpoint).
    """
    quarantine = quarantine or f"{checkpoint.rstrip('/')}-quarantine"
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]      # the same for every run with this checkpoint
    embedder = embedder or HashingEmbedder()
    appended = [0]

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_corrupt(batch.withColumn("file", F.col("_metadata_f")))
        bad.write.mode("overwrite").parquet(f"{quarantine}/stream={name}/batch={batch_id}")
        out = embed_new(good.drop("file"), table, embedder, model).persist()
        n = out.count()
        if n:
            append_vectors(out, table, model)
        out.unpersist()
        appended[0] += n

    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    stream = (reader.text(source).where(F.trim("value") != "")
              .select(F.from_json("value", PAPER_SCHEMA, options).alias("r"),
                      F.col("_metadata.file_modification_time").alias("_metadata_t"),
                      F.col("_metadata.file_path").alias("_metadata_f"))
              .select("r.*", "_metadata_t", "_metadata_f"))
    q = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return appended[0]


def read_quarantine(spark: SparkSession, quarantine: str) -> DataFrame:
    """All bad lines met by the streams: file, _corrupt_record, stream, batch."""
    rows = read_or_none(spark, quarantine, QUARANTINE_SCHEMA)
    return spark.createDataFrame([], QUARANTINE_SCHEMA) if rows is None else rows
