"""Labelling of pool files as they arrive, upserted into the label store.

A file stream over the pool folders (``maxFilesPerTrigger`` files a batch;
10 for the cold start over all history) feeds ``foreachBatch``: each batch's
files are parsed by the kind their path names (S13), the papers are looked
up once each (S11), labelled by exact keyword match (J8) and upserted into
the label store (K3), which writes the batch's rows only. The upsert carries
the stream's and the batch's id, so a replayed batch changes nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import label as L
from ..sinks.label_store import upsert_into
from ..sources.pools import parse_pools


def run_label_stream(spark: SparkSession, dirs: list[str], papers: DataFrame, vocab: DataFrame,
                     store: str, checkpoint: str, run_ts: Column, buckets: int = 16,
                     max_files: int = 10) -> None:
    """Label every new pool file under ``dirs`` into ``store``.

    ``papers(paper_id string, keywords)``; ``vocab(word)``.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = batch.select("value", F.col("_metadata.file_path").alias("file_path"))
        ids = parse_pools(lines, dirs).select("paper_id")
        labels = L.match_keywords(L.lookup(ids, papers, ["keywords"]), vocab)
        upsert_into(store, labels, run_ts, buckets, batch=f"{stream}-{batch_id}")

    # the same for every run with this checkpoint
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    streams = [spark.readStream.format("text").option("recursiveFileLookup", "true")
               .option("maxFilesPerTrigger", max_files).load(d)
               .select("value", "_metadata") for d in dirs]
    src = streams[0]
    for s in streams[1:]:
        src = src.unionByName(s)
    q = (src.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
