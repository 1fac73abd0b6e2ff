"""Streaming jobs as named queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators.incremental import append_vectors
from ..session import scratch_path
from ..sinks.label_store import compact, init_store, read_store, vacuum
from ..sources import vocab as VS
from ..streaming.incremental import read_quarantine, run_incremental
from ..streaming.labels import run_label_stream
from . import io_job, label_job, search_job

COLD_START_FILES = 400   # files per trigger in the registered check (the original job takes 10)


def q_stream_incremental(spark: SparkSession, sf: str):
    """Two deliveries arrive one after the other; a third run with nothing new.

    The vector table starts with the stored vectors; each run appends only
    ids it lacks; the last run must append nothing.
    """
    fx = Fixtures(spark, sf)
    table = scratch_path(spark, "stream-vectors")
    append_vectors(search_job.stored_vectors(fx), table, "hashing")
    src = scratch_path(spark, "stream-papers")
    ckpt = scratch_path(spark, "stream-ckpt")
    rec = io_job.paper_records(fx)
    cols = ["_id", "id_of_mysql", "ts", "title", "abstract", "keywords", "venue", "authors", "affiliations"]
    first = rec.where(F.col("year") < 2000)
    second = rec.where((F.col("year") >= 2000) | F.col("year").isNull()) \
                .unionByName(first.where(F.col("lang") == "en"))
    first.select(*cols).write.json(f"{src}/d1")
    run_incremental(spark, f"{src}/*", table, ckpt)
    second.select(*cols).write.json(f"{src}/d2")
    run_incremental(spark, f"{src}/*", table, ckpt)
    again = run_incremental(spark, f"{src}/*", table, ckpt)
    if again != 0:
        raise AssertionError(f"a run without new files appended {again} rows")
    return spark.read.parquet(table).select("pid", "ts", "model")


def q_stream_quarantine(spark: SparkSession, sf: str):
    """The paper files with the torn one as a stream, run twice: each bad line is quarantined once."""
    root = io_job.paper_files(spark, sf)
    at = scratch_path(spark, "quarantine")
    for _ in range(2):
        run_incremental(spark, f"{root}/*", f"{at}/table", f"{at}/ckpt", quarantine=f"{at}/bad")
    return read_quarantine(spark, f"{at}/bad").select("_corrupt_record")


def _label_stream(spark, sf, dirs, max_files):
    fx = Fixtures(spark, sf)
    root = label_job.label_inputs(spark, sf)
    store = scratch_path(spark, "label-store")
    init_store(label_job.label_store_old(fx), store, 16)
    vocab = VS.read_vocab(spark, f"{root}/vocab")
    run_label_stream(spark, [f"{root}/{d}" for d in dirs], label_job._papers(fx), vocab, store,
                     scratch_path(spark, "label-ckpt"), label_job.run_ts(), 16, max_files)
    return store


def q_stream_labels(spark, sf):
    """Newly arrived latest and scholar pool files labelled into the store."""
    return read_store(spark, _label_stream(spark, sf, ["latest", "scholar"], COLD_START_FILES)).drop("bucket")


def q_label_cold_start(spark, sf):
    """Every pool file of the history, in file batches, upserted into the store, which is then compacted."""
    store = _label_stream(spark, sf, ["latest", "scholar", "high"], COLD_START_FILES)
    compact(spark, store)
    vacuum(spark, store)
    return read_store(spark, store).drop("bucket")


QUERIES = {
    "stream_incremental": q_stream_incremental,
    "stream_quarantine": q_stream_quarantine,
    "stream_labels": q_stream_labels,
    "label_cold_start": q_label_cold_start,
}

_UPSERT = """
    SELECT COALESCE(o.pub_id, n.pub_id) AS pub_id,
           CASE WHEN n.pub_id IS NOT NULL THEN n.labels ELSE o.labels END AS labels,
           COALESCE(o.create_time, TIMESTAMP '2001-08-01 00:00:00') AS create_time,
           CASE WHEN n.pub_id IS NOT NULL THEN TIMESTAMP '2001-08-01 00:00:00' ELSE o.modify_time END AS modify_time
    FROM label_old o FULL OUTER JOIN ({new}) n ON o.pub_id = n.pub_id"""

ORACLE = {
    "stream_incremental": """
        SELECT pid, ts, 'hashing' AS model FROM vec
        UNION ALL
        SELECT d.doc_id AS pid,
               CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE CAST(epoch(o.o_orderdate) AS BIGINT) END AS ts,
               'hashing' AS model
        FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
        WHERE d.lang <> 'de' AND d.doc_id NOT IN (SELECT pid FROM vec)""",
    "stream_quarantine": io_job._TORN,
    "stream_labels": _UPSERT.format(new="""
        SELECT s.* FROM strong_labels s WHERE s.pub_id IN (
          SELECT paper_id FROM label_pool_ids WHERE pool IN ('latest', 'scholar'))"""),
    "label_cold_start": _UPSERT.format(new="SELECT * FROM strong_labels"),
}
