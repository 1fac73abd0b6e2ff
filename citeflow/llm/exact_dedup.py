"""Operator 3: exact deduplication by a stateful stream (DataFrame and SQL functions only).

1. Feed. Every text is normalised (runs of white space become one space) and
   hashed once; (digest, doc_id, locator) rows go to the shared folder. The
   locator is the file that holds the row's text.
2. State. A Structured Streaming aggregation keyed by the digest reads the feed.
   Its state lives in RocksDB (on disk) and has no watermark, so nothing expires;
   for each digest it retains the smallest id with that row's locator and the
   number of copies. Map-side partial aggregation sends one row per digest and
   task, however large a group of copies is. A later call with the same ``state_dir``
   appends its rows to the feed there, reads only these and goes on from the state:
   copies of documents of earlier calls are found without reading those again.
3. Bytes. A digest seen more than once is a hit. The texts behind hits, pruned by
   a bitmap of fixed size, are grouped by (digest, whole text); a digest with
   more than one text is a collision, and its rows are then grouped by the whole
   text itself. The group-by also collapses copies map-side. Texts of earlier calls
   are read from the files that the locators of their feed rows name.

Rows: null text counts as empty; rows that repeat a doc_id and its text all get
that document's result; a null doc_id never is the keeper of a group that has a
real id (if all are null, all stay). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_or_none
from . import common as C

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",       # many small state partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",                # their native memory goes with the task
}
FEED_SCHEMA = "doc_id long, digest string, text_sha256 string, locator string"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), C.SPACE + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hashed(docs: DataFrame, digest: Callable[[Column], Column], locator: str | None) -> DataFrame:
    types = {"doc_id": "long", "text": "string"} | ({locator: "string"} if locator else {})
    d = C.pick(docs, **types).select("doc_id", normalised(F.col("text")).alias("norm"),
                                     (F.col(locator) if locator else F.input_file_name()).alias("locator"))
    return d.withColumn("text_sha256", sha256(F.col("norm"))).withColumn("digest", digest(F.col("norm")))


def run_state(spark: SparkSession, feed_dir: str, state_dir: str) -> DataFrame:
    """Brings the keyed state up to date with the feed; returns it as
    (digest, keep_id, locator, group_size)."""
    own = spark.newSession()        # the state store's settings stay out of the caller's session
    for k, v in _STATE_CONF.items():
        own.conf.set(k, v)
    for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(k, spark.conf.get(k))
    seen = (own.readStream.schema(FEED_SCHEMA).parquet(feed_dir)
               .groupBy("digest")
               .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
                    F.count(F.lit(1)).alias("n")))
    query = (seen.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state_dir).start())
    query.awaitTermination()
    state = own.read.format("statestore").load(state_dir)
    value = state.schema["value"].dataType.names
    first, n = (F.col(f"value.`{c}`") for c in value[:2])
    # read in the caller's session from here on
    return C.scratch(state.select(F.col("key.digest").alias("digest"), first["doc_id"].alias("keep_id"),
                                  first["locator"].alias("locator"), n.alias("group_size")), "exact-state")


def _files(rows: DataFrame) -> list[str]:
    """The files that locators name (a row per file)."""
    return sorted(unquote(r.locator) for r in rows.select("locator").distinct().collect())


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256,
                state_dir: str | None = None, locator: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row kept), own (the row's).

    ``locator`` names a column that tells rows apart; by default it is the row's file.
    With ``state_dir`` the groups go over all calls with that folder, which must be in a place that
    all workers reach; the documents must be files, which stay where they are.
    """
    spark = docs.sparkSession
    if state_dir and locator:
        raise ValueError("with state_dir the locator is the row's file")
    hashed = _hashed(docs, digest, locator)
    feed = C.scratch(hashed.select("doc_id", "digest", "text_sha256", "locator"), "exact-rows")
    feed_dir = f"{state_dir}/feed" if state_dir else C.shared_path(spark, "exact-feed")
    earlier = read_or_none(spark, feed_dir, FEED_SCHEMA) if state_dir else None      # the files there now
    if state_dir and not feed.where("locator = ''").isEmpty():
        raise ValueError("with state_dir the documents must be read from files")
    feed.write.mode("append").parquet(feed_dir)
    state = run_state(spark, feed_dir, f"{state_dir}/stream" if state_dir else C.shared_path(spark, "exact-stream"))

    hits = C.bitmap(state.where("group_size > 1"), "digest")
    at_hits = C.maybe_in(hashed, "digest", hits).select("digest", "norm")
    before = None
    if earlier is not None:
        met = C.scratch(earlier.join(feed.select("digest").distinct(), "digest", "left_semi"), "exact-met")
        if files := _files(met):
            before = _hashed(spark.read.parquet(*files), digest, None).join(met.select("digest").distinct(), "digest", "left_semi")
            at_hits = at_hits.unionByName(before.select("digest", "norm"))
    collided = C.scratch(
        at_hits.groupBy("digest", "norm").agg(F.lit(1).alias("one"))
               .groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
               .where("texts > 1").select("digest"), "exact-collided")

    cols = ["doc_id", "keep_id", "group_size", "text_sha256", "locator", "own"]
    out = feed.withColumnRenamed("locator", "own").join(state, "digest")
    if not collided.isEmpty():
        rows = hashed.join(collided, "digest", "left_semi")
        every = rows if before is None else rows.unionByName(before.join(collided, "digest", "left_semi"))
        by_text = every.groupBy("digest", "norm").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"),
            F.count(F.lit(1)).alias("group_size"))
        fixed = rows.withColumnRenamed("locator", "own").join(by_text, ["digest", "norm"]).select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", "text_sha256",
            F.col("first.locator").alias("locator"), "own")
        out = out.join(collided, "digest", "left_anti").select(*cols).unionByName(fixed.select(*cols))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256", "locator", "own")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each text the one row with the smallest (id, nulls last, place), all columns as they are."""
    row, gone_row = C.unused([*docs.columns, "doc_id", "text"], "row", "gone_row")
    rows = C.numbered(docs, row)
    gone = exact_dedup(rows, locator=row).where("own <> locator").select(F.col("own").cast("long").alias(gone_row))
    return C.with_schema(rows.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row), docs.schema)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.documents(spark, sf_dir)).drop("locator", "own")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {"op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm"""}
