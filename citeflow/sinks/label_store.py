"""Label store with merge on read (K3 at scale).

::

    log/            one row per change: version, kind (base or delta), name, upto, buckets
    base/name/      all labels as of a version, by bucket = pmod(xxhash64(pub_id), buckets)
    delta/name/     the rows of one upsert

* An upsert writes its own rows and a row of the log: what it costs is what the batch
  costs, whatever the store holds. The name of a delta comes from its batch (a stream's
  batch id), so a batch that is run again writes the same folder, or nothing if the log
  has it. A folder that the log doesn't name is not part of the store.
* A read takes the last base and the deltas after it, and merges them by key: labels and
  ``modify_time`` of the last version, ``create_time`` of the first.
* ``compact`` is a job of its own: it writes what a read gives as the next base, which
  replaces the deltas up to the version it has read (``upto``); later ones stay. ``vacuum``
  then deletes the folders that no reader needs.

One writer at a time is assumed to a store. Every step is an ordinary Spark job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_or_none
from . import files

STORE_SCHEMA = "pub_id string, labels array<string>, create_time timestamp_ntz, modify_time timestamp_ntz, bucket int"
_DELTA = "pub_id string, labels array<string>, modify_time timestamp_ntz"
_LOG = "version long, kind string, name string, upto long, buckets int"


def bucket_of(col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, path: str) -> list:
    """The changes that make up the store now: the last base, then the deltas it doesn't hold."""
    rows = read_or_none(spark, f"{path}/log", _LOG)
    rows = [] if rows is None else rows.orderBy("version").collect()        # a row per change
    base = next((r for r in reversed(rows) if r.kind == "base"), None)
    held = base.upto if base else -1
    return ([base] if base else []) + [r for r in rows if r.kind == "delta" and r.version > held]


def _record(spark: SparkSession, path: str, kind: str, name: str, upto: int | None, buckets: int) -> None:
    rows = read_or_none(spark, f"{path}/log", _LOG)
    last = None if rows is None else rows.agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    spark.createDataFrame([(version, kind, name, version if upto is None else upto, buckets)], _LOG) \
        .coalesce(1).write.mode("append").parquet(f"{path}/log")


def _write_base(df: DataFrame, path: str, upto: int | None, buckets: int) -> None:
    name = uuid.uuid4().hex[:12]
    (df.withColumn("bucket", bucket_of("pub_id", buckets)).repartition(buckets, "bucket")
       .write.partitionBy("bucket").parquet(f"{path}/base/{name}"))
    _record(df.sparkSession, path, "base", name, upto, buckets)


def init_store(df: DataFrame, path: str, buckets: int) -> None:
    """A store that holds ``df``, in place of what it held before."""
    _write_base(df.select("pub_id", "labels", "create_time", "modify_time"), path, None, buckets)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    changes = _log(spark, path)
    if not changes:
        return spark.createDataFrame([], STORE_SCHEMA)
    own = ["pub_id", "labels", "create_time", "modify_time"]
    buckets = changes[-1].buckets
    base = [c for c in changes if c.kind == "base"]
    stored = spark.read.schema(STORE_SCHEMA).parquet(f"{path}/base/{base[0].name}").select(*own) if base else None
    deltas = changes[len(base):]
    if not deltas:
        return stored.withColumn("bucket", bucket_of("pub_id", buckets))
    rows = spark.read.schema(_DELTA + ", name string").option("basePath", f"{path}/delta").parquet(
        *[f"{path}/delta/name={c.name}" for c in deltas])
    turn = F.array_position(F.array(*[F.lit(c.name) for c in deltas]), F.col("name"))
    rows = rows.select("pub_id", "labels", F.col("modify_time").alias("create_time"), "modify_time", turn.alias("turn"))
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("turn", F.lit(0).cast("bigint")))
    merged = rows.groupBy("pub_id").agg(F.max_by("labels", "turn").alias("labels"), F.min_by("create_time", "turn").alias("create_time"),
                                        F.max_by("modify_time", "turn").alias("modify_time"))
    return merged.withColumn("bucket", bucket_of("pub_id", buckets))


def upsert_into(store: str, new: DataFrame, run_ts: Column, buckets: int, batch: str | None = None) -> None:
    """Labels of the ids in ``new(pub_id, labels)`` replace those stored; ``batch`` names the upsert, so that
    running it again changes nothing. ``buckets`` are those of the next base."""
    spark = new.sparkSession
    name = batch or uuid.uuid4().hex[:12]
    logged = read_or_none(spark, f"{store}/log", _LOG)
    if logged is not None and not logged.where((F.col("kind") == "delta") & (F.col("name") == name)).isEmpty():
        return
    rows = new.select("pub_id", "labels", run_ts.alias("modify_time")).dropDuplicates(["pub_id"])
    path = f"{store}/delta/name={name}"
    rows.write.mode("overwrite").parquet(path)
    if spark.read.schema(_DELTA).parquet(path).isEmpty():
        return
    _record(spark, store, "delta", name, None, buckets)


def compact(spark: SparkSession, store: str) -> None:
    """Writes the store as one base; nothing to do without deltas."""
    changes = _log(spark, store)
    if any(c.kind == "delta" for c in changes):
        _write_base(read_store(spark, store).drop("bucket"), store, changes[-1].version, changes[-1].buckets)


def vacuum(spark: SparkSession, store: str) -> list[str]:
    """Deletes bases and deltas that the store no longer consists of; returns their folders. No reader may be
    at an older version, and no upsert or compaction under way."""
    kept = {f"base/{c.name}" if c.kind == "base" else f"delta/name={c.name}" for c in _log(spark, store)}
    gone = [f"{kind}/{n}" for kind in ("base", "delta") for n in files.names(spark, f"{store}/{kind}")]
    gone = [g for g in gone if g not in kept and not g.rpartition("/")[2].startswith(("_", "."))]
    for g in gone:
        files.delete(spark, f"{store}/{g}")
    return gone
