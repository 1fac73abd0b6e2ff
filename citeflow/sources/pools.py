"""Paper-pool sources (S3-S5, S12-S14) and their union.

Pools are JSON-lines files laid out by day (``<root>/<kind>/day=YYYY-MM-DD/``):

* ``latest`` lines ``{"pub_id": ...}`` (a line may start with a BOM),
* ``scholar`` lines ``{"<scholar id>": [{"pub_id" | "event_pub_id": ...}, ...]}``,
* ``high`` (no day) lines ``{"_id": ...}``.

Files are read as text and parsed with ``from_json``: a torn or malformed
line yields a null record that is dropped (or quarantined), never an error
that ends the read. A day range is a partition filter, so only those
directories are listed and read.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SCHOLAR_SCHEMA = "map<string, array<struct<pub_id: string, event_pub_id: string>>>"
POOL_ORDER = {"high": 0, "latest": 1, "scholar": 2}


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` can be listed (a missing pool is not an error)."""
    return _load(spark, path) is not None


def _load(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """The text scan of ``path`` (listed once), or None when it does not exist."""
    try:
        return spark.read.format("text").options(**options).load(path)
    except AnalysisException:
        return None


def _text(df: DataFrame, start=None, end=None) -> DataFrame:
    if "day" in df.columns and (start is not None or end is not None):
        day = F.col("day").cast("date")
        if start is not None:
            df = df.where(day >= F.lit(start))
        if end is not None:
            df = df.where(day <= F.lit(end))
    return df.withColumn("value", F.regexp_replace("value", r"^\uFEFF", ""))


def read_latest(spark: SparkSession, path: str, start: _dt.date | None = None,
                end: _dt.date | None = None) -> DataFrame:
    """S3: ``(paper_id, day)`` of the latest-paper pool; absent path -> empty."""
    df = _load(spark, path)
    if df is None:
        return _empty(spark, "paper_id string, day date")
    t = _text(df, start, end)
    rec = F.from_json("value", "pub_id string")
    return (t.select(rec["pub_id"].alias("paper_id"), F.col("day").cast("date").alias("day"))
            .where(F.col("paper_id").isNotNull()))


def read_scholar(spark: SparkSession, path: str, start: _dt.date | None = None,
                 end: _dt.date | None = None) -> DataFrame:
    """``(scholar_id, paper_id, day)``; an event's id is ``pub_id`` or ``event_pub_id``."""
    df = _load(spark, path)
    if df is None:
        return _empty(spark, "scholar_id string, paper_id string, day date")
    t = _text(df, start, end)
    m = t.select(F.from_json("value", SCHOLAR_SCHEMA).alias("m"),
                 F.col("day").cast("date").alias("day"))
    ev = m.select(F.explode("m").alias("scholar_id", "evs"), "day") \
          .select("scholar_id", F.explode("evs").alias("e"), "day")
    return (ev.select("scholar_id", F.coalesce("e.pub_id", "e.event_pub_id").alias("paper_id"), "day")
            .where(F.col("paper_id").isNotNull()))


def read_high(spark: SparkSession, path: str) -> DataFrame:
    """``(paper_id)`` of the high-cited pool file; rows without ``_id`` skipped."""
    t = _load(spark, path)
    if t is None:
        return _empty(spark, "paper_id string")
    return (t.select(F.from_json("value", "`_id` string")["_id"].alias("paper_id"))
            .where(F.col("paper_id").isNotNull()))


def pool_union(high: DataFrame, latest: DataFrame, scholar: DataFrame) -> DataFrame:
    """The three pools in order high, latest, scholar; repeats kept."""
    def tag(df, name):
        return df.select(F.lit(name).alias("pool"), F.lit(POOL_ORDER[name]).alias("pool_rank"),
                         F.col("paper_id").cast("string").alias("paper_id"))
    return tag(high, "high").unionByName(tag(latest, "latest")).unionByName(tag(scholar, "scholar"))


def read_pools(spark: SparkSession, root: str, start: _dt.date | None = None,
               end: _dt.date | None = None) -> DataFrame:
    """All three pools of ``root`` for the days in ``[start, end]`` -> U1 rows."""
    return pool_union(read_high(spark, f"{root}/high"),
                      read_latest(spark, f"{root}/latest", start, end),
                      read_scholar(spark, f"{root}/scholar", start, end))


def discover(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Files under the pool directories; a missing directory is skipped.

    Returns ``(file_path, file_name)`` from the scan's own file metadata.
    """
    present = [d for d in dirs if _exists(spark, d)]
    if not present:
        return _empty(spark, "file_path string, file_name string")
    # Spark's own listing: no file is opened, and empty files, which a scan leaves out, are in it
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(present).inputFiles()
    t = spark.createDataFrame([(f,) for f in files], "file_path string")
    return t.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"))


def pool_kind(path: Column, roots: list[str]) -> Column:
    """The pool a file belongs to: named by the file, or else by a folder below the pool directories given
    (the last part of a directory counts, the folders above it don't)."""
    base = path
    for r in roots:
        above = re.escape(r.rstrip("/").rpartition("/")[0])
        base = F.regexp_replace(base, F.lit(f"^(?:[a-z]+:)?/*{above.lstrip('/') if above else ''}/"), F.lit(""))
    name = F.element_at(F.split(base, "/"), -1)
    of = lambda c: (F.when(c.contains("latest"), F.lit("latest")).when(c.contains("scholar"), F.lit("scholar"))
                     .when(c.contains("high"), F.lit("high")))
    return F.coalesce(of(name), of(base))


def parse_pools(lines: DataFrame, roots: list[str]) -> DataFrame:
    """(pool, paper_id, file_path) of ``lines`` (value, file_path), each parsed as its pool's format."""
    t = (lines.select(F.regexp_replace("value", r"^\uFEFF", "").alias("value"), "file_path")
              .withColumn("pool", pool_kind(F.col("file_path"), roots)).where(F.col("pool").isNotNull()))
    latest = t.where(F.col("pool") == "latest").select(
        "pool", F.from_json("value", "pub_id string")["pub_id"].alias("paper_id"), "file_path")
    high = t.where(F.col("pool") == "high").select(
        "pool", F.from_json("value", "`_id` string")["_id"].alias("paper_id"), "file_path")
    sch = (t.where(F.col("pool") == "scholar")
           .select("pool", "file_path", F.explode(F.from_json("value", SCHOLAR_SCHEMA)).alias("k", "evs"))
           .select("pool", "file_path", F.explode("evs").alias("e"))
           .select("pool", F.coalesce("e.pub_id", "e.event_pub_id").alias("paper_id"), "file_path"))
    return latest.unionByName(sch).unionByName(high).where(F.col("paper_id").isNotNull())


def route(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """Parse each file as the pool it belongs to; latest, then scholar, then high, others ignored.

    Returns ``(pool, paper_id, file_path)``.
    """
    present = [d for d in dirs if _exists(spark, d)]
    if not present:
        return _empty(spark, "pool string, paper_id string, file_path string")
    t = (spark.read.format("text").option("recursiveFileLookup", "true").load(present)
         .select("value", F.col("_metadata.file_path").alias("file_path")))
    return parse_pools(t, present)


def day_range(start: _dt.date, end: _dt.date, drop_last: bool = False):
    """Every day in ``[start, end]`` (the last dropped when asked) as a Column array."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    if drop_last:
        days = F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0)))
    return days
