"""Spark session defaults and the shared checkpoint folder.

Every job in the package takes a ``SparkSession`` from the caller; this module
only supplies defaults for local runs (tests, bench) and reads the cluster's
``spark.checkpoint.dir`` when a job must cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "citeflow", driver_memory: str = "16g") -> SparkSession:
    """A local-mode session with the package defaults (tests and bench only)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_FALLBACK: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) one scratch folder per process is
    made and reused by later sessions of the same process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    conf = spark.conf.get("spark.checkpoint.dir", None)
    # the configured folder, not the per-context subfolder setCheckpointDir adds
    path = conf or current
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL_FALLBACK:
            _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="citeflow-ckpt-"))
        path = _LOCAL_FALLBACK[0]
        spark.conf.set("spark.checkpoint.dir", path)
    if not current:
        sc.setCheckpointDir(path)
    return path


_MAKING: list[list[str]] = []        # scratch paths given to each table that ``finished`` is making


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    path = _fresh_path(spark, name)
    if _MAKING:
        _MAKING[-1].append(path)
    return path


def _fresh_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def reusable_path(spark: SparkSession, name: str, written: dict) -> tuple[str, bool]:
    """A derived-input folder keyed by (name, checkpoint folder).

    Returns ``(path, ready)``; ``ready`` is True when an earlier call of this
    process already wrote it completely (its marker folder is readable).
    """
    base = ensure_checkpoint_dir(spark)
    key = (name, base)
    if key in written and _is_ready(spark, written[key]):
        return written[key], True
    path = _fresh_path(spark, name.replace("/", "_"))
    written[key] = path
    return path, False


def _is_ready(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.text(f"{path}-ready").count() > 0
    except AnalysisException:
        return False


def mark_ready(spark: SparkSession, path: str) -> None:
    """Write the completion marker of ``path`` (a sibling folder, via Spark)."""
    spark.createDataFrame([("ready",)], "value string").coalesce(1) \
         .write.mode("overwrite").text(f"{path}-ready")


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The parquet table at ``path``, or None if there is none yet; any other failure is raised."""
    from pyspark.errors import AnalysisException
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Where ``df`` was written as Parquet in the shared folder, to remove it there, and the table read from it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read from there: for tables that grow with the input."""
    return stored(df, name)[1]


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table of this job, by the file system it lies on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, Spark removes the shuffle files of a query when it ends: for loops whose steps are all written out."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def finished(spark: SparkSession, make, name: str) -> DataFrame:
    """The table that ``make()`` gives, written to the shared folder; the shuffle files and scratch tables of making it go."""
    path = scratch_path(spark, name)
    _MAKING.append([])
    try:
        with shuffles_removed(spark):
            df = make()
            df.write.parquet(path)
    finally:
        for old in _MAKING.pop():
            remove_path(spark, old)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``citeflow`` package importable in the Python workers.

    Pandas UDFs and ``mapInPandas`` / ``applyInPandas`` functions refer to
    package code; the package is zipped once per application and added with
    ``SparkContext.addPyFile``, which distributes it to every executor (the
    equivalent of ``--py-files`` when the job was not submitted with it).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="citeflow-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
