"""Incremental vector building.

New records = incoming records (last one wins per id) minus ids already in
the vector table: a left-anti join, so a replay of the same input appends
nothing. Vectors are appended to a parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from ..sources.papers import last_wins


def new_records(incoming: DataFrame, stored_ids: DataFrame, key: str = "pid",
                seq: str = "seq") -> DataFrame:
    """Last-wins incoming records whose ``key`` is not stored yet."""
    latest = last_wins(incoming, key=key, seq=seq)
    return latest.join(stored_ids.select(key).distinct(), key, "left_anti")


def append_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """K4: append ``(pid, embedding, ts, model)`` rows (D12: every model stored)."""
    out = vectors.select("pid", F.col("embedding").cast("array<float>").alias("embedding"),
                         "ts", F.lit(model).alias("model"))
    out.write.mode("append").partitionBy("model").parquet(path)


def dense_index(df: DataFrame, order_col: str, n_parts: int | None = None) -> DataFrame:
    """0-based dense running number by ``order_col`` without a global single-task window.

    Rows are range-partitioned by ``order_col``; each partition numbers its
    rows locally and adds the row count of all earlier partitions (a table
    of one row per partition, broadcast by construction).
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once, so both uses see the same partition number of every row
    parted = cut_lineage(df.repartitionByRange(n, order_col).withColumn("_p", F.spark_partition_id()))
    local = parted.withColumn(
        "_l", F.row_number().over(Window.partitionBy("_p").orderBy(order_col)) - 1)
    counts = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return (local.join(F.broadcast(offs), "_p")
            .withColumn("idx", (F.col("_o") + F.col("_l")).cast("bigint"))
            .drop("_p", "_l", "_o"))
