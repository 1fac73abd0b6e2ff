"""Folders of a table store, by the Hadoop FileSystem API: whatever store the path names."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import SparkSession

DAY_TAG = re.compile(r"(\d{4}_\d{2}_\d{2})(?:\D.*)?")     # a dated output: its day, perhaps a suffix


def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of files and folders directly under ``path``; none if there is no such folder."""
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    fs, p = _folder(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.delete(p, True)


def expired(entries: list[str], run_day: dt.date, keep_days: int) -> list[str]:
    """K7: the dated entries older than the last ``keep_days`` days up to ``run_day``; others are not ours."""
    out = []
    for name in entries:
        if m := DAY_TAG.fullmatch(name):
            try:
                day = dt.datetime.strptime(m[1], "%Y_%m_%d").date()
            except ValueError:
                continue
            if day <= run_day - dt.timedelta(days=keep_days):
                out.append(name)
    return out


def apply_retention(spark: SparkSession, root: str, run_day: dt.date, keep_days: int) -> list[str]:
    """K7: deletes the expired dated outputs under ``root``; returns their names."""
    gone = expired(names(spark, root), run_day, keep_days)
    for name in gone:
        delete(spark, f"{root.rstrip('/')}/{name}")
    return gone
