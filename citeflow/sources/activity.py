"""Activity sources: active users between two days."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_users(events: DataFrame, start: _dt.date, end: _dt.date,
                 event_type: str = "purchase") -> DataFrame:
    """Distinct users with an event of ``event_type`` in ``[start, end)``.

    The range predicate on ``ts`` and the type equality reach the parquet
    scan as pushed filters.
    """
    return (events
            .where((F.col("event_type") == event_type)
                   & (F.col("ts") >= F.lit(start).cast("timestamp"))
                   & (F.col("ts") < F.lit(end).cast("timestamp")))
            .select("user_id")
            .distinct())
