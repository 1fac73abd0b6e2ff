"""Recall score: a citation-and-date score, higher is better (F1).

``distance = exp((b + min(c, 8000)) / 10000 - 1)`` where ``b`` is the number
of whole 12-day steps since 2000-01-01 (0 before that day or for a missing
date) and ``c`` the citation count (0 when missing, no lower clamp).

Ranking uses the integer ``b + min(c, 8000)``: it is monotone in the
distance and exact in every engine, so ties are equal everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _as_date(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    s = c.cast("string")
    # text dates may be '0' or malformed: try_to_date keeps ANSI mode happy
    return F.when(s == "0", F.lit(None).cast("date")).otherwise(F.try_to_date(s))


def date_steps(ts) -> Column:
    """Whole 12-day steps since day zero; 0 when earlier or unknown."""
    d = _as_date(ts)
    days = F.datediff(d, F.lit(C.DISTANCE_START_DATE).cast("date"))
    steps = F.floor(days / F.lit(C.DISTANCE_DAYS_PER_STEP)).cast("bigint")
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), steps), F.lit(0).cast("bigint"))


def score_int(ts, citations) -> Column:
    """Integer rank key: date steps plus capped citations."""
    c = F.col(citations) if isinstance(citations, str) else citations
    capped = F.least(F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")),
                     F.lit(C.CITATION_CAP).cast("bigint"))
    return date_steps(ts) + capped


def distance_from_score(score: Column) -> Column:
    return F.exp(score.cast("double") / F.lit(float(C.SCORE_SCALE)) - F.lit(1.0))


def distance(ts, citations) -> Column:
    """The recall distance of a paper (float, in (0, 1] for c <= 10000)."""
    return distance_from_score(score_int(ts, citations))
