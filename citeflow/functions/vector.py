"""Dense-vector expressions (F13-F17): Column -> Column, JVM side.

Vectors are ``array<float>`` or ``array<double>``; every metric casts to
double before arithmetic and sums left to right, so results equal a
sequential double sum in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """sum of products."""
    prod = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(F.transform(as_double(a), lambda x: x * x),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2sq(a, b) -> Column:
    """F16: squared Euclidean distance (the index metric; same order as its root)."""
    diff = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """dot / (|a| |b|)."""
    return dot(a, b) / (norm(a) * norm(b))


def normalize(a) -> Column:
    """unit length; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n)).otherwise(as_double(a))


def concat_vectors(first, second) -> Column:
    """concatenation, first vector's values first."""
    return F.concat(as_double(first), as_double(second))


ASCENDING = {"l2": True, "cosine": False, "dot": False}
