"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Summed in doubles, given as a float; 0 for vectors of no or different length, or of zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.coalesce(F.when(fine, dot(a, b) / norms), F.lit(0.0)).cast("float")
