"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The cosine of normalised vectors; 0 for unequal lengths."""
    wide = lambda v: v.cast("array<double>")
    total = F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))
