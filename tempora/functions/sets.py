"""Aggregates that join sets to text, for comparable outputs."""

from __future__ import annotations

from pyspark.sql import functions as F


def set_text(col, sep: str = ","):
    """Sorted distinct values as one string."""
    return F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))), sep)
