"""Document ids of rows that have none."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAST = 1 << 62


def own_id(doc_id: str, text: str) -> Column:
    """The document id; for a null one a number from ``LEAST`` on that equal texts share."""
    made = F.shiftrightunsigned(F.xxhash64(F.col(text).cast("string")), 2) + F.lit(LEAST)
    return F.coalesce(F.col(doc_id).cast("long"), made)
