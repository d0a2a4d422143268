"""Labelled rows for training: the training folds, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def fold(ident: str) -> Column:
    """crc32 of the id's text modulo 5; fold 0 is held out.  A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % FOLDS, F.lit(0).cast("long"))


def training_sample(labels: DataFrame, ident: str, label: str, most: int) -> DataFrame:
    """(id, label) of about ``most`` training rows at most, chosen by a hash of the id.

    One row per id; an id with contradicting labels counts as 0.  Null ids and labels are left out.
    """
    rows = labels.filter(F.col(ident).isNotNull() & F.col(label).isNotNull() & (fold(ident) != 0))
    rows = rows.groupBy(F.col(ident).cast("long").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    share = min(1.0, most / max(rows.count(), 1))
    return rows.filter(F.shiftrightunsigned(F.xxhash64("id"), 32) <= int(share * (1 << 32)))
