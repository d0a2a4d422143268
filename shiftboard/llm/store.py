"""Intermediate tables in the shared folder, which also cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_path, scratch_path


def keep(d: DataFrame, label: str) -> DataFrame:
    """Write ``d`` below the shared folder and read it back: later steps cost no recomputation."""
    path = scratch_path(d.sparkSession, label)
    d.write.parquet(path)
    back = d.sparkSession.read.schema(d.schema).parquet(path)
    back._kept_at = path
    return back


def drop(spark: SparkSession, d: DataFrame | None) -> None:
    """Remove a table written by ``keep`` that nothing reads any more."""
    if d is not None and getattr(d, "_kept_at", None):
        drop_path(spark, d._kept_at)
