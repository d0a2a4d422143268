"""Straight-line projection of a yearly level, over all years and recent ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.quality import drop_missing_rows
from ..operators.stats import linear_fit
from .names import accepts_names


@dataclass(frozen=True)
class TrendConfig:
    first_year: int = 1880
    recent_year: int = 2000
    last_year: int = 2050


@accepts_names
def report_trend_projection(tables: Mapping[str, DataFrame], config: TrendConfig = TrendConfig()) -> DataFrame:
    """``tables``: ``levels`` (year, level).  Rows ``(fit, year, predicted)``."""
    levels = drop_missing_rows(tables["levels"], ["year", "level"])
    whole = linear_fit(levels, "year", "level", predict=(config.first_year, config.last_year))
    recent = linear_fit(
        levels, "year", "level", F.col("year") >= config.recent_year, (config.recent_year, config.last_year)
    )
    parts = [
        d.select(F.lit(name).alias("fit"), F.col("x").alias("year"), "predicted")
        for name, d in (("all", whole), ("recent", recent))
    ]
    return parts[0].unionByName(parts[1])
