"""Planned against actual performance by period and shift."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import calendar as cal
from ..functions.ratios import alignment_status, pct_diff_raw, round_half_even
from ..functions.text import num_coerce
from ..operators.project import project_columns
from ..sources.files import inline_config, skip_leading_rows
from .names import accepts_names


@dataclass(frozen=True)
class ProductivityConfig:
    #: junk rows at the start of the file; needs ``raw`` to read files directly
    skip_rows: int = 0
    limit: float = 5
    digits: int = 2


def working_minutes(spark: SparkSession) -> DataFrame:
    """The minutes of a day that fall in a period and a shift: 1,440 rows at most.

    Facts meet their bands by an equal minute, so no band is tested per fact.
    """

    def minutes(bands, name: str) -> DataFrame:
        spans = inline_config(spark, cal.minute_spans(bands), "label string, lo int, hi int")
        return spans.select(F.col("label").alias(name), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("minute"))

    return minutes(cal.PERIODS, "period").join(minutes(cal.SHIFTS, "shift"), "minute")


@accepts_names
def report_productivity(
    tables: Mapping[str, DataFrame], config: ProductivityConfig = ProductivityConfig()
) -> DataFrame:
    """Mean planned and actual value, variance and status per (period, shift).

    ``tables``: ``raw`` (timestamp, planned_value, actual_value as text).  Rows
    outside every period or shift, or without both numbers, are left out.
    """
    raw = tables["raw"]
    if config.skip_rows:
        raw = skip_leading_rows(raw, config.skip_rows)
    raw = project_columns(raw, drop=["override_column_1", "override_column_2"])
    values = raw.select(
        cal.minute_of_day(F.to_timestamp("timestamp")).alias("minute"),
        num_coerce("planned_value").alias("planned"),
        num_coerce("actual_value").alias("actual"),
    ).dropna(subset=["planned", "actual"])
    rows = values.join(F.broadcast(working_minutes(raw.sparkSession)), "minute")
    means = rows.groupBy("period", "shift").agg(
        round_half_even(F.avg("planned"), config.digits).alias("planned_average"),
        round_half_even(F.avg("actual"), config.digits).alias("actual_average"),
    )
    variance = round_half_even(pct_diff_raw("actual_average", "planned_average"), config.digits)
    return means.withColumn("variance_pct", variance).withColumn(
        "status", alignment_status("variance_pct", config.limit, null_status="Not Aligned")
    ).select("period", "shift", "variance_pct", "planned_average", "actual_average", "status")
