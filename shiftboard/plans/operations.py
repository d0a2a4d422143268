"""Operational metrics per facility and process date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators.filters import filter_date_floor
from .kpi import STAFFING
from .names import accepts_names


@dataclass(frozen=True)
class OpsConfig:
    floor: dt.date = dt.date(2024, 12, 31)


def facility_list(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct facilities in a hub network that have an operations region."""
    regions = tables["facilities"].select("facility_code", "operations_region").filter(
        F.col("operations_region").isNotNull()
    )
    everything = tables["all_facilities"].filter(F.col("hub_name").isNotNull())
    return (
        everything.join(regions, "facility_code")
        .select("facility_code", "operations_region", "facility_type", "geographic_region", "country_name", "hub_name")
        .distinct()
    )


@accepts_names
def report_ops_metrics(tables: Mapping[str, DataFrame], config: OpsConfig = OpsConfig()) -> DataFrame:
    """Staffing hours and costs, efficiency, volume, errors and quality by day.

    ``tables``: ``metrics``, ``all_facilities``, ``facilities``.  Facts are summed
    per facility and date before facility attributes are joined.
    """
    rows = filter_date_floor(tables["metrics"], "process_date", config.floor, "after_instant")
    days = rows.groupBy("facility_code", "process_date").agg(
        *[F.sum(c).alias(n) for n, c in STAFFING.items()],
        F.avg("efficiency_percentage").alias("avg_efficiency"),
        F.sum("total_processed_volume").alias("total_volume"),
        F.sum("error_count").alias("total_errors"),
        F.avg("quality_score").alias("avg_quality_score"),
    )
    joined = days.join(facility_list(tables), "facility_code")
    return joined.withColumns(
        {"week_number": cal.iso_week("process_date"), "year": cal.iso_year("process_date").cast("string")}
    )
