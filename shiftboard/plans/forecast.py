"""Forecast alignment next to downtime and quality incidents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.ratios import alignment_status, pct_diff_raw
from ..operators.filters import filter_date_floor
from .names import accepts_names

Tables = Mapping[str, DataFrame]
VALUES = ("forecast_value_a", "forecast_value_b", "actual_value_a", "actual_value_b")


@dataclass(frozen=True)
class ForecastConfig:
    floor: dt.date = dt.date(2024, 12, 31)
    limit: float = 5
    null_status: str = "Aligned"
    #: True joins event rows themselves (every downtime with every incident of a
    #: facility and day); False sums each side to facility and day first.
    detail: bool = False


def downtime_events(tables: Tables, config: ForecastConfig) -> DataFrame:
    rows = filter_date_floor(tables["downtime"], "start_time_local", config.floor, "after_day")
    keys = [
        "facility_id", "region_name", "facility_type", "process_area", "process_group", "start_time_local", "end_time_local",
    ]
    once = rows.filter(F.col("facility_type").isNotNull()).groupBy(*keys).agg(F.avg("total_hours").alias("total_hours"))
    return once.withColumns(
        {
            "event_date": F.to_date("start_time_local"),
            "total_downtime_minutes": cal.minutes_between("start_time_local", "end_time_local"),
        }
    )


def approved_incidents(tables: Tables, config: ForecastConfig) -> DataFrame:
    approved = tables["incident_status"].filter(F.col("incident_status") == "approved").select("incident_id")
    rows = filter_date_floor(tables["incidents"], "incident_date", config.floor, "from")
    cols = ["incident_id", "incident_date", "facility_id", "category", "root_cause", "shift", "affected_units"]
    return rows.join(approved, "incident_id", "left_semi").select(*cols).distinct()


def forecast_accuracy(tables: Tables, config: ForecastConfig) -> DataFrame:
    """Mean forecast and actual by facility and day, percent difference and status."""
    rows = filter_date_floor(tables["forecasts"], "forecast_timestamp", config.floor, "after_close")
    for c in VALUES:
        rows = rows.filter(F.col(c) > 0)
    days = rows.groupBy("region", "facility_id", F.to_date("forecast_timestamp").alias("forecast_date")).agg(
        *[F.avg(c).alias(c) for c in VALUES], F.max("last_update_date").alias("last_update_date")
    )
    outputs = {}
    for x in ("b", "a"):
        raw = pct_diff_raw(f"actual_value_{x}", f"forecast_value_{x}")
        outputs[f"forecast_{x}_pct_diff"] = F.round(raw, 2)
        # the status reads the unrounded difference
        outputs[f"forecast_{x}_alignment_status"] = alignment_status(raw, config.limit, config.null_status)
    return days.withColumns(outputs)


@accepts_names
def report_forecast_alignment(tables: Tables, config: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Forecast rows beside the facility-day's downtime and approved incidents.

    ``tables``: ``forecasts``, ``downtime``, ``incidents``, ``incident_status``.
    By default each side is summed to facility and day, one row per forecast row;
    ``row_multiplier`` says how many rows the row-by-row join would give.
    """
    forecast = forecast_accuracy(tables, config)
    downtime, incidents = downtime_events(tables, config), approved_incidents(tables, config)
    incidents = incidents.withColumn("event_date", F.to_date("incident_date"))
    key = ["facility_id", "event_date"]
    if config.detail:
        downtime = downtime.select(*key, "total_downtime_minutes", F.col("total_hours").alias("downtime_total_hours"))
        incidents = incidents.select(*key, "affected_units")
    else:
        downtime = downtime.groupBy(*key).agg(
            F.sum("total_downtime_minutes").alias("total_downtime_minutes"),
            F.sum("total_hours").alias("downtime_total_hours"),
            F.count("*").alias("downtime_events"),
        )
        incidents = incidents.groupBy(*key).agg(
            F.sum("affected_units").alias("affected_units"), F.count("*").alias("incidents")
        )
    keyed = forecast.withColumn("event_date", F.col("forecast_date"))
    joined = keyed.join(downtime, key, "left").join(incidents, key, "left").drop("event_date", "last_update_date", *VALUES)
    if config.detail:
        return joined
    once = [F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(1)) for c in ("downtime_events", "incidents")]
    return joined.withColumn("row_multiplier", (once[0] * once[1]).cast("bigint"))
