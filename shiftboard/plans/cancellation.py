"""Order cancellations by reason family, daily and weekly."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.ratios import rate_dpmo, ratio_or_null
from ..operators.filters import filter_date_floor
from .names import accepts_names

# Cancellation reasons by family.
FAMILIES = {
    "execution": (
        "PROCESSING_FAILURE",
        "LATE_SHIPMENT",
        "LOST_INVENTORY",
        "INSUFFICIENT_STOCK",
        "MISSED_DEADLINE",
        "SHIPPING_ERROR",
        "QUALITY_ISSUE",
        "PACKAGING_PROBLEM",
    ),
    "manual": ("CUSTOMER_REQUESTED", "FORCE_CANCEL", "ADMIN_REQUESTED", "MANUAL_OVERRIDE"),
    "planning": (
        "CAPACITY_CONSTRAINT",
        "DELAYED_SUPPLY",
        "DEPENDENCY_MISSING",
        "FACILITY_UNAVAILABLE",
        "SYSTEM_MAINTENANCE",
        "INVENTORY_UNAVAILABLE",
        "ITEM_DISCONTINUED",
        "SUPPLIER_ISSUE",
        "LOCATION_RESTRICTED",
        "SUPPLY_CHAIN_DISRUPTION",
        "REPLENISHMENT_DELAY",
        "RESTRICTED_LOCATION",
    ),
    "system": (
        "INVALID_DATE",
        "INVALID_SCHEDULE",
        "INVALID_REQUEST",
        "VALIDATION_FAILED",
        "DATA_MISMATCH",
        "SYSTEM_ERROR",
        "TECHNICAL_FAILURE",
        "SOFTWARE_ISSUE",
        "UNABLE_TO_PROCESS",
        "CONFIGURATION_ERROR",
    ),
}
FACILITY_COLS = ("country_code", "operations_group", "site_type", "region_name")


@dataclass(frozen=True)
class CancellationConfig:
    floor: dt.date = dt.date(2024, 12, 26)
    families: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(FAMILIES))


def daily_cancellations(tables: Mapping[str, DataFrame], config: CancellationConfig) -> DataFrame:
    """Cancelled quantity per family, requests and rates, by facility and ship date.

    The two floors of the template - an instant on the facts and a day on the
    result - come to the later one, the day, which the scan can use.
    """
    rows = filter_date_floor(tables["items"], "scheduled_delivery_date", config.floor, "after_day")
    quantity, reason = F.col("quantity_cancelled"), F.col("cancel_reason")
    days = rows.groupBy("facility_id", F.to_date("scheduled_delivery_date").alias("ship_date")).agg(
        *[
            F.sum(F.when(reason.isin(*reasons), quantity).otherwise(F.lit(0))).alias(f"{n}_count")
            for n, reasons in config.families.items()
        ],
        F.sum("quantity_requested").alias("total_quantity_requested"),
    )
    dims = tables["facilities"].filter(F.col("country_code").isNotNull()).select("facility_id", *FACILITY_COLS)
    dims = dims.distinct()  # a repeated dimension row must not double a day
    cancelled = sum((F.col(f"{n}_count") for n in config.families), F.lit(0))
    return days.join(dims, "facility_id").withColumns(
        {f"{n}_dpmo": rate_dpmo(f"{n}_count", "total_quantity_requested") for n in config.families}
        | {"cancellation_rate": ratio_or_null(cancelled, "total_quantity_requested") * 100}
    )


@accepts_names
def report_cancellation(
    tables: Mapping[str, DataFrame], config: CancellationConfig = CancellationConfig()
) -> DataFrame:
    """Daily rows and, under them, weekly sums with unweighted means of the daily rates.

    ``tables``: ``items``, ``facilities``.  Both grains come from one pass with
    grouping sets: a daily group holds one row, whose sum and mean are itself.
    """
    daily = daily_cancellations(tables, config).withColumns(
        {
            "week_start_date": cal.week_start_monday("ship_date"),
            "week_number": F.weekofyear("ship_date"),
            "year": F.year("ship_date"),
        }
    )
    common = ["facility_id", "year", *FACILITY_COLS]
    per_day, per_week = [*common, "ship_date"], [*common, "week_start_date", "week_number"]
    every = [F.col(c) for c in (*common, "ship_date", "week_start_date", "week_number")]
    counts = [f"{n}_count" for n in config.families] + ["total_quantity_requested"]
    rates = [f"{n}_dpmo" for n in config.families] + ["cancellation_rate"]
    both = daily.groupingSets([[F.col(c) for c in per_day], [F.col(c) for c in per_week]], *every).agg(
        F.when(F.grouping("ship_date") == 0, "daily").otherwise("weekly").alias("aggregation_level"),
        *[F.sum(c).alias(c) for c in counts],
        *[F.avg(c).alias(c) for c in rates],
    )
    return both.select(
        "aggregation_level",
        "facility_id",
        F.col("ship_date").alias("date"),
        "week_start_date",
        "week_number",
        "year",
        *FACILITY_COLS,
        *counts,
        *rates,
    )
