"""Metric hierarchy: speed, quality and cost measures as one long numbered table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.labels import code_to_label
from ..functions.ratios import ratio_bps
from ..operators.filters import filter_date_floor
from ..operators.joins import join_full_outer_chain
from ..operators.ordered import row_number_grouped
from ..session import pin
from .names import accepts_names

Tables = Mapping[str, DataFrame]

# Country names by code.
COUNTRIES = {"C1": "Country1", "C2": "Country2", "C3": "Country3", "C4": "Country4", "C5": "Country5"}
# Service targets in minutes by facility and process.
SLA = (
    ("FAC001", "ProcessA", 90),
    ("FAC001", "ProcessB", 120),
    ("FAC002", "ProcessA", 90),
    ("FAC002", "ProcessB", 120),
    ("FAC003", "ProcessA", 95),
    ("FAC003", "ProcessB", 120),
)
HOURS = ("a", "b", "c", "d", "e")
# Subcategory order, metric order, subcategory, metric, unit, measure.
# The six cost rows share one measure, and "DPMO" holds units, as in the template.
CATALOG = (
    *((1, i, "Speed", f"Performance Metric {x.upper()}", "bps", f"metric_{x}_bps") for i, x in enumerate(HOURS, 1)),
    (3, 1, "Quality", "Quality Events", "DPMO", "total_event_units"),
    (4, 1, "Cost", "Resource Hours Type 1", "hours", "total_buffer_hours"),
    (4, 2, "Cost", "Resource Hours Type 2", "hours", "total_buffer_hours"),
    (4, 3, "Cost", "Resource Hours Type 3", "hours", "total_buffer_hours"),
    (4, 4, "Cost", "Buffer Management", "%", "total_buffer_hours"),
    (4, 5, "Cost", "Resource Hours Type 4", "hours", "total_buffer_hours"),
    (4, 6, "Cost", "Resource Hours Type 5", "hours", "total_buffer_hours"),
)
SLA_PLACE = (2, 1, "Speed", "SLA - ", "mins")


@dataclass(frozen=True)
class HierarchyConfig:
    floor: dt.date = dt.date(2024, 12, 31)
    metric_type: str = "type.category.subcategory"
    countries: Mapping[str, str] = field(default_factory=lambda: dict(COUNTRIES))
    sla: Sequence[tuple[str, str, int]] = SLA


def _date_cols(ts: str) -> dict:
    return cal.date_parts(ts, ["date", "week", "year"])


def hub_facilities(tables: Tables) -> DataFrame:
    cols = ["facility_id", "facility_type", "region_code", "country", "hub_id"]
    return tables["facilities"].filter(F.col("hub_id").isNotNull()).select(*cols).distinct()


def performance_bps(tables: Tables, config: HierarchyConfig) -> DataFrame:
    """Hours as basis points of average weekly volume, by country day and facility.

    The template joins values to facilities to volumes row by row and then
    averages; each value and volume row is repeated evenly inside a group, so
    both averages are taken before joining and nothing fans out.
    """
    typed = hub_facilities(tables).filter(F.col("facility_type").isNotNull())
    volume = filter_date_floor(tables["volume"], "metric_date", config.floor, "after_instant").filter(
        (F.col("volume_metric") != 0) & (F.col("metric_type") == config.metric_type)
    )
    # weeks are matched without their year, as in the template
    by_week = (
        volume.groupBy("facility_id", F.weekofyear("metric_date").alias("week"))
        .agg(F.sum("volume_metric").alias("s"), F.count("volume_metric").alias("n"))
        .join(typed, "facility_id")
        .groupBy("country", "facility_id", "week")
        .agg((F.sum("s") / F.sum("n")).alias("avg_volume"))
    )
    values = filter_date_floor(tables["values"], "snapshot_date", config.floor, "after_instant")
    by_day = values.groupBy("country_code", "snapshot_date").agg(F.avg("total_value").alias("avg_value"))
    named = by_day.withColumn("country", code_to_label("country_code", config.countries)).withColumns(
        _date_cols("snapshot_date")
    )
    known = named.join(typed.select("country").distinct(), "country", "left_semi")
    days = known.join(by_week, ["country", "week"], "left")

    runs = filter_date_floor(tables["performance"], "start_time", config.floor, "after_day").filter(
        F.col("facility_type").isNotNull()
    )
    names = [f"metric_{x}_hours" for x in HOURS]
    run_keys = ["facility_id", "country", "facility_type", "process_name", "process_group", "start_time", "end_time"]
    per_run = runs.groupBy(*run_keys).agg(*[F.avg(c).alias(c) for c in names])
    hours = per_run.groupBy("facility_id", F.to_date("start_time").alias("date")).agg(
        *[F.sum(c).alias(c) for c in names]
    )
    joined = days.join(hours, ["facility_id", "date"], "left")
    return joined.select(
        "facility_id",
        "date",
        "week",
        "year",
        F.col("country_code").alias("region"),
        *[
            F.when(F.col("avg_volume") > 0, ratio_bps(c, "avg_volume")).otherwise(F.lit(0.0)).alias(c.replace("hours", "bps"))
            for c in names
        ],
    )


def approved_event_units(tables: Tables, config: HierarchyConfig) -> DataFrame:
    """Units of approved quality events by facility and day."""
    approved = tables["event_status"].filter(F.col("status") == "approved").select("event_id")
    events = filter_date_floor(tables["quality_events"], "event_date", config.floor, "from")
    cols = ["event_id", "event_date", "facility_id", "category", "root_cause", "shift_id", "event_units"]
    once = events.join(approved, "event_id", "left_semi").select(*cols).distinct()
    return once.groupBy("facility_id", *[c.alias(n) for n, c in _date_cols("event_date").items()]).agg(
        F.sum("event_units").alias("total_event_units")
    )


def buffer_hours(tables: Tables, config: HierarchyConfig) -> DataFrame:
    """Hours lost to buffer events by facility and day; a repeated event is averaged."""
    events = filter_date_floor(tables["buffer_events"], "event_start", config.floor, "after_day")
    keys = ["facility_id", "process_path", "event_start", "event_end", "event_family", "event_cause", "event_description"]
    once = events.groupBy(*keys).agg((F.avg("minutes_affected") / 60).alias("hours"))
    days = once.groupBy("facility_id", *[c.alias(n) for n, c in _date_cols("event_start").items()]).agg(
        F.sum("hours").alias("total_buffer_hours")
    )
    hubs = hub_facilities(tables).select("facility_id", F.col("region_code").alias("region"))
    return days.join(hubs, "facility_id")


@accepts_names
def report_metric_hierarchy(tables: Tables, config: HierarchyConfig = HierarchyConfig()) -> DataFrame:
    """All measures as numbered rows: category, subcategory, metric, unit, date, facility.

    ``tables``: ``volume``, ``facilities``, ``values``, ``performance``,
    ``quality_events``, ``event_status``, ``buffer_events``.  Measures and service
    targets leave the combined rows in a single pass, which is stored and then numbered.
    """
    # several country codes may share a facility's days; the other two hold a facility's day once
    combined = join_full_outer_chain(
        [performance_bps(tables, config), buffer_hours(tables, config), approved_event_units(tables, config)],
        ["facility_id", "date", "week", "year"],
        repeats=0,
    )

    def entry(sub_order, order, sub, metric, unit, process, value):
        return F.struct(
            F.lit(1).alias("category_order"),
            F.lit(sub_order).alias("subcategory_order"),
            F.lit(order).alias("metric_order"),
            F.lit("Output").alias("category"),
            F.lit(sub).alias("subcategory"),
            F.lit(metric).alias("metric"),
            F.lit(unit).alias("unit"),
            F.lit(process).cast("string").alias("process_type"),
            value.cast("double").alias("metric_value"),
        )

    measures = F.filter(
        F.array(*[entry(s, o, sub, m, u, None, F.col(c)) for s, o, sub, m, u, c in CATALOG]),
        lambda e: e["metric_value"].isNotNull(),
    )
    order, metric_order, sub, prefix, unit = SLA_PLACE
    targets = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("facility_id") == facility,
                    entry(order, metric_order, sub, prefix + process, unit, process, F.lit(minutes)),
                )
                for facility, process, minutes in config.sla
            ]
        )
    )
    rows = combined.select(
        "date",
        F.col("week").alias("week_number"),
        "year",
        "region",
        "facility_id",
        F.inline(F.concat(measures, targets) if config.sla else measures),
    )
    # stored, reduced as they are: the numbering counts them and reads them
    rows = pin(rows)
    # a metric's day holds a few rows per facility; region and value only settle ties, so the numbering is total
    by_day = ["category_order", "subcategory_order", "metric_order", "date"]
    numbered = row_number_grouped(rows, by_day, ["facility_id", "process_type", "region", "metric_value"])
    return numbered.drop("category_order", "subcategory_order", "metric_order")
