"""Daily KPI trend per facility, and the multi-source KPI board."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.labels import band_case
from ..functions.ratios import ratio_bps, ratio_or_null
from ..operators.filters import filter_date_floor, filter_relative_months
from ..operators.joins import join_dim_enrich, join_full_outer_chain
from ..operators.reshape import metric_unpivot
from ..operators.windows import change
from .names import accepts_names

Tables = Mapping[str, DataFrame]

# Impact columns behind each basis-point measure.
IMPACTS = {
    "execution": ("labor_impact", "capacity_impact"),
    "event": ("event_impact",),
    "constraint": ("constraint_impact",),
    "unallocated": ("unallocated_impact",),
    "complexity": ("complexity_impact",),
    "training": ("training_impact",),
    "downtime": ("downtime_impact",),
    "planning": ("planning_impact",),
}
# Flag thresholds, [lo, hi).
EFFICIENCY_BANDS = ((None, 80, "Low Efficiency"), (95, None, "High Efficiency"))
QUALITY_BANDS = ((None, 90, "Quality Alert"), (98, None, "Excellent Quality"))


def weekly_volume(volumes: DataFrame, floor: dt.date, date: str = "snapshot_date") -> DataFrame:
    """``(region_code, week_start, total_volume)`` for Sunday-start weeks."""
    rows = filter_date_floor(volumes, date, floor, "after_instant")
    return rows.groupBy("region_code", cal.week_start_sunday(date).alias("week_start")).agg(
        F.sum("total_volume").alias("total_volume")
    )


def daily_bps(
    facts: DataFrame,
    volume: DataFrame,
    impacts: Mapping[str, tuple[str, ...]],
    guard: str,
    extra: Mapping[str, tuple[str, str]],
    date: str = "snapshot_date",
) -> DataFrame:
    """Per facility and day: summed impacts as basis points of the weekly volume.

    Facts are reduced per facility, region and day before the weekly volume is
    joined, so the join sees days, not facts.  ``extra`` adds ``name: (function,
    column)`` measures, ``avg`` or ``sum``.
    """
    rows = facts.filter((F.col("total_impact") > 0) & (F.col("metric_type") == "DAILY"))

    def parts(cols: tuple[str, ...]) -> Column:
        total = F.coalesce(F.col(cols[0]), F.lit(0.0))
        for c in cols[1:]:
            total = total + F.coalesce(F.col(c), F.lit(0.0))
        return F.sum(total)

    sums = [F.sum("total_impact").alias("total_impact")]
    sums += [parts(cols).alias(f"__{n}") for n, cols in impacts.items()]
    for n, (fn, c) in extra.items():
        sums.append(F.sum(c).alias(f"__s_{n}"))
        if fn == "avg":
            sums.append(F.count(c).alias(f"__n_{n}"))
    days = rows.groupBy("facility_id", "region_code", F.to_date(date).alias("date")).agg(*sums)

    with_volume = days.withColumn("week_start", cal.week_start_sunday("date")).join(
        volume, ["region_code", "week_start"], "left"
    )
    outputs = [F.max("total_volume").alias("total_volume"), F.sum("total_impact").alias("total_impact")]
    outputs += [ratio_bps(F.sum(f"__{n}"), F.max("total_volume"), guard).alias(f"{n}_bps") for n in impacts]
    for n, (fn, _) in extra.items():
        total = F.sum(f"__s_{n}")
        outputs.append((ratio_or_null(total, F.sum(f"__n_{n}")) if fn == "avg" else total).alias(n))
    # one shuffle serves this grouping and the windows by facility that follow
    return with_volume.repartition("facility_id").groupBy("facility_id", "date").agg(*outputs)


@dataclass(frozen=True)
class KpiTrendConfig:
    volume_floor: dt.date = dt.date(2024, 12, 31)
    report_floor: dt.date = dt.date(2024, 12, 26)
    rows_back: int = 7
    impacts: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(IMPACTS))


TREND = {
    "execution_bps": ("execution_bps", "pct", "execution_bps_wow_change_pct", "ma_7d_execution_bps"),
    "avg_efficiency": ("avg_efficiency", "abs", "efficiency_wow_change", "ma_7d_efficiency"),
    "avg_quality_score": ("avg_quality_score", "abs", "quality_wow_change", "ma_7d_quality"),
}
FACILITY_COLS = ("country_name", "region_name", "hub_name", "facility_type", "operations_region", "geographic_region")


@accepts_names
def report_kpi_trend(tables: Tables, config: KpiTrendConfig = KpiTrendConfig()) -> DataFrame:
    """Daily basis points, 7-row change and moving average, flags, facility attributes.

    ``tables``: ``volumes``, ``performance``, ``facilities``.  The report's date
    floor applies after the windows: earlier days still feed lags and averages.
    """
    volume = weekly_volume(tables["volumes"], config.volume_floor)
    daily = daily_bps(
        tables["performance"],
        volume,
        config.impacts,
        "null",
        {
            "avg_efficiency": ("avg", "efficiency_percentage"),
            "total_errors": ("sum", "error_count"),
            "avg_quality_score": ("avg", "quality_score"),
            "total_processed_units": ("sum", "processed_units"),
        },
    )
    w = Window.partitionBy("facility_id").orderBy("date")
    recent = w.rowsBetween(1 - config.rows_back, 0)
    trend = {}
    for c, kind, change_name, mean_name in TREND.values():
        trend[change_name] = change(F.col(c), F.lag(c, config.rows_back).over(w), kind)
        trend[mean_name] = F.avg(c).over(recent)
    final = daily.withColumns(trend).withColumns(
        {
            "week_number": cal.week_number_shifted("date"),
            "year": F.year("date"),
            "efficiency_flag": band_case("avg_efficiency", EFFICIENCY_BANDS, "Normal"),
            "quality_flag": band_case("avg_quality_score", QUALITY_BANDS, "Normal"),
        }
    )
    dims = tables["facilities"].withColumnRenamed("facility_code", "facility_id")
    return join_dim_enrich(final.filter(F.col("date") > F.lit(config.report_floor)), dims, "facility_id", FACILITY_COLS)


# --- multi-source board ----------------------------------------------------

# Impact columns of the board's own facts, one of which is named otherwise.
BOARD_IMPACTS = IMPACTS | {"constraint": ("capacity_constraint_impact",)}
# The twelve staffing measures and the short names they report under.
STAFFING = {
    f"{short}_{unit_short}_{reason}": f"{side}_{unit}_{reason}"
    for side, short in (("overstaffing", "os"), ("understaffing", "us"))
    for unit, unit_short in (("hours", "hrs"), ("cost", "cost"))
    for reason in ("not_actioned", "unplanned", "not_adopted")
}
# The metric catalog: pillar, section, group, name, unit, measure.
BOARD_CATALOG = (
    ("Output", "Speed", "Performance Impact", "Execution", "bps", "execution_bps"),
    ("Output", "Speed", "Performance Impact", "Training", "bps", "training_bps"),
    ("Output", "Speed", "Performance Impact", "Planning", "bps", "planning_bps"),
    ("Output", "Speed", "Performance Impact", "Capacity Constraint", "bps", "constraint_bps"),
    ("Output", "Speed", "Performance Impact", "Complexity", "bps", "complexity_bps"),
    ("Output", "Speed", "Performance Impact", "Event", "bps", "event_bps"),
    ("Output", "Speed", "Performance Impact", "Unallocated", "bps", "unallocated_bps"),
    ("Output", "Speed", "Performance Impact", "Downtime", "bps", "downtime_bps"),
    ("Output", "Quality", "Quality Metrics", "Defect Units", "units", "quality_miss_units"),
    ("Output", "Cost", "Staffing Hours", "Overstaffing Hours Not Actioned", "hours", "os_hrs_not_actioned"),
    ("Output", "Cost", "Staffing Hours", "Overstaffing Hours Unplanned", "hours", "os_hrs_unplanned"),
    ("Output", "Cost", "Staffing Cost", "Overstaffing Cost Not Actioned", "cost", "os_cost_not_actioned"),
)


@dataclass(frozen=True)
class MultiKpiConfig:
    as_of: dt.date
    volume_floor: dt.date = dt.date(2024, 12, 31)
    staffing_floor: dt.date = dt.date(2024, 12, 31)
    report_floor: dt.date = dt.date(2024, 12, 26)
    quality_months: int = 14
    impacts: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(BOARD_IMPACTS))
    volume_date: str = "metric_date"
    impact_date: str = "metric_date"
    #: the source that may hold a facility-day several times: 0 performance, 1 staffing (by region), 2 quality
    repeats: int = 1
    #: False lets several sources, joined pairwise
    unique_keys: bool = True


def multi_kpi_base(tables: Tables, config: MultiKpiConfig) -> DataFrame:
    """One row per facility and day with every measure of the three sources."""
    volume = weekly_volume(tables["volumes"], config.volume_floor, config.volume_date)
    performance = daily_bps(tables["impact"], volume, config.impacts, "zero", {}, config.impact_date)
    dims = tables["facilities"].withColumnRenamed("facility_code", "facility_id")
    performance = join_dim_enrich(performance, dims, "facility_id", ["region_name"]).drop("total_volume", "total_impact")

    staffing = (
        filter_date_floor(tables["staffing"], "process_date", config.staffing_floor, "after_instant")
        .groupBy(F.col("facility_code").alias("facility_id"), F.to_date("process_date").alias("date"), "region_name")
        .agg(*[F.sum(c).alias(n) for n, c in STAFFING.items()])
    )
    # quality is reported on the day after it was processed
    quality = (
        filter_relative_months(tables["quality"], "process_date", config.as_of, config.quality_months)
        .groupBy("facility_id", cal.date_shift("process_date", days=1).alias("date"))
        .agg(F.sum("defect_units").alias("quality_miss_units"))
    )
    return join_full_outer_chain([performance, staffing, quality], ["facility_id", "date"], config.unique_keys, config.repeats)


@accepts_names
def report_multi_kpi(tables: Tables, config: MultiKpiConfig) -> DataFrame:
    """Every facility-day with every catalog metric, long; missing measures stay as NULL rows.

    ``tables``: ``volumes``, ``impact``, ``facilities``, ``quality``, ``staffing``.
    """
    base = multi_kpi_base(tables, config).filter(F.col("date") > F.lit(config.report_floor))
    base = base.withColumns({"week_number": cal.week_number_shifted("date"), "year": F.year("date")})
    names = ("pillar", "section", "metric_group", "metric_name", "unit", "column")
    catalog = [dict(zip(names, entry)) for entry in BOARD_CATALOG]
    return metric_unpivot(
        base, ["facility_id", "date", "week_number", "year", "region_name"], catalog, drop_null=False
    )
