"""Quarter-on-quarter review of late deliveries, outbound scores and task scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.ratios import round_half_even
from ..functions.text import str_rstrip_iso
from ..operators.aggregate import category_mean_bars
from ..operators.filters import filter_period
from .names import accepts_names

# The parts of the total task score.
SCORES = (
    "execution_score",
    "compliance_score",
    "event_score",
    "capacity_score",
    "uncategorized_score",
    "accuracy_score",
    "workload_score",
    "planning_score",
)


@dataclass(frozen=True)
class QuarterlyConfig:
    quarters: Sequence[str] = ("2025-Q1", "2026-Q1")
    site: str | None = "DEMO1"
    digits: int = 3


def span(quarters: Sequence[str]) -> tuple[str, str]:
    """First day of the earliest quarter, and first day after the latest one."""
    numbers = sorted(int(q[:4]) * 4 + int(q[-1]) - 1 for q in quarters)
    return tuple(f"{n // 4:04d}-{n % 4 * 3 + 1:02d}-01" for n in (numbers[0], numbers[-1] + 1))


def _labelled(d: DataFrame, date: str, quarters: Sequence[str], is_text: bool = True) -> DataFrame:
    """Date parsed, period labels added, wanted quarters kept by date range."""
    if is_text:
        # ISO text sorts like its date, so the wanted span reaches the scan before anything is parsed
        first, last = span(quarters)
        d = d.filter((F.col(date) >= first) & (F.col(date) < last))
        d = d.withColumn(date, str_rstrip_iso(date))
    kept = filter_period(d, date, quarters=quarters)
    return kept.withColumns(
        {
            "week_number": cal.period_labels(date, "week"),
            "month": cal.period_labels(date, "month"),
            "quarter": cal.period_labels(date, "quarter"),
            "year": cal.period_labels(date, "year"),
        }
    )


PERIODS = ("week_number", "month", "quarter", "year")


@accepts_names
def report_quarterly_review(
    tables: Mapping[str, DataFrame], config: QuarterlyConfig = QuarterlyConfig()
) -> dict[str, DataFrame]:
    """Summaries per source, mean bars by site and quarter, and one site's rows.

    ``tables``: ``late``, ``outbound``, ``tasks``.
    """

    def rounded(c, name: str):
        return round_half_even(c, config.digits).alias(name)

    def total_of(c: str):
        # a group without any value sums to 0, as in data-frame grouping
        return F.coalesce(F.sum(c), F.lit(0))

    late = _labelled(tables["late"], "balance_date", config.quarters).groupBy(
        "facility_code", "balance_date", *PERIODS
    ).agg(rounded(total_of("defect_rate"), "defect_rate"), total_of("raw_late_count").alias("raw_late_count"))
    outbound = _labelled(tables["outbound"], "clean_date", config.quarters).groupBy(
        "facility_code", "process_path", "category", "clean_date", *PERIODS
    ).agg(
        rounded(total_of("performance_score"), "performance_score"),
        rounded(F.avg("weekly_percentage"), "weekly_percentage"),
    )
    total = reduce(lambda a, b: a + b, [F.col(c) for c in SCORES])
    tasks = (
        _labelled(tables["tasks"].withColumn("total_score", total), "date", config.quarters, is_text=False)
        .groupBy("warehouse_id", "date", "process_group", *PERIODS)
        .agg(
            total_of("total_units").alias("total_units"),
            *[rounded(total_of(c), c) for c in (*SCORES, "total_score")],
        )
    )
    bundle = {
        "late": late,
        "outbound": outbound,
        "tasks": tasks,
        "task_bars": category_mean_bars(tasks, "warehouse_id", "quarter", "total_score"),
        "late_bars": category_mean_bars(late, "facility_code", "quarter", "raw_late_count"),
        "outbound_bars": category_mean_bars(outbound, "facility_code", "quarter", "performance_score"),
    }
    if config.site is not None:
        bundle |= {
            "site_late": late.filter(F.col("facility_code") == config.site),
            "site_outbound": outbound.filter(F.col("facility_code") == config.site),
            "site_tasks": tasks.filter(F.col("warehouse_id") == config.site),
        }
    return bundle
