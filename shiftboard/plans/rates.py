"""Predicted, actual and planned rates by process, crew and time of day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.ratios import pct_diff_raw, round_half_even
from ..functions.text import fmt_number, num_coerce, str_concat, str_replace
from ..operators.reshape import melt_long
from .names import accepts_names

RATES = ("predicted_rate", "actual_rate", "planned_rate")


@dataclass(frozen=True)
class RateConfig:
    processes: Sequence[str] = ("PROCESS_A", "PROCESS_B", "PROCESS_C", "PROCESS_D")
    digits: int = 3


def clean_rates(rates: DataFrame, config: RateConfig) -> DataFrame:
    """Wanted processes with clock times, crew and numeric rates; unplanned rows leave."""
    rows = rates.filter(F.col("process_group").isin(*config.processes)).filter(
        F.nullif(F.col("planned_rate"), F.lit("null")).isNotNull()
    )

    def clock(c: str):
        # 2025-01-10T08:00:00.000Z -> 08:00
        plain = str_replace(c, {"T": " ", "Z": ""})
        return F.date_format(F.try_to_timestamp(plain), "HH:mm")

    return rows.select(
        "process_group",
        cal.schedule_group_of_name("dow").alias("schedule_group"),
        F.trim("shift").alias("shift"),
        clock("interval_start_local").alias("interval_start_local"),
        clock("interval_end_local").alias("interval_end_local"),
        *[num_coerce(c).alias(c) for c in RATES],
    )


def _means(d: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """Rounded means; a missing key leaves its rows out, as in data-frame grouping."""
    return d.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[round_half_even(F.avg(c), digits).alias(c) for c in RATES]
    )


@accepts_names
def report_rate_comparison(tables: Mapping[str, DataFrame], config: RateConfig = RateConfig()) -> dict[str, DataFrame]:
    """``summary`` by process, crew and interval; ``by_time`` long per process; ``deviation`` by crew.

    ``tables``: ``rates`` with text dates and rates.  Later means are means of the
    rounded summary, as published.
    """
    keys = ["process_group", "schedule_group", "shift", "interval_start_local", "interval_end_local"]
    summary = _means(clean_rates(tables["rates"], config), keys, config.digits).select(
        "process_group",
        F.concat("interval_start_local", F.lit(" GMT")).alias("interval_start_local"),
        F.concat("interval_end_local", F.lit(" GMT")).alias("interval_end_local"),
        *RATES,
        str_concat(["schedule_group", "shift"], " ").alias("shift_view"),
    )
    times = _means(summary, ["process_group", "interval_start_local"], config.digits)
    by_time = melt_long(times, ["process_group", "interval_start_local"], RATES, "rate_type", "rate")
    crews = _means(summary, ["process_group", "shift_view"], config.digits)
    deviation = crews.withColumn(
        "predicted_vs_actual_pct_dev", fmt_number(pct_diff_raw("predicted_rate", "actual_rate"), "pct", 2)
    )
    return {"summary": summary, "by_time": by_time, "deviation": deviation}
