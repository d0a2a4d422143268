"""Weekly site bundle: four metrics wide by week with totals, and root causes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.text import fmt_number, num_coerce, str_split_cols
from ..operators.project import positional_header
from ..operators.reshape import pivot_wide_plain, pivot_wide_sum
from ..operators.stats import median_by_group
from .bundle import Bundle
from .names import accepts_names

# The headers each extract is given by position.
HEADERS = {
    "metric_a": ("site", "region", "week", "metric_a_rate"),
    "metric_b": (
        "site", "group_1", "region", "target", "week_number", "week", "date", "metric_b_value", "metric_b_last_year", "yoy_change",
    ),
    "metric_c": (
        "site", "group_2", "region", "target_rate", "week_number", "week", "date", "metric_c_count", "metric_c_rate", "vs_target", "wow", "yoy",
    ),
    "metric_d": (
        "site", "group_1", "region", "target_rate", "week_number", "week", "full_date", "units", "metric_d_rate", "vs_target", "yoy",
    ),
    "root_cause": (
        "site", "start", "end", "process_path", "category", "subcategory", "root_cause", "commentary", "metric_a_bps",
    ),
}
# Summed metric, its date column and the separator before the time.
DATED = {
    "metric_b": ("metric_b_value", "date", " "),
    "metric_c": ("metric_c_count", "date", "T"),
    "metric_d": ("units", "full_date", " "),
}


@dataclass(frozen=True)
class WeeklySitesConfig:
    #: week columns; without them every week found in an extract becomes one
    weeks: Sequence[int] | None = None
    site: str = "SITE_A"


def _dated(d: DataFrame, column: str, sep: str) -> DataFrame:
    """Date and time split apart, weekday added."""
    parts = str_split_cols(d, column, sep, ["__date", "time"])
    if column != "date":
        parts = parts.drop(column)
    return parts.withColumn("date", cal.date_parse("__date", "yyyy-MM-dd", strict=False)).drop("__date").withColumn(
        "weekday", cal.date_names("date", "weekday")
    )


@accepts_names
def report_weekly_site_bundle(
    tables: Mapping[str, DataFrame], config: WeeklySitesConfig = WeeklySitesConfig()
) -> Bundle:
    """Per metric ``*_dashboard``, ``*_wide`` and ``*_total``; root-cause sums; one site by week.

    ``tables``: ``metric_a`` … ``metric_d``, ``root_cause``, with columns in
    extract order.  Week columns are in numeric order; a week outside declared ``config.weeks`` raises.
    """
    weeks = None if config.weeks is None else sorted(config.weeks)
    named = {k: positional_header(tables[k], header) for k, header in HEADERS.items()}
    rate = named["metric_a"].withColumn("week", F.col("week").cast("int"))

    def rate_wide() -> DataFrame:
        wide = pivot_wide_plain(rate, ["site", "region"], "week", "metric_a_rate", weeks).drop("region")
        return wide.withColumns({w: fmt_number(F.col(w), "share", 0) for w in wide.columns if w != "site"})

    def rate_total() -> DataFrame:
        return rate.groupBy("site").agg(fmt_number(F.avg("metric_a_rate"), "share", 0).alias("avg_metric_a"))

    # results are built when asked for: a wide one without declared weeks lists them with a job
    out: dict[str, Callable[[], DataFrame]] = {
        "metric_a_dashboard": lambda: rate.withColumn("metric_a_rate", fmt_number("metric_a_rate", "share", 0)),
        "metric_a_wide": rate_wide,
        "metric_a_total": rate_total,
    }
    one_site = F.col("site") == config.site

    def dated_results(name: str, value: str, date: str, sep: str) -> dict[str, Callable[[], DataFrame]]:
        dated = _dated(named[name], date, sep).withColumn(value, num_coerce(value))
        dated = dated.withColumn("week_number", F.col("week_number").cast("int"))
        total = F.coalesce(F.sum(value), F.lit(0.0))
        of_site = F.round(total, 3) if name == "metric_b" else total
        return {
            f"{name}_dashboard": lambda: dated,
            f"{name}_wide": lambda: pivot_wide_sum(dated, ["site"], "week_number", value, weeks),
            f"{name}_total": lambda: dated.groupBy("site").agg(total.alias(f"total_{name}")),
            f"site_{name}": lambda: dated.filter(one_site).groupBy("week").agg(of_site.alias(value)),
        }

    for name, (value, date, sep) in DATED.items():
        out |= dated_results(name, value, date, sep)

    causes = named["root_cause"]
    for edge in ("start", "end"):
        causes = str_split_cols(causes, edge, " ", [f"{edge}_date", f"{edge}_time"]).drop(edge)
        causes = causes.withColumn(f"{edge}_date", cal.date_parse(f"{edge}_date", "yyyy-MM-dd", strict=False))
        causes = causes.withColumn(f"{edge}_weekday", cal.date_names(f"{edge}_date", "weekday"))
    bps = F.coalesce(F.sum("metric_a_bps"), F.lit(0.0)).alias("bps")
    out["root_cause_dashboard"] = lambda: causes
    out["root_cause_by_process"] = lambda: causes.groupBy("process_path", "root_cause").agg(bps)
    out["root_cause_total"] = lambda: causes.groupBy("root_cause").agg(bps)

    def site_metric_a() -> DataFrame:
        return median_by_group(rate.filter(one_site), ["week"], "metric_a_rate").withColumnRenamed("median", "metric_a_rate")

    return Bundle({**out, "site_metric_a": site_metric_a})
