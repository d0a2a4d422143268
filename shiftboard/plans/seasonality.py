"""Seasonality of dated event counts: days, weeks, months, quarters, places."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.text import fmt_number, str_slice
from ..operators.aggregate import percent_of_total, value_counts
from ..operators.filters import filter_period
from ..operators.sets import concat_frames, top_n
from ..operators.stats import box_stats
from .bundle import Bundle
from .names import accepts_names


@dataclass(frozen=True)
class SeasonalityConfig:
    year: int
    places: int = 40
    days: int = 10


@accepts_names
def report_event_seasonality(tables: Mapping[str, DataFrame], config: SeasonalityConfig) -> Bundle:
    """``tables``: ``current`` and ``earlier`` (date, strikes, place; extra columns dropped).

    ``month_share`` month's part of its year; ``weekday_mean`` and ``weekday_box``
    of the current frame; ``weeks`` and ``months`` of one year; ``quarters``;
    ``top_days``; ``top_places``.
    """
    current = tables["current"]
    extra = [c for c in current.columns if c not in tables["earlier"].columns]
    both = concat_frames([current, tables["earlier"]], drop=extra)

    monthly = both.select(
        F.year("date").alias("year"), cal.date_names("date", "month").alias("month_txt"), "strikes"
    )
    month_share = percent_of_total(monthly, ["month_txt", "year"], "strikes", ["year"])
    weekdays = current.select(cal.date_names("date", "weekday").alias("weekday"), "strikes")
    year = filter_period(both, "date", year=config.year)
    quarter = both.groupBy(cal.period_labels("date", "quarter").alias("quarter")).agg(F.sum("strikes").alias("strikes"))
    return Bundle({
        "month_share": lambda: month_share,
        "weekday_mean": lambda: weekdays.groupBy("weekday").agg(F.avg("strikes").alias("mean_strikes")),
        "weekday_box": lambda: box_stats(weekdays, ["weekday"], "strikes"),
        "weeks": lambda: year.groupBy(cal.period_labels("date", "week").alias("week")).agg(F.sum("strikes").alias("strikes")),
        "months": lambda: year.groupBy(
            F.month("date").alias("month"), cal.date_names("date", "month3").alias("month_txt")
        ).agg(F.sum("strikes").alias("strikes")),
        "quarters": lambda: quarter.withColumns(
            {
                "strikes_formatted": fmt_number("strikes", "millions", 1),
                "quarter_number": str_slice("quarter", -2),
                "year": str_slice("quarter", 0, 4),
            }
        ),
        "top_days": lambda: top_n(
            current.groupBy(F.to_date("date").alias("date")).agg(F.sum("strikes").alias("strikes")),
            "strikes",
            config.days,
            "date",
        ),
        "top_places": lambda: value_counts(current, "place", config.places),
    })
