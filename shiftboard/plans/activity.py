"""Daily activity against sleep by person and weekday."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.text import str_split_cols
from ..operators.aggregate import count_distinct
from ..operators.joins import join_many_to_many
from ..operators.project import rename_columns
from ..operators.reshape import melt_long
from ..operators.stats import summary_stats, weighted_fit
from .bundle import Bundle
from .names import accepts_names

KEY = ["id", "weekday"]
# Measures stacked per weekday in the two charts.
ACTIVE = ("lightlyactiveminutes", "veryactiveminutes", "fairlyactiveminutes")
REST = ("totalminutesasleep", "sedentaryminutes")


@dataclass(frozen=True)
class ActivityConfig:
    activity_summary: Sequence[str] = ("totalsteps", "calories", "veryactiveminutes")
    sleep_summary: Sequence[str] = ("totalminutesasleep", "totaltimeinbed")
    #: places at which the fitted line and its band are given, and the band's confidence
    band: tuple[int, float] = (80, 0.95)


def prepared(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Lower-case headers, parsed dates and weekdays."""
    activity = rename_columns(tables["activity"], str.lower)
    activity = activity.withColumn("activitydate", cal.date_parse("activitydate", "M/d/yyyy"))
    activity = activity.withColumn("weekday", cal.date_names("activitydate", "weekday"))
    sleep = str_split_cols(rename_columns(tables["sleep"], str.lower), "sleepday", " ", ["date", "time"]).drop("sleepday")
    sleep = sleep.withColumn("date", cal.date_parse("date", "M/d/yyyy"))
    return activity, sleep.withColumn("weekday", cal.date_names("date", "weekday"))


@accepts_names
def report_activity_sleep(
    tables: Mapping[str, DataFrame], config: ActivityConfig = ActivityConfig()
) -> Bundle:
    """``tables``: ``activity`` (Id, ActivityDate M/d/yyyy, …) and ``sleep`` (Id, SleepDay, …).

    The two logs meet on (person, weekday), which neither holds once.  Weekday sums
    and the fit over the merged rows are worked out from per-key totals and
    repetition counts, so the merged rows themselves are never made.
    """
    activity, sleep = prepared(tables)
    merged = join_many_to_many(
        activity,
        sleep,
        KEY,
        {c: F.col(c) for c in (*ACTIVE, "sedentaryminutes")},
        {"totalminutesasleep": F.col("totalminutesasleep")},
    )
    weekday_sums = merged.groupBy("weekday").agg(
        F.sum("row_multiplier").alias("rows"), *[F.sum(c).alias(c) for c in (*ACTIVE, *REST)]
    )
    repeats = activity.groupBy(*KEY).agg(F.count("*").alias("times"))
    fitted = (sleep, KEY, "totaltimeinbed", "totalminutesasleep", repeats)
    return Bundle({
        "participants": lambda: count_distinct(activity, ["id"], count_null=True)
        .select(F.lit("activity").alias("log"), F.col("id").alias("participants"))
        .unionByName(
            count_distinct(sleep, ["id"], count_null=True).select(
                F.lit("sleep").alias("log"), F.col("id").alias("participants")
            )
        ),
        "activity_summary": lambda: summary_stats(activity, config.activity_summary),
        "sleep_summary": lambda: summary_stats(sleep, config.sleep_summary),
        "active_minutes": lambda: melt_long(weekday_sums, ["weekday"], ACTIVE, "activity_type", "minutes"),
        "rest_minutes": lambda: melt_long(weekday_sums, ["weekday"], REST, "rest_and_sleep", "minutes"),
        "fit": lambda: weighted_fit(*fitted),
        "fit_band": lambda: weighted_fit(*fitted, band=config.band),
    })
