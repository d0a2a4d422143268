"""Income shares by education, hours and country."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ratios import ratio_or_null
from ..operators.aggregate import argmax_key, value_counts
from ..operators.sets import dedupe_rows
from .bundle import Bundle
from .names import accepts_names


@dataclass(frozen=True)
class DemographicsConfig:
    rich: str = ">50K"
    higher: Sequence[str] = ("Bachelors", "Masters", "Doctorate")
    bachelor: str = "Bachelors"
    sex: str = "Male"
    least_hours: int = 1
    country: str = "India"


@accepts_names
def report_demographics(
    tables: Mapping[str, DataFrame], config: DemographicsConfig = DemographicsConfig()
) -> Bundle:
    """``tables``: ``people`` (age, education, race, sex, occupation, native_country,
    hours_per_week, salary), with exact repeats dropped first.

    ``figures`` one row of shares; ``races``; ``countries`` with their share of high
    earners; ``best_country``; ``top_occupation`` among one country's high earners.
    """
    people = dedupe_rows(tables["people"])
    rich = F.coalesce(F.col("salary") == config.rich, F.lit(False))
    higher = F.coalesce(F.col("education").isin(*config.higher), F.lit(False))
    least = F.coalesce(F.col("hours_per_week") == config.least_hours, F.lit(False))

    def share(part: Column, whole: Column) -> Column:
        return ratio_or_null(F.count_if(part & whole), F.count_if(whole)) * 100

    figures = people.agg(
        F.count("*").alias("people"),
        F.avg(F.when(F.col("sex") == config.sex, F.col("age"))).alias("average_age"),
        share(F.col("education") == config.bachelor, F.col("education").isNotNull()).alias("bachelor_pct"),
        share(rich, higher).alias("higher_education_rich_pct"),
        share(rich, ~higher).alias("lower_education_rich_pct"),
        F.min("hours_per_week").alias("min_hours"),
        share(rich, least).alias("least_hours_rich_pct"),
    )
    countries = (
        people.filter(F.col("native_country").isNotNull())
        .groupBy("native_country")
        .agg(F.count("*").alias("people"), F.count_if(rich).alias("rich"))
        # a country without high earners has no count to divide, hence no share
        .withColumn("rich_pct", ratio_or_null(F.nullif(F.col("rich"), F.lit(0)), "people") * 100)
    )
    earners = people.filter(rich & (F.col("native_country") == config.country))
    return Bundle({
        "figures": lambda: figures,
        "races": lambda: value_counts(people, "race"),
        "countries": lambda: countries,
        "best_country": lambda: argmax_key(countries, "native_country", "rich_pct"),
        "top_occupation": lambda: value_counts(earners, "occupation", 1),
    })
