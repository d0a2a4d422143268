"""Cost variance by facility and week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import code_to_label
from ..operators.aggregate import cost_share_bps
from ..operators.joins import join_dim_enrich
from .names import accepts_names

# Country names by region code.
COUNTRIES = {
    "AT": "Austria",
    "BE": "Belgium",
    "DE": "Germany",
    "ES": "Spain",
    "CZ": "Czech Republic",
    "FR": "France",
    "GB": "United Kingdom",
    "IE": "Ireland",
    "IT": "Italy",
    "LU": "Luxembourg",
    "NL": "Netherlands",
    "PL": "Poland",
    "PT": "Portugal",
    "SE": "Sweden",
    "TR": "Turkey",
}
# Cost categories and the column prefix each reports under.
CATEGORIES = {
    "labor_backlog": "Labor_Backlog",
    "equipment_exception": "Equipment_Exception",
    "execution_variance": "Execution_Variance",
    "planning_variance": "Planning_Variance",
}


@dataclass(frozen=True)
class CostConfig:
    report_floor: dt.date = dt.date(2024, 12, 26)
    countries: Mapping[str, str] = field(default_factory=lambda: dict(COUNTRIES))
    categories: Mapping[str, str] = field(default_factory=lambda: dict(CATEGORIES))


@accepts_names
def report_cost_variance(tables: Mapping[str, DataFrame], config: CostConfig = CostConfig()) -> DataFrame:
    """Over-budget cost per category, in basis points of the weekly plan and in amount.

    ``tables``: ``costs`` (facility_code, week_number, year, region_code,
    cost_category, over_budget, planned_cost, start_of_week) and ``facilities``.
    Facts are read once and reduced once; weekly totals come from the reduced rows.
    """
    week = ["facility_code", "year", "week_number"]
    shares = cost_share_bps(
        tables["costs"],
        week,
        [*week, "start_of_week", "region_code", "cost_category"],
        "planned_cost",
        F.col("over_budget") > 0,
    )
    category = F.col("cost_category")
    cases = {n: category == v for n, v in config.categories.items()}
    cases["unknown_variance"] = category.isNull() | (category == "")

    def total(measure: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(measure)).otherwise(F.lit(0.0)))

    summary = shares.groupBy(
        "facility_code",
        F.col("start_of_week").alias("date"),
        code_to_label("region_code", config.countries).alias("country_name"),
    ).agg(
        *[total("variance_bps", cond).alias(f"{n}_bps") for n, cond in cases.items()],
        *[total("affected", cond).alias(f"{n}_cost_affected") for n, cond in cases.items()],
    )
    late = summary.filter(F.col("date") > F.lit(config.report_floor))
    return join_dim_enrich(late, tables["facilities"], "facility_code", ["facility_type", "region_name", "hub_name"])
