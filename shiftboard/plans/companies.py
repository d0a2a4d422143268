"""Company valuations: validation, time to milestone, valuations by place and quarter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.labels import code_to_label, code_to_number
from ..functions.text import str_slice, str_strip_chars
from ..operators import quality
from ..operators.filters import filter_period
from ..operators.sets import skip_top_n
from ..operators.stats import box_stats
from ..operators.windows import quantile_cut
from .bundle import Bundle
from .names import accepts_names

# Continent numbers and industry spellings with their repairs.
CONTINENTS = {"North America": 1, "Asia": 2, "Europe": 3, "South America": 4, "Oceania": 5, "Africa": 6}
INDUSTRIES = (
    "Artificial intelligence",
    "Other",
    "E-commerce & direct-to-consumer",
    "Fintech",
    "Internet software & services",
    "Supply chain, logistics, & delivery",
    "Consumer & retail",
    "Data management & analytics",
    "Edtech",
    "Health",
    "Hardware",
    "Auto & transportation",
    "Travel",
    "Cybersecurity",
    "Mobile & telecommunications",
)
REPAIRS = {
    "Artificial Intelligence": "Artificial intelligence",
    "Data management and analytics": "Data management & analytics",
    "FinTech": "Fintech",
}


@dataclass(frozen=True)
class CompanyConfig:
    quarters_of: Sequence[int] = (2020, 2021)
    week_year: int = 2021
    biggest: int = 4
    #: company -> founding year to use instead
    founded: Mapping[str, int] = field(default_factory=dict)
    industries: Sequence[str] = INDUSTRIES
    repairs: Mapping[str, str] = field(default_factory=lambda: dict(REPAIRS))
    continents: Mapping[str, int] = field(default_factory=lambda: dict(CONTINENTS))
    #: labels of the lower and upper half, in that order as published
    halves: Sequence[str] = ("high", "low")


def validated(companies: DataFrame, config: CompanyConfig) -> DataFrame:
    """Valuation as a number, repaired industry and founding year, years to milestone."""
    founded: Column = F.col("year_founded")
    if config.founded:
        founded = F.coalesce(code_to_number("company", config.founded), founded)
    return companies.withColumns(
        {
            "valuation_num": str_strip_chars("valuation", "$B").cast("bigint"),
            "industry": code_to_label("industry", config.repairs),
            "year_joined": F.year("date_joined"),
            "month_joined": cal.date_names("date_joined", "month"),
            "year_founded": founded,
            "continent_number": code_to_number("continent", config.continents),
        }
    ).withColumn("years_to_join", F.col("year_joined") - F.col("year_founded"))


@accepts_names
def report_company_valuation(
    tables: Mapping[str, DataFrame], config: CompanyConfig = CompanyConfig()
) -> Bundle:
    """``tables``: ``companies`` (company, valuation ``$180B``, date_joined, industry,
    city, country, continent, year_founded)."""
    raw = tables["companies"]
    clean = validated(raw, config)
    by_country = clean.groupBy("country").agg(F.sum("valuation_num").alias("valuation"))
    by_industry = clean.groupBy("industry").agg(
        F.max("years_to_join").alias("max_years"),
        F.max("valuation_num").alias("max_valuation"),
        F.count("*").alias("companies"),
    )
    years = sorted(config.quarters_of)
    quarters = [f"{y}-Q{q}" for y in years for q in (1, 2, 3, 4)]
    per_quarter = (
        filter_period(clean, "date_joined", quarters=quarters)
        .groupBy(cal.period_labels("date_joined", "quarter").alias("quarter"))
        .agg(F.avg("valuation_num").alias("avg_valuation"))
    )
    per_week = (
        filter_period(clean, "date_joined", year=config.week_year)
        .groupBy(cal.period_labels("date_joined", "week").alias("week"))
        .agg(F.count("company").alias("companies"))
    )

    def halves() -> DataFrame:
        cut = quantile_cut(clean, "valuation_num", 2, config.halves, "valuation_half")
        return cut.groupBy("valuation_half", "continent_number").agg(F.count("*").alias("companies"))

    return Bundle({
        "impossible": lambda: quality.rule_check(
            clean.select("company", "year_joined", "year_founded", "years_to_join"),
            {"joined before founded": F.col("years_to_join") >= 0},
        ),
        "industry_check": lambda: quality.domain_check(raw, "industry", config.industries, config.repairs),
        "missing_cost": lambda: quality.missing_cost_report(raw),
        "missing_by_country": lambda: quality.rows_with_missing(raw, "country"),
        "by_industry": lambda: by_industry,
        "by_country": lambda: skip_top_n(by_country.filter(F.col("country").isNotNull()), "valuation", config.biggest, "country"),
        "per_quarter": lambda: per_quarter.withColumns(
            {"quarter_number": str_slice("quarter", -2), "year_joined": str_slice("quarter", 0, 4)}
        ),
        "per_week": lambda: per_week,
        "years_by_month": lambda: box_stats(clean.filter(F.col("years_to_join").isNotNull()), ["month_joined"], "years_to_join"),
        "years_by_founding": lambda: clean.groupBy("year_founded").agg(F.avg("years_to_join").alias("avg_num_yrs")),
        "halves": halves,
    })
