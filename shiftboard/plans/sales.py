"""Sales exploration: means, distributions, counts and filtered counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..functions.text import str_concat
from ..operators.aggregate import value_counts
from ..operators.stats import box_stats, histogram_bins, kde_density
from .bundle import Bundle
from .names import accepts_names


@dataclass(frozen=True)
class SalesConfig:
    year: int = 2016
    months: Sequence[str] = ("May", "June", "July")
    countries: Sequence[str] = ("Canada", "France")
    country: str = "Canada"
    sub_category: str = "Bike Racks"
    states_of: str = "France"
    categories: Sequence[str] = ("Accessories", "Bikes")
    added_revenue: float = 50
    bins: int = 30
    grid: int = 1000


@accepts_names
def report_sales_eda(tables: Mapping[str, DataFrame], config: SalesConfig = SalesConfig()) -> Bundle:
    """``tables``: ``sales`` (year, month name, day, customer_age, country, state,
    product_category, sub_category, product, order_quantity, profit, revenue)."""
    sales = tables["sales"]
    in_countries = F.col("country").isin(*config.countries)
    in_months = (F.col("year") == config.year) & F.col("month").isin(*config.months)

    def figures() -> DataFrame:
        return sales.agg(
            F.avg("customer_age").alias("mean_age"),
            F.avg("order_quantity").alias("mean_quantity"),
            F.sum(F.col("revenue") + config.added_revenue).alias("revenue"),
            F.count_if(in_countries).alias("in_countries"),
            F.count_if(
                (F.col("country") == config.country) & (F.col("sub_category") == config.sub_category)
            ).alias("country_sub_category"),
            F.count_if(in_months).alias("in_months"),
        )

    def sub_categories() -> DataFrame:
        wanted = F.col("product_category").isin(*config.categories) & F.col("sub_category").isNotNull()
        return sales.filter(wanted).groupBy("product_category", "sub_category").agg(F.count("*").alias("n"))

    def date_counts() -> DataFrame:
        written = str_concat([F.col(c).cast("string") for c in ("year", "month", "day")], ".")
        return value_counts(
            sales.select(cal.date_parse(written, "yyyy.MMMM.d").alias("calculated_date")), "calculated_date"
        )

    return Bundle(
        {
            "figures": figures,
            "year_counts": lambda: value_counts(sales, "year"),
            "month_counts": lambda: value_counts(sales, "month"),
            "country_counts": lambda: value_counts(sales, "country"),
            "products": lambda: value_counts(sales, "product", 10),
            "states": lambda: value_counts(sales.filter(F.col("country") == config.states_of), "state"),
            "sub_categories": sub_categories,
            "date_counts": date_counts,
            "quantity_histogram": lambda: histogram_bins(sales, "order_quantity", bins=config.bins),
            "age_box": lambda: box_stats(sales, [], "customer_age"),
            "quantity_box": lambda: box_stats(sales, [], "order_quantity"),
            "profit_by_country": lambda: box_stats(sales, ["country"], "profit"),
            "profit_by_month": lambda: box_stats(sales.filter(F.col("year") == config.year), ["month"], "profit"),
            "age_density": lambda: kde_density(sales, "customer_age", config.grid),
        }
    )
