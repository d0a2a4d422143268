"""Health screen: body mass, normalised flags, counts by condition, correlations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import binary_flag
from ..functions.text import bmi, unit_convert
from ..operators.reshape import melt_group_count
from ..operators.stats import corr_matrix, quantile_trim
from .bundle import Bundle
from .names import accepts_names

# The columns counted per condition, in order.
COUNTED = ("cholesterol", "gluc", "smoke", "alco", "active")


@dataclass(frozen=True)
class HealthConfig:
    overweight: float = 25
    lo: float = 0.025
    hi: float = 0.975


def screened(exams: DataFrame, config: HealthConfig) -> DataFrame:
    return exams.withColumns(
        {
            "bmi": bmi("weight", "height"),
            "cholesterol": binary_flag(F.col("cholesterol") == 1, 0, 1, null_as=1),
            "gluc": binary_flag(F.col("gluc") == 1, 0, 1, null_as=1),
            "years_old": unit_convert("age", "days_to_years"),
        }
    ).withColumn("overweight", binary_flag(F.col("bmi") > config.overweight))


@accepts_names
def report_health_screen(
    tables: Mapping[str, DataFrame], config: HealthConfig = HealthConfig()
) -> Bundle:
    """``tables``: ``exams`` (age in days, height, weight, ap_hi, ap_lo, cholesterol,
    gluc, smoke, alco, active, cardio).

    ``counts`` per (cardio, variable, value); ``corr`` lower triangle over rows
    with plausible pressure and trimmed height and weight.
    """
    rows = screened(tables["exams"], config)

    def correlations() -> DataFrame:
        trimmed = quantile_trim(rows, ["height", "weight"], config.lo, config.hi)
        return corr_matrix(trimmed.filter(F.col("ap_lo") <= F.col("ap_hi")), numeric)

    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
    return Bundle({
        "counts": lambda: melt_group_count(rows, ["cardio"], COUNTED),
        "corr": correlations,
    })
