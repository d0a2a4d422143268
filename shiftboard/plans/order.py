"""The row order each report is read in, applied by the caller at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.sets import sort_multi

# Order of the reports' rows, (column, direction).
ORDERS = {
    "report_kpi_trend": (("facility_id", "asc"), ("date", "asc")),
    "report_cost_variance": (("facility_code", "asc"), ("date", "asc")),
    "report_ops_metrics": (("facility_code", "asc"), ("process_date", "asc")),
    "report_cancellation": (("facility_id", "asc"), ("aggregation_level", "desc"), (("date", "week_start_date"), "asc")),
}


def report_order(d: DataFrame, report: str) -> DataFrame:
    """``d`` sorted as ``report`` is read; missing values last.

    Sorting is left to the edge because a sorted frame that is written, joined or grouped again is sorted for nothing.
    """
    keys = [
        (F.coalesce(*c) if isinstance(c, tuple) else c, direction, "last") for c, direction in ORDERS[report]
    ]
    return sort_multi(d, keys)
