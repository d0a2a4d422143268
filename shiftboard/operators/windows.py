"""Trend columns over the last *n* rows of a group, and category encodings.

The trend columns expect one row per group and period (an aggregate), so a
window partition holds as many rows as there are periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ratios import ratio_or_null
from .ordered import exact_quantiles, row_number_global


def _over(part: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*part).orderBy(*order)


def lag_n(c: str, n: int, part: Sequence[str], order: Sequence[str]) -> Column:
    """The value ``n`` rows earlier - rows, not days."""
    return F.lag(c, n).over(_over(part, order))


def change(now: Column, before: Column, kind: str) -> Column:
    """Relative (``pct``, NULL on a zero base) or absolute (``abs``) change."""
    if kind == "pct":
        return ratio_or_null(now - before, before) * 100
    return now - before


def wow_change(c: str, n: int, part: Sequence[str], order: Sequence[str], kind: str = "pct") -> Column:
    return change(F.col(c), lag_n(c, n, part, order), kind)


def moving_avg_7(c: str, part: Sequence[str], order: Sequence[str], n: int = 7) -> Column:
    """Mean of this and the ``n - 1`` rows before; shorter at the start."""
    return F.avg(c).over(_over(part, order).rowsBetween(1 - n, 0))


def label_encode(d: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Code = rank of the category in sorted order from 0; missing gives -1."""
    name = name or f"{c}_code"
    categories = d.filter(F.col(c).isNotNull()).select(c).distinct()
    codes = row_number_global(categories, [c], "__rank").select(c, (F.col("__rank") - 1).cast("int").alias(name))
    return d.join(codes, c, "left").select(
        *d.columns, F.coalesce(F.col(name), F.lit(-1)).alias(name)
    )


def quantile_cut(d: DataFrame, c: str, q: int, labels: Sequence[str], name: str = "bucket") -> DataFrame:
    """``q`` quantile bins, closed on the right; equal values share a bin."""
    if len(labels) != q:
        raise ValueError("one label per bin")
    probs = {f"e{i}": i / q for i in range(1, q)}
    # q - 1 edges, read first and compared as literals
    edges = exact_quantiles(d, [], c, probs).first()
    v = F.col(c)
    out = F.when(v.isNull() | F.lit(edges is None), F.lit(None).cast("string"))
    for i, label in enumerate(labels[:-1], start=1):
        out = out.when(v <= F.lit(edges and edges[f"e{i}"]), label)
    return d.withColumn(name, out.otherwise(labels[-1]))
