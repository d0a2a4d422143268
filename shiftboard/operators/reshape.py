"""Wide/long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def _listed(d: DataFrame, c: str) -> list[Any]:
    """Distinct values, sorted: they become columns, so Spark's own limit for pivots holds."""
    most = int(d.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = d.filter(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{c} has more than {most} values (spark.sql.pivotMaxValues); keep it long")
    return sorted(r[0] for r in found)


def _within(names: str, levels: Sequence[Any], drop_other: bool) -> Column:
    """The pivot column; a value outside ``levels`` raises while running, or is NULL."""
    c = F.col(names)
    other = F.lit(None) if drop_other else F.raise_error(F.concat(F.lit(f"{names} is not a declared level: "), c.cast("string")))
    return F.when(c.isin(*levels) | c.isNull(), c).otherwise(other) if levels else F.when(c.isNull(), c).otherwise(other)


def pivot_wide_sum(
    d: DataFrame,
    ids: Sequence[str],
    names: str,
    values: str,
    levels: Sequence[Any] | None = None,
    fill: float = 0,
    drop_other: bool = False,
) -> DataFrame:
    """Long to wide: repeats summed, absent cells filled, columns in ``levels`` order.

    Without ``levels`` every value found becomes a column, sorted.  Declared levels fix the schema and
    spare the job that lists them; a value outside them raises, unless ``drop_other`` leaves it out.
    """
    rows = d.filter(F.col(values).isNotNull() & F.col(names).isNotNull())
    if levels is None:
        levels = _listed(rows, names)
    else:
        rows = rows.withColumn(names, _within(names, levels, drop_other)).filter(F.col(names).isNotNull())
    wide = rows.groupBy(*ids).pivot(names, list(levels)).agg(F.sum(values))
    return wide.na.fill(fill, subset=[str(x) for x in levels])


def pivot_wide_plain(
    d: DataFrame, ids: Sequence[str], names: str, values: str, levels: Sequence[Any] | None = None, drop_other: bool = False
) -> DataFrame:
    """Long to wide without fill; a cell given twice raises while running.  ``levels`` as in ``pivot_wide_sum``."""
    if levels is None:
        levels = _listed(d, names)
    else:
        d = d.withColumn(names, _within(names, levels, drop_other))
    once = F.when(F.count("*") <= 1, F.max(values)).otherwise(
        F.raise_error(F.lit("more than one row for a pivot cell")).cast(d.schema[values].dataType)
    )
    cells = d.groupBy(*ids, names).agg(once.alias(values))
    return cells.groupBy(*ids).pivot(names, list(levels)).agg(F.first(values))


def melt_long(d: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide to long in one scan; NULL values keep their rows."""
    return d.unpivot(list(ids), list(values), var, val)


def metric_unpivot(
    d: DataFrame, ids: Sequence[str], catalog: Sequence[Mapping[str, Any]], drop_null: bool
) -> DataFrame:
    """One row per catalog entry: its labels, and the measure named by ``column``.

    The catalog is a constant list, so every branch comes from a single pass.
    """
    entries = [
        F.struct(
            *[F.lit(v).alias(k) for k, v in entry.items() if k != "column"],
            F.col(entry["column"]).cast("double").alias("metric_value"),
        )
        for entry in catalog
    ]
    long = d.select(*ids, F.inline(F.array(*entries)))
    return long.filter(F.col("metric_value").isNotNull()) if drop_null else long


def melt_group_count(d: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows per (ids, variable, value)."""
    return (
        d.unpivot(list(ids), list(values), "variable", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(*ids, "variable", "value")
        .agg(F.count("*").alias("total"))
    )


def nested_explode(d: DataFrame, c: str, depth: int = 1, name: str = "item") -> DataFrame:
    """One row per innermost element of ``depth`` levels of arrays; one generator for all levels."""
    rest = [x for x in d.columns if x != c]
    inner = F.col(c)
    for _ in range(depth - 1):
        inner = F.flatten(F.filter(inner, lambda x: x.isNotNull()))
    return d.select(*rest, F.explode(inner).alias(name))


def one_hot(d: DataFrame, c: str, levels: Sequence[Any] | None = None, prefix: str = "") -> DataFrame:
    """A 0/1 column per category.  Without ``levels`` they are listed first; wide categories belong in ``one_hot_long``."""
    levels = _listed(d, c) if levels is None else levels
    return d.withColumns(
        {f"{prefix}{x}": F.coalesce((F.col(c) == F.lit(x)).cast("int"), F.lit(0)) for x in levels}
    )


def one_hot_long(d: DataFrame, c: str, ids: Sequence[str]) -> DataFrame:
    """``(ids…, category, value 1)`` rows: the cells of ``one_hot`` that are not 0, for any number of categories."""
    return d.filter(F.col(c).isNotNull()).select(*ids, F.col(c).alias("category"), F.lit(1).alias("value"))
