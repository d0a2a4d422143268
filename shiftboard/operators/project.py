"""Column selection, naming and derivation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def project_columns(
    d: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None
) -> DataFrame:
    """Keep (and order) or drop columns; dropping an absent column is no error."""
    if keep is not None:
        d = d.select(*keep)
    return d.drop(*drop) if drop else d


def rename_columns(d: DataFrame, names: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    if callable(names):
        return d.toDF(*[names(c) for c in d.columns])
    return d.withColumnsRenamed(dict(names))


def positional_header(d: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace all headers by position; blank names become ``temp_col_1``, ``temp_col_2``…"""
    filled, blanks = [], 0
    for name in names:
        if not name:
            blanks += 1
            name = f"temp_col_{blanks}"
        filled.append(name)
    return d.toDF(*filled)


def star_plus_derived(d: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    return d.withColumns(dict(derived))


def derive_arithmetic(d: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Add computed columns; a NULL operand makes the result NULL."""
    return d.withColumns(dict(derived))


def point_update(d: DataFrame, cond: Column, values: Mapping[str, Any]) -> DataFrame:
    """Set columns on the rows where ``cond`` holds."""
    return d.withColumns(
        {c: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    )
