"""Profiles, missing values and rule checks, each in one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import code_to_label, score_band
from .aggregate import value_counts


def _rows_of(one: DataFrame, names: Sequence[str], fields: Mapping[str, Any]) -> DataFrame:
    """One row per column from a one-row aggregate; ``fields`` map a name to its Column."""
    structs = [
        F.struct(F.lit(n).alias("column"), *[f(i, n).alias(k) for k, f in fields.items()])
        for i, n in enumerate(names)
    ]
    return one.select(F.inline(F.array(*structs)))


def table_profile(d: DataFrame) -> DataFrame:
    """Type, non-null count, rows, columns and cells, one row per column."""
    names, types = d.columns, dict(d.dtypes)
    one = d.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"__{i}") for i, c in enumerate(names)])
    width = len(names)
    return _rows_of(
        one,
        names,
        {
            "dtype": lambda i, n: F.lit(types[n]),
            "non_null": lambda i, n: F.col(f"__{i}"),
            "rows": lambda i, n: F.col("rows"),
            "columns": lambda i, n: F.lit(width),
            "cells": lambda i, n: F.col("rows") * width,
        },
    )


def missing_counts(d: DataFrame) -> DataFrame:
    names = d.columns
    one = d.agg(*[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(names)])
    return _rows_of(
        one,
        names,
        {
            "missing": lambda i, n: F.col(f"__{i}"),
            "any_missing": lambda i, n: F.col(f"__{i}") > 0,
        },
    )


def any_missing(d: DataFrame, cols: Sequence[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols or d.columns])


def rows_with_missing(d: DataFrame, by: str | None = None) -> DataFrame:
    """Rows with a missing value, or their number by ``by``."""
    rows = d.filter(any_missing(d))
    return rows if by is None else value_counts(rows, by)


def drop_missing_rows(d: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return d.dropna(subset=list(cols) if cols else None)


def drop_missing_cols(d: DataFrame) -> DataFrame:
    """Drop columns that hold any NULL; one counting job decides which."""
    counts = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in d.columns]).first()
    return d.select(*[c for c in d.columns if counts[c] == 0])


def missing_cost_report(d: DataFrame) -> DataFrame:
    """Share of cells lost by dropping incomplete rows, or incomplete columns."""
    names = d.columns
    one = d.agg(
        F.count("*").alias("n"),
        F.count_if(~any_missing(d)).alias("complete"),
        *[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(names)],
    )
    full_cols = reduce(lambda a, b: a + b, [(F.col(f"__{i}") == 0).cast("bigint") for i in range(len(names))])
    cells = one.select(
        (F.col("n") * len(names)).alias("cells"),
        (F.col("complete") * len(names)).alias("cells_after_row_drop"),
        (F.col("n") * full_cols).alias("cells_after_col_drop"),
    )

    def lost(after: str) -> Column:
        return F.try_divide((F.col("cells") - F.col(after)).cast("double"), F.col("cells").cast("double"))

    return cells.withColumns(
        {"row_drop_share": lost("cells_after_row_drop"), "col_drop_share": lost("cells_after_col_drop")}
    )


def domain_check(
    d: DataFrame, c: str, allowed: Sequence[Any], repair: Mapping[Any, Any] | None = None
) -> DataFrame:
    """Values outside the allowed list with their row counts, before and after repair.

    ``stage`` is ``before`` or ``after``; a clean column gives no rows.
    """
    counted = d.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    fixed = code_to_label(c, repair) if repair else F.col(c)
    stages = F.array(
        F.struct(F.lit("before").alias("stage"), F.col(c).alias("value")),
        F.struct(F.lit("after").alias("stage"), fixed.alias("value")),
    )
    return (
        counted.select(F.inline(stages), "n")
        .filter(~F.col("value").isin(*allowed))
        .groupBy("stage", "value")
        .agg(F.sum("n").alias("n"))
    )


def rule_check(d: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break rules, one row per broken rule; a rule that is NULL is not broken."""
    broken = F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return d.select("*", F.explode(F.array_compact(broken)).alias("rule"))


def rule_repair(d: DataFrame, rules: Mapping[str, Column], repairs: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Rows with the columns that broken rules repair; rules run in turn, each over what the ones before it left.

    ``repairs`` maps a rule to new values by column.  What a repair cannot mend still shows in ``rule_check``.
    """
    unknown = set(repairs) - set(rules)
    if unknown:
        raise ValueError(f"repairs without a rule: {sorted(unknown)}")
    types = {f.name: f.dataType for f in d.schema.fields}
    for name, rule in rules.items():
        new = {c: F.when(~rule, v.cast(types[c])).otherwise(F.col(c)) for c, v in repairs.get(name, {}).items()}
        d = d.withColumns(new) if new else d
    return d


def score_bands(d: DataFrame, c: str) -> DataFrame:
    """Scores per band; out-of-range scores count nowhere."""
    band = score_band(c)
    return d.agg(*[F.count_if(band == b).alias(b.lower()) for b in ("Negative", "Neutral", "Positive")])
