"""Column names as configuration: a report reads tables that name their columns otherwise."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

Names = Mapping[str, Mapping[str, str]]


def renamed(tables: Mapping[str, DataFrame], names: Names) -> dict[str, DataFrame]:
    """``tables`` under the report's column names; ``names``: table -> report's column -> column of the table.

    A column that already has a report's name and is replaced by another one is left out.
    """
    unknown = set(names) - set(tables)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    out = dict(tables)
    for table, columns in names.items():
        d = out[table]
        missing = sorted(set(columns.values()) - set(d.columns))
        if missing:
            raise ValueError(f"{table} has no columns {missing}")
        hidden = [c for c in columns if c in d.columns and c not in columns.values()]
        out[table] = d.drop(*hidden).withColumnsRenamed({own: report for report, own in columns.items()})
    return out


def accepts_names(report: Callable) -> Callable:
    """Give a report a ``names`` argument, see ``renamed``."""

    @functools.wraps(report)
    def run(tables: Mapping[str, DataFrame], *args, names: Names | None = None, **kwargs):
        return report(renamed(tables, names) if names else tables, *args, **kwargs)

    return run
