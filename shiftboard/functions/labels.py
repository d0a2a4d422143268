"""Columns that name a value: bands, flags, code lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, functions as F

from .calendar import ColumnLike, _c

Band = tuple[float | None, float | None, str]


def band_case(c: ColumnLike, bands: Sequence[Band], default: str | None = None) -> Column:
    """First ``(lo, hi, label)`` with ``lo <= c < hi``; an open end is ``None``."""
    c = _c(c)
    out = None
    for lo, hi, label in bands:
        test = c.isNotNull()
        if lo is not None:
            test = test & (c >= lo)
        if hi is not None:
            test = test & (c < hi)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(default))


def binary_flag(cond: Column, yes: Any = 1, no: Any = 0, null_as: Any = None) -> Column:
    """``yes``/``no`` from a predicate; a NULL predicate gives ``null_as`` or ``no``."""
    return F.when(cond, yes).when(cond.isNull(), no if null_as is None else null_as).otherwise(no)


def _literal_map(mapping: Mapping[Any, Any]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def code_to_label(c: ColumnLike, mapping: Mapping[Any, Any]) -> Column:
    """Mapped label, or the original value where the code is not listed."""
    c = _c(c)
    return F.coalesce(F.try_element_at(_literal_map(mapping), c), c)


def code_to_number(c: ColumnLike, mapping: Mapping[str, int]) -> Column:
    """Mapped number, NULL where the code is not listed."""
    return F.try_element_at(_literal_map(mapping), _c(c))


def username_length_rule(c: ColumnLike, shortest: int = 8, longest: int = 15) -> Column:
    """``valid`` / ``too short`` / ``too long`` by text length, limits included."""
    return band_case(
        F.length(_c(c)),
        [(None, shortest, "too short"), (shortest, longest + 1, "valid"), (longest + 1, None, "too long")],
    )


# Score bands on the 1-10 scale, [lo, hi).
SCORE_BANDS = ((1, 6, "Negative"), (6, 9, "Neutral"), (9, 11, "Positive"))


def score_band(c: ColumnLike) -> Column:
    return band_case(c, SCORE_BANDS)
