"""Guarded ratios and the rates built from them.

Every division states what a zero or missing denominator gives: NULL
(``ratio_or_null``) or 0 (``ratio_or_zero``).  Division is always fractional.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .calendar import ColumnLike, _c


def ratio_or_null(num: ColumnLike, den: ColumnLike) -> Column:
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def ratio_or_zero(num: ColumnLike, den: ColumnLike) -> Column:
    """0 unless the denominator is positive."""
    den = _c(den).cast("double")
    return F.when(den > 0, _c(num).cast("double") / F.nullif(den, F.lit(0.0))).otherwise(F.lit(0.0))


def ratio_bps(num: ColumnLike, den: ColumnLike, guard: str = "null") -> Column:
    """Share in basis points; ``guard`` is ``"null"`` or ``"zero"``."""
    ratio = {"null": ratio_or_null, "zero": ratio_or_zero}[guard]
    return ratio(num, den) * 10_000


def rate_dpmo(num: ColumnLike, den: ColumnLike) -> Column:
    """Defects per million opportunities."""
    return ratio_or_null(num, den) * 1_000_000


def pct_diff_raw(actual: ColumnLike, base: ColumnLike) -> Column:
    return ratio_or_null(_c(actual).cast("double") - _c(base).cast("double"), base) * 100


def pct_diff(actual: ColumnLike, base: ColumnLike, digits: int = 2) -> Column:
    """Percent difference from ``base``, rounded half up."""
    return F.round(pct_diff_raw(actual, base), digits)


def alignment_status(diff: ColumnLike, limit: float = 5, null_status: str = "Aligned") -> Column:
    """``Not Aligned`` where the absolute difference exceeds ``limit``.

    A missing difference counts as ``null_status``: ``Aligned`` in the SQL
    templates, ``Not Aligned`` in the notebook ones.
    """
    diff = _c(diff)
    return (
        F.when(diff.isNull(), null_status)
        .when(F.abs(diff) > limit, "Not Aligned")
        .otherwise("Aligned")
    )


def round_half_even(c: ColumnLike, digits: int) -> Column:
    """Half-even rounding, as array libraries do; float noise is rounded off first."""
    return F.bround(F.round(_c(c), digits + 6), digits)
