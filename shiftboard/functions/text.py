"""Text and number columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .calendar import ColumnLike, _c


def str_strip_chars(c: ColumnLike, chars: str) -> Column:
    """Remove any of ``chars`` from both ends."""
    return F.btrim(_c(c), F.lit(chars))


def str_rstrip_iso(c: ColumnLike, compat: bool = False) -> Column:
    """Date of an ISO instant such as ``2025-01-10T00:00:00.000Z``.

    ``compat=True`` reproduces stripping the suffix as a *set* of trailing
    characters, which also eats the zero of day 10, 20 and 30.
    """
    c = _c(c)
    if compat:
        return F.to_date(F.rtrim(c, F.lit("T0:.Z")), "yyyy-M-d")
    return F.to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def str_replace(c: ColumnLike, pairs: Mapping[str, str]) -> Column:
    """Literal replacements, applied in order."""
    out = _c(c)
    for old, new in pairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def str_trim_len(c: ColumnLike) -> Column:
    return F.length(F.trim(_c(c)))


def str_split_cols(d: DataFrame, c: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Split ``c`` on a literal separator; surplus pieces drop, missing ones are NULL."""
    pieces = F.split(F.col(c), r"\Q" + sep + r"\E")
    return d.withColumns({n: F.get(pieces, F.lit(i)) for i, n in enumerate(names)})


def str_slice(c: ColumnLike, start: int, stop: int | None = None) -> Column:
    """Half-open slice by position; negative positions count from the end."""
    c = _c(c)
    size = F.length(c)

    def at(pos: int | None) -> Column:
        if pos is None:
            return size
        return F.least(F.lit(pos), size) if pos >= 0 else F.greatest(size + pos, F.lit(0))

    lo, hi = at(start), at(stop)
    return F.substr(c, lo + 1, F.greatest(hi - lo, F.lit(0)))


def str_concat(cols: Sequence[ColumnLike], sep: str = "") -> Column:
    """Joined text; NULL if any part is NULL."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        parts.append(_c(c))
    return F.concat(*parts)


def str_case(c: ColumnLike, kind: str) -> Column:
    return {"title": F.initcap, "lower": F.lower, "upper": F.upper}[kind](_c(c))


def fmt_number(c: ColumnLike, kind: str, digits: int = 2) -> Column:
    """Number as text: ``pct`` 12.35%, ``share`` 0.1235 -> 12%, ``millions`` 1.5M."""
    x = _c(c).cast("double")
    x, suffix = {"pct": (x, "%%"), "share": (x * 100, "%%"), "millions": (x / 1e6, "M")}[kind]
    text = F.format_string(f"%.{digits}f{suffix}", F.round(x, digits))
    return F.when(x.isNotNull(), text)


def num_coerce(c: ColumnLike, type_name: str = "double") -> Column:
    """Number, or NULL where the text is not one."""
    return F.trim(_c(c).cast("string")).try_cast(type_name)


def null_coalesce(cols: Sequence[ColumnLike]) -> Column:
    return F.coalesce(*[_c(c) for c in cols])


def num_math(op: str, c: ColumnLike, arg: float | int | None = None) -> Column:
    c = _c(c)
    table = {
        "abs": lambda: F.abs(c),
        "round": lambda: F.round(c, int(arg or 0)),
        "round_even": lambda: F.bround(c, int(arg or 0)),
        "power": lambda: F.pow(c, F.lit(arg)),
        "divide": lambda: c / F.nullif(F.lit(float(arg)), F.lit(0.0)),
        "modulo": lambda: c % F.lit(arg),
        "factorial": lambda: F.factorial(c),
    }
    return table[op]()


# Factor or formula of each conversion.
DAYS_PER_YEAR = 365


def unit_convert(c: ColumnLike, kind: str) -> Column:
    x = _c(c).cast("double")
    return {
        "f_to_c": (x - 32) * 5 / 9,
        "h_to_s": x * 3600,
        "m_to_s": x * 60,
        "days_to_years": x / DAYS_PER_YEAR,
        "cm_to_m": x * 0.01,
        "min_to_h": x / 60,
    }[kind]


def bmi(weight_kg: ColumnLike, height_cm: ColumnLike) -> Column:
    from .ratios import ratio_or_null

    return ratio_or_null(weight_kg, F.pow(unit_convert(height_cm, "cm_to_m"), F.lit(2)))


def lookup_json(c: ColumnLike, path: str, type_name: str) -> Column:
    """Typed field of a JSON text, NULL if absent or of another type."""
    return F.get_json_object(_c(c), path).try_cast(type_name)
