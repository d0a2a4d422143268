"""Row filters.  Literals stay on the right of bare columns so they reach the scan."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

_COMPARE = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "=": operator.eq,
    "!=": operator.ne,
}


def filter_compare(d: DataFrame, c: str, op: str, value: Any) -> DataFrame:
    return d.filter(_COMPARE[op](F.col(c), value))


def filter_in_list(d: DataFrame, c: str, values: Sequence[Any]) -> DataFrame:
    return d.filter(F.col(c).isin(*values))


def filter_not_in(d: DataFrame, c: str, values: Sequence[Any], keep_null: bool = True) -> DataFrame:
    """Rows outside the list.  Missing values stay by default, as in data-frame masks."""
    outside = ~F.col(c).isin(*values)
    return d.filter(outside | F.col(c).isNull() if keep_null else outside)


def filter_compound(d: DataFrame, cond: Column) -> DataFrame:
    return d.filter(cond)


def filter_null(d: DataFrame, c: str, is_null: bool = True, empty_is_null: bool = False) -> DataFrame:
    missing = F.col(c).isNull()
    if empty_is_null:
        missing = missing | (F.col(c) == "")
    return d.filter(missing if is_null else ~missing)


def filter_date_floor(d: DataFrame, ts: str, floor: dt.date, mode: str = "from") -> DataFrame:
    """Lower date bound.

    ``after_instant``  later than midnight that starts ``floor`` (keeps the day)
    ``after_day``      later than the whole day
    ``after_close``    later than 23:59:59 of the day
    ``from``           from that midnight on
    """
    day = dt.datetime.combine(floor, dt.time())
    c = F.col(ts)
    bound = {
        "after_instant": lambda: c > F.lit(day).cast("timestamp_ntz"),
        "after_day": lambda: c >= F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz"),
        "after_close": lambda: c > F.lit(day + dt.timedelta(hours=23, minutes=59, seconds=59)).cast("timestamp_ntz"),
        "from": lambda: c >= F.lit(day).cast("timestamp_ntz"),
    }[mode]()
    return d.filter(bound)


def filter_relative_months(d: DataFrame, ts: str, as_of: dt.date, months: int) -> DataFrame:
    """The last ``months`` months up to ``as_of`` (a parameter, so reruns agree)."""
    return d.filter(F.col(ts) >= F.add_months(F.lit(as_of), -months))


def filter_period(
    d: DataFrame, ts: str, year: int | None = None, quarters: Sequence[str] | None = None
) -> DataFrame:
    """A calendar year, or quarters named ``yyyy-Qn``, as date ranges the scan can prune by."""
    spans: list[tuple[dt.date, dt.date]] = []
    if year is not None:
        spans.append((dt.date(year, 1, 1), dt.date(year + 1, 1, 1)))
    for name in quarters or ():
        y, q = int(name[:4]), int(name[-1])
        spans.append((dt.date(y, 3 * q - 2, 1), dt.date(y + q // 4, (3 * q) % 12 + 1, 1)))
    cond = F.lit(False)
    for lo, hi in spans:
        cond = cond | ((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi)))
    return d.filter(cond)


def sentinel_to_null(d: DataFrame, cols: Sequence[str], token: str = "null", drop: bool = True) -> DataFrame:
    """Turn a marker text into real NULLs, and drop those rows if asked."""
    d = d.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in cols})
    return d.dropna(subset=list(cols)) if drop else d
