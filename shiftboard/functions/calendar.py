"""Calendar columns: parsing, parts, period labels, week starts, shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- parsing ---------------------------------------------------------------

def date_parse(c: ColumnLike, formats: Sequence[str] | str, strict: bool = True) -> Column:
    """Text (or epoch seconds) to DATE, trying ``formats`` in order.

    ``"epoch"`` reads seconds since 1970.  Text that no format reads raises when
    ``strict``, else becomes NULL.
    """
    formats = [formats] if isinstance(formats, str) else list(formats)
    c = _c(c)
    tries = [
        F.timestamp_seconds(c.try_cast("bigint")).cast("date") if f == "epoch" else F.try_to_date(c, f)
        for f in formats
    ]
    parsed = F.coalesce(*tries)
    if not strict:
        return parsed
    bad = c.isNotNull() & parsed.isNull()
    return F.when(
        bad, F.raise_error(F.concat(F.lit("unreadable date: "), c.cast("string"))).cast("date")
    ).otherwise(parsed)


# --- parts and names -------------------------------------------------------

def date_parts(c: ColumnLike, parts: Sequence[str]) -> dict[str, Column]:
    """Named calendar parts, ready for ``withColumns``.

    ``dow`` counts from 0 = Sunday, ``week`` is the ISO week, ``time`` is ``HH:mm``.
    """
    c = _c(c)
    available = {
        "year": lambda: F.year(c),
        "quarter": lambda: F.quarter(c),
        "month": lambda: F.month(c),
        "day": lambda: F.dayofmonth(c),
        "week": lambda: F.weekofyear(c),
        "dow": lambda: F.dayofweek(c) - 1,
        "date": lambda: F.to_date(c),
        "time": lambda: F.date_format(c, "HH:mm"),
    }
    return {p: available[p]() for p in parts}


def date_names(c: ColumnLike, kind: str) -> Column:
    pattern = {"month": "MMMM", "month3": "MMM", "weekday": "EEEE", "weekday3": "EEE"}[kind]
    return F.date_format(_c(c), pattern)


def _two_digit_week(c: Column) -> Column:
    return F.lpad(F.weekofyear(c).cast("string"), 2, "0")


def period_labels(c: ColumnLike, kind: str) -> Column:
    """Sortable text labels.

    ``week`` pairs the ISO week with the *calendar* year, as reporting templates
    do (2024-12-30 is ``2024-W01``); :func:`iso_year_week` is the ISO form.
    """
    c = _c(c)
    if kind == "quarter":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-Q"), F.quarter(c).cast("string"))
    if kind == "week":
        return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), _two_digit_week(c))
    return F.date_format(c, {"month": "yyyy-MM", "day": "yyyy/MM/dd", "hhmm": "HH:mm", "year": "yyyy"}[kind])


def iso_year(c: ColumnLike) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(c))


def iso_week(c: ColumnLike) -> Column:
    """ISO week as two-digit text."""
    return _two_digit_week(_c(c))


def iso_year_week(c: ColumnLike) -> Column:
    c = _c(c)
    return F.concat(iso_year(c).cast("string"), F.lit("-W"), iso_week(c))


# --- weeks and shifts of dates ---------------------------------------------

def week_start_monday(c: ColumnLike) -> Column:
    return F.trunc(F.to_date(_c(c)), "week")


def week_start_sunday(c: ColumnLike) -> Column:
    d = F.to_date(_c(c))
    return F.date_sub(d, F.dayofweek(d) - 1)


def week_number_shifted(c: ColumnLike) -> Column:
    """Week number of Sunday-start weeks: the ISO week of the following day."""
    return F.weekofyear(F.date_add(F.to_date(_c(c)), 1))


def minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole elapsed minutes (not minute marks crossed); negative if reversed."""
    return F.timestamp_diff("MINUTE", _c(start), _c(end))


def date_shift(c: ColumnLike, days: int = 0, months: int = 0) -> Column:
    d = F.to_date(_c(c))
    if months:
        d = F.add_months(d, months)
    return F.date_add(d, days) if days else d


# --- time of day -----------------------------------------------------------

# Shift and break periods of the day, half open, [start, end).
SHIFTS = (("Day", "08:00", "18:30"), ("Night", "19:00", "05:00"))
PERIODS = (
    ("P1", "08:00", "10:35"),
    ("P2", "11:00", "14:35"),
    ("P3", "15:00", "18:35"),
    ("P4", "18:35", "20:05"),
    ("P5", "20:30", "01:50"),
    ("P6", "02:15", "05:05"),
)
# Crew rota by weekday.
CREWS = (
    ("Front End", ("Sun", "Mon", "Tue")),
    ("Midweek", ("Wed",)),
    ("Back End", ("Thu", "Fri", "Sat")),
)


def minute_of_day(ts: ColumnLike) -> Column:
    ts = _c(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def _minutes(clock: str) -> int:
    hours, minutes = clock.split(":")
    return int(hours) * 60 + int(minutes)


def clock_band(ts: ColumnLike, bands: Sequence[tuple[str, str, str]]) -> Column:
    """Label of the ``[start, end)`` clock band holding ``ts``; NULL in a gap.

    A band whose end precedes its start runs over midnight.
    """
    m = minute_of_day(ts)
    out = None
    for label, lo, hi in minute_spans(bands):
        inside = (m >= lo) & (m < hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def minute_spans(bands: Sequence[tuple[str, str, str]]) -> list[tuple[str, int, int]]:
    """Bands as ``(label, first minute, end minute)``; one over midnight gives two."""
    spans = []
    for label, start, end in bands:
        lo, hi = _minutes(start), _minutes(end)
        spans += [(label, lo, hi)] if lo < hi else [(label, lo, 24 * 60), (label, 0, hi)]
    return spans


def shift_of_day(ts: ColumnLike) -> Column:
    return clock_band(ts, SHIFTS)


def period_of_day(ts: ColumnLike) -> Column:
    return clock_band(ts, PERIODS)


def schedule_group_of_name(weekday: ColumnLike) -> Column:
    """Crew for a weekday given as three-letter text in any case."""
    name = F.initcap(F.trim(_c(weekday)))
    out = None
    for crew, days in CREWS:
        out = F.when(name.isin(*days), crew) if out is None else out.when(name.isin(*days), crew)
    return out.otherwise("unknown")


def schedule_group(date: ColumnLike) -> Column:
    return schedule_group_of_name(date_names(date, "weekday3"))
