"""Column functions on edge rows."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shiftboard.functions import calendar as cal, labels, ratios, text

D = dt.date


def one(rows, values, type_name, column):
    """Results of a column over values, in order."""
    d = rows([(i, v) for i, v in enumerate(values)], f"i int, x {type_name}")
    return [r[0] for r in d.orderBy("i").select(column).collect()]


YEAR_ENDS = [D(2024, 12, 29), D(2024, 12, 30), D(2024, 12, 31), D(2025, 1, 1), D(2025, 1, 4), D(2025, 1, 5), D(2025, 1, 6), D(2020, 12, 31), D(2021, 1, 3)]


def test_week_starts_and_numbers(rows):
    def ask(column):
        return one(rows, YEAR_ENDS, "date", column)

    assert ask(cal.week_start_monday("x")) == [d - dt.timedelta(days=d.weekday()) for d in YEAR_ENDS]
    assert ask(cal.week_start_sunday("x")) == [d - dt.timedelta(days=(d.weekday() + 1) % 7) for d in YEAR_ENDS]
    assert ask(cal.week_number_shifted("x")) == [(d + dt.timedelta(days=1)).isocalendar().week for d in YEAR_ENDS]
    iso = [d.isocalendar() for d in YEAR_ENDS]
    assert ask(cal.iso_year_week("x")) == [f"{i.year}-W{i.week:02d}" for i in iso]
    # the label form pairs the ISO week with the calendar year
    assert ask(cal.period_labels("x", "week")) == [f"{d.year}-W{i.week:02d}" for d, i in zip(YEAR_ENDS, iso)]
    assert ask(cal.period_labels("x", "quarter"))[:4] == ["2024-Q4", "2024-Q4", "2024-Q4", "2025-Q1"]


def test_date_parse(rows):
    texts = ["1/9/2025", "2025-01-09", "bad", None]
    parsed = one(rows, texts, "string", cal.date_parse("x", ["M/d/yyyy", "yyyy-MM-dd"], strict=False))
    assert parsed == [D(2025, 1, 9), D(2025, 1, 9), None, None]
    with pytest.raises(Exception, match="unreadable date"):
        one(rows, ["bad"], "string", cal.date_parse("x", "M/d/yyyy"))


def test_iso_text_strip(rows):
    texts = ["2025-01-10T00:00:00.000Z", "2025-01-20T00:00:00.000Z", "2025-01-30T00:00:00.000Z", "2025-01-05T00:00:00.000Z", None]
    assert one(rows, texts, "string", text.str_rstrip_iso("x")) == [D(2025, 1, d) for d in (10, 20, 30, 5)] + [None]
    compat = one(rows, texts, "string", text.str_rstrip_iso("x", compat=True))
    assert compat == [D(2025, 1, d) for d in (1, 2, 3, 5)] + [None]


CLOCKS = {
    "04:59": ("Night", "P6"), "05:00": (None, "P6"), "05:04": (None, "P6"), "05:05": (None, None), "07:59": (None, None),
    "08:00": ("Day", "P1"), "10:34": ("Day", "P1"), "10:35": ("Day", None), "14:35": ("Day", None), "18:29": ("Day", "P3"),
    "18:30": (None, "P3"), "18:34": (None, "P3"), "18:35": (None, "P4"), "18:59": (None, "P4"), "19:00": ("Night", "P4"),
    "20:04": ("Night", "P4"), "20:05": ("Night", None), "20:30": ("Night", "P5"), "23:59": ("Night", "P5"), "00:00": ("Night", "P5"),
    "01:49": ("Night", "P5"), "01:50": ("Night", None), "02:14": ("Night", None), "02:15": ("Night", "P6"),
}


def test_shift_and_period(rows):
    times = [dt.datetime.fromisoformat(f"2024-05-01 {c}:30") for c in CLOCKS]
    assert one(rows, times, "timestamp_ntz", cal.shift_of_day("x")) == [v[0] for v in CLOCKS.values()]
    assert one(rows, times, "timestamp_ntz", cal.period_of_day("x")) == [v[1] for v in CLOCKS.values()]


def test_schedule_group(rows):
    week = [D(2024, 5, 5) + dt.timedelta(days=i) for i in range(7)]  # Sunday first
    assert one(rows, week, "date", cal.schedule_group("x")) == ["Front End"] * 3 + ["Midweek"] + ["Back End"] * 3
    assert one(rows, [" sun ", "WED", "noday"], "string", cal.schedule_group_of_name("x")) == ["Front End", "Midweek", "unknown"]


def test_minutes_between(rows):
    a = dt.datetime(2024, 1, 1, 10, 0, 45)
    d = rows([(a, a + dt.timedelta(seconds=90)), (a, a - dt.timedelta(minutes=5)), (a, None)], "a timestamp_ntz, b timestamp_ntz")
    # 90 seconds cross two minute marks but are one whole minute
    assert [r[0] for r in d.select(cal.minutes_between("a", "b")).collect()] == [1, -5, None]


def test_ratio_guards(rows):
    d = rows([(0.0, 2.0), (None, 2.0), (3.0, 0.0), (3.0, None), (3.0, -1.0), (1.0, 4.0)], "n double, d double")
    assert [r[0] for r in d.select(ratios.ratio_or_null("n", "d")).collect()] == [0.0, None, None, None, -3.0, 0.25]
    assert [r[0] for r in d.select(ratios.ratio_or_zero("n", "d")).collect()] == [0.0, None, 0.0, 0.0, 0.0, 0.25]
    assert d.select(ratios.rate_dpmo("n", "d")).collect()[-1][0] == 250_000


def test_alignment(rows):
    values = [-5.0, 5.0, 5.0001, None]
    assert one(rows, values, "double", ratios.alignment_status("x")) == ["Aligned", "Aligned", "Not Aligned", "Aligned"]
    notebook = one(rows, values, "double", ratios.alignment_status("x", null_status="Not Aligned"))
    assert notebook == ["Aligned", "Aligned", "Not Aligned", "Not Aligned"]


def test_round_half_even(rows):
    assert one(rows, [0.125, 0.375, 2.5, -0.125], "double", ratios.round_half_even("x", 2)) == [0.12, 0.38, 2.5, -0.12]


def test_labels(rows):
    flags = one(rows, ["A", "Z", "", None], "string", labels.code_to_label("x", {"A": "Alpha"}))
    assert flags == ["Alpha", "Z", "", None]
    assert one(rows, ["A", "Z", None], "string", labels.code_to_number("x", {"A": 7})) == [7, None, None]
    assert one(rows, [7, 8, 15, 16], "int", labels.username_length_rule(F.repeat(F.lit("a"), F.col("x")))) == [
        "too short", "valid", "valid", "too long",
    ]
    assert one(rows, [0, 1, 5, 6, 8, 9, 10, 11, None], "int", labels.score_band("x")) == [
        None, "Negative", "Negative", "Neutral", "Neutral", "Positive", "Positive", None, None,
    ]
    assert one(rows, [True, False, None], "boolean", labels.binary_flag(F.col("x"), "y", "n", "?")) == ["y", "n", "?"]


def test_numbers_from_text(rows):
    values = ["null", "", " 7 ", "7.5", "$180B", "x", None]
    assert one(rows, values, "string", text.num_coerce("x")) == [None, None, 7.0, 7.5, None, None, None]
    assert one(rows, ["$180B", "B$5$"], "string", text.str_strip_chars("x", "$B").cast("int")) == [180, 5]


def test_split_keeps_shape(rows):
    d = rows([("a b c d",), ("a",), (None,), ("",)], "x string")
    got = [tuple(r) for r in text.str_split_cols(d, "x", " ", ["p", "q"]).select("p", "q").collect()]
    assert got == [("a", "b"), ("a", None), (None, None), ("", None)]


@settings(max_examples=12, deadline=None)
@given(st.text("abcde", max_size=6), st.integers(-7, 7), st.one_of(st.none(), st.integers(-7, 7)))
def test_slice_is_pythons(spark, word, start, stop):
    d = spark.range(1).select(text.str_slice(F.lit(word), start, stop))
    assert d.first()[0] == word[start:stop]


def test_formats(rows):
    assert one(rows, [12.345, None], "double", text.fmt_number("x", "pct", 1)) == ["12.3%", None]
    assert one(rows, [0.125], "double", text.fmt_number("x", "share", 0)) == ["13%"]
    assert one(rows, [1_540_000.0], "double", text.fmt_number("x", "millions", 1)) == ["1.5M"]
