"""Scalar and calendar functions over whole columns, counted per distinct result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal, labels, text
from ..operators.joins import join_code_label
from ..operators.reshape import nested_explode
from .registry import Tables, query


def tally(d: DataFrame, **cols) -> DataFrame:
    """Rows per distinct combination of the given columns."""
    return d.groupBy(*[c.alias(n) for n, c in cols.items()]).agg(F.count("*").alias("n"))


# --- text ------------------------------------------------------------------

@query(
    "str_strip_chars",
    """SELECT c_custkey, CAST(trim('$' || CAST(CAST(abs(round(c_acctbal)) AS BIGINT) AS VARCHAR) || 'B', 'B$') AS BIGINT) AS val_num
       FROM customer""",
)
def _(t: Tables) -> DataFrame:
    # the balance written as a valuation, e.g. $1864B
    written = F.concat(F.lit("$"), F.abs(F.round("c_acctbal")).cast("bigint").cast("string"), F.lit("B"))
    return t.customer.select("c_custkey", text.str_strip_chars(written, "B$").cast("bigint").alias("val_num"))


def iso_order_date() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00.000Z'")


@query(
    "str_rstrip_iso",
    """SELECT strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS iso, CAST(o_orderdate AS DATE) AS parsed,
              CAST(rtrim(strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z'), 'T0:.Z') AS VARCHAR) AS trimmed_text,
              CASE WHEN day(o_orderdate) IN (10, 20, 30)
                   THEN make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate) // 10)
                   ELSE CAST(o_orderdate AS DATE) END AS parsed_compat, count(*) AS n
       FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(
        t.orders,
        iso=iso_order_date(),
        parsed=text.str_rstrip_iso(iso_order_date()),
        trimmed_text=F.rtrim(iso_order_date(), F.lit("T0:.Z")),
        parsed_compat=text.str_rstrip_iso(iso_order_date(), compat=True),
    )


@query(
    "str_replace",
    """SELECT replace(replace(strftime(ts, '%Y-%m-%dT%H:00:00Z'), 'T', ' '), 'Z', '') AS hour_text, count(*) AS n
       FROM events GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH':00:00Z'")
    return tally(t.events, hour_text=text.str_replace(iso, {"T": " ", "Z": ""}))


@query(
    "str_trim_len",
    """SELECT CAST(length(trim('  ' || p_name || ' ')) AS INTEGER) AS trimmed_length, count(*) AS n
       FROM part GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return tally(t.part, trimmed_length=text.str_trim_len(padded))


@query(
    "str_split_cols",
    """SELECT p_name, split_part(p_name, ' ', 1) AS first_word,
              CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN split_part(p_name, ' ', 2) END AS second_word,
              CASE WHEN len(string_split(p_name, ' ')) >= 3 THEN split_part(p_name, ' ', 3) END AS third_word, count(*) AS n
       FROM part GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    names = ["first_word", "second_word", "third_word"]
    split = text.str_split_cols(t.part.select("p_name"), "p_name", " ", names)
    return split.groupBy("p_name", *names).agg(F.count("*").alias("n"))


@query(
    "str_slice",
    """SELECT c_custkey, c_name[-2:] AS last_two, substr(c_name, -2, 1) AS second_last, c_name[1:8] AS head, c_name[10:12] AS middle
       FROM customer""",
)
def _(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        text.str_slice("c_name", -2).alias("last_two"),
        text.str_slice("c_name", -2, -1).alias("second_last"),
        text.str_slice("c_name", 0, 8).alias("head"),
        text.str_slice("c_name", 9, 12).alias("middle"),
    )


@query(
    "str_concat",
    """SELECT 'SLA - ' || p_type AS metric, p_brand || '.' || p_type AS dotted, count(*) AS n FROM part GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(
        t.part,
        metric=text.str_concat([F.lit("SLA - "), "p_type"]),
        dotted=text.str_concat(["p_brand", "p_type"], "."),
    )


@query(
    "str_case",
    """SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS title, lower(p_type) AS lower, upper(lower(p_type)) AS upper,
              count(*) AS n FROM part GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(
        t.part,
        title=text.str_case("p_type", "title"),
        lower=text.str_case("p_type", "lower"),
        upper=text.str_case(F.lower("p_type"), "upper"),
    )


# --- numbers ---------------------------------------------------------------

@query(
    "fmt_number",
    """SELECT p_partkey, printf('%.2f%%', round(p_retailprice / 7, 2)) AS pct,
              printf('%.0f%%', round(p_size / 64.0 * 100, 0)) AS share, printf('%.1fM', round(p_retailprice * 1000 / 1e6, 1)) AS millions
       FROM part""",
)
def _(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        text.fmt_number(F.col("p_retailprice") / 7, "pct", 2).alias("pct"),
        text.fmt_number(F.col("p_size") / 64, "share", 0).alias("share"),
        text.fmt_number(F.col("p_retailprice") * 1000, "millions", 1).alias("millions"),
    )


@query(
    "num_coerce",
    """SELECT o_orderpriority, try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) AS leading_digit,
              try_cast(o_orderpriority AS DOUBLE) AS whole, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        "o_orderpriority",
        text.num_coerce(F.substring("o_orderpriority", 1, 1)).alias("leading_digit"),
        text.num_coerce("o_orderpriority").alias("whole"),
    ).agg(F.count("*").alias("n"))


@query(
    "null_coalesce",
    """SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'unassigned') AS segment,
              round(sum(coalesce(nullif(c_acctbal, 0), 0)), 2) AS balance, count(nullif(c_mktsegment, 'BUILDING')) AS assigned
       FROM customer GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    balance = text.null_coalesce([F.nullif(F.col("c_acctbal"), F.lit(0.0)), F.lit(0.0)])
    return t.customer.groupBy(text.null_coalesce([segment, F.lit("unassigned")]).alias("segment")).agg(
        F.round(F.sum(balance), 2).alias("balance"), F.count(segment).alias("assigned")
    )


@query(
    "num_math",
    """SELECT c_custkey, abs(c_acctbal) AS magnitude, round(c_acctbal, 1) AS half_up, round_even(c_acctbal / 4, 0) AS half_even,
              round(power(c_acctbal / 1000, 2), 6) AS squared, round(c_acctbal / 1000000.0, 9) AS millions,
              c_custkey % 2 AS odd, CAST(factorial(CAST(c_custkey % 12 AS INTEGER)) AS BIGINT) AS fact
       FROM customer""",
)
def _(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        text.num_math("abs", balance).alias("magnitude"),
        text.num_math("round", balance, 1).alias("half_up"),
        text.num_math("round_even", balance / 4, 0).alias("half_even"),
        F.round(text.num_math("power", balance / 1000, 2), 6).alias("squared"),
        F.round(text.num_math("divide", balance, 1_000_000), 9).alias("millions"),
        text.num_math("modulo", "c_custkey", 2).alias("odd"),
        text.num_math("factorial", (F.col("c_custkey") % 12).cast("int")).alias("fact"),
    )


@query(
    "unit_convert",
    """SELECT l_quantity, round((l_quantity - 32) * 5 / 9, 6) AS celsius, l_quantity * 3600 AS seconds, l_quantity * 60 AS minute_seconds,
              round(l_quantity / 365, 6) AS years, round(l_quantity * 0.01, 6) AS metres, round(l_quantity / 60, 6) AS hours, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    per_value = t.lineitem.groupBy("l_quantity").agg(F.count("*").alias("n"))
    return per_value.select(
        "l_quantity",
        F.round(text.unit_convert("l_quantity", "f_to_c"), 6).alias("celsius"),
        text.unit_convert("l_quantity", "h_to_s").alias("seconds"),
        text.unit_convert("l_quantity", "m_to_s").alias("minute_seconds"),
        F.round(text.unit_convert("l_quantity", "days_to_years"), 6).alias("years"),
        F.round(text.unit_convert("l_quantity", "cm_to_m"), 6).alias("metres"),
        F.round(text.unit_convert("l_quantity", "min_to_h"), 6).alias("hours"),
        "n",
    )


@query(
    "nested_explode",
    """SELECT word, count(*) AS n FROM (
         SELECT unnest(string_split(line, ' ')) AS word FROM (
           SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    nested = t.documents.select(F.transform(lines, lambda line: F.split(line, " ")).alias("words"))
    return nested_explode(nested, "words", 2, "word").groupBy("word").agg(F.count("*").alias("n"))


@query(
    "lookup_json",
    """SELECT CAST(props ->> '$.k' AS INTEGER) AS k, try_cast(props ->> '$.absent' AS INTEGER) AS absent, count(*) AS n
       FROM events GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(
        t.events, k=text.lookup_json("props", "$.k", "int"), absent=text.lookup_json("props", "$.absent", "int")
    )


# --- calendar --------------------------------------------------------------

@query(
    "date_parse",
    """SELECT CAST(o_orderdate AS DATE) AS mdy, CAST(o_orderdate AS DATE) AS ymd, CAST(o_orderdate AS DATE) AS iso,
              CAST(o_orderdate AS DATE) AS spelled, CAST(o_orderdate AS DATE) AS epoch,
              CASE WHEN year(o_orderdate) < 1998 THEN CAST(o_orderdate AS DATE) END AS coerced, count(*) AS n
       FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    seconds = F.unix_date(F.to_date(d)).cast("bigint") * 86_400
    some_bad = F.when(F.year(d) < 1998, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("not a date"))
    return tally(
        t.orders,
        mdy=cal.date_parse(F.date_format(d, "M/d/yyyy"), "M/d/yyyy"),
        ymd=cal.date_parse(F.date_format(d, "yyyy-MM-dd"), ["M/d/yyyy", "yyyy-MM-dd"]),
        iso=cal.date_parse(iso_order_date(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        spelled=cal.date_parse(F.date_format(d, "yyyy.MMMM.d"), "yyyy.MMMM.d"),
        epoch=cal.date_parse(seconds.cast("string"), "epoch"),
        coerced=cal.date_parse(some_bad, "yyyy-MM-dd", strict=False),
    )


@query(
    "date_parts",
    """SELECT CAST(year(ts) AS INTEGER) AS year, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day, CAST(week(ts) AS INTEGER) AS week, CAST(dayofweek(ts) AS INTEGER) AS dow,
              CAST(ts AS DATE) AS date, strftime(ts, '%H:%M') AS time, count(*) AS n
       FROM events GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    parts = ["year", "quarter", "month", "day", "week", "dow", "date", "time"]
    return tally(t.events, **cal.date_parts("ts", parts))


@query(
    "date_names",
    """SELECT monthname(o_orderdate) AS month, left(monthname(o_orderdate), 3) AS month3, dayname(o_orderdate) AS weekday,
              left(dayname(o_orderdate), 3) AS weekday3, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    kinds = ["month", "month3", "weekday", "weekday3"]
    return tally(t.orders, **{k: cal.date_names("o_orderdate", k) for k in kinds})


@query(
    "period_labels",
    """SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') || '-Q' || quarter(ts) AS quarter,
              strftime(ts, '%Y') || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, strftime(ts, '%Y/%m/%d') AS day,
              strftime(ts, '%H:%M') AS hhmm, strftime(ts, '%Y') AS year, count(*) AS n
       FROM (SELECT o_orderdate AS ts FROM orders UNION ALL SELECT ts FROM events) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    both = t.orders.select(F.col("o_orderdate").alias("ts")).unionByName(t.events.select("ts"))
    kinds = ["month", "quarter", "week", "day", "hhmm", "year"]
    return tally(both, **{k: cal.period_labels("ts", k) for k in kinds})


@query(
    "iso_year_week",
    """SELECT CAST(isoyear(o_orderdate) AS VARCHAR) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS iso_week,
              count(*) AS n FROM orders GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return tally(t.orders, iso_week=cal.iso_year_week("o_orderdate"))


@query(
    "week_start_monday",
    "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) AS n FROM orders GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return tally(t.orders, week_start=cal.week_start_monday("o_orderdate"))


@query(
    "week_start_sunday",
    """SELECT CAST(date_trunc('week', CAST(o_orderdate AS DATE) + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS week_start,
              count(*) AS n FROM orders GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return tally(t.orders, week_start=cal.week_start_sunday("o_orderdate"))


@query(
    "week_number_shifted",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(week(o_orderdate + INTERVAL 1 DAY) AS INTEGER) AS week_number, count(*) AS n
       FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(t.orders, date=F.to_date("o_orderdate"), week_number=cal.week_number_shifted("o_orderdate"))


@query(
    "minutes_between",
    """SELECT user_id, CAST(ts AS DATE) AS day, datesub('minute', min(ts), max(ts)) AS minutes,
              datesub('minute', max(ts), min(ts)) AS reversed FROM events GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    spans = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    return spans.select(
        "user_id", "day", cal.minutes_between("a", "b").alias("minutes"), cal.minutes_between("b", "a").alias("reversed")
    )


@query(
    "date_shift",
    """SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS next_day,
              CAST(CAST(o_orderdate AS DATE) - INTERVAL 14 MONTH AS DATE) AS months_back,
              CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS week_ago, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return tally(
        t.orders,
        date=F.to_date("o_orderdate"),
        next_day=cal.date_shift("o_orderdate", days=1),
        months_back=cal.date_shift("o_orderdate", months=-14),
        week_ago=cal.date_shift("o_orderdate", days=-7),
    )


CLOCK = "CAST(hour(ts) * 60 + minute(ts) AS INTEGER)"
SHIFT_SQL = f"""CASE WHEN {CLOCK} >= 480 AND {CLOCK} < 1110 THEN 'Day' WHEN {CLOCK} >= 1140 OR {CLOCK} < 300 THEN 'Night' END"""
PERIOD_SQL = f"""CASE WHEN {CLOCK} >= 480 AND {CLOCK} < 635 THEN 'P1' WHEN {CLOCK} >= 660 AND {CLOCK} < 875 THEN 'P2'
    WHEN {CLOCK} >= 900 AND {CLOCK} < 1115 THEN 'P3' WHEN {CLOCK} >= 1115 AND {CLOCK} < 1205 THEN 'P4'
    WHEN {CLOCK} >= 1230 OR {CLOCK} < 110 THEN 'P5' WHEN {CLOCK} >= 135 AND {CLOCK} < 305 THEN 'P6' END"""
CREW_SQL = """CASE WHEN dayofweek(ts) IN (0, 1, 2) THEN 'Front End' WHEN dayofweek(ts) = 3 THEN 'Midweek' ELSE 'Back End' END"""


@query("shift_of_day", f"SELECT {CLOCK} AS clock, {SHIFT_SQL} AS shift, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return tally(t.events, clock=cal.minute_of_day("ts"), shift=cal.shift_of_day("ts"))


@query("period_of_day", f"SELECT {CLOCK} AS clock, {PERIOD_SQL} AS period, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return tally(t.events, clock=cal.minute_of_day("ts"), period=cal.period_of_day("ts"))


@query("schedule_group", f"SELECT CAST(ts AS DATE) AS day, {CREW_SQL} AS crew, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return tally(t.events, day=F.to_date("ts"), crew=cal.schedule_group("ts"))


# --- labels ----------------------------------------------------------------

@query(
    "band_case",
    """SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity >= 40 THEN 'high' ELSE 'normal' END AS band, count(*) AS n
       FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    band = labels.band_case("l_quantity", [(None, 10, "low"), (40, None, "high")], "normal")
    return tally(t.lineitem, band=band)


@query(
    "binary_flag",
    """SELECT CASE WHEN c_acctbal > 2500 THEN 1 ELSE 0 END AS over, CASE WHEN nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' THEN 'yes'
              WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 'unknown' ELSE 'no' END AS machinery, count(*) AS n
       FROM customer GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return tally(
        t.customer,
        over=labels.binary_flag(F.col("c_acctbal") > 2500),
        machinery=labels.binary_flag(segment == "MACHINERY", "yes", "no", "unknown"),
    )


@query(
    "code_to_label",
    """SELECT CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE l_returnflag END AS flag, count(*) AS n
       FROM lineitem GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return tally(t.lineitem, flag=labels.code_to_label("l_returnflag", {"A": "Accepted", "R": "Returned"}))


@query(
    "code_to_label__table",
    """SELECT coalesce(c_name, o_custkey::VARCHAR) AS customer, count(*) AS n FROM orders
       LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """Names of customers as a code table that lacks every third one."""
    codes = t.customer.filter(F.col("c_custkey") % 3 > 0).select(F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("label"))
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("customer"))
    return tally(join_code_label(rows, "customer", codes), customer=F.col("customer"))


@query(
    "username_length_rule",
    """SELECT CASE WHEN length(p_name) < 8 THEN 'too short' WHEN length(p_name) > 15 THEN 'too long' ELSE 'valid' END AS verdict,
              count(*) AS n FROM part GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return tally(t.part, verdict=labels.username_length_rule("p_name"))
