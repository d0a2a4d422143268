"""Review and study reports over stand-in extracts cut from the given tables.

A report with several results is registered under its key for the leading one
and ``key__part`` for the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..plans import (
    activity,
    companies,
    demographics,
    health,
    productivity,
    quarterly,
    rates,
    sales,
    seasonality,
    trend,
    weekly_sites,
)
from .aggregates import T_975, rounded
from . import expected
from .registry import Tables, query
from .scalars import CREW_SQL, PERIOD_SQL, SHIFT_SQL

C = F.col


def parts(
    key: str,
    build: Callable[[Tables], Mapping[str, DataFrame]],
    checks: Mapping[str, str],
    digits: Mapping[str, Mapping[str, int]] | None = None,
) -> None:
    """Register each checked part of a bundle; the first takes the plain key."""
    for i, (name, sql) in enumerate(checks.items()):

        def run(t: Tables, name: str = name) -> DataFrame:
            frame = build(t)[name]
            for c, n in ((digits or {}).get(name) or {}).items():
                frame = frame.withColumn(c, F.round(c, n))
            return frame

        query(key if i == 0 else f"{key}__{name}", sql)(run)


# --- rate comparison -------------------------------------------------------

PROCESS = {"click": "PROCESS_A", "view": "PROCESS_B", "error": "PROCESS_C", "purchase": "PROCESS_D", "signup": "OTHER"}


def rate_rows(t: Tables) -> dict[str, DataFrame]:
    process = F.lit(None).cast("string")
    for kind, name in PROCESS.items():
        process = F.when(C("event_type") == kind, name).otherwise(process)
    hour = F.date_trunc("hour", C("ts"))
    iso = "yyyy-MM-dd'T'HH:mm:ss'.000Z'"
    rows = t.events.select(
        F.concat(F.lit(" "), cal.shift_of_day("ts"), F.lit(" ")).alias("shift"),
        process.alias("process_group"),
        F.date_format(hour, iso).alias("interval_start_local"),
        F.date_format(hour + F.expr("INTERVAL 1 HOUR"), iso).alias("interval_end_local"),
        F.lower(cal.date_names("ts", "weekday3")).alias("dow"),
        C("value").cast("string").alias("predicted_rate"),
        (C("value") + C("event_id") % 7).cast("string").alias("actual_rate"),
        F.when(C("event_id") % 10 == 0, "null").otherwise((C("value") * 2).cast("string")).alias("planned_rate"),
    )
    return {"rates": rows}


def _mean(c: str) -> str:
    return f"round_even(round(avg({c}), 9), 3) AS {c}"


RATE_MEANS = ", ".join(_mean(c) for c in expected.RATES)
RATE_SUMMARY = f"""(SELECT process_group, strftime(h, '%H:%M GMT') AS interval_start_local, strftime(h + INTERVAL 1 HOUR, '%H:%M GMT') AS interval_end_local,
    crew || ' ' || shift AS shift_view, {RATE_MEANS} FROM (
      SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROCESS.items())} END AS process_group, {CREW_SQL} AS crew, {SHIFT_SQL} AS shift,
             TIMESTAMP '2000-01-01' + to_hours(hour(ts)) AS h, value AS predicted_rate, value + event_id % 7 AS actual_rate, value * 2 AS planned_rate
      FROM events WHERE event_id % 10 != 0 AND event_type != 'signup') WHERE shift IS NOT NULL GROUP BY 1, 2, 3, 4)"""
RATE_TIMES = f"(SELECT process_group, interval_start_local, {RATE_MEANS} FROM {RATE_SUMMARY} GROUP BY 1, 2)"

parts(
    "report_rate_comparison",
    lambda t: rates.report_rate_comparison(rate_rows(t)),
    {
        "deviation": f"""SELECT *, printf('%.2f%%', round((predicted_rate - actual_rate) / actual_rate * 100, 2)) AS predicted_vs_actual_pct_dev
                         FROM (SELECT process_group, shift_view, {RATE_MEANS} FROM {RATE_SUMMARY} GROUP BY 1, 2)""",
        "summary": f"SELECT * FROM {RATE_SUMMARY}",
        "by_time": " UNION ALL ".join(
            f"SELECT process_group, interval_start_local, '{c}' AS rate_type, {c} AS rate FROM {RATE_TIMES}" for c in expected.RATES
        ),
    },
)

# --- quarterly review ------------------------------------------------------

SCORE_SQL = {c: ("l_quantity" if i % 2 else f"CASE WHEN l_linenumber != {i + 1} THEN l_tax * {i + 1} END") for i, c in enumerate(expected.SCORES)}


def review_tables(t: Tables) -> dict[str, DataFrame]:
    def iso(c: str):
        return F.date_format(c, "yyyy-MM-dd'T00:00:00.000Z'")

    scores = [
        (C("l_quantity") if i % 2 else F.when(C("l_linenumber") != i + 1, C("l_tax") * (i + 1))).alias(c)
        for i, c in enumerate(expected.SCORES)
    ]
    return {
        "late": t.orders.select(
            (C("o_custkey") % 20).cast("string").alias("facility_code"),
            iso("o_orderdate").alias("balance_date"),
            (C("o_totalprice") / 7).alias("defect_rate"),
            (C("o_orderkey") % 7).alias("raw_late_count"),
        ),
        "outbound": t.lineitem.select(
            C("l_suppkey").cast("string").alias("facility_code"),
            C("l_returnflag").alias("process_path"),
            C("l_linestatus").alias("category"),
            iso("l_shipdate").alias("clean_date"),
            (C("l_extendedprice") / 3).alias("performance_score"),
            (C("l_quantity") / 7).alias("weekly_percentage"),
        ),
        "tasks": t.lineitem.select(
            C("l_suppkey").cast("string").alias("warehouse_id"),
            F.to_date("l_shipdate").alias("date"),
            C("l_returnflag").alias("process_group"),
            C("l_orderkey").alias("total_units"),
            *scores,
        ),
    }


def _periods(c: str) -> str:
    return f"""strftime({c}, '%Y') || '-W' || lpad(CAST(week({c}) AS VARCHAR), 2, '0') AS week_number, strftime({c}, '%Y-%m') AS month,
        strftime({c}, '%Y') || '-Q' || quarter({c}) AS quarter, strftime({c}, '%Y') AS year"""


def _in_quarters(c: str) -> str:
    return f"year({c}) || '-Q' || quarter({c}) IN ('1998-Q1', '1999-Q1')"


def _r3(c: str) -> str:
    return f"round_even(round({c}, 9), 3)"


LATE = f"""(SELECT CAST(o_custkey % 20 AS VARCHAR) AS facility_code, CAST(o_orderdate AS DATE) AS balance_date, {_periods('o_orderdate')},
    {_r3('sum(o_totalprice / 7)')} AS defect_rate, sum(o_orderkey % 7)::BIGINT AS raw_late_count FROM orders WHERE {_in_quarters('o_orderdate')} GROUP BY ALL)"""
TASKS = f"""(SELECT CAST(l_suppkey AS VARCHAR) AS warehouse_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS process_group, {_periods('l_shipdate')},
    sum(l_orderkey)::BIGINT AS total_units, {", ".join(f"{_r3(f'coalesce(sum({v}), 0)')} AS {c}" for c, v in SCORE_SQL.items())},
    {_r3(f"coalesce(sum({' + '.join(f'({v})' for v in SCORE_SQL.values())}), 0)")} AS total_score FROM lineitem WHERE {_in_quarters('l_shipdate')} GROUP BY ALL)"""
REVIEW = quarterly.QuarterlyConfig(quarters=("1998-Q1", "1999-Q1"), site="7")

parts(
    "report_quarterly_review",
    lambda t: quarterly.report_quarterly_review(review_tables(t), REVIEW),
    {
        "tasks": f"SELECT * FROM {TASKS}",
        "late": f"SELECT * FROM {LATE}",
        "outbound": f"""SELECT CAST(l_suppkey AS VARCHAR) AS facility_code, l_returnflag AS process_path, l_linestatus AS category, CAST(l_shipdate AS DATE) AS clean_date,
            {_periods('l_shipdate')}, {_r3('sum(l_extendedprice / 3)')} AS performance_score, {_r3('avg(l_quantity / 7)')} AS weekly_percentage
            FROM lineitem WHERE {_in_quarters('l_shipdate')} GROUP BY ALL""",
        "outbound_bars": f"""SELECT facility_code, quarter, round(avg(performance_score), 9) AS mean_performance_score FROM (
            SELECT CAST(l_suppkey AS VARCHAR) AS facility_code, l_returnflag, l_linestatus, l_shipdate, strftime(l_shipdate, '%Y') || '-Q' || quarter(l_shipdate) AS quarter,
            {_r3('sum(l_extendedprice / 3)')} AS performance_score FROM lineitem WHERE {_in_quarters('l_shipdate')} GROUP BY ALL) GROUP BY 1, 2""",
        "site_tasks": f"SELECT * FROM {TASKS} WHERE warehouse_id = '7'",
        "late_bars": f"SELECT facility_code, quarter, round(avg(raw_late_count), 9) AS mean_raw_late_count FROM {LATE} GROUP BY 1, 2",
        "task_bars": f"SELECT warehouse_id, quarter, round(avg(total_score), 9) AS mean_total_score FROM {TASKS} GROUP BY 1, 2",
        "site_late": f"SELECT * FROM {LATE} WHERE facility_code = '7'",
        "site_outbound": f"""SELECT CAST(l_suppkey AS VARCHAR) AS facility_code, l_returnflag AS process_path, l_linestatus AS category, CAST(l_shipdate AS DATE) AS clean_date,
            {_periods('l_shipdate')}, {_r3('sum(l_extendedprice / 3)')} AS performance_score, {_r3('avg(l_quantity / 7)')} AS weekly_percentage
            FROM lineitem WHERE {_in_quarters('l_shipdate')} AND l_suppkey = 7 GROUP BY ALL""",
    },
    {
        "outbound_bars": {"mean_performance_score": 9},
        "late_bars": {"mean_raw_late_count": 9},
        "task_bars": {"mean_total_score": 9},
    },
)

# --- productivity ----------------------------------------------------------


@query(
    "report_productivity",
    f"""SELECT period, shift, round_even(round((a - p) / nullif(p, 0) * 100, 8), 2) AS variance_pct, p AS planned_average, a AS actual_average,
        CASE WHEN abs(round_even(round((a - p) / nullif(p, 0) * 100, 8), 2)) <= 5 THEN 'Aligned' ELSE 'Not Aligned' END AS status
        FROM (SELECT {PERIOD_SQL} AS period, {SHIFT_SQL} AS shift, round_even(round(avg(value), 8), 2) AS p,
              round_even(round(avg(value * 0.9 + event_id % 5), 8), 2) AS a
              FROM events WHERE event_id % 11 != 0 AND event_id % 13 != 0 GROUP BY 1, 2) WHERE period IS NOT NULL AND shift IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    raw = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(C("event_id") % 11 == 0, "n/a").otherwise(C("value").cast("string")).alias("planned_value"),
        F.when(C("event_id") % 13 != 0, (C("value") * 0.9 + C("event_id") % 5).cast("string")).alias("actual_value"),
        F.lit("x").alias("override_column_1"),
    )
    return productivity.report_productivity({"raw": raw})


# --- weekly site bundle ----------------------------------------------------

def site_tables(t: Tables) -> dict[str, DataFrame]:
    site = F.concat(F.lit("SITE_"), (C("l_suppkey") % 40).cast("string"))
    week = F.weekofyear("l_shipdate").cast("string")
    day_space = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    day_t = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    blank = F.lit(None).cast("double")
    value = F.when(C("l_linenumber") == 7, "missing").otherwise(C("l_quantity").cast("string"))
    metric_a = t.lineitem.groupBy(site.alias("s"), F.weekofyear("l_shipdate").alias("w")).agg(
        F.round(F.avg("l_discount"), 4).alias("rate")
    )
    flag = C("l_returnflag")
    return {
        "metric_a": metric_a.select("s", F.lit("EU").alias("r"), C("w").cast("string").alias("w"), "rate"),
        "metric_b": t.lineitem.select(site, flag, F.lit("EU"), blank, week, week, day_space, value, blank, blank),
        "metric_c": t.lineitem.select(
            site, flag, F.lit("EU"), blank, week, week, day_t, C("l_linenumber").cast("string"), blank, blank, blank, blank
        ),
        "metric_d": t.lineitem.select(
            site, flag, F.lit("EU"), blank, week, week, day_space, C("l_extendedprice").cast("string"), blank, blank, blank
        ),
        "root_cause": t.lineitem.select(
            site, day_space, day_space, flag, C("l_linestatus"), C("l_linestatus"), C("l_linenumber").cast("string"), F.lit(""), C("l_tax")
        ),
    }


WEEKS = range(1, 54)
SITE = "'SITE_' || l_suppkey % 40"


def _wide(value: str, where: str = "true", digits: int = 2) -> str:
    cells = ", ".join(f'round(coalesce(sum({value}) FILTER (week(l_shipdate) = {w}), 0), {digits}) AS "{w}"' for w in WEEKS)
    return f"SELECT {SITE} AS site, {cells} FROM lineitem WHERE {where} GROUP BY 1"


def _weeks(digits: int) -> dict[str, int]:
    return {str(w): digits for w in WEEKS}


RATE_A = f"(SELECT {SITE} AS site, week(l_shipdate) AS w, round(avg(l_discount), 4) AS rate FROM lineitem GROUP BY 1, 2)"

parts(
    "report_weekly_site_bundle",
    lambda t: weekly_sites.report_weekly_site_bundle(site_tables(t), weekly_sites.WeeklySitesConfig(WEEKS, "SITE_7")),
    {
        "metric_b_wide": _wide("l_quantity", "l_linenumber != 7"),
        "metric_a_wide": f"SELECT site, "
        + ", ".join(f"printf('%.0f%%', round(max(rate) FILTER (w = {w}) * 100, 0)) AS \"{w}\"" for w in WEEKS)
        + f" FROM {RATE_A} GROUP BY 1",
        "metric_a_total": f"SELECT site, printf('%.0f%%', round(avg(rate) * 100, 0)) AS avg_metric_a FROM {RATE_A} GROUP BY 1",
        "metric_b_total": f"SELECT {SITE} AS site, sum(l_quantity) AS total_metric_b FROM lineitem WHERE l_linenumber != 7 GROUP BY 1",
        "metric_c_wide": _wide("l_linenumber::DOUBLE"),
        "metric_c_total": f"SELECT {SITE} AS site, sum(l_linenumber)::DOUBLE AS total_metric_c FROM lineitem GROUP BY 1",
        "metric_d_total": f"SELECT {SITE} AS site, round(sum(l_extendedprice), 2) AS total_metric_d FROM lineitem GROUP BY 1",
        "site_metric_c": f"SELECT CAST(week(l_shipdate) AS VARCHAR) AS week, sum(l_linenumber)::DOUBLE AS metric_c_count FROM lineitem WHERE {SITE} = 'SITE_7' GROUP BY 1",
        "site_metric_d": f"SELECT CAST(week(l_shipdate) AS VARCHAR) AS week, round(sum(l_extendedprice), 2) AS units FROM lineitem WHERE {SITE} = 'SITE_7' GROUP BY 1",
        "metric_a_dashboard": f"SELECT site, 'EU' AS region, w::INTEGER AS week, printf('%.0f%%', round(rate * 100, 0)) AS metric_a_rate FROM {RATE_A}",
        "metric_d_wide": _wide("l_extendedprice"),
        "metric_b_dashboard": f"""SELECT {SITE} AS site, l_returnflag AS group_1, 'EU' AS region, NULL::DOUBLE AS target, week(l_shipdate)::INTEGER AS week_number,
            CAST(week(l_shipdate) AS VARCHAR) AS week, CASE WHEN l_linenumber != 7 THEN l_quantity END AS metric_b_value, NULL::DOUBLE AS metric_b_last_year,
            NULL::DOUBLE AS yoy_change, '00:00:00' AS time, CAST(l_shipdate AS DATE) AS date, dayname(l_shipdate) AS weekday FROM lineitem""",
        "metric_d_dashboard": f"""SELECT {SITE} AS site, l_returnflag AS group_1, 'EU' AS region, NULL::DOUBLE AS target_rate, week(l_shipdate)::INTEGER AS week_number,
            CAST(week(l_shipdate) AS VARCHAR) AS week, l_extendedprice AS units, NULL::DOUBLE AS metric_d_rate, NULL::DOUBLE AS vs_target,
            NULL::DOUBLE AS yoy, '00:00:00' AS time, CAST(l_shipdate AS DATE) AS date, dayname(l_shipdate) AS weekday FROM lineitem""",
        "root_cause_dashboard": f"""SELECT {SITE} AS site, l_returnflag AS process_path, l_linestatus AS category, l_linestatus AS subcategory,
            CAST(l_linenumber AS VARCHAR) AS root_cause, '' AS commentary, l_tax AS metric_a_bps, CAST(l_shipdate AS DATE) AS start_date, '00:00:00' AS start_time,
            dayname(l_shipdate) AS start_weekday, CAST(l_shipdate AS DATE) AS end_date, '00:00:00' AS end_time, dayname(l_shipdate) AS end_weekday FROM lineitem""",
        "root_cause_by_process": """SELECT l_returnflag AS process_path, CAST(l_linenumber AS VARCHAR) AS root_cause, round(sum(l_tax), 4) AS bps
            FROM lineitem GROUP BY 1, 2""",
        "root_cause_total": "SELECT CAST(l_linenumber AS VARCHAR) AS root_cause, round(sum(l_tax), 4) AS bps FROM lineitem GROUP BY 1",
        "site_metric_a": f"SELECT w::INTEGER AS week, round(median(rate), 6) AS metric_a_rate FROM {RATE_A} WHERE site = 'SITE_7' GROUP BY 1",
        "site_metric_b": f"""SELECT CAST(week(l_shipdate) AS VARCHAR) AS week, round(sum(CASE WHEN l_linenumber != 7 THEN l_quantity ELSE 0 END), 3) AS metric_b_value
            FROM lineitem WHERE {SITE} = 'SITE_7' GROUP BY 1""",
        "metric_c_dashboard": f"""SELECT {SITE} AS site, l_returnflag AS group_2, 'EU' AS region, NULL::DOUBLE AS target_rate, week(l_shipdate)::INTEGER AS week_number,
            CAST(week(l_shipdate) AS VARCHAR) AS week, l_linenumber::DOUBLE AS metric_c_count, NULL::DOUBLE AS metric_c_rate, NULL::DOUBLE AS vs_target,
            NULL::DOUBLE AS wow, NULL::DOUBLE AS yoy, '00:00:00' AS time, CAST(l_shipdate AS DATE) AS date, dayname(l_shipdate) AS weekday FROM lineitem""",
    },
    {
        "metric_b_wide": _weeks(2),
        "metric_c_wide": _weeks(2),
        "metric_d_wide": _weeks(2),
        "metric_d_total": {"total_metric_d": 2},
        "site_metric_d": {"units": 2},
        "root_cause_by_process": {"bps": 4},
        "root_cause_total": {"bps": 4},
        "site_metric_a": {"metric_a_rate": 6},
    },
)


@query(
    "report_weekly_site_bundle__found_weeks",
    f"""SELECT * FROM (PIVOT (SELECT {SITE} AS site, week(l_shipdate)::VARCHAR AS week, l_quantity FROM lineitem WHERE l_linenumber != 7) ON week
        USING round(coalesce(sum(l_quantity), 0), 2) GROUP BY site)""",
)
def _(t: Tables) -> DataFrame:
    """Weeks as they are found in the extract."""
    wide = weekly_sites.report_weekly_site_bundle(site_tables(t))["metric_b_wide"]
    return rounded(wide, 2, *[c for c in wide.columns if c != "site"])


# --- event seasonality -----------------------------------------------------


def strike_tables(t: Tables) -> dict[str, DataFrame]:
    rows = t.orders.select(
        F.to_date("o_orderdate").alias("date"),
        (C("o_orderkey") % 97).alias("strikes"),
        F.concat(F.lit("POINT("), (C("o_custkey") % 60).cast("string"), F.lit(" 1)")).alias("place"),
    )
    late = rows.filter(C("date") >= "1999-01-01")
    return {
        "current": late.withColumns({"week": F.weekofyear("date"), "dow": cal.date_names("date", "weekday")}),
        "earlier": rows.filter(C("date") < "1999-01-01"),
    }


STRIKES = """(SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey % 97 AS strikes, 'POINT(' || o_custkey % 60 || ' 1)' AS place FROM orders)"""
CURRENT = f"(SELECT * FROM {STRIKES} WHERE date >= DATE '1999-01-01')"

parts(
    "report_event_seasonality",
    lambda t: seasonality.report_event_seasonality(strike_tables(t), seasonality.SeasonalityConfig(year=1998)),
    {
        "month_share": f"""SELECT month_txt, year, part, sum(part) OVER (PARTITION BY year)::BIGINT AS total, round(part / sum(part) OVER (PARTITION BY year) * 100, 6) AS pct
            FROM (SELECT monthname(date) AS month_txt, year(date)::INTEGER AS year, sum(strikes)::BIGINT AS part FROM {STRIKES} GROUP BY 1, 2)""",
        "weekday_mean": f"SELECT dayname(date) AS weekday, round(avg(strikes), 6) AS mean_strikes FROM {CURRENT} GROUP BY 1",
        "weekday_box": f"""WITH q AS (SELECT dayname(date) AS weekday, quantile_cont(strikes, 0.25) AS q1, median(strikes) AS median, quantile_cont(strikes, 0.75) AS q3 FROM {CURRENT} GROUP BY 1)
            SELECT weekday, q1, median, q3, min(strikes::DOUBLE) FILTER (strikes >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max(strikes::DOUBLE) FILTER (strikes <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
                   count(*) FILTER (strikes < q1 - 1.5 * (q3 - q1) OR strikes > q3 + 1.5 * (q3 - q1)) AS outliers FROM {CURRENT} c JOIN q ON q.weekday = dayname(c.date) GROUP BY ALL""",
        "weeks": f"""SELECT strftime(date, '%Y') || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS week, sum(strikes)::BIGINT AS strikes
            FROM {STRIKES} WHERE year(date) = 1998 GROUP BY 1""",
        "months": f"SELECT month(date)::INTEGER AS month, left(monthname(date), 3) AS month_txt, sum(strikes)::BIGINT AS strikes FROM {STRIKES} WHERE year(date) = 1998 GROUP BY 1, 2",
        "quarters": f"""SELECT quarter, strikes, printf('%.1fM', round(strikes / 1e6, 1)) AS strikes_formatted, quarter[-2:] AS quarter_number, quarter[:4] AS year
            FROM (SELECT strftime(date, '%Y') || '-Q' || quarter(date) AS quarter, sum(strikes)::BIGINT AS strikes FROM {STRIKES} GROUP BY 1)""",
        "top_days": f"SELECT date, sum(strikes)::BIGINT AS strikes FROM {CURRENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "top_places": f"SELECT place, count(*) AS n FROM {CURRENT} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40",
    },
    {"month_share": {"pct": 6}, "weekday_mean": {"mean_strikes": 6}},
)

# --- company valuation -----------------------------------------------------

INDUSTRY = {"BUILDING": "Artificial Intelligence", "AUTOMOBILE": "FinTech", "MACHINERY": "Health", "HOUSEHOLD": "Travel", "FURNITURE": "Unknown trade"}
CONTINENT = ["Atlantis", *companies.CONTINENTS]


def company_rows(t: Tables) -> dict[str, DataFrame]:
    nation = t.nation.select(C("n_nationkey").alias("c_nationkey"), "n_name")
    industry = F.lit(None).cast("string")
    for segment, name in INDUSTRY.items():
        industry = F.when(C("c_mktsegment") == segment, name).otherwise(industry)
    continent = F.element_at(F.array(*[F.lit(x) for x in CONTINENT]), (C("c_nationkey") % 7 + 1).cast("int"))
    key = C("c_custkey").cast("int")
    rows = t.customer.join(nation, "c_nationkey").select(
        C("c_name").alias("company"),
        F.concat(F.lit("$"), F.abs(F.round(C("c_acctbal") / 100)).cast("bigint").cast("string"), F.lit("B")).alias("valuation"),
        F.date_add(F.lit("2019-01-01").cast("date"), key % 1200).alias("date_joined"),
        industry.alias("industry"),
        F.when(key % 17 != 0, F.concat(F.lit("City "), (key % 50).cast("string"))).alias("city"),
        C("n_name").alias("country"),
        continent.alias("continent"),
        (F.lit(2023) - key % 30).alias("year_founded"),
    )
    return {"companies": rows}


COMPANY = f"""(SELECT c_name AS company, abs(round(c_acctbal / 100))::BIGINT AS v, CAST(DATE '2019-01-01' + (c_custkey % 1200)::INTEGER AS DATE) AS joined,
    CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN '{expected.REPAIRS.get(v, v)}'" for k, v in INDUSTRY.items())} END AS industry,
    c_custkey % 17 = 0 AS no_city, n_name AS country, CASE c_nationkey % 7 WHEN 0 THEN NULL ELSE c_nationkey % 7 END AS continent_number,
    CASE WHEN c_name = 'Customer#000000007' THEN 2000 ELSE (2023 - c_custkey % 30)::INTEGER END AS founded FROM customer JOIN nation ON n_nationkey = c_nationkey)"""
COMPANY_CONFIG = companies.CompanyConfig(founded={"Customer#000000007": 2000})

parts(
    "report_company_valuation",
    lambda t: companies.report_company_valuation(company_rows(t), COMPANY_CONFIG),
    {
        "by_industry": f"SELECT industry, max(year(joined) - founded)::INTEGER AS max_years, max(v) AS max_valuation, count(*) AS companies FROM {COMPANY} GROUP BY 1",
        "by_country": f"SELECT country, sum(v)::BIGINT AS valuation FROM {COMPANY} GROUP BY 1 ORDER BY 2 DESC, 1 OFFSET 4",
        "per_quarter": f"""SELECT q AS quarter, round(avg(v), 6) AS avg_valuation, q[-2:] AS quarter_number, q[:4] AS year_joined
            FROM (SELECT strftime(joined, '%Y') || '-Q' || quarter(joined) AS q, v FROM {COMPANY} WHERE year(joined) IN (2020, 2021)) GROUP BY 1""",
        "per_week": f"""SELECT strftime(joined, '%Y') || '-W' || lpad(CAST(week(joined) AS VARCHAR), 2, '0') AS week, count(*) AS companies
            FROM {COMPANY} WHERE year(joined) = 2021 GROUP BY 1""",
        "impossible": f"""SELECT company, year(joined)::INTEGER AS year_joined, founded AS year_founded, (year(joined) - founded)::INTEGER AS years_to_join,
            'joined before founded' AS rule FROM {COMPANY} WHERE year(joined) < founded""",
        "industry_check": """SELECT 'before' AS stage, 'Artificial Intelligence' AS value, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL SELECT 'before', 'FinTech', count(*) FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
            UNION ALL SELECT unnest(['before', 'after']), 'Unknown trade', count(*) FROM customer WHERE c_mktsegment = 'FURNITURE'""",
        "missing_cost": """SELECT n * 8 AS cells, full_rows * 8 AS cells_after_row_drop, n * 7 AS cells_after_col_drop, round((n - full_rows) / n, 6) AS row_drop_share,
            0.125::DOUBLE AS col_drop_share FROM (SELECT count(*) AS n, count(*) FILTER (c_custkey % 17 != 0) AS full_rows FROM customer)""",
        "missing_by_country": f"SELECT country, count(*) AS n FROM {COMPANY} WHERE no_city GROUP BY 1",
        "halves": f"""SELECT CASE WHEN v <= m THEN 'high' ELSE 'low' END AS valuation_half, continent_number, count(*) AS companies
            FROM {COMPANY}, (SELECT median(v) AS m FROM {COMPANY}) GROUP BY 1, 2""",
        "years_by_founding": f"SELECT founded AS year_founded, round(avg(year(joined) - founded), 6) AS avg_num_yrs FROM {COMPANY} GROUP BY 1",
        "years_by_month": f"""WITH c AS (SELECT monthname(joined) AS month_joined, (year(joined) - founded)::DOUBLE AS y FROM {COMPANY}),
            q AS (SELECT month_joined, quantile_cont(y, 0.25) AS q1, median(y) AS median, quantile_cont(y, 0.75) AS q3 FROM c GROUP BY 1)
            SELECT month_joined, q1, median, q3, min(y) FILTER (y >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max(y) FILTER (y <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
                   count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers FROM c JOIN q USING (month_joined) GROUP BY ALL""",
    },
    {"per_quarter": {"avg_valuation": 6}, "missing_cost": {"row_drop_share": 6}, "years_by_founding": {"avg_num_yrs": 6}},
)

# --- demographics ----------------------------------------------------------

EDUCATION = {"1-URGENT": "Bachelors", "2-HIGH": "Masters", "3-MEDIUM": "Doctorate", "4-NOT SPECIFIED": "HS-grad"}


def people_rows(t: Tables) -> dict[str, DataFrame]:
    buyer = t.customer.select(C("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    education = F.lit(None).cast("string")
    for priority, name in EDUCATION.items():
        education = F.when(C("o_orderpriority") == priority, name).otherwise(education)
    rows = t.orders.join(buyer, "o_custkey").select(
        (C("o_orderkey") % 20 + 20).alias("age"),
        education.alias("education"),
        C("o_orderstatus").alias("race"),
        F.when(C("o_orderkey") % 2 == 0, "Male").otherwise("Female").alias("sex"),
        C("c_mktsegment").alias("occupation"),
        F.when(C("c_nationkey") != 0, F.concat(F.lit("NATION_"), C("c_nationkey").cast("string"))).alias("native_country"),
        (C("o_orderkey") % 10 + 1).alias("hours_per_week"),
        F.when(C("o_totalprice") > 300_000, ">50K").otherwise("<=50K").alias("salary"),
    )
    return {"people": rows}


PEOPLE = f"""(SELECT DISTINCT o_orderkey % 20 + 20 AS age, CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EDUCATION.items())} END AS education,
    o_orderstatus AS race, CASE WHEN o_orderkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, c_mktsegment AS occupation,
    CASE WHEN c_nationkey != 0 THEN 'NATION_' || c_nationkey END AS native_country, o_orderkey % 10 + 1 AS hours, o_totalprice > 300000 AS rich
    FROM orders JOIN customer ON c_custkey = o_custkey)"""
HIGHER = "coalesce(education IN ('Bachelors', 'Masters', 'Doctorate'), false)"
NATIONS = f"""(SELECT native_country, count(*) AS people, count(*) FILTER (rich) AS rich, round(nullif(count(*) FILTER (rich), 0) / count(*) * 100, 6) AS rich_pct
    FROM {PEOPLE} WHERE native_country IS NOT NULL GROUP BY 1)"""

parts(
    "report_demographics",
    lambda t: demographics.report_demographics(people_rows(t), demographics.DemographicsConfig(country="NATION_7")),
    {
        "figures": f"""SELECT count(*) AS people, round(avg(age) FILTER (sex = 'Male'), 6) AS average_age,
            round(count(*) FILTER (education = 'Bachelors') / count(education) * 100, 6) AS bachelor_pct,
            round(count(*) FILTER (rich AND {HIGHER}) / count(*) FILTER ({HIGHER}) * 100, 6) AS higher_education_rich_pct,
            round(count(*) FILTER (rich AND NOT {HIGHER}) / count(*) FILTER (NOT {HIGHER}) * 100, 6) AS lower_education_rich_pct,
            min(hours) AS min_hours, round(count(*) FILTER (rich AND hours = 1) / count(*) FILTER (hours = 1) * 100, 6) AS least_hours_rich_pct FROM {PEOPLE}""",
        "races": f"SELECT race, count(*) AS n FROM {PEOPLE} GROUP BY 1",
        "countries": f"SELECT * FROM {NATIONS}",
        "best_country": f"SELECT * FROM {NATIONS} ORDER BY rich_pct DESC NULLS LAST, native_country LIMIT 1",
        "top_occupation": f"SELECT occupation, count(*) AS n FROM {PEOPLE} WHERE rich AND native_country = 'NATION_7' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    },
    {
        "figures": {c: 6 for c in ("average_age", "bachelor_pct", "higher_education_rich_pct", "lower_education_rich_pct", "least_hours_rich_pct")},
        "countries": {"rich_pct": 6},
        "best_country": {"rich_pct": 6},
    },
)

# --- health screen ---------------------------------------------------------


def exam_rows(t: Tables) -> dict[str, DataFrame]:
    line = C("l_linenumber")
    rows = t.lineitem.select(
        (C("l_quantity") * 365 + line * 100).alias("age"),
        (140 + C("l_quantity")).alias("height"),
        (50 + line * 6 + C("l_discount") * 100).alias("weight"),
        (100 + C("l_quantity")).alias("ap_hi"),
        (60 + C("l_tax") * 1000).alias("ap_lo"),
        (line % 3 + 1).alias("cholesterol"),
        (C("l_orderkey") % 2 + 1).cast("int").alias("gluc"),
        (C("l_returnflag") == "A").cast("int").alias("smoke"),
        (C("l_returnflag") == "R").cast("int").alias("alco"),
        (C("l_linestatus") == "O").cast("int").alias("active"),
        (C("l_extendedprice") > 30_000).cast("int").alias("cardio"),
    )
    return {"exams": rows}


EXAMS = """(SELECT *, CASE WHEN bmi > 25 THEN 1 ELSE 0 END AS overweight FROM (SELECT *, weight / power(height * 0.01, 2) AS bmi, age / 365 AS years_old FROM (
    SELECT l_quantity * 365 + l_linenumber * 100 AS age, 140 + l_quantity AS height, 50 + l_linenumber * 6 + l_discount * 100 AS weight,
    100 + l_quantity AS ap_hi, 60 + l_tax * 1000 AS ap_lo, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS cholesterol, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END AS gluc,
    CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS smoke, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS alco, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS active,
    CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS cardio FROM lineitem)))"""
EXAM_COLS = ["age", "height", "weight", "ap_hi", "ap_lo", "cholesterol", "gluc", "smoke", "alco", "active", "cardio", "bmi", "years_old", "overweight"]
TRIMMED = f"""(SELECT e.* FROM {EXAMS} e, (SELECT quantile_cont(height, 0.025) AS hl, quantile_cont(height, 0.975) AS hh, quantile_cont(weight, 0.025) AS wl,
    quantile_cont(weight, 0.975) AS wh FROM {EXAMS}) q WHERE ap_lo <= ap_hi AND height BETWEEN hl AND hh AND weight BETWEEN wl AND wh)"""

parts(
    "report_health_screen",
    lambda t: health.report_health_screen(exam_rows(t)),
    {
        "counts": " UNION ALL ".join(
            f"SELECT cardio, '{c}' AS variable, {c} AS value, count(*) AS total FROM {EXAMS} GROUP BY 1, 3" for c in ("cholesterol", "gluc", "smoke", "alco", "active")
        ),
        "corr": "WITH x AS " + TRIMMED + " "
        + " UNION ALL ".join(
            f"SELECT '{b}' AS row_col, '{a}' AS col_col, round(corr({a}, {b}), 6) AS corr FROM x"
            for i, a in enumerate(EXAM_COLS)
            for b in EXAM_COLS[i + 1 :]
        ),
    },
    {"corr": {"corr": 6}},
)

# --- trend projection ------------------------------------------------------


@query(
    "report_trend_projection",
    """WITH l AS (SELECT year(o_orderdate) AS year, o_totalprice AS level FROM orders WHERE o_orderkey % 50 != 0),
            f AS (SELECT 'all' AS fit, regr_slope(level, year) AS s, regr_intercept(level, year) AS i, 1995 AS y0 FROM l
                  UNION ALL SELECT 'recent', regr_slope(level, year), regr_intercept(level, year), 1999 FROM l WHERE year >= 1999)
       SELECT fit, y::INTEGER AS year, round(s * y + i, 2) AS predicted FROM (SELECT *, unnest(range(y0, 2011)) AS y FROM f)""",
)
def _(t: Tables) -> DataFrame:
    levels = t.orders.select(
        F.year("o_orderdate").alias("year"), F.when(C("o_orderkey") % 50 != 0, C("o_totalprice")).alias("level")
    )
    report = trend.report_trend_projection({"levels": levels}, trend.TrendConfig(1995, 1999, 2010))
    return rounded(report, 2, "predicted")


# --- sales exploration -----------------------------------------------------


def sales_rows(t: Tables) -> dict[str, DataFrame]:
    buyers = t.orders.join(t.customer.select(C("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    orders = buyers.select(C("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority", "c_nationkey")
    goods = t.part.select(C("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_name")
    rows = t.lineitem.join(orders, "l_orderkey").join(goods, "l_partkey")
    day = C("o_orderdate")
    sold = rows.select(
        F.year(day).alias("year"),
        cal.date_names(day, "month").alias("month"),
        F.dayofmonth(day).alias("day"),
        C("l_linenumber").alias("customer_age"),
        F.concat(F.lit("NATION_"), C("c_nationkey").cast("string")).alias("country"),
        C("o_orderpriority").alias("state"),
        C("p_type").alias("product_category"),
        C("p_brand").alias("sub_category"),
        C("p_name").alias("product"),
        C("l_quantity").alias("order_quantity"),
        (C("l_extendedprice") * (C("l_discount") - C("l_tax"))).alias("profit"),
        C("l_extendedprice").alias("revenue"),
    )
    return {"sales": sold}


SOLD = """(SELECT o_orderdate AS d, l_linenumber AS age, 'NATION_' || c_nationkey AS country, o_orderpriority AS state, p_type, p_brand, p_name, l_quantity AS q,
    l_extendedprice * (l_discount - l_tax) AS profit, l_extendedprice AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey)"""
SALES_CONFIG = sales.SalesConfig(
    year=1998, countries=("NATION_3", "NATION_7"), country="NATION_3", sub_category="Brand#5", states_of="NATION_7", categories=("PROMO", "SMALL"), grid=40
)


def _box(keys: str, value: str, where: str = "true") -> str:
    group = f"{keys}, " if keys else ""
    using = f"USING ({keys.split(' AS ')[-1]})" if keys else "ON true"
    name = f"{keys.split(' AS ')[-1]}, " if keys else ""
    return f"""WITH c AS (SELECT {group}{value}::DOUBLE AS y FROM {SOLD} WHERE {where}),
        q AS (SELECT {name}quantile_cont(y, 0.25) AS q1, median(y) AS median, quantile_cont(y, 0.75) AS q3 FROM c GROUP BY ALL)
        SELECT {name}round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(y) FILTER (y >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
        round(max(y) FILTER (y <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi, count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM c JOIN q {using} GROUP BY ALL"""


BOX_DIGITS = {c: 6 for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")}

parts(
    "report_sales_eda",
    lambda t: sales.report_sales_eda(sales_rows(t), SALES_CONFIG),
    {
        "figures": f"""SELECT round(avg(age), 6) AS mean_age, round(avg(q), 6) AS mean_quantity, round(sum(revenue + 50), 2) AS revenue,
            count(*) FILTER (country IN ('NATION_3', 'NATION_7')) AS in_countries, count(*) FILTER (country = 'NATION_3' AND p_brand = 'Brand#5') AS country_sub_category,
            count(*) FILTER (year(d) = 1998 AND month(d) IN (5, 6, 7)) AS in_months FROM {SOLD}""",
        "month_counts": f"SELECT monthname(d) AS month, count(*) AS n FROM {SOLD} GROUP BY 1",
        "country_counts": f"SELECT country, count(*) AS n FROM {SOLD} GROUP BY 1",
        "products": f"SELECT p_name AS product, count(*) AS n FROM {SOLD} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "states": f"SELECT state, count(*) AS n FROM {SOLD} WHERE country = 'NATION_7' GROUP BY 1",
        "sub_categories": f"SELECT p_type AS product_category, p_brand AS sub_category, count(*) AS n FROM {SOLD} WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1, 2",
        "date_counts": f"SELECT CAST(d AS DATE) AS calculated_date, count(*) AS n FROM {SOLD} GROUP BY 1",
        "quantity_histogram": f"""WITH s AS (SELECT min(q) AS lo, (max(q) - min(q)) / 30 AS w FROM {SOLD}),
            c AS (SELECT least(floor((q - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM {SOLD}, s GROUP BY 1)
            SELECT g::INTEGER AS bin, round(lo + g * w, 6) AS bin_lo, round(lo + (g + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS n
            FROM (SELECT unnest(range(30)) AS g) CROSS JOIN s LEFT JOIN c ON c.bin = g""",
        "age_box": _box("", "age"),
        "quantity_box": _box("", "q"),
        "year_counts": f"SELECT year(d)::INTEGER AS year, count(*) AS n FROM {SOLD} GROUP BY 1",
        "profit_by_country": _box("country", "profit"),
        "profit_by_month": _box("monthname(d) AS month", "profit", "year(d) = 1998"),
        "age_density": f"""WITH s AS (SELECT count(*) AS n, stddev_samp(age) * power(count(*), -0.2) AS h, min(age) - 0.5 * (max(age) - min(age)) AS lo,
              2 * (max(age) - min(age)) / 39 AS step FROM {SOLD}), a AS (SELECT age, count(*) AS w FROM {SOLD} GROUP BY 1), g AS (SELECT unnest(range(40))::INTEGER AS i)
            SELECT i, round(lo + i * step, 6) AS x, round(sum(w * exp(-0.5 * power((lo + i * step - age) / h, 2))) / (n * h * sqrt(2 * pi())), 10) AS density
            FROM g CROSS JOIN s CROSS JOIN a GROUP BY i, lo, step, n, h""",
    },
    {
        "figures": {"mean_age": 6, "mean_quantity": 6, "revenue": 2},
        "quantity_histogram": {"bin_lo": 6, "bin_hi": 6},
        "age_box": BOX_DIGITS,
        "quantity_box": BOX_DIGITS,
        "profit_by_country": BOX_DIGITS,
        "profit_by_month": BOX_DIGITS,
        "age_density": {"x": 6, "density": 10},
    },
)

# --- activity and sleep ----------------------------------------------------


def log_tables(t: Tables) -> dict[str, DataFrame]:
    kind, v = C("event_type"), C("value")
    activity_rows = t.events.filter(kind != "view").select(
        C("user_id").alias("Id"),
        F.date_format("ts", "M/d/yyyy").alias("ActivityDate"),
        C("event_id").alias("TotalSteps"),
        (v * 10).alias("Calories"),
        v.alias("VeryActiveMinutes"),
        (v * 2).alias("FairlyActiveMinutes"),
        (v * 3).alias("LightlyActiveMinutes"),
        (v * 4).alias("SedentaryMinutes"),
    )
    sleep_rows = t.events.filter(kind == "view").select(
        C("user_id").alias("Id"),
        F.concat(F.date_format("ts", "M/d/yyyy"), F.lit(" 12:00:00 AM")).alias("SleepDay"),
        F.lit(1).alias("TotalSleepRecords"),
        (v * 5 + C("event_id") % 9).alias("TotalMinutesAsleep"),
        (v * 6).alias("TotalTimeInBed"),
    )
    return {"activity": activity_rows, "sleep": sleep_rows}


MERGED = """(SELECT dayname(a.ts) AS weekday, a.value AS av, s.value * 5 + s.event_id % 9 AS asleep, s.value * 6 AS in_bed
    FROM events a JOIN events s ON a.user_id = s.user_id AND dayname(a.ts) = dayname(s.ts) WHERE a.event_type != 'view' AND s.event_type = 'view')"""

parts(
    "report_activity_sleep",
    lambda t: activity.report_activity_sleep(log_tables(t)),
    {
        "active_minutes": " UNION ALL ".join(
            f"SELECT weekday, '{n}' AS activity_type, round(sum({v}), 2) AS minutes FROM {MERGED} GROUP BY 1"
            for n, v in {"veryactiveminutes": "av", "fairlyactiveminutes": "av * 2", "lightlyactiveminutes": "av * 3"}.items()
        ),
        "rest_minutes": " UNION ALL ".join(
            f"SELECT weekday, '{n}' AS rest_and_sleep, round(sum({v}), 2) AS minutes FROM {MERGED} GROUP BY 1"
            for n, v in {"totalminutesasleep": "asleep", "sedentaryminutes": "av * 4"}.items()
        ),
        "participants": """SELECT 'activity' AS log, count(DISTINCT user_id) AS participants FROM events WHERE event_type != 'view'
            UNION ALL SELECT 'sleep', count(DISTINCT user_id) FROM events WHERE event_type = 'view'""",
        "fit": f"""SELECT count(*) AS n, round(regr_slope(asleep, in_bed), 6) AS slope, round(regr_intercept(asleep, in_bed), 4) AS intercept,
            round(regr_r2(asleep, in_bed), 6) AS r2, round(sqrt((regr_syy(asleep, in_bed) - power(regr_sxy(asleep, in_bed), 2) / regr_sxx(asleep, in_bed))
            / (count(*) - 2) / regr_sxx(asleep, in_bed)), 8) AS std_err FROM {MERGED}""",
        "fit_band": f"""WITH f AS (SELECT count(*)::DOUBLE AS n, regr_slope(asleep, in_bed) AS a, regr_intercept(asleep, in_bed) AS b, avg(in_bed) AS m, min(in_bed) AS lo,
            max(in_bed) AS hi, regr_sxx(asleep, in_bed) AS sxx, (regr_syy(asleep, in_bed) - power(regr_sxy(asleep, in_bed), 2) / regr_sxx(asleep, in_bed)) / (count(*) - 2) AS s2
            FROM {MERGED}), p AS (SELECT unnest(range(80)) AS i, lo + i * (hi - lo) / 79 AS x, a, b, sqrt(s2 * (1 / n + power(x - m, 2) / sxx)) AS e, {T_975} AS t FROM f)
            SELECT round(x, 6) AS x, round(a * x + b, 5) AS predicted, round(e, 7) AS std_err_mean, round(a * x + b - t * e, 5) AS low, round(a * x + b + t * e, 5) AS high FROM p""",
        "activity_summary": " UNION ALL ".join(
            f"""SELECT '{n}' AS column, count(*) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, min({v})::DOUBLE AS min,
                round(quantile_cont({v}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({v}::DOUBLE, 0.5), 6) AS median,
                round(quantile_cont({v}::DOUBLE, 0.75), 6) AS q3, max({v})::DOUBLE AS max FROM events WHERE event_type != 'view'"""
            for n, v in {"totalsteps": "event_id", "calories": "value * 10", "veryactiveminutes": "value"}.items()
        ),
        "sleep_summary": " UNION ALL ".join(
            f"""SELECT '{n}' AS column, count(*) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, min({v}) AS min,
                round(quantile_cont({v}, 0.25), 6) AS q1, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS q3, max({v}) AS max
                FROM events WHERE event_type = 'view'"""
            for n, v in {"totalminutesasleep": "value * 5 + event_id % 9", "totaltimeinbed": "value * 6"}.items()
        ),
    },
    {
        "active_minutes": {"minutes": 2},
        "rest_minutes": {"minutes": 2},
        "fit": {"slope": 6, "intercept": 4, "r2": 6, "std_err": 8},
        "fit_band": {"x": 6, "predicted": 5, "std_err_mean": 7, "low": 5, "high": 5},
        "activity_summary": {c: 6 for c in ("mean", "std", "q1", "median", "q3")},
        "sleep_summary": {c: 6 for c in ("mean", "std", "q1", "median", "q3")},
    },
)
