"""Warehouse reports over stand-in facts cut from the given tables.

Each stand-in is a plain projection of a whole table into the report's columns;
the SQL beside it makes the same projection and states the report independently.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import calendar as cal
from ..plans import cancellation, cost, forecast, hierarchy, kpi, operations
from .aggregates import rounded
from . import expected
from .registry import Tables, query

C = F.col


def facilities(t: Tables) -> DataFrame:
    """Suppliers as facilities; every seventh has no hub."""
    nation = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    rows = t.supplier.join(nation, "s_nationkey").join(region, "n_regionkey")
    hub = F.when(C("s_suppkey") % 7 != 0, C("r_name"))
    return rows.select(
        C("s_suppkey").cast("string").alias("facility_code"),
        C("s_suppkey").cast("string").alias("facility_id"),
        F.when(C("s_suppkey") % 2 == 0, "SORT").otherwise("HUB").alias("facility_type"),
        C("n_name").alias("country_name"),
        C("n_name").alias("country"),
        C("n_name").alias("region_name"),
        C("r_name").alias("region_code"),
        hub.alias("hub_name"),
        hub.alias("hub_id"),
        F.when(C("s_suppkey") % 5 != 0, C("r_name")).alias("operations_region"),
        C("r_name").alias("geographic_region"),
        F.when(C("s_suppkey") % 11 != 0, C("n_name")).alias("country_code"),
        C("r_name").alias("operations_group"),
        F.when(C("s_suppkey") % 2 == 0, "SORT").otherwise("HUB").alias("site_type"),
    )


FACILITIES = """(SELECT CAST(s_suppkey AS VARCHAR) AS facility_code, CAST(s_suppkey AS VARCHAR) AS facility_id,
    CASE WHEN s_suppkey % 2 = 0 THEN 'SORT' ELSE 'HUB' END AS facility_type, n_name AS country_name, n_name AS country, n_name AS region_name,
    r_name AS region_code, CASE WHEN s_suppkey % 7 != 0 THEN r_name END AS hub_name, CASE WHEN s_suppkey % 7 != 0 THEN r_name END AS hub_id,
    CASE WHEN s_suppkey % 5 != 0 THEN r_name END AS operations_region, r_name AS geographic_region,
    CASE WHEN s_suppkey % 11 != 0 THEN n_name END AS country_code, r_name AS operations_group,
    CASE WHEN s_suppkey % 2 = 0 THEN 'SORT' ELSE 'HUB' END AS site_type
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

SUNDAY = "CAST({0} AS DATE) - CAST(dayofweek({0}) AS INTEGER)"


def sunday(c: str) -> str:
    return f"CAST({SUNDAY.format(c)} AS DATE)"


# --- KPI trend (flagship) --------------------------------------------------

# impact column -> event type whose value it takes (others NULL)
IMPACT_SOURCE = {
    "labor_impact": "click",
    "capacity_impact": "view",
    "event_impact": "error",
    "constraint_impact": "purchase",
    "unallocated_impact": "signup",
    "complexity_impact": "click",
    "training_impact": "view",
    "downtime_impact": "error",
    "planning_impact": "purchase",
}


def performance(t: Tables) -> DataFrame:
    """Events as daily performance rows of the facility numbered by their user."""
    kind = C("event_type")
    return t.events.select(
        C("user_id").cast("string").alias("facility_id"),
        (C("user_id") % 4).cast("string").alias("region_code"),
        F.when(kind == "signup", "WEEKLY").otherwise("DAILY").alias("metric_type"),
        C("ts").alias("snapshot_date"),
        C("value").alias("total_impact"),
        *[F.when(kind == e, C("value")).alias(n) for n, e in IMPACT_SOURCE.items()],
        (70 + C("event_id") % 30).cast("double").alias("efficiency_percentage"),
        (85 + C("event_id") % 15).cast("double").alias("quality_score"),
        F.when(kind == "error", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("error_count"),
        C("event_id").alias("processed_units"),
    )


PERFORMANCE = f"""(SELECT CAST(user_id AS VARCHAR) AS facility_id, CAST(user_id % 4 AS VARCHAR) AS region_code,
    CASE WHEN event_type = 'signup' THEN 'WEEKLY' ELSE 'DAILY' END AS metric_type, ts AS snapshot_date, value AS total_impact,
    {", ".join(f"CASE WHEN event_type = '{e}' THEN value END AS {n}" for n, e in IMPACT_SOURCE.items())},
    (70 + event_id % 30)::DOUBLE AS efficiency_percentage, (85 + event_id % 15)::DOUBLE AS quality_score,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count, event_id AS processed_units FROM events)"""


def volumes(t: Tables) -> DataFrame:
    # no fact has region 9 and region 3 has no volume, so its ratios meet a missing denominator
    region = C("user_id") % 4
    return t.events.select(
        F.when(region == 3, F.lit("9")).otherwise(region.cast("string")).alias("region_code"),
        C("ts").alias("snapshot_date"),
        C("event_id").alias("total_volume"),
    )


def _impact_sum(cols) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in cols)


KPI_VOLUME = f"""(SELECT CASE WHEN user_id % 4 = 3 THEN '9' ELSE CAST(user_id % 4 AS VARCHAR) END AS region_code, {sunday('ts')} AS wk,
    sum(event_id)::BIGINT AS volume FROM events WHERE ts > TIMESTAMP '2023-12-31' GROUP BY 1, 2)"""
KPI_DAILY = f"""(SELECT facility_id, CAST(snapshot_date AS DATE) AS date, max(volume) AS total_volume, sum(total_impact) AS total_impact,
    {", ".join(f"sum({_impact_sum(cols)}) AS {n}_sum" for n, cols in expected.IMPACTS.items())},
    avg(efficiency_percentage) AS avg_efficiency, sum(error_count)::BIGINT AS total_errors, avg(quality_score) AS avg_quality_score,
    sum(processed_units)::BIGINT AS total_processed_units
    FROM {PERFORMANCE} p LEFT JOIN {KPI_VOLUME} v ON v.region_code = p.region_code AND v.wk = {sunday('snapshot_date')}
    WHERE total_impact > 0 AND metric_type = 'DAILY' GROUP BY 1, 2)"""
BPS = [f"{n}_bps" for n in expected.IMPACTS]
KPI_ROUNDED = [*BPS, "avg_efficiency", "avg_quality_score", "execution_bps_wow_change_pct", "efficiency_wow_change", "quality_wow_change",
               "ma_7d_execution_bps", "ma_7d_efficiency", "ma_7d_quality"]


@query(
    "report_kpi_trend",
    f"""WITH d AS (SELECT *, {", ".join(f"{n}_sum / nullif(total_volume, 0) * 10000 AS {n}_bps" for n in expected.IMPACTS)} FROM {KPI_DAILY}),
        w AS (SELECT *, lag(execution_bps, 7) OVER p AS le, lag(avg_efficiency, 7) OVER p AS lf, lag(avg_quality_score, 7) OVER p AS lq,
              avg(execution_bps) OVER r AS ma_7d_execution_bps, avg(avg_efficiency) OVER r AS ma_7d_efficiency, avg(avg_quality_score) OVER r AS ma_7d_quality
              FROM d WINDOW p AS (PARTITION BY facility_id ORDER BY date),
                            r AS (PARTITION BY facility_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
        f AS (SELECT facility_id, date, week(date + INTERVAL 1 DAY)::INTEGER AS week_number, year(date)::INTEGER AS year, total_volume,
              total_impact, total_errors, total_processed_units, {", ".join(BPS)}, avg_efficiency, avg_quality_score,
              (execution_bps - le) / nullif(le, 0) * 100 AS execution_bps_wow_change_pct, avg_efficiency - lf AS efficiency_wow_change,
              avg_quality_score - lq AS quality_wow_change, ma_7d_execution_bps, ma_7d_efficiency, ma_7d_quality,
              CASE WHEN avg_efficiency < 80 THEN 'Low Efficiency' WHEN avg_efficiency >= 95 THEN 'High Efficiency' ELSE 'Normal' END AS efficiency_flag,
              CASE WHEN avg_quality_score < 90 THEN 'Quality Alert' WHEN avg_quality_score >= 98 THEN 'Excellent Quality' ELSE 'Normal' END AS quality_flag
              FROM w WHERE date > DATE '2024-01-03')
       SELECT f.* REPLACE ({", ".join(f"round({c}, 4) AS {c}" for c in [*KPI_ROUNDED, "total_impact"])}), country_name, region_name, hub_name,
              facility_type, operations_region, geographic_region FROM f LEFT JOIN {FACILITIES} x ON x.facility_code = f.facility_id""",
)
def _(t: Tables) -> DataFrame:
    tables = {"volumes": volumes(t), "performance": performance(t), "facilities": facilities(t).drop("facility_id")}
    config = kpi.KpiTrendConfig(volume_floor=dt.date(2023, 12, 31), report_floor=dt.date(2024, 1, 3))
    return rounded(kpi.report_kpi_trend(tables, config), 4, *KPI_ROUNDED, "total_impact")


# --- multi-source board ----------------------------------------------------

STAFFING_COLS = [
    f"{side}_{unit}_{reason}"
    for side in ("overstaffing", "understaffing")
    for unit in ("hours", "cost")
    for reason in ("not_actioned", "unplanned", "not_adopted")
]


def staffing_value(i: int) -> Column:
    """A measure per staffing column from a line item; every third is sometimes missing."""
    v = C("l_quantity") * (i + 1) if i % 2 else C("l_extendedprice")
    return F.when(C("l_linenumber") != i, v) if i % 3 == 0 else v


def staffing_sql(i: int) -> str:
    v = f"l_quantity * {i + 1}" if i % 2 else "l_extendedprice"
    return f"CASE WHEN l_linenumber != {i} THEN {v} END" if i % 3 == 0 else v


def staffing(t: Tables) -> DataFrame:
    dims = facilities(t).select(C("facility_code").cast("bigint").alias("l_suppkey"), "region_name")
    return t.lineitem.join(dims, "l_suppkey").select(
        C("l_suppkey").cast("string").alias("facility_code"),
        C("l_shipdate").alias("process_date"),
        "region_name",
        *[staffing_value(i).alias(n) for i, n in enumerate(STAFFING_COLS)],
        (C("l_quantity") + 50).alias("efficiency_percentage"),
        C("l_orderkey").alias("total_processed_volume"),
        C("l_linenumber").cast("bigint").alias("error_count"),
        (100 - C("l_quantity")).alias("quality_score"),
    )


BOARD_IMPACT = f"""(SELECT facility_id, CAST(snapshot_date AS DATE) AS date, max(volume) AS volume,
    {", ".join(f"sum({_impact_sum(cols)}) AS {n}_sum" for n, cols in expected.IMPACTS.items())}
    FROM {PERFORMANCE} p LEFT JOIN {KPI_VOLUME} v ON v.region_code = p.region_code AND v.wk = {sunday('snapshot_date')}
    WHERE total_impact > 0 AND metric_type = 'DAILY' GROUP BY 1, 2)"""


@query(
    "report_multi_kpi",
    f"""WITH pm AS (SELECT i.facility_id, date, region_name,
              {", ".join(f"CASE WHEN volume > 0 THEN {n}_sum / nullif(volume, 0) * 10000 ELSE 0 END AS {n}_bps" for n in expected.IMPACTS)}
              FROM {BOARD_IMPACT} i LEFT JOIN {FACILITIES} f ON f.facility_code = i.facility_id),
            oh AS (SELECT CAST(l_suppkey AS VARCHAR) AS facility_id, CAST(l_shipdate AS DATE) AS date, region_name,
              {", ".join(f"sum({staffing_sql(STAFFING_COLS.index(c))}) AS {n}" for n, c in expected.STAFFING.items())}
              FROM lineitem JOIN {FACILITIES} f ON f.facility_code = CAST(l_suppkey AS VARCHAR)
              WHERE l_shipdate > TIMESTAMP '2001-10-01' GROUP BY 1, 2, 3),
            qm AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS facility_id, CAST(o_orderdate AS DATE) + 1 AS date, sum(o_orderkey)::DOUBLE AS quality_miss_units
              FROM orders WHERE o_orderdate >= DATE '2001-11-04' - INTERVAL 4 MONTH GROUP BY 1, 2),
            b AS (SELECT coalesce(pm.facility_id, oh.facility_id, qm.facility_id) AS facility_id, coalesce(pm.date, oh.date, qm.date) AS date,
              coalesce(pm.region_name, oh.region_name) AS region_name, pm.* EXCLUDE (facility_id, date, region_name),
              oh.* EXCLUDE (facility_id, date, region_name), quality_miss_units
              FROM pm FULL JOIN oh ON pm.facility_id = oh.facility_id AND pm.date = oh.date
              FULL JOIN qm ON coalesce(pm.facility_id, oh.facility_id) = qm.facility_id AND coalesce(pm.date, oh.date) = qm.date)
       {" UNION ALL ".join(
           f"SELECT facility_id, date, week(date + INTERVAL 1 DAY)::INTEGER AS week_number, year(date)::INTEGER AS year, region_name, "
           f"'{p}' AS pillar, '{s}' AS section, '{g}' AS metric_group, '{m}' AS metric_name, '{u}' AS unit, round({c}::DOUBLE, 4) AS metric_value "
           f"FROM b WHERE date > DATE '2001-10-05'" for p, s, g, m, u, c in expected.BOARD)}""",
)
def _(t: Tables) -> DataFrame:
    quality = t.orders.select(
        (C("o_custkey") % 50).cast("string").alias("facility_id"),
        C("o_orderdate").alias("process_date"),
        C("o_orderkey").alias("defect_units"),
    )
    tables = {
        "volumes": volumes(t).withColumnRenamed("snapshot_date", "metric_date"),
        "impact": performance(t).withColumnsRenamed(
            {"snapshot_date": "metric_date", "constraint_impact": "capacity_constraint_impact"}
        ),
        "facilities": facilities(t).drop("facility_id"),
        "staffing": staffing(t),
        "quality": quality,
    }
    config = kpi.MultiKpiConfig(
        as_of=dt.date(2001, 11, 4),
        quality_months=4,
        volume_floor=dt.date(2023, 12, 31),
        staffing_floor=dt.date(2001, 10, 1),
        report_floor=dt.date(2001, 10, 5),
    )
    return rounded(kpi.report_multi_kpi(tables, config), 4, "metric_value")


# --- cost variance ---------------------------------------------------------

CATEGORY = {"A": "Labor_Backlog", "R": "Equipment_Exception"}


def costs(t: Tables) -> DataFrame:
    flag, line = C("l_returnflag"), C("l_linenumber")
    return t.lineitem.select(
        C("l_suppkey").cast("string").alias("facility_code"),
        F.weekofyear("l_shipdate").alias("week_number"),
        F.year("l_shipdate").alias("year"),
        F.when(line % 3 == 0, "AT").when(line % 3 == 1, "DE").otherwise("XX").alias("region_code"),
        F.when(flag == "A", "Labor_Backlog")
        .when(flag == "R", "Equipment_Exception")
        .when(line % 2 == 0, F.lit(""))
        .when(line % 7 == 0, "Planning_Variance")
        .alias("cost_category"),
        (C("l_discount") - 0.05).alias("over_budget"),
        C("l_extendedprice").alias("planned_cost"),
        cal.week_start_sunday("l_shipdate").alias("start_of_week"),
    )


COST_CASES = {
    "labor_backlog": "cat = 'Labor_Backlog'",
    "equipment_exception": "cat = 'Equipment_Exception'",
    "execution_variance": "cat = 'Execution_Variance'",
    "planning_variance": "cat = 'Planning_Variance'",
    "unknown_variance": "coalesce(cat, '') = ''",
}


@query(
    "report_cost_variance",
    f"""WITH b AS (SELECT CAST(l_suppkey AS VARCHAR) AS fac, week(l_shipdate) AS wk, year(l_shipdate) AS yr,
              CASE l_linenumber % 3 WHEN 0 THEN 'Austria' WHEN 1 THEN 'Germany' ELSE 'XX' END AS country_name,
              CASE WHEN l_returnflag = 'A' THEN 'Labor_Backlog' WHEN l_returnflag = 'R' THEN 'Equipment_Exception' WHEN l_linenumber % 2 = 0 THEN ''
                   WHEN l_linenumber % 7 = 0 THEN 'Planning_Variance' END AS cat,
              l_discount - 0.05 > 0 AS over, l_extendedprice AS cost, {sunday('l_shipdate')} AS date FROM lineitem),
            w AS (SELECT *, sum(CASE WHEN over THEN cost ELSE 0 END) OVER g AS affected, sum(cost) OVER g AS planned FROM b WINDOW g AS (PARTITION BY fac, yr, wk)),
            v AS (SELECT *, CASE WHEN over AND affected > 0 THEN affected / planned * (cost / affected) * 10000 ELSE 0 END AS bps FROM w),
            s AS (SELECT fac AS facility_code, date, country_name,
              {", ".join(f"round(sum(CASE WHEN {c} THEN bps ELSE 0 END), 4) AS {n}_bps" for n, c in COST_CASES.items())},
              {", ".join(f"round(sum(CASE WHEN {c} AND over THEN cost ELSE 0 END), 2) AS {n}_cost_affected" for n, c in COST_CASES.items())}
              FROM v GROUP BY 1, 2, 3)
       SELECT s.*, facility_type, region_name, hub_name FROM s LEFT JOIN {FACILITIES} f USING (facility_code) WHERE date > DATE '1999-12-26'""",
)
def _(t: Tables) -> DataFrame:
    tables = {"costs": costs(t), "facilities": facilities(t).drop("facility_id")}
    report = cost.report_cost_variance(tables, cost.CostConfig(report_floor=dt.date(1999, 12, 26)))
    report = rounded(report, 4, *[f"{n}_bps" for n in COST_CASES])
    return rounded(report, 2, *[f"{n}_cost_affected" for n in COST_CASES])


# --- operations ------------------------------------------------------------

@query(
    "report_ops_metrics",
    f"""WITH fl AS (SELECT DISTINCT facility_code, operations_region, facility_type, geographic_region, country_name, hub_name FROM {FACILITIES}
              WHERE hub_name IS NOT NULL AND operations_region IS NOT NULL)
       SELECT facility_code, l_shipdate AS process_date, country_name, facility_type, geographic_region, operations_region, hub_name,
              lpad(CAST(week(l_shipdate) AS VARCHAR), 2, '0') AS week_number, CAST(isoyear(l_shipdate) AS VARCHAR) AS year,
              {", ".join(f"round(sum({staffing_sql(STAFFING_COLS.index(c))}), 2) AS {n}" for n, c in expected.STAFFING.items())},
              round(avg(l_quantity + 50), 4) AS avg_efficiency, sum(l_orderkey)::BIGINT AS total_volume, sum(l_linenumber)::BIGINT AS total_errors,
              round(avg(100 - l_quantity), 4) AS avg_quality_score
       FROM lineitem JOIN fl ON facility_code = CAST(l_suppkey AS VARCHAR) WHERE l_shipdate > TIMESTAMP '1999-12-31' GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    dims = facilities(t)
    tables = {
        "metrics": staffing(t).drop("region_name"),
        "all_facilities": dims.select("facility_code", "facility_type", "geographic_region", "country_name", "hub_name"),
        "facilities": dims.select("facility_code", "operations_region"),
    }
    report = operations.report_ops_metrics(tables, operations.OpsConfig(dt.date(1999, 12, 31)))
    return rounded(rounded(report, 2, *expected.STAFFING), 4, "avg_efficiency", "avg_quality_score")


# --- cancellations ---------------------------------------------------------

# part types stand in for reasons, one or two per family
REASON = {
    "ECONOMY": "LATE_SHIPMENT",
    "PROMO": "CUSTOMER_REQUESTED",
    "LARGE": "SUPPLIER_ISSUE",
    "MEDIUM": "DELAYED_SUPPLY",
    "SMALL": "SYSTEM_ERROR",
}
FAMILY_TYPES = {"execution": "'ECONOMY'", "manual": "'PROMO'", "planning": "'LARGE', 'MEDIUM'", "system": "'SMALL'"}
RATES = [f"{n}_dpmo" for n in FAMILY_TYPES] + ["cancellation_rate"]


def order_items(t: Tables) -> DataFrame:
    parts = t.part.select(C("p_partkey").alias("l_partkey"), "p_type")
    reason = F.lit(None).cast("string")
    for kind, name in REASON.items():
        reason = F.when(C("p_type") == kind, name).otherwise(reason)
    return t.lineitem.join(parts, "l_partkey").select(
        C("l_suppkey").cast("string").alias("facility_id"),
        C("l_shipdate").alias("scheduled_delivery_date"),
        reason.alias("cancel_reason"),
        F.when(C("l_returnflag") == "R", C("l_quantity")).otherwise(0).cast("bigint").alias("quantity_cancelled"),
        C("l_quantity").cast("bigint").alias("quantity_requested"),
    )


@query(
    "report_cancellation",
    f"""WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS facility_id, CAST(l_shipdate AS DATE) AS d,
              {", ".join(f"sum(CASE WHEN p_type IN ({ts}) AND l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS {n}_count" for n, ts in FAMILY_TYPES.items())},
              sum(l_quantity)::BIGINT AS total_quantity_requested
              FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CAST(l_shipdate AS DATE) > DATE '2000-12-26' GROUP BY 1, 2),
            r AS (SELECT c.*, country_code, operations_group, site_type, region_name,
              {", ".join(f"{n}_count / nullif(total_quantity_requested, 0) * 1000000 AS {n}_dpmo" for n in FAMILY_TYPES)},
              ({" + ".join(f"{n}_count" for n in FAMILY_TYPES)}) / nullif(total_quantity_requested, 0) * 100 AS cancellation_rate
              FROM c JOIN {FACILITIES} f USING (facility_id) WHERE country_code IS NOT NULL)
       SELECT 'daily' AS aggregation_level, facility_id, d AS date, NULL::DATE AS week_start_date, NULL::INTEGER AS week_number, year(d)::INTEGER AS year,
              country_code, operations_group, site_type, region_name, {", ".join(f"{n}_count" for n in FAMILY_TYPES)}, total_quantity_requested,
              {", ".join(f"round({x}, 4) AS {x}" for x in RATES)} FROM r
       UNION ALL
       SELECT 'weekly', facility_id, NULL, CAST(date_trunc('week', d) AS DATE), week(d)::INTEGER, year(d)::INTEGER, country_code, operations_group, site_type,
              region_name, {", ".join(f"sum({n}_count)::BIGINT" for n in FAMILY_TYPES)}, sum(total_quantity_requested)::BIGINT,
              {", ".join(f"round(avg({x}), 4)" for x in RATES)} FROM r GROUP BY 2, 4, 5, 6, 7, 8, 9, 10""",
)
def _(t: Tables) -> DataFrame:
    tables = {"items": order_items(t), "facilities": facilities(t).drop("facility_code")}
    report = cancellation.report_cancellation(tables, cancellation.CancellationConfig(dt.date(2000, 12, 26)))
    return rounded(report, 4, *RATES)


# --- metric hierarchy ------------------------------------------------------

def hierarchy_tables(t: Tables) -> dict[str, DataFrame]:
    dims = facilities(t).drop("facility_code")
    ship = C("l_shipdate")
    runs = t.lineitem.select(
        C("l_suppkey").cast("string").alias("facility_id"),
        F.lit("any").alias("country"),
        F.when(C("l_linestatus") == "F", "SORT").alias("facility_type"),
        C("l_returnflag").alias("process_name"),
        C("l_linestatus").alias("process_group"),
        ship.alias("start_time"),
        (ship + F.expr("INTERVAL 2 HOURS")).alias("end_time"),
        C("l_quantity").alias("metric_a_hours"),
        C("l_extendedprice").alias("metric_b_hours"),
        C("l_tax").alias("metric_c_hours"),
        F.when(C("l_returnflag") == "A", C("l_quantity")).alias("metric_d_hours"),
        F.lit(1.0).alias("metric_e_hours"),
    )
    return {
        "facilities": dims,
        "volume": t.lineitem.select(
            C("l_suppkey").cast("string").alias("facility_id"),
            (C("l_quantity") - 25).alias("volume_metric"),
            ship.alias("metric_date"),
            F.when(C("l_returnflag") == "N", "other").otherwise("type.category.subcategory").alias("metric_type"),
        ),
        "values": t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).select(
            F.concat(F.lit("C"), (C("c_nationkey") % 6).cast("string")).alias("country_code"),
            C("o_orderdate").alias("snapshot_date"),
            C("o_totalprice").alias("total_value"),
        ),
        "performance": runs,
        "quality_events": t.orders.select(
            C("o_orderkey").alias("event_id"),
            (C("o_custkey") % 120).cast("string").alias("facility_id"),
            C("o_orderdate").alias("event_date"),
            C("o_orderpriority").alias("shift_id"),
            (C("o_orderkey") % 100).alias("event_units"),
            C("o_orderpriority").alias("category"),
            C("o_orderpriority").alias("root_cause"),
        ),
        "event_status": t.orders.select(
            C("o_orderkey").alias("event_id"), F.when(C("o_orderstatus") == "F", "approved").otherwise("open").alias("status")
        ),
        "buffer_events": t.lineitem.select(
            C("l_suppkey").cast("string").alias("facility_id"),
            C("l_returnflag").alias("process_path"),
            ship.alias("event_start"),
            ship.alias("event_end"),
            C("l_linestatus").alias("event_family"),
            C("l_linenumber").cast("string").alias("event_cause"),
            F.lit("late").alias("event_description"),
            C("l_quantity").cast("bigint").alias("minutes_affected"),
        ),
    }


HIER_COUNTRIES = {f"C{i}": f"NATION_{i}" for i in range(1, 6)}
HIER_SLA = (("3", "ProcessA", 90), ("3", "ProcessB", 120), ("10", "ProcessA", 95))
FLOOR = "TIMESTAMP '2001-06-30'"
HOUR_SQL = {"a": "l_quantity", "b": "l_extendedprice", "c": "l_tax", "d": "CASE WHEN l_returnflag = 'A' THEN l_quantity END", "e": "1.0"}


@query(
    "report_metric_hierarchy",
    f"""WITH f AS {FACILITIES},
        ve AS (SELECT f.facility_id, country, l_quantity - 25 AS v, week(l_shipdate) AS wk FROM lineitem JOIN f ON f.facility_id = CAST(l_suppkey AS VARCHAR)
               WHERE hub_id IS NOT NULL AND l_shipdate > {FLOOR} AND l_quantity != 25 AND l_returnflag != 'N'),
        va AS (SELECT 'C' || c_nationkey % 6 AS country_code, CASE WHEN c_nationkey % 6 IN (1, 2, 3, 4, 5) THEN 'NATION_' || c_nationkey % 6 ELSE 'C0' END AS country,
               o_orderdate AS snap, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > {FLOOR}),
        ag AS (SELECT country_code, ve.facility_id, snap, avg(va.v) AS avg_value, avg(ve.v) AS avg_volume
               FROM va JOIN (SELECT DISTINCT country FROM f WHERE hub_id IS NOT NULL) k ON k.country = va.country
               LEFT JOIN ve ON ve.country = va.country AND ve.wk = week(snap) GROUP BY 1, 2, 3),
        runs AS (SELECT CAST(l_suppkey AS VARCHAR) AS facility_id, l_returnflag, l_linestatus, l_shipdate AS st,
               {", ".join(f"avg({v}) AS {x}" for x, v in HOUR_SQL.items())} FROM lineitem
               WHERE CAST(l_shipdate AS DATE) > DATE '2001-06-30' AND l_linestatus = 'F' GROUP BY 1, 2, 3, 4),
        pb AS (SELECT country_code AS region, ag.facility_id, CAST(snap AS DATE) AS date,
               {", ".join(f"CASE WHEN avg_volume > 0 THEN sum({x}) / avg_volume * 10000 ELSE 0 END AS metric_{x}_bps" for x in HOUR_SQL)}
               FROM ag LEFT JOIN runs ON runs.st = snap AND runs.facility_id = ag.facility_id GROUP BY 1, 2, 3, snap, avg_value, avg_volume),
        be AS (SELECT CAST(l_suppkey AS VARCHAR) AS facility_id, l_returnflag, l_shipdate, l_linestatus, l_linenumber, avg(l_quantity::BIGINT / 60) AS h
               FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '2001-06-30' GROUP BY 1, 2, 3, 4, 5),
        ba AS (SELECT be.facility_id, CAST(l_shipdate AS DATE) AS date, region_code AS region, sum(h) AS total_buffer_hours
               FROM be JOIN f ON f.facility_id = be.facility_id WHERE hub_id IS NOT NULL GROUP BY 1, 2, 3),
        qe AS (SELECT CAST(o_custkey % 120 AS VARCHAR) AS facility_id, CAST(o_orderdate AS DATE) AS date, sum(o_orderkey % 100)::DOUBLE AS total_event_units
               FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= {FLOOR} GROUP BY 1, 2),
        m AS (SELECT coalesce(pb.facility_id, ba.facility_id, qe.facility_id) AS facility_id, coalesce(pb.date, ba.date, qe.date) AS date,
               coalesce(pb.region, ba.region) AS region, {", ".join(f"metric_{x}_bps" for x in HOUR_SQL)}, total_buffer_hours, total_event_units
               FROM pb FULL JOIN ba ON pb.facility_id = ba.facility_id AND pb.date = ba.date
               FULL JOIN qe ON coalesce(pb.facility_id, ba.facility_id) = qe.facility_id AND coalesce(pb.date, ba.date) = qe.date),
        u AS ({" UNION ALL ".join(
            f"SELECT {s} AS so, {o} AS mo, '{sub}' AS subcategory, '{met}' AS metric, '{unit}' AS unit, date, region, facility_id, NULL AS process_type, {c} AS metric_value FROM m WHERE {c} IS NOT NULL"
            for s, o, sub, met, unit, c in expected.HIERARCHY)}
            UNION ALL SELECT 2, 1, 'Speed', 'SLA - ' || p, 'mins', date, region, m.facility_id, p, mins FROM m
            JOIN (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in HIER_SLA)}) sla(facility_id, p, mins) ON sla.facility_id = m.facility_id)
       SELECT row_number() OVER (ORDER BY so, mo, date, facility_id NULLS FIRST, process_type NULLS FIRST, region NULLS FIRST, metric_value) AS row_num,
              'Output' AS category, subcategory, metric, unit, date, week(date)::INTEGER AS week_number, year(date)::INTEGER AS year, region, facility_id,
              process_type, round(metric_value, 3) AS metric_value FROM u""",
)
def _(t: Tables) -> DataFrame:
    config = hierarchy.HierarchyConfig(floor=dt.date(2001, 6, 30), countries=HIER_COUNTRIES, sla=HIER_SLA)
    return rounded(hierarchy.report_metric_hierarchy(hierarchy_tables(t), config), 3, "metric_value")


# --- forecast alignment ----------------------------------------------------

def forecast_tables(t: Tables) -> dict[str, DataFrame]:
    ship = C("l_shipdate")
    return {
        "forecasts": t.lineitem.select(
            C("l_linestatus").alias("region"),
            C("l_suppkey").cast("string").alias("facility_id"),
            ship.alias("forecast_timestamp"),
            C("l_extendedprice").alias("forecast_value_a"),
            C("l_quantity").alias("forecast_value_b"),
            (C("l_extendedprice") * (1 + C("l_tax"))).alias("actual_value_a"),
            (C("l_quantity") * (1 + C("l_discount")) - 2).alias("actual_value_b"),
            ship.alias("last_update_date"),
        ),
        "downtime": t.orders.select(
            (C("o_custkey") % 100).cast("string").alias("facility_id"),
            F.lit("R").alias("region_name"),
            F.when(C("o_orderstatus") != "P", "SORT").alias("facility_type"),
            C("o_orderpriority").alias("process_area"),
            C("o_orderpriority").alias("process_group"),
            C("o_orderdate").alias("start_time_local"),
            F.timestamp_add("SECOND", (C("o_orderkey") % 7200).cast("int"), C("o_orderdate")).alias("end_time_local"),
            (C("o_orderkey") % 24).cast("double").alias("total_hours"),
        ),
        "incidents": t.orders.select(
            C("o_orderkey").alias("incident_id"),
            (C("o_custkey") % 100).cast("string").alias("facility_id"),
            C("o_orderdate").alias("incident_date"),
            C("o_orderpriority").alias("shift"),
            (C("o_orderkey") % 50).alias("affected_units"),
            C("o_orderpriority").alias("category"),
            C("o_orderpriority").alias("root_cause"),
        ),
        "incident_status": t.orders.select(
            C("o_orderkey").alias("incident_id"),
            F.when(C("o_orderstatus") == "F", "approved").otherwise("draft").alias("incident_status"),
        ),
    }


@query(
    "report_forecast_alignment",
    """WITH fa AS (SELECT l_linestatus AS region, CAST(l_suppkey AS VARCHAR) AS facility_id, CAST(l_shipdate AS DATE) AS forecast_date,
              (avg(l_quantity * (1 + l_discount) - 2) - avg(l_quantity)) / avg(l_quantity) * 100 AS b,
              (avg(l_extendedprice * (1 + l_tax)) - avg(l_extendedprice)) / avg(l_extendedprice) * 100 AS a FROM lineitem
              WHERE l_shipdate > TIMESTAMP '1999-12-31 23:59:59' AND l_quantity * (1 + l_discount) - 2 > 0 AND l_extendedprice > 0 GROUP BY 1, 2, 3),
            dt AS (SELECT facility_id, d, sum(datesub('minute', st, en)) AS total_downtime_minutes, sum(h) AS downtime_total_hours, count(*) AS downtime_events
              FROM (SELECT CAST(o_custkey % 100 AS VARCHAR) AS facility_id, CAST(o_orderdate AS DATE) AS d, o_orderpriority, o_orderdate AS st,
                      o_orderdate + to_seconds(o_orderkey % 7200) AS en, avg(o_orderkey % 24) AS h FROM orders
                      WHERE o_orderstatus != 'P' AND CAST(o_orderdate AS DATE) > DATE '1999-12-31' GROUP BY ALL) GROUP BY 1, 2),
            qi AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS facility_id, CAST(o_orderdate AS DATE) AS d, sum(o_orderkey % 50)::BIGINT AS affected_units, count(*) AS incidents
              FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1999-12-31' GROUP BY 1, 2)
       SELECT fa.region, fa.facility_id, forecast_date, round(b, 2) AS forecast_b_pct_diff, CASE WHEN abs(b) > 5 THEN 'Not Aligned' ELSE 'Aligned' END AS forecast_b_alignment_status,
              round(a, 2) AS forecast_a_pct_diff, CASE WHEN abs(a) > 5 THEN 'Not Aligned' ELSE 'Aligned' END AS forecast_a_alignment_status,
              total_downtime_minutes::BIGINT AS total_downtime_minutes, round(downtime_total_hours, 4) AS downtime_total_hours, downtime_events, affected_units, incidents,
              (greatest(coalesce(downtime_events, 0), 1) * greatest(coalesce(incidents, 0), 1))::BIGINT AS row_multiplier
       FROM fa LEFT JOIN dt ON dt.facility_id = fa.facility_id AND dt.d = forecast_date LEFT JOIN qi ON qi.facility_id = fa.facility_id AND qi.d = forecast_date""",
)
def _(t: Tables) -> DataFrame:
    report = forecast.report_forecast_alignment(forecast_tables(t), forecast.ForecastConfig(dt.date(1999, 12, 31)))
    return rounded(report, 4, "downtime_total_hours")
