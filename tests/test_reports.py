"""Reports on small hand-made inputs: the cases the generated tables do not hold."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftboard.plans import activity, cancellation, companies, cost, demographics, forecast, hierarchy, kpi, operations, productivity, rates, weekly_sites

from conftest import as_set

D, TS = dt.date, dt.datetime


# --- KPI trend -------------------------------------------------------------

def kpi_tables(rows, days=10):
    impacts = sorted({c for cols in kpi.IMPACTS.values() for c in cols})
    start = TS(2025, 1, 5)  # a Sunday
    facts = [
        ("F1", "EU", "DAILY", start + dt.timedelta(days=i), 10.0, *[float(i + 1) if c == "labor_impact" else None for c in impacts], 70.0 + 3 * i, 91.0, 1, 5)
        for i in range(days)
    ]
    facts.append(("F2", None, "DAILY", start, 10.0, *[1.0] * len(impacts), 90.0, 99.0, 0, 1))
    facts.append(("F1", "EU", "WEEKLY", start, 10.0, *[99.0] * len(impacts), 1.0, 1.0, 9, 9))
    facts.append(("F1", "EU", "DAILY", start, 0.0, *[99.0] * len(impacts), 1.0, 1.0, 9, 9))
    schema = (
        "facility_id string, region_code string, metric_type string, snapshot_date timestamp_ntz, total_impact double, "
        + ", ".join(f"{c} double" for c in impacts)
        + ", efficiency_percentage double, quality_score double, error_count bigint, processed_units bigint"
    )
    volumes = [("EU", start + dt.timedelta(days=i), 100 * (1 + i // 7)) for i in range(0, days)]
    dims = [("F1", "Spain", "South", "Hub", "SORT", "Ops", "Geo")]
    return {
        "performance": rows(facts, schema),
        "volumes": rows(volumes, "region_code string, snapshot_date timestamp_ntz, total_volume bigint"),
        "facilities": rows(
            dims,
            "facility_code string, country_name string, region_name string, hub_name string, facility_type string, operations_region string, geographic_region string",
        ),
    }


def test_kpi_trend(rows):
    got = {(r.facility_id, r.date): r for r in kpi.report_kpi_trend(kpi_tables(rows)).collect()}
    assert len(got) == 11
    first, eighth = got["F1", D(2025, 1, 5)], got["F1", D(2025, 1, 12)]
    # weekly volume: 7 days of 100, then 3 of 200
    assert (first.total_volume, eighth.total_volume) == (700, 600)
    assert first.execution_bps == pytest.approx(1 / 700 * 10_000)
    assert first.execution_bps_wow_change_pct is None
    assert eighth.execution_bps_wow_change_pct == pytest.approx((8 / 600 - 1 / 700) / (1 / 700) * 100)
    assert eighth.efficiency_wow_change == pytest.approx(21)
    assert eighth.ma_7d_efficiency == pytest.approx(sum(70 + 3 * i for i in range(1, 8)) / 7)
    assert [got["F1", D(2025, 1, d)].efficiency_flag for d in (5, 9, 14)] == ["Low Efficiency", "Normal", "High Efficiency"]
    assert first.week_number == 2 and first.year == 2025
    lone = got["F2", D(2025, 1, 5)]
    # no region, so no volume: ratios stay missing; no dimension row either
    assert lone.execution_bps is None and lone.country_name is None and lone.quality_flag == "Excellent Quality"


def test_kpi_floor_applies_after_windows(rows):
    tables = kpi_tables(rows)
    late = kpi.report_kpi_trend(tables, kpi.KpiTrendConfig(report_floor=D(2025, 1, 11)))
    r = {x.date: x for x in late.collect()}
    assert min(r) == D(2025, 1, 12) and r[D(2025, 1, 12)].execution_bps_wow_change_pct is not None


# --- cost ------------------------------------------------------------------

def test_cost_variance_country_and_unknown(rows):
    week = D(2025, 1, 5)
    data = [
        ("F1", 1, 2025, "AT", "Labor_Backlog", 1.0, 30.0, week),
        ("F1", 1, 2025, "AT", None, 2.0, 10.0, week),
        ("F1", 1, 2025, "AT", "", 0.0, 60.0, week),
        ("F1", 1, 2025, "ZZ", "Other", 5.0, 60.0, week),
        ("F2", 1, 2025, "AT", "Labor_Backlog", 0.0, 5.0, week),
    ]
    schema = "facility_code string, week_number int, year int, region_code string, cost_category string, over_budget double, planned_cost double, start_of_week date"
    dims = rows([("F1", "SORT", "R", "H")], "facility_code string, facility_type string, region_name string, hub_name string")
    got = {(r.facility_code, r.country_name): r for r in cost.report_cost_variance({"costs": rows(data, schema), "facilities": dims}).collect()}
    austria = got["F1", "Austria"]
    # affected 100 of planned 160: ratio 0.625, shared by cost
    assert austria.labor_backlog_bps == pytest.approx(0.625 * 30 / 100 * 10_000)
    assert austria.unknown_variance_bps == pytest.approx(0.625 * 10 / 100 * 10_000)
    assert austria.unknown_variance_cost_affected == 10
    assert got["F1", "ZZ"].labor_backlog_bps == 0
    assert got["F2", "Austria"].labor_backlog_bps == 0 and got["F2", "Austria"].hub_name is None


# --- operations ------------------------------------------------------------

def test_ops_needs_hub_and_region(rows):
    staffing = list(kpi.STAFFING.values())
    day = TS(2025, 1, 1)
    schema = "facility_code string, process_date timestamp_ntz, " + ", ".join(f"{c} double" for c in staffing) + (
        ", efficiency_percentage double, total_processed_volume bigint, error_count bigint, quality_score double"
    )
    facts = rows([(f, day, *[1.0] * 12, e, 5, 1, 90.0) for f in ("A", "B", "C") for e in (80.0, 100.0)], schema)
    everything = rows(
        [("A", "S", "g", "X", "h"), ("B", "S", "g", "X", None), ("C", "S", "g", "X", "h")],
        "facility_code string, facility_type string, geographic_region string, country_name string, hub_name string",
    )
    dims = rows([("A", "North"), ("B", "North"), ("C", None)], "facility_code string, operations_region string")
    got = operations.report_ops_metrics({"metrics": facts, "all_facilities": everything, "facilities": dims}).collect()
    assert [(r.facility_code, r.avg_efficiency, r.os_hrs_unplanned, r.total_volume, r.week_number, r.year) for r in got] == [
        ("A", 90.0, 2.0, 10, "01", "2025")
    ]


# --- cancellations ---------------------------------------------------------

def test_cancellation_grains(rows):
    monday = TS(2025, 1, 6)
    items = [
        ("F1", monday, "LATE_SHIPMENT", 1, 10),
        ("F1", monday, "CUSTOMER_REQUESTED", 2, 10),
        ("F1", monday + dt.timedelta(days=1), "SYSTEM_ERROR", 5, 5),
        ("F1", monday + dt.timedelta(days=1), "NOT_LISTED", 5, 0),
        ("F2", monday, "LATE_SHIPMENT", 1, 1),
        ("F1", TS(2024, 12, 26, 12), "LATE_SHIPMENT", 9, 9),
    ]
    tables = {
        "items": rows(items, "facility_id string, scheduled_delivery_date timestamp_ntz, cancel_reason string, quantity_cancelled bigint, quantity_requested bigint"),
        "facilities": rows(
            [("F1", "ES", "G", "S", "R"), ("F2", None, "G", "S", "R")],
            "facility_id string, country_code string, operations_group string, site_type string, region_name string",
        ),
    }
    got = cancellation.report_cancellation(tables).collect()
    daily = sorted((r.date, r.execution_dpmo, r.cancellation_rate) for r in got if r.aggregation_level == "daily")
    assert daily == [(D(2025, 1, 6), 50_000.0, 15.0), (D(2025, 1, 7), 0.0, 100.0)]
    (week,) = [r for r in got if r.aggregation_level == "weekly"]
    # mean of the daily rates, not the ratio of the sums
    assert (week.week_start_date, week.total_quantity_requested, week.cancellation_rate, week.date) == (D(2025, 1, 6), 25, 57.5, None)


# --- hierarchy -------------------------------------------------------------

def test_hierarchy_numbers_every_row(rows):
    day = TS(2025, 1, 7)
    dims = rows(
        [("FAC001", "S", "R1", "Country1", "H"), ("FAC009", "S", "R1", "Country2", "H")],
        "facility_id string, facility_type string, region_code string, country string, hub_id string",
    )
    hours = ", ".join(f"metric_{x}_hours double" for x in hierarchy.HOURS)
    run = ("FAC001", "Country1", "S", "p", "g", day, day + dt.timedelta(hours=1), 2.0, None, 1.0, 1.0, 1.0)
    tables = {
        "facilities": dims,
        "volume": rows([("FAC001", 10.0, day, hierarchy.HierarchyConfig().metric_type)], "facility_id string, volume_metric double, metric_date timestamp_ntz, metric_type string"),
        "values": rows([("C1", day, 5.0), ("C2", day, 7.0), ("C2", day, 9.0), ("C9", day, 1.0)], "country_code string, snapshot_date timestamp_ntz, total_value double"),
        # the same run twice is averaged, not added
        "performance": rows([run, run], f"facility_id string, country string, facility_type string, process_name string, process_group string, start_time timestamp_ntz, end_time timestamp_ntz, {hours}"),
        "quality_events": rows([(1, "FAC009", day, "d", 4, "c", "r"), (2, "FAC009", day, "d", 8, "c", "r")], "event_id bigint, facility_id string, event_date timestamp_ntz, shift_id string, event_units bigint, category string, root_cause string"),
        "event_status": rows([(1, "approved"), (1, "approved"), (2, "open")], "event_id bigint, status string"),
        "buffer_events": rows([("FAC001", "p", day, day, "f", "c", "d", 90)], "facility_id string, process_path string, event_start timestamp_ntz, event_end timestamp_ntz, event_family string, event_cause string, event_description string, minutes_affected bigint"),
    }
    got = hierarchy.report_metric_hierarchy(tables).collect()
    assert sorted(r.row_num for r in got) == list(range(1, len(got) + 1))
    values = {(r.metric, r.facility_id): r.metric_value for r in got}
    assert values["Performance Metric A", "FAC001"] == 2_000.0
    assert ("Performance Metric B", "FAC001") not in values  # missing hours give no row
    assert values["Performance Metric A", None] == 0.0  # a country without volume
    assert values["Quality Events", "FAC009"] == 4.0
    assert values["Buffer Management", "FAC001"] == 1.5
    assert values["SLA - ProcessB", "FAC001"] == 120.0 and ("SLA - ProcessA", "FAC009") not in values


# --- forecast --------------------------------------------------------------

def forecast_tables(rows):
    day = TS(2025, 1, 2, 3)
    return {
        "forecasts": rows([("EU", "F1", day, 10.0, 100.0, 10.4, 110.0, day), ("EU", "F2", day, 10.0, 100.0, 0.0, 100.0, day), ("EU", "F3", day, 10.0, 100.0, 10.5, 100.0, day)],
                          "region string, facility_id string, forecast_timestamp timestamp_ntz, forecast_value_a double, forecast_value_b double, actual_value_a double, actual_value_b double, last_update_date timestamp_ntz"),
        "downtime": rows([("F1", "R", "S", "a", "g", day, day + dt.timedelta(minutes=m, seconds=59), float(m)) for m in (5, 7)],
                         "facility_id string, region_name string, facility_type string, process_area string, process_group string, start_time_local timestamp_ntz, end_time_local timestamp_ntz, total_hours double"),
        "incidents": rows([(i, "F1", day, "d", 10 * i, "c", "r") for i in (1, 2, 3)], "incident_id bigint, facility_id string, incident_date timestamp_ntz, shift string, affected_units bigint, category string, root_cause string"),
        "incident_status": rows([(1, "approved"), (2, "approved"), (3, "draft")], "incident_id bigint, incident_status string"),
    }


def test_forecast_alignment(rows):
    tables = forecast_tables(rows)
    got = {r.facility_id: r for r in forecast.report_forecast_alignment(tables).collect()}
    assert set(got) == {"F1", "F3"}  # a zero actual leaves its row out
    f1 = got["F1"]
    assert (f1.forecast_a_pct_diff, f1.forecast_a_alignment_status) == (4.0, "Aligned")
    assert (f1.forecast_b_pct_diff, f1.forecast_b_alignment_status) == (10.0, "Not Aligned")
    assert (f1.total_downtime_minutes, f1.affected_units, f1.row_multiplier) == (12, 30, 4)
    assert got["F3"].forecast_a_alignment_status == "Aligned" and got["F3"].row_multiplier == 1
    detail = forecast.report_forecast_alignment(tables, forecast.ForecastConfig(detail=True))
    assert as_set(detail.filter("facility_id = 'F1'"), "total_downtime_minutes", "affected_units") == [(5, 10), (5, 20), (7, 10), (7, 20)]


# --- notebooks -------------------------------------------------------------

def test_rates_drop_unplanned(rows):
    def row(process, planned, dow="Sun", start="2025-01-05T08:00:00.000Z"):
        return (" Day ", process, start, "2025-01-05T09:00:00.000Z", dow, "10.0", "8.0", planned)

    data = [row("PROCESS_A", "9"), row("PROCESS_A", "null"), row("PROCESS_A", None), row("OTHER", "9"), row("PROCESS_A", "11", " wed ")]
    d = rows(data, "shift string, process_group string, interval_start_local string, interval_end_local string, dow string, predicted_rate string, actual_rate string, planned_rate string")
    got = rates.report_rate_comparison({"rates": d})
    assert as_set(got["summary"], "shift_view", "interval_start_local", "planned_rate") == [("Front End Day", "08:00 GMT", 9.0), ("Midweek Day", "08:00 GMT", 11.0)]
    assert as_set(got["deviation"], "shift_view", "predicted_vs_actual_pct_dev") == [("Front End Day", "25.00%"), ("Midweek Day", "25.00%")]
    assert got["by_time"].filter("rate_type = 'planned_rate'").first().rate == 10.0


def test_productivity_from_file(spark, tmp_path):
    lines = ["timestamp,planned_value,actual_value"] + ["junk,x,y"] * 5
    lines += ["2025-01-05 08:10:00,100,104", "2025-01-05 08:20:00,100,bad", "2025-01-05 18:40:00,100,50", "2025-01-05 19:30:00,0,5", "2025-01-05 23:00:00,10,20"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    raw = spark.read.schema("timestamp string, planned_value string, actual_value string").option("header", True).csv(str(tmp_path))
    got = productivity.report_productivity({"raw": raw}, productivity.ProductivityConfig(skip_rows=5))
    assert as_set(got, "period", "shift", "variance_pct", "status") == [
        ("P1", "Day", 4.0, "Aligned"),
        ("P4", "Night", None, "Not Aligned"),
        ("P5", "Night", 100.0, "Not Aligned"),
    ]


def test_weekly_bundle(rows):
    def extract(header, data):
        return rows(data, ", ".join(f"c{i} string" for i in range(len(header))))

    h = weekly_sites.HEADERS
    def fill(header, **values):
        return tuple(values.get(c) for c in header)

    tables = {
        "metric_a": rows([("A", "EU", "10", 0.126), ("A", "EU", "9", 0.5), ("B", "EU", "9", None)], "s string, r string, w string, v double"),
        "metric_b": extract(h["metric_b"], [fill(h["metric_b"], site="A", week_number="9", week="W9", date="2025-03-01 10:00:00", metric_b_value=v) for v in ("1", "2.5", "x")]),
        "metric_c": extract(h["metric_c"], [fill(h["metric_c"], site="A", week_number="10", week="W10", date="2025-03-03T10:00:00", metric_c_count="4")]),
        "metric_d": extract(h["metric_d"], [fill(h["metric_d"], site="A", week_number=None, week="W10", full_date="2025-03-03 10:00", units="4")]),
        "root_cause": rows([("A", "2025-03-01 10:00", "2025-03-02 11:00", "p", "c", "s", "late", "", 1.5), ("A", None, None, "q", "c", "s", "late", "", None)],
                           "a string, b string, c string, d string, e string, f string, g string, h string, i double"),
    }
    got = weekly_sites.report_weekly_site_bundle(tables, weekly_sites.WeeklySitesConfig([10, 9], "A"))
    assert got["metric_a_wide"].columns == ["site", "9", "10"]
    assert as_set(got["metric_a_wide"]) == [("A", "50%", "13%"), ("B", None, None)]
    assert as_set(got["metric_b_wide"]) == [("A", 3.5, 0.0)]
    assert as_set(got["metric_b_dashboard"], "date", "time", "weekday").count((D(2025, 3, 1), "10:00:00", "Saturday")) == 3
    assert got["metric_c_dashboard"].first().date == D(2025, 3, 3)
    assert got["metric_d_wide"].count() == 0 and as_set(got["metric_d_total"]) == [("A", 4.0)]
    assert as_set(got["root_cause_total"]) == [("late", 1.5)]
    assert as_set(got["root_cause_by_process"]) == [("p", "late", 1.5), ("q", "late", 0.0)]
    assert as_set(got["site_metric_a"]) == [(10, 0.126), (9, 0.5)]


def test_company_validation(rows):
    data = [
        ("Yi", "$5B", D(2017, 1, 1), "FinTech", None, "China", "Asia", 2025),
        ("Ab", "$180B", D(2020, 5, 1), "Fintech", "Paris", "France", "Europe", 2010),
        ("Cd", "$1B", D(2021, 5, 1), "Zoo", "Rome", "Italy", "Moon", 2019),
    ]
    d = rows(data, "company string, valuation string, date_joined date, industry string, city string, country string, continent string, year_founded int")
    got = companies.report_company_valuation({"companies": d}, companies.CompanyConfig(biggest=1))
    assert as_set(got["impossible"], "company", "years_to_join") == [("Yi", -8)]
    assert as_set(got["industry_check"], "stage", "value") == [("after", "Zoo"), ("before", "FinTech"), ("before", "Zoo")]
    assert as_set(got["by_country"]) == [("China", 5), ("Italy", 1)]
    fixed = companies.report_company_valuation({"companies": d}, companies.CompanyConfig(founded={"Yi": 2011}))
    assert fixed["impossible"].count() == 0
    assert as_set(fixed["by_industry"], "industry", "max_years", "max_valuation") == [("Fintech", 10, 180), ("Zoo", 2, 1)]
    assert as_set(got["halves"], "valuation_half", "continent_number") == [("high", 2), ("high", None), ("low", 3)]


def test_demographics_missing_education_counts_as_lower(rows):
    data = [
        (30, "Bachelors", "W", "Male", "Tech", "India", 1, ">50K"),
        (30, "Bachelors", "W", "Male", "Tech", "India", 1, ">50K"),
        (40, None, "B", "Male", "Sales", "Cuba", 1, "<=50K"),
        (20, "HS-grad", "W", "Female", "Sales", "India", 40, ">50K"),
    ]
    d = rows(data, "age int, education string, race string, sex string, occupation string, native_country string, hours_per_week int, salary string")
    got = demographics.report_demographics({"people": d})
    r = got["figures"].first()
    assert (r.people, r.average_age, r.bachelor_pct, r.higher_education_rich_pct, r.lower_education_rich_pct, r.least_hours_rich_pct) == (3, 35.0, 50.0, 100.0, 50.0, 50.0)
    assert as_set(got["countries"], "native_country", "rich_pct") == [("Cuba", None), ("India", 100.0)]
    assert as_set(got["top_occupation"]) == [("Sales", 1)]  # a tie goes to the first name


def test_activity_sums_equal_the_merged_rows(rows):
    act = [(1, "4/12/2016", 100, 5.0, 1.0, 2.0, 3.0, 4.0), (1, "4/19/2016", 100, 5.0, 10.0, 20.0, 30.0, 40.0), (2, "4/12/2016", 9, 1.0, 7.0, 7.0, 7.0, 7.0)]
    slp = [(1, "4/12/2016 12:00:00 AM", 1, 300.0, 320.0), (1, "4/26/2016 12:00:00 AM", 1, 400.0, 450.0)]
    tables = {
        "activity": rows(act, "Id bigint, ActivityDate string, TotalSteps int, Calories double, VeryActiveMinutes double, FairlyActiveMinutes double, LightlyActiveMinutes double, SedentaryMinutes double"),
        "sleep": rows(slp, "Id bigint, SleepDay string, TotalSleepRecords int, TotalMinutesAsleep double, TotalTimeInBed double"),
    }
    got = activity.report_activity_sleep(tables)
    a, s = activity.prepared(tables)
    merged = a.join(s, ["id", "weekday"])
    brute = merged.groupBy("weekday").agg(*[F.sum(c).alias(c) for c in activity.ACTIVE]).first()
    mine = {r.activity_type: r.minutes for r in got["active_minutes"].collect()}
    assert mine == {c: brute[c] for c in activity.ACTIVE}
    assert as_set(got["participants"]) == [("activity", 2), ("sleep", 1)]
    pairs = merged.select("totaltimeinbed", "totalminutesasleep").toPandas()
    assert got["fit"].first().n == len(pairs) == 4
    slope = pd.Series(pairs.totalminutesasleep).cov(pairs.totaltimeinbed) / pairs.totaltimeinbed.var()
    assert got["fit"].first().slope == pytest.approx(slope)


def test_report_order(rows):
    from shiftboard.plans.order import report_order

    d = rows([("b", "daily", dt.date(2024, 1, 2), None), ("a", "daily", dt.date(2024, 1, 3), None), ("a", "weekly", None, dt.date(2024, 1, 1)),
              ("a", "daily", dt.date(2024, 1, 2), None)], "facility_id string, aggregation_level string, date date, week_start_date date")
    got = [(r.facility_id, r.aggregation_level, r.date) for r in report_order(d, "report_cancellation").collect()]
    assert got == [("a", "weekly", None), ("a", "daily", dt.date(2024, 1, 2)), ("a", "daily", dt.date(2024, 1, 3)), ("b", "daily", dt.date(2024, 1, 2))]


def test_cancellation_ignores_repeated_dimension_rows(rows):
    from shiftboard.plans import cancellation

    items = rows([("f", dt.datetime(2025, 1, 6), "LATE_SHIPMENT", 2, 10)], "facility_id string, scheduled_delivery_date timestamp_ntz, cancel_reason string, quantity_cancelled long, quantity_requested long")
    place = ("f", "US", "g", "t", "r")
    dims = rows([place, place], "facility_id string, country_code string, operations_group string, site_type string, region_name string")
    got = cancellation.report_cancellation({"items": items, "facilities": dims}).filter("aggregation_level = 'daily'").collect()
    assert [(r.execution_count, r.total_quantity_requested) for r in got] == [(2, 10)]


def test_reports_read_other_column_names(rows):
    tables = kpi_tables(rows)
    own = {"volumes": {"snapshot_date": "vol_day"}, "performance": {"facility_id": "site", "constraint_impact": "capacity_constraint_impact"}}
    other = dict(tables)
    for table, columns in own.items():
        other[table] = other[table].withColumnsRenamed(columns)
    config = kpi.KpiTrendConfig()
    plain = kpi.report_kpi_trend(tables, config)
    assert as_set(kpi.report_kpi_trend(other, config, names=own)) == as_set(plain)
    with pytest.raises(ValueError, match="has no columns"):
        kpi.report_kpi_trend(tables, config, names=own)
    with pytest.raises(ValueError, match="no such tables"):
        kpi.report_kpi_trend(tables, config, names={"x": {}})


def test_a_part_of_the_site_bundle_costs_that_part(spark, monkeypatch):
    """Without declared weeks each wide result lists its weeks with a job; asking for another one starts none."""
    from shiftboard.bindings.registry import Tables
    from shiftboard.bindings.study_reports import site_tables
    from shiftboard.operators import reshape
    from shiftboard.plans.weekly_sites import report_weekly_site_bundle

    listed = []
    real = reshape._listed
    monkeypatch.setattr(reshape, "_listed", lambda *x: listed.append(x) or real(*x))
    bundle = report_weekly_site_bundle(site_tables(Tables(spark, "/root/testdata/sf0.001")))
    assert bundle["root_cause_total"].count() > 0 and not listed
    assert len(bundle["metric_c_wide"].columns) > 10 and len(listed) == 1
