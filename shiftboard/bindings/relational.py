"""Projection, filters and joins over whole tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators import aggregate as agg, filters as flt, joins, project as prj
from .registry import Tables, query


def counted(d: DataFrame, *keys: str) -> DataFrame:
    return d.groupBy(*keys).agg(F.count("*").alias("n"))


# --- projection ------------------------------------------------------------

@query("project_columns", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    kept = prj.project_columns(t.customer, keep=["c_mktsegment", "c_custkey", "c_acctbal", "c_name"])
    return prj.project_columns(kept, drop=["c_name", "not_there"])


@query("rename_columns", "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    upper = prj.rename_columns(t.customer, str.upper)
    return prj.rename_columns(prj.rename_columns(upper, str.lower), {"c_custkey": "customer_id", "c_name": "name"})


@query(
    "star_plus_derived",
    "SELECT *, c_acctbal < 0 AS overdrawn, round(c_acctbal * 1.1, 4) AS with_interest FROM customer",
)
def _(t: Tables) -> DataFrame:
    derived = {"overdrawn": F.col("c_acctbal") < 0, "with_interest": F.round(F.col("c_acctbal") * 1.1, 4)}
    return prj.star_plus_derived(t.customer, derived)


@query(
    "derive_arithmetic",
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
              round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    priced = prj.derive_arithmetic(t.lineitem, {"net": net, "charge": net * (1 + F.col("l_tax"))})
    return priced.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("net"), 2).alias("net"), F.round(F.sum("charge"), 2).alias("charge")
    )


@query("positional_header", "SELECT r_regionkey AS id, r_name AS temp_col_1 FROM region")
def _(t: Tables) -> DataFrame:
    return prj.positional_header(t.region, ["id", ""])


@query(
    "point_update",
    """SELECT c_custkey, CASE WHEN c_custkey = 714 THEN 2011.0 ELSE c_acctbal END AS c_acctbal, c_name, c_nationkey, c_mktsegment
       FROM customer""",
)
def _(t: Tables) -> DataFrame:
    return prj.point_update(t.customer, F.col("c_custkey") == 714, {"c_acctbal": 2011.0})


# --- filters ---------------------------------------------------------------

@query(
    "filter_compare",
    """SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem
       WHERE l_quantity >= 40 AND l_discount != 0.05 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    rows = flt.filter_compare(flt.filter_compare(t.lineitem, "l_quantity", ">=", 40.0), "l_discount", "!=", 0.05)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("filter_in_list", "SELECT * FROM part WHERE p_type IN ('PROMO', 'ECONOMY')")
def _(t: Tables) -> DataFrame:
    return flt.filter_in_list(t.part, "p_type", ["PROMO", "ECONOMY"])


@query(
    "filter_not_in",
    """SELECT kind, count(*) AS n, true AS null_kept FROM (SELECT nullif(p_type, 'PROMO') AS kind FROM part)
       WHERE kind NOT IN ('LARGE', 'SMALL') OR kind IS NULL GROUP BY 1
       UNION ALL SELECT kind, count(*), false FROM (SELECT nullif(p_type, 'PROMO') AS kind FROM part)
       WHERE kind NOT IN ('LARGE', 'SMALL') GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    kinds = t.part.select(F.nullif(F.col("p_type"), F.lit("PROMO")).alias("kind"))
    forms = [
        counted(flt.filter_not_in(kinds, "kind", ["LARGE", "SMALL"], keep), "kind").withColumn("null_kept", F.lit(keep))
        for keep in (True, False)
    ]
    return forms[0].unionByName(forms[1])


@query(
    "filter_compound",
    """SELECT l_linestatus, count(*) AS n FROM lineitem
       WHERE (l_returnflag = 'A' AND l_quantity IN (1, 2, 3)) OR (l_returnflag = 'R' AND l_tax <= 0.02 AND NOT l_discount > 0.05)
       GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    accepted = (F.col("l_returnflag") == "A") & F.col("l_quantity").isin(1, 2, 3)
    returned = (F.col("l_returnflag") == "R") & (F.col("l_tax") <= 0.02) & ~(F.col("l_discount") > 0.05)
    return counted(flt.filter_compound(t.lineitem, accepted | returned), "l_linestatus")


@query(
    "filter_null",
    """SELECT lang, 'missing' AS kind, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL GROUP BY 1
       UNION ALL SELECT lang, 'present', count(*) FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1
       UNION ALL SELECT lang, 'null or empty', count(*) FROM documents
       WHERE nullif(replace(source, 'web', ''), 'x') IS NULL OR replace(source, 'web', '') = '' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    blanked = t.documents.withColumn("source", F.replace(F.col("source"), F.lit("web"), F.lit("")))
    kinds = {
        "missing": flt.filter_null(joined, "quality"),
        "present": flt.filter_null(joined, "quality", is_null=False),
        "null or empty": flt.filter_null(blanked, "source", empty_is_null=True),
    }
    parts = [counted(d, "lang").withColumn("kind", F.lit(k)) for k, d in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "filter_date_floor",
    """SELECT 'after_instant' AS mode, count(*) AS n, CAST(min(ts) AS DATE) AS first_day FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'
       UNION ALL SELECT 'after_day', count(*), CAST(min(ts) AS DATE) FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'
       UNION ALL SELECT 'after_close', count(*), CAST(min(ts) AS DATE) FROM events WHERE ts > TIMESTAMP '2024-01-15 23:59:59'
       UNION ALL SELECT 'from', count(*), CAST(min(ts) AS DATE) FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(t: Tables) -> DataFrame:
    modes = ["after_instant", "after_day", "after_close", "from"]
    floor = dt.date(2024, 1, 15)
    parts = [
        flt.filter_date_floor(t.events, "ts", floor, mode)
        .agg(F.count("*").alias("n"), F.to_date(F.min("ts")).alias("first_day"))
        .select(F.lit(mode).alias("mode"), "n", "first_day")
        for mode in modes
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "filter_relative_months",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 14 MONTH GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return counted(flt.filter_relative_months(t.orders, "o_orderdate", dt.date(2001, 8, 1), 14), "o_orderstatus")


@query(
    "filter_period",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, 'quarters' AS kind, count(*) AS n FROM orders
       WHERE year(o_orderdate) || '-Q' || quarter(o_orderdate) IN ('1998-Q1', '1999-Q4') GROUP BY 1
       UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), 'year', count(*) FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    picks = {
        "quarters": flt.filter_period(t.orders, "o_orderdate", quarters=["1998-Q1", "1999-Q4"]),
        "year": flt.filter_period(t.orders, "o_orderdate", year=2000),
    }
    parts = [
        d.groupBy(cal.period_labels("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
        .withColumn("kind", F.lit(k))
        for k, d in picks.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "sentinel_to_null",
    """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type != 'error' GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    marked = t.events.withColumn(
        "planned", F.when(F.col("event_type") == "error", F.lit("null")).otherwise(F.col("value").cast("string"))
    )
    clean = flt.sentinel_to_null(marked, ["planned"])
    return clean.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("planned").cast("double")), 2).alias("total")
    )


# --- joins -----------------------------------------------------------------

@query(
    "join_inner",
    """SELECT l_returnflag, o_orderstatus, count(*) AS n, sum(l_quantity) AS quantity
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    approved = t.orders.filter(F.col("o_orderstatus") == "F").withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.join_inner(t.lineitem, approved, "l_orderkey").groupBy("l_returnflag", "o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "join_left_multi_key",
    """SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity / big), 6) AS share
       FROM lineitem LEFT JOIN (SELECT l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS big FROM lineitem
            WHERE l_quantity > 25 GROUP BY 1, 2, 3) USING (l_suppkey, l_returnflag, l_linestatus) GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    keys = ["l_suppkey", "l_returnflag", "l_linestatus"]
    totals = t.lineitem.filter(F.col("l_quantity") > 25).groupBy(*keys).agg(F.sum("l_quantity").alias("big"))
    joined = joins.join_left_multi_key(t.lineitem, totals, keys)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") / F.col("big")), 6).alias("share")
    )


def facility_dim(t: Tables) -> DataFrame:
    """Stand-in facility dimension: supplier, its nation (country) and region (hub)."""
    nation = t.nation.withColumnRenamed("n_nationkey", "s_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    s = joins.join_dim_enrich(t.supplier, nation, "s_nationkey", ["n_name", "n_regionkey"])
    return joins.join_dim_enrich(s, region, "n_regionkey", ["r_name"])


@query(
    "join_dim_enrich",
    """SELECT s_suppkey, s_name, s_acctbal, s_nationkey, n_regionkey, n_name, r_name
       FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def _(t: Tables) -> DataFrame:
    return facility_dim(t)


@query(
    "join_computed_key",
    """WITH weekly AS (SELECT CAST(date_trunc('week', CAST(ts AS DATE) + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS week_start,
              count(*) AS volume FROM events GROUP BY 1)
       SELECT event_type, week_start, volume, count(*) AS n FROM events LEFT JOIN weekly
         ON CAST(date_trunc('week', CAST(ts AS DATE) + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) = week_start GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    weekly = t.events.groupBy(cal.week_start_sunday("ts").alias("sunday")).agg(F.count("*").alias("volume"))
    joined = joins.join_computed_key(t.events, weekly, {"week_start": (cal.week_start_sunday("ts"), F.col("sunday"))})
    return joined.groupBy("event_type", "week_start", "volume").agg(F.count("*").alias("n"))


@query(
    "join_left_then_notnull",
    "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def _(t: Tables) -> DataFrame:
    return joins.join_left_then_notnull(t.documents.drop("text"), t.labels, "doc_id", "quality")


@query(
    "join_full_outer_chain",
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 2) AS purchase FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2),
            e AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2),
            s AS (SELECT user_id, CAST(ts AS DATE) AS day, round(max(value), 2) AS signup FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
       SELECT coalesce(p.user_id, e.user_id, s.user_id) AS user_id, coalesce(p.day, e.day, s.day) AS day, purchase, errors, signup
       FROM p FULL OUTER JOIN e ON p.user_id = e.user_id AND p.day = e.day
       FULL OUTER JOIN s ON coalesce(p.user_id, e.user_id) = s.user_id AND coalesce(p.day, e.day) = s.day""",
)
def _(t: Tables) -> DataFrame:
    def daily(kinds: tuple[str, ...], measure) -> DataFrame:
        rows = t.events.filter(F.col("event_type").isin(*kinds))
        return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(measure)

    frames = [
        daily(("purchase", "click"), F.round(F.sum("value"), 2).alias("purchase")),
        daily(("error", "view"), F.count("*").alias("errors")),
        daily(("signup",), F.round(F.max("value"), 2).alias("signup")),
    ]
    return joins.join_full_outer_chain(frames, ["user_id", "day"])


@query(
    "join_cross_config",
    """WITH daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors
              FROM events GROUP BY 1),
            cfg(metric_name, unit) AS (VALUES ('Events', 'rows'), ('Users', 'people'), ('Errors', 'rows'))
       SELECT day, metric_name, unit, CASE metric_name WHEN 'Events' THEN n WHEN 'Users' THEN users WHEN 'Errors' THEN errors END AS metric_value
       FROM daily CROSS JOIN cfg""",
)
def _(t: Tables) -> DataFrame:
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    config = [
        {"metric_name": "Events", "unit": "rows", "metric_value": F.col("n")},
        {"metric_name": "Users", "unit": "people", "metric_value": F.col("users")},
        {"metric_name": "Errors", "unit": "rows", "metric_value": F.col("errors")},
    ]
    return joins.join_cross_config(daily, config).drop("n", "users", "errors")


@query(
    "join_many_to_many",
    """WITH c AS (SELECT user_id, dayname(ts) AS weekday, value FROM events WHERE event_type NOT IN ('view', 'error')),
            v AS (SELECT user_id, dayname(ts) AS weekday, value FROM events WHERE event_type IN ('view', 'error')),
            m AS (SELECT user_id, weekday, c.value AS cv, v.value AS vv FROM c JOIN v USING (user_id, weekday)),
            nc AS (SELECT user_id, weekday, count(*) AS n_left FROM c GROUP BY 1, 2),
            nv AS (SELECT user_id, weekday, count(*) AS n_right FROM v GROUP BY 1, 2)
       SELECT user_id, weekday, n_left, n_right, count(*) AS row_multiplier, round(sum(cv), 2) AS clicked, round(sum(vv), 2) AS viewed
       FROM m JOIN nc USING (user_id, weekday) JOIN nv USING (user_id, weekday) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "value", cal.date_names("ts", "weekday").alias("weekday"))
    merged = joins.join_many_to_many(
        rows.filter(~F.col("event_type").isin("view", "error")),
        rows.filter(F.col("event_type").isin("view", "error")),
        ["user_id", "weekday"],
        {"clicked": F.col("value")},
        {"viewed": F.col("value")},
    )
    return merged.withColumns({c: F.round(c, 2) for c in ("clicked", "viewed")})


@query(
    "join_semi_rows",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def _(t: Tables) -> DataFrame:
    return joins.join_semi_rows(t.documents.drop("text"), t.labels, "doc_id")


@query(
    "join_aligned_ratio",
    """WITH rich AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey != 3 GROUP BY 1),
            everyone AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
       SELECT c_nationkey, round(rich.n / everyone.n * 100, 6) AS ratio FROM rich FULL JOIN everyone USING (c_nationkey)""",
)
def _(t: Tables) -> DataFrame:
    rich = t.customer.filter((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") != 3))
    ratio = joins.join_aligned_ratio(
        agg.value_counts(rich, "c_nationkey"), agg.value_counts(t.customer, "c_nationkey"), "c_nationkey", "n"
    )
    return ratio.withColumn("ratio", F.round("ratio", 6))
