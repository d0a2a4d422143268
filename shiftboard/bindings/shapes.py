"""Reshaping, windows, ordering, duplicates and data quality over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators import ordered, quality, reshape, sets, windows as win
from .aggregates import rounded
from .registry import Tables, query

TYPES = ["click", "error", "purchase", "signup", "view"]


def daily_events(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean")
    )


DAILY = """(SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS total, count(*) AS n, round(avg(value), 9) AS mean
            FROM events GROUP BY 1, 2)"""

# --- reshape ---------------------------------------------------------------


@query(
    "pivot_wide_sum",
    """SELECT * FROM (PIVOT (SELECT event_type, week(ts)::VARCHAR AS week, value FROM events WHERE value IS NOT NULL) ON week
       USING round(coalesce(sum(value), 0), 2) GROUP BY event_type)""",
)
def _(t: Tables) -> DataFrame:
    """A column for every week there is."""
    rows = t.events.withColumn("week", F.weekofyear("ts"))
    wide = reshape.pivot_wide_sum(rows, ["event_type"], "week", "value")
    return rounded(wide, 2, *[c for c in wide.columns if c != "event_type"])


@query(
    "pivot_wide_plain",
    "SELECT day, " + ", ".join(f"max(CASE WHEN event_type = '{x}' THEN total END) AS {x}" for x in TYPES) + f" FROM {DAILY} GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return reshape.pivot_wide_plain(daily_events(t).drop("n", "mean"), ["day"], "event_type", "total", TYPES)


@query(
    "melt_long",
    """WITH s AS (SELECT l_suppkey, sum(l_quantity) AS quantity, nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_tax END), 0) AS tax,
              sum(CASE WHEN l_quantity > 1000 THEN l_quantity END) AS huge FROM lineitem GROUP BY 1)
       SELECT l_suppkey, 'quantity' AS measure, quantity AS amount FROM s UNION ALL SELECT l_suppkey, 'tax', round(tax, 4) FROM s
       UNION ALL SELECT l_suppkey, 'huge', huge FROM s""",
)
def _(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))), 4).alias("tax"),
        F.sum(F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))).alias("huge"),
    )
    return reshape.melt_long(sums, ["l_suppkey"], ["quantity", "tax", "huge"], "measure", "amount")


CATALOG = [
    {"category": "Output", "subcategory": "Speed", "metric": "Events", "unit": "rows", "metric_order": 1, "column": "n"},
    {"category": "Output", "subcategory": "Speed", "metric": "Users", "unit": "people", "metric_order": 2, "column": "users"},
    {"category": "Output", "subcategory": "Quality", "metric": "Errors", "unit": "rows", "metric_order": 1, "column": "errors"},
    {"category": "Output", "subcategory": "Quality", "metric": "Error Value", "unit": "value", "metric_order": 2, "column": "error_value"},
    {"category": "Output", "subcategory": "Cost", "metric": "Purchases", "unit": "value", "metric_order": 1, "column": "purchases"},
    {"category": "Output", "subcategory": "Cost", "metric": "Largest", "unit": "value", "metric_order": 2, "column": "largest"},
]
MEASURES = """(SELECT user_id, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n, count(DISTINCT event_type)::DOUBLE AS users,
    count(*) FILTER (event_type = 'error')::DOUBLE AS errors, round(sum(CASE WHEN event_type = 'error' THEN value END), 2) AS error_value,
    round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2) AS purchases, max(value) AS largest FROM events GROUP BY 1, 2)"""


@query(
    "metric_unpivot",
    " UNION ALL ".join(
        f"SELECT user_id, day, '{e['category']}' AS category, '{e['subcategory']}' AS subcategory, '{e['metric']}' AS metric, '{e['unit']}' AS unit, "
        f"{e['metric_order']} AS metric_order, {e['column']} AS metric_value FROM {MEASURES} WHERE {e['column']} IS NOT NULL"
        for e in CATALOG
    ),
)
def _(t: Tables) -> DataFrame:
    def only(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value"))

    wide = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"),
        F.count_distinct("event_type").alias("users"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.round(F.sum(only("error")), 2).alias("error_value"),
        F.round(F.sum(only("purchase")), 2).alias("purchases"),
        F.max("value").alias("largest"),
    )
    return reshape.metric_unpivot(wide, ["user_id", "day"], CATALOG, drop_null=True)


@query(
    "melt_group_count",
    " UNION ALL ".join(
        f"SELECT l_linestatus, '{n}' AS variable, CASE WHEN {c} THEN 1 ELSE 0 END AS value, count(*) AS total FROM lineitem GROUP BY 1, 3"
        for n, c in {"bulk": "l_quantity > 25", "discounted": "l_discount > 0.05", "taxed": "l_tax > 0.04"}.items()
    ),
)
def _(t: Tables) -> DataFrame:
    flags = t.lineitem.select(
        "l_linestatus",
        (F.col("l_quantity") > 25).cast("int").alias("bulk"),
        (F.col("l_discount") > 0.05).cast("int").alias("discounted"),
        (F.col("l_tax") > 0.04).cast("int").alias("taxed"),
    )
    return reshape.melt_group_count(flags, ["l_linestatus"], ["bulk", "discounted", "taxed"])


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS {s}" for s in ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    )
    + " FROM customer",
)
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return reshape.one_hot(rows, "segment").drop("segment")


# --- windows ---------------------------------------------------------------

@query("lag_n", f"SELECT event_type, day, total, lag(total, 7) OVER (PARTITION BY event_type ORDER BY day) AS week_ago FROM {DAILY}")
def _(t: Tables) -> DataFrame:
    return daily_events(t).select("event_type", "day", "total", win.lag_n("total", 7, ["event_type"], ["day"]).alias("week_ago"))


@query(
    "wow_change",
    f"""SELECT event_type, day, round((total - w) / nullif(w, 0) * 100, 6) AS pct, round(mean - v, 9) AS diff
        FROM (SELECT *, lag(total, 7) OVER p AS w, lag(mean, 7) OVER p AS v FROM {DAILY} WINDOW p AS (PARTITION BY event_type ORDER BY day))""",
)
def _(t: Tables) -> DataFrame:
    return daily_events(t).select(
        "event_type",
        "day",
        F.round(win.wow_change("total", 7, ["event_type"], ["day"]), 6).alias("pct"),
        F.round(win.wow_change("mean", 7, ["event_type"], ["day"], "abs"), 9).alias("diff"),
    )


@query(
    "moving_avg_7",
    f"""SELECT event_type, day, round(avg(total) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS ma_7
        FROM {DAILY}""",
)
def _(t: Tables) -> DataFrame:
    return daily_events(t).select(
        "event_type", "day", F.round(win.moving_avg_7("total", ["event_type"], ["day"]), 4).alias("ma_7")
    )


NUMBERED = """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_num FROM orders"""


def numbered(t: Tables, rows_per_slice: int = ordered.ROWS_PER_SLICE) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return ordered.row_number_global(rows, ["day", "o_orderkey"], rows_per_slice=rows_per_slice)


@query("row_number_global", NUMBERED)
def _(t: Tables) -> DataFrame:
    return numbered(t)


@query("row_number_global__sliced", NUMBERED)
def _(t: Tables) -> DataFrame:
    return numbered(t, 1000)


BACKFILL = "CASE WHEN event_type NOT IN ('error', 'view') THEN value END"
FILLED = f"""SELECT event_id, user_id, first_value({BACKFILL} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value,
        'table' AS scope FROM events
        UNION ALL SELECT event_id, user_id, first_value({BACKFILL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        'user' FROM events"""


def filled(t: Tables, rows_per_slice: int = ordered.ROWS_PER_SLICE) -> DataFrame:
    known = F.when(~F.col("event_type").isin("error", "view"), F.col("value"))
    rows = t.events.select("event_id", "user_id", known.alias("value"))
    table = ordered.backfill_next(rows, ["value"], ["event_id"], rows_per_slice=rows_per_slice).withColumn("scope", F.lit("table"))
    user = ordered.backfill_next(rows, ["value"], ["event_id"], ["user_id"], rows_per_slice).withColumn("scope", F.lit("user"))
    return table.unionByName(user)


@query("backfill_next", FILLED)
def _(t: Tables) -> DataFrame:
    return filled(t)


@query("backfill_next__sliced", FILLED)
def _(t: Tables) -> DataFrame:
    return filled(t, 1000)


@query(
    "lag_n__long_series",
    """SELECT event_id, user_id % 2 AS half, round(value, 2) AS value, lag(round(value, 2), 7) OVER p AS before,
        round(round(value, 2) - lag(round(value, 2), 7) OVER p, 6) AS change,
        round(avg(round(value, 2)) OVER (p ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma_7
       FROM events WINDOW p AS (PARTITION BY user_id % 2 ORDER BY event_id)""",
)
def _(t: Tables) -> DataFrame:
    """Two series of half of all rows each."""
    rows = t.events.select("event_id", (F.col("user_id") % 2).alias("half"), F.round("value", 2).alias("value"))

    def columns(part):
        return {
            "before": win.lag_n("value", 7, part, ["event_id"]),
            "change": F.round(win.wow_change("value", 7, part, ["event_id"], "abs"), 6),
            "ma_7": F.round(win.moving_avg_7("value", part, ["event_id"]), 6),
        }

    return ordered.trend_columns(rows, ["half"], ["event_id"], 7, columns, rows_per_slice=1000)


@query(
    "median_by_group__narrowed",
    "SELECT l_returnflag, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in {"low": 0.025, "median": 0.5, "high": 0.975}.items())
    + " FROM lineitem GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    """Brackets narrowed until a task orders no more than 20 values."""
    found = ordered.exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"low": 0.025, "median": 0.5, "high": 0.975}, most=20)
    return rounded(found, 6, "low", "median", "high")


@query(
    "label_encode",
    """SELECT c_custkey, CASE WHEN s IS NULL THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY s IS NULL ORDER BY s) - 1 AS INTEGER) END AS segment_code
       FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return win.label_encode(rows, "segment").drop("segment")


@query(
    "quantile_cut",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
       SELECT CASE WHEN o_totalprice <= b THEN 'high' ELSE 'low' END AS half,
              CASE WHEN o_totalprice <= a THEN 'q1' WHEN o_totalprice <= b THEN 'q2' WHEN o_totalprice <= c THEN 'q3' ELSE 'q4' END AS quarter,
              count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders, q GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    halves = win.quantile_cut(t.orders, "o_totalprice", 2, ["high", "low"], "half")
    both = win.quantile_cut(halves, "o_totalprice", 4, ["q1", "q2", "q3", "q4"], "quarter")
    return both.groupBy("half", "quarter").agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )


# --- ordering and sets -----------------------------------------------------

@query("sort_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return sets.sort_multi(
        rows, [("c_nationkey", "asc", "last"), (F.abs("c_acctbal"), "desc", "last"), ("c_custkey", "asc", "last")]
    )


@query("top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def _(t: Tables) -> DataFrame:
    return sets.top_n(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 40, "c_custkey")


@query("bottom_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
def _(t: Tables) -> DataFrame:
    return sets.bottom_n(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 20, "c_custkey")


@query(
    "skip_top_n",
    """SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1 ORDER BY total DESC, 1 OFFSET 4""",
)
def _(t: Tables) -> DataFrame:
    totals = t.customer.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return sets.skip_top_n(totals, "total", 4, "c_nationkey")


@query("sample_n", "SELECT * FROM customer ORDER BY md5('1:' || c_custkey), c_custkey LIMIT 50")
def _(t: Tables) -> DataFrame:
    return sets.sample_n(t.customer, 50, 1, "c_custkey")


WEIGHTS = [8, 8, 8, 8, 8, 3, 3, 4, 20, 30]


# the alias table of WEIGHTS, written out: slot, share that stays, its score, the score that has the rest
SLOTS = """VALUES (0, 0.8, 1, 9), (1, 0.8, 2, 9), (2, 0.8, 3, 9), (3, 0.8, 4, 9), (4, 0.8, 5, 10), (5, 0.3, 6, 10), (6, 0.3, 7, 10), (7, 0.4, 8, 10),
    (8, 1.0, 9, 9), (9, 0.8, 10, 9)"""


@query(
    "weighted_draw",
    f"""WITH u AS (SELECT o_orderkey, CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 AS a,
            CAST('0x' || substr(md5('42:' || o_orderkey), 9, 8) AS BIGINT) / 4294967296.0 AS b FROM orders),
        t(slot, stays, own, other) AS ({SLOTS})
       SELECT (CASE WHEN b < stays THEN own ELSE other END)::BIGINT AS score, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
       FROM u JOIN t ON floor(a * 10) = slot GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    drawn = sets.weighted_draw(t.orders, "o_orderkey", list(range(1, 11)), WEIGHTS, 42, "score")
    return drawn.groupBy("score").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "top_n__tenth",
    """SELECT 'top' AS part, o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT (SELECT count(*) // 10 FROM orders))
       UNION ALL SELECT 'bottom', o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT (SELECT count(*) // 10 FROM orders))
       UNION ALL SELECT 'rest', o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders)
       WHERE r > (SELECT count(*) // 10 FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    """A tenth of all rows from each end, and all but the leaders, without a merge in one task."""
    rows = t.orders.select("o_orderkey", "o_totalprice")
    many = {"n": rows.count() // 10, "tie": "o_orderkey", "merged": 100, "rows_per_slice": 1000}
    parts = {"top": sets.top_n, "bottom": sets.bottom_n, "rest": sets.skip_top_n}
    found = [take(rows, "o_totalprice", **many).select(F.lit(part).alias("part"), "*") for part, take in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "sample_n__tenth",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT (SELECT count(*) // 10 FROM orders)",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return sets.sample_n(rows, rows.count() // 10, 7, "o_orderkey", merged=100, rows_per_slice=1000)


@query(
    "union_all_grains",
    f"""SELECT 'daily' AS aggregation_level, event_type, day, CAST(NULL AS DATE) AS week_start, n, total FROM {DAILY}
        UNION ALL SELECT 'weekly', event_type, NULL, CAST(date_trunc('week', day) AS DATE), sum(n)::BIGINT, round(sum(total), 2) FROM {DAILY} GROUP BY 2, 4""",
)
def _(t: Tables) -> DataFrame:
    daily = daily_events(t)
    weekly = daily.groupBy("event_type", cal.week_start_monday("day").alias("week_start")).agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total")
    )
    return sets.union_all_grains(
        {"daily": daily, "weekly": weekly}, ["event_type", "day", "week_start", "n", "total"]
    )


@query(
    "concat_frames",
    "SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    first = t.orders.filter(day < "1998-01-01").withColumn("week", F.weekofyear(day))
    second = t.orders.filter(day.isNull() | (day >= "1998-01-01"))
    both = sets.concat_frames([first, second], drop=["week"])
    return both.groupBy(F.year(day).alias("year"), "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "dedupe_rows",
    """SELECT doc_id, lang, source, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(t: Tables) -> DataFrame:
    firsts = sets.dedupe_rows(t.documents, ["text"], "doc_id")
    return firsts.select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@query("dedupe_rows__exact", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem")
def _(t: Tables) -> DataFrame:
    return sets.dedupe_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


@query(
    "flag_duplicates",
    "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents",
)
def _(t: Tables) -> DataFrame:
    return sets.flag_duplicates(t.documents.select("doc_id", "text"), ["text"], "doc_id").drop("text")


ALLOWED = ["1-URGENT", "2-HIGH", "5-LOW"]


@query(
    "set_difference",
    "SELECT o_orderpriority FROM orders EXCEPT SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW'])",
)
def _(t: Tables) -> DataFrame:
    return sets.set_difference(t.orders, "o_orderpriority", ALLOWED)


# --- data quality ----------------------------------------------------------

def labelled(t: Tables) -> DataFrame:
    return t.documents.drop("text").join(t.labels, "doc_id", "left")


LABELLED = "(SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
LABEL_COLS = {"doc_id": "bigint", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query(
    "table_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{ty}' AS dtype, count({c}) AS non_null, count(*) AS rows, 6 AS columns, count(*) * 6 AS cells FROM {LABELLED}"""
        for c, ty in LABEL_COLS.items()
    ),
)
def _(t: Tables) -> DataFrame:
    return quality.table_profile(labelled(t))


@query(
    "missing_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, count({c}) < count(*) AS any_missing FROM {LABELLED}" for c in LABEL_COLS
    ),
)
def _(t: Tables) -> DataFrame:
    return quality.missing_counts(labelled(t))


@query("rows_with_missing", f"SELECT lang, count(*) AS n FROM {LABELLED} WHERE quality IS NULL OR toxic IS NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return quality.rows_with_missing(labelled(t), "lang")


@query("drop_missing_rows", f"SELECT * FROM {LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return quality.drop_missing_rows(labelled(t))


@query("drop_missing_cols", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    return quality.drop_missing_cols(labelled(t))


@query(
    "missing_cost_report",
    f"""SELECT cells, cells_after_row_drop, cells_after_col_drop, round((cells - cells_after_row_drop) / cells, 6) AS row_drop_share,
               round((cells - cells_after_col_drop) / cells, 6) AS col_drop_share
        FROM (SELECT count(*) * 6 AS cells, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) * 6 AS cells_after_row_drop,
              count(*) * 4 AS cells_after_col_drop FROM {LABELLED})""",
)
def _(t: Tables) -> DataFrame:
    return rounded(quality.missing_cost_report(labelled(t)), 6, "row_drop_share", "col_drop_share")


@query(
    "domain_check",
    """SELECT 'before' AS stage, c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTO', 'MACHINERY') GROUP BY 2
       UNION ALL SELECT 'after', c_mktsegment, count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTO', 'MACHINERY', 'AUTOMOBILE') GROUP BY 2""",
)
def _(t: Tables) -> DataFrame:
    return quality.domain_check(
        t.customer, "c_mktsegment", ["BUILDING", "AUTO", "MACHINERY"], {"AUTOMOBILE": "AUTO"}
    )


def balance_rules():
    return {"not overdrawn": F.col("c_acctbal") >= 0, "within limit": F.col("c_acctbal") <= 9000}


@query(
    "rule_check",
    """SELECT 'not overdrawn' AS rule, c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal >= 0
       UNION ALL SELECT 'within limit', c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal <= 9000""",
)
def _(t: Tables) -> DataFrame:
    return quality.rule_check(t.customer.select("c_custkey", "c_acctbal"), balance_rules())


@query(
    "rule_check__repaired",
    """WITH fixed AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 AND c_custkey % 2 = 0 THEN 9000 ELSE c_acctbal END AS c_acctbal,
            CASE WHEN c_acctbal < 0 THEN 'was overdrawn' ELSE c_mktsegment END AS note FROM customer)
       SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, note, CASE WHEN c_acctbal > 9000 THEN 'within limit' END AS rule FROM fixed""",
)
def _(t: Tables) -> DataFrame:
    """Overdrawn accounts are set to 0, every second one above the limit to the limit; the others still break the rule."""
    rows = t.customer.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("note"))
    limit = F.when(F.col("c_custkey") % 2 == 0, 9000).otherwise(F.col("c_acctbal"))
    # both columns are mended from the balance as it was
    repairs = {"not overdrawn": {"c_acctbal": F.lit(0), "note": F.lit("was overdrawn")}, "within limit": {"c_acctbal": limit}}
    fixed = quality.rule_repair(rows, balance_rules(), repairs)
    broken = quality.rule_check(fixed, balance_rules()).select("c_custkey", "rule")
    return fixed.join(broken, "c_custkey", "left")


@query(
    "score_bands",
    """SELECT count(*) FILTER (p_size % 11 BETWEEN 1 AND 5) AS negative, count(*) FILTER (p_size % 11 BETWEEN 6 AND 8) AS neutral,
              count(*) FILTER (p_size % 11 BETWEEN 9 AND 10) AS positive FROM part""",
)
def _(t: Tables) -> DataFrame:
    return quality.score_bands(t.part.select((F.col("p_size") % 11).alias("score")), "score")
