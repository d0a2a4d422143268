"""Aggregation and statistics over whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal, ratios
from ..operators import aggregate as agg, joins, stats
from ..session import scratch_path
from .registry import Tables, query


def rounded(d: DataFrame, digits: int, *cols: str) -> DataFrame:
    return d.withColumns({c: F.round(c, digits) for c in cols})


# --- grouping --------------------------------------------------------------

@query(
    "agg_group_basic",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice,
              max(l_tax) AS max_l_tax, min(l_shipdate) AS min_l_shipdate, count(l_orderkey) AS count_l_orderkey
       FROM lineitem GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    measures = {
        "l_quantity": "sum",
        "l_extendedprice": "avg",
        "l_tax": "max",
        "l_shipdate": "min",
        "l_orderkey": "count",
    }
    return rounded(agg.agg_group_basic(t.lineitem, ["l_returnflag", "l_linestatus"], measures), 4, "avg_l_extendedprice")


@query(
    "agg_named",
    """SELECT month(o_orderdate)::INTEGER AS month, year(o_orderdate)::INTEGER AS year, round(sum(o_totalprice), 2) AS total, count(*) AS n
       FROM orders GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_totalprice", F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))
    return agg.agg_named(rows, ["month", "year"], total=F.round(F.sum("o_totalprice"), 2), n=F.count("*"))


@query(
    "agg_conditional",
    """SELECT l_suppkey, sum(CASE WHEN flag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN flag = 'R' THEN l_quantity ELSE 0 END) AS r,
              sum(CASE WHEN flag IS NULL OR flag = '' THEN l_quantity ELSE 0 END) AS unknown,
              sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS discounted
       FROM (SELECT *, nullif(l_returnflag, 'N') AS flag FROM lineitem) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    flag = F.col("flag")
    cases = {
        "a": flag == "A",
        "r": flag == "R",
        "unknown": flag.isNull() | (flag == ""),
        "discounted": F.col("l_discount") > 0.05,
    }
    return agg.agg_conditional(rows, ["l_suppkey"], "l_quantity", cases)


FAMILIES = {"execution": ["ECONOMY", "SMALL"], "manual": ["PROMO"], "planning": ["LARGE", "MEDIUM"]}


@query(
    "agg_reason_family",
    """SELECT l_suppkey, sum(CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN l_quantity ELSE 0 END) AS execution,
              sum(CASE WHEN p_type IN ('PROMO') THEN l_quantity ELSE 0 END) AS manual,
              sum(CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN l_quantity ELSE 0 END) AS planning
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = joins.join_inner(t.lineitem, parts, "l_partkey")
    return agg.agg_reason_family(rows, ["l_suppkey"], "p_type", "l_quantity", FAMILIES)


@query(
    "agg_multi_grain",
    """WITH fine AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_returnflag, sum(l_quantity) AS quantity,
              round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2, 3),
            coarse AS (SELECT l_suppkey, week, sum(quantity) AS total_quantity, round(sum(price), 2) AS total_price FROM fine GROUP BY 1, 2)
       SELECT * FROM fine JOIN coarse USING (l_suppkey, week)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("week", cal.week_start_monday("l_shipdate"))
    grains = agg.agg_multi_grain(
        rows,
        ["l_suppkey", "week", "l_returnflag"],
        ["l_suppkey", "week"],
        {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice")},
    )
    return rounded(grains, 2, "price", "total_price")


@query("agg_distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def _(t: Tables) -> DataFrame:
    return agg.agg_distinct_rows(t.customer, ["c_mktsegment", "c_nationkey"])


@query(
    "count_rows",
    """SELECT 'group' AS kind, o_orderpriority, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'filtered', NULL, count(*) FROM orders WHERE o_totalprice > 250000""",
)
def _(t: Tables) -> DataFrame:
    groups = agg.count_rows(t.orders, ["o_orderpriority"]).select(F.lit("group").alias("kind"), "o_orderpriority", "n")
    some = agg.count_rows(t.orders, where=F.col("o_totalprice") > 250_000)
    return groups.unionByName(
        some.select(F.lit("filtered").alias("kind"), F.lit(None).cast("string").alias("o_orderpriority"), "n")
    )


@query("value_counts", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(t: Tables) -> DataFrame:
    return agg.value_counts(t.part, "p_brand", 10)


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def _(t: Tables) -> DataFrame:
    return agg.distinct_values(t.orders, "o_orderpriority")


@query(
    "count_distinct",
    """SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT kind) + max(CASE WHEN kind IS NULL THEN 1 ELSE 0 END) AS kind
       FROM (SELECT user_id, nullif(event_type, 'error') AS kind FROM events)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    return agg.count_distinct(rows, ["user_id", "kind"], count_null=True)


@query(
    "count_distinct__sketches",
    """WITH d AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, user_id, event_id FROM events)
       SELECT 'week' AS grain, event_type, week, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events, TRUE AS near FROM d GROUP BY ALL
       UNION ALL SELECT 'total', event_type, NULL, count(DISTINCT user_id), count(DISTINCT event_id), TRUE FROM d GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Weeks and totals from stored daily sketches, each beside the exact count: no further apart than four standard errors."""
    rows = t.events.withColumn("day", F.to_date("ts")).withColumn("week", F.date_trunc("week", "ts").cast("date"))
    cols = ["user_id", "event_id"]
    path = scratch_path(t.spark, "sketches")
    agg.distinct_sketches(rows, ["event_type", "day"], cols).write.parquet(path)
    stored = t.spark.read.parquet(path).withColumn("week", F.date_trunc("week", "day").cast("date"))
    out = []
    for grain, keys in {"week": ["event_type", "week"], "total": ["event_type"]}.items():
        exact = rows.groupBy(*keys).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
        both = agg.united_distinct(stored, keys, cols).join(exact, keys)
        far = F.greatest(F.abs(F.col("user_id") / F.col("users") - 1), F.abs(F.col("event_id") / F.col("events") - 1))
        week = F.col("week") if "week" in keys else F.lit(None).cast("date").alias("week")
        out.append(both.select(F.lit(grain).alias("grain"), "event_type", week, "users", "events", (far <= 4 * 1.04 / 2**6).alias("near")))
    return out[0].unionByName(out[1])


# --- ratios ----------------------------------------------------------------

@query(
    "ratio_bps",
    """WITH g AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS num,
              sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS den FROM events GROUP BY 1)
       SELECT user_id, round(num / nullif(den, 0) * 10000, 4) AS bps_null,
              round(CASE WHEN den > 0 THEN num / nullif(den, 0) * 10000 ELSE 0 END, 4) AS bps_zero FROM g""",
)
def _(t: Tables) -> DataFrame:
    def part(kind: str):
        return F.sum(F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0))

    sums = t.events.groupBy("user_id").agg(part("error").alias("num"), part("purchase").alias("den"))
    return sums.select(
        "user_id",
        F.round(ratios.ratio_bps("num", "den", "null"), 4).alias("bps_null"),
        F.round(ratios.ratio_bps("num", "den", "zero"), 4).alias("bps_zero"),
    )


@query(
    "cost_share_bps",
    """WITH b AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_returnflag, l_extendedprice AS cost,
              l_discount > 0.05 AS over FROM lineitem),
            w AS (SELECT l_suppkey, week, sum(CASE WHEN over THEN cost ELSE 0 END) AS affected, sum(cost) AS planned FROM b GROUP BY 1, 2),
            r AS (SELECT b.*, w.affected, CASE WHEN w.planned > 0 THEN w.affected / w.planned ELSE 0 END AS ratio FROM b LEFT JOIN w USING (l_suppkey, week))
       SELECT l_suppkey, week, l_returnflag, round(max(ratio), 6) AS variance_ratio,
              round(sum(CASE WHEN over AND affected > 0 THEN ratio * (cost / affected) * 10000 ELSE 0 END), 4) AS variance_bps
       FROM r GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("week", cal.week_start_monday("l_shipdate"))
    shares = agg.cost_share_bps(
        rows,
        ["l_suppkey", "week"],
        ["l_suppkey", "week", "l_returnflag"],
        "l_extendedprice",
        F.col("l_discount") > 0.05,
    )
    return shares.select(
        "l_suppkey",
        "week",
        "l_returnflag",
        F.round("variance_ratio", 6).alias("variance_ratio"),
        F.round("variance_bps", 4).alias("variance_bps"),
    )


@query(
    "rate_dpmo",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0) * 1000000, 4) AS dpmo
       FROM lineitem GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0))
    return t.lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(
        F.round(ratios.rate_dpmo(returned, F.sum("l_quantity")), 4).alias("dpmo")
    )


def yearly_by_priority(t: Tables) -> DataFrame:
    def total(year: int, but: str):
        mine = (F.year("o_orderdate") == year) & (F.col("o_orderpriority") != but)
        return F.sum(F.when(mine, F.col("o_totalprice")))

    keys = ["o_orderpriority", "o_orderstatus"]
    return t.orders.groupBy(*keys).agg(total(1998, "").alias("actual"), total(1997, "5-LOW").alias("base"))


YEARLY = """SELECT o_orderpriority, o_orderstatus, sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS actual,
    sum(CASE WHEN year(o_orderdate) = 1997 AND o_orderpriority != '5-LOW' THEN o_totalprice END) AS base FROM orders GROUP BY 1, 2"""


@query(
    "pct_diff",
    f"SELECT o_orderpriority, o_orderstatus, round((actual - base) / nullif(base, 0) * 100, 2) AS pct FROM ({YEARLY})",
)
def _(t: Tables) -> DataFrame:
    return yearly_by_priority(t).select(
        "o_orderpriority", "o_orderstatus", ratios.pct_diff("actual", "base").alias("pct")
    )


@query(
    "alignment_status",
    f"""SELECT o_orderpriority, o_orderstatus, CASE WHEN abs(d) > 5 THEN 'Not Aligned' ELSE 'Aligned' END AS sql_status,
               CASE WHEN abs(d) <= 5 THEN 'Aligned' ELSE 'Not Aligned' END AS notebook_status
        FROM (SELECT *, round((actual - base) / nullif(base, 0) * 100, 2) AS d FROM ({YEARLY}))""",
)
def _(t: Tables) -> DataFrame:
    diff = ratios.pct_diff("actual", "base")
    return yearly_by_priority(t).select(
        "o_orderpriority",
        "o_orderstatus",
        ratios.alignment_status(diff).alias("sql_status"),
        ratios.alignment_status(diff, null_status="Not Aligned").alias("notebook_status"),
    )


@query(
    "percent_of_total",
    """WITH m AS (SELECT year(o_orderdate)::INTEGER AS year, monthname(o_orderdate) AS month, sum(o_totalprice) AS part FROM orders GROUP BY 1, 2)
       SELECT year, month, round(part, 2) AS part, round(sum(part) OVER (PARTITION BY year), 2) AS total,
              round(part / sum(part) OVER (PARTITION BY year) * 100, 6) AS pct FROM m""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.year("o_orderdate").alias("year"), cal.date_names("o_orderdate", "month").alias("month"), "o_totalprice"
    )
    share = agg.percent_of_total(rows, ["year", "month"], "o_totalprice", ["year"])
    return rounded(rounded(share, 2, "part", "total"), 6, "pct")


@query(
    "avg_of_ratios_weekly",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END)::DOUBLE AS e, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)
       SELECT user_id, CAST(date_trunc('week', day) AS DATE) AS week_start, round(avg(e / nullif(n, 0)), 6) AS error_share, count(*) AS days
       FROM d GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    error = (F.col("event_type") == "error").cast("double")
    weekly = agg.avg_of_ratios_weekly(t.events, ["user_id"], "ts", {"error_share": (error, F.lit(1.0))})
    return rounded(weekly, 6, "error_share")


@query(
    "argmax_key",
    """SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) / count(*) * 100, 6) AS share FROM customer
       GROUP BY 1 ORDER BY share DESC, 1 LIMIT 1""",
)
def _(t: Tables) -> DataFrame:
    share = t.customer.groupBy("c_nationkey").agg(
        F.round(ratios.ratio_or_null(F.count_if(F.col("c_acctbal") > 5000), F.count("*")) * 100, 6).alias("share")
    )
    return agg.argmax_key(share, "c_nationkey", "share")


# --- statistics ------------------------------------------------------------

def _summary_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
            round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median,
            round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, max({c})::DOUBLE AS max FROM {table}"""
        for c in cols
    )


@query("summary_stats", _summary_sql("lineitem", ["l_quantity", "l_extendedprice", "l_tax"]))
def _(t: Tables) -> DataFrame:
    stat = stats.summary_stats(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(stat, 6, "mean", "std", "q1", "median", "q3")


@query(
    "median_by_group",
    "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return rounded(stats.median_by_group(t.orders, ["o_orderpriority"], "o_totalprice"), 4, "median")


@query(
    "quantile_trim",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.025) AS plo, quantile_cont(l_extendedprice, 0.975) AS phi,
              quantile_cont(l_quantity, 0.025) AS qlo, quantile_cont(l_quantity, 0.975) AS qhi FROM lineitem)
       SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_quantity) AS quantity
       FROM lineitem, q WHERE l_extendedprice BETWEEN plo AND phi AND l_quantity BETWEEN qlo AND qhi GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    kept = stats.quantile_trim(t.lineitem, ["l_extendedprice", "l_quantity"])
    return kept.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
        F.sum("l_quantity").alias("quantity"),
    )


@query(
    "histogram_bins",
    """WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
            c AS (SELECT least(floor((value - lo) / w), 29)::INTEGER AS bin, count(*) AS n FROM events, s GROUP BY 1)
       SELECT 'value' AS what, g.bin::INTEGER AS bin, round(lo + g.bin * w, 6) AS bin_lo, round(lo + (g.bin + 1) * w, 6) AS bin_hi, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN s LEFT JOIN c ON c.bin = g.bin
       UNION ALL
       SELECT 'size', g.bin::INTEGER, 5.0 * g.bin, 5.0 * (g.bin + 1), coalesce(n, 0) FROM (SELECT unnest(range(10)) AS bin) g
       LEFT JOIN (SELECT least(p_size // 5, 9) AS bin, count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY 1) p ON p.bin = g.bin""",
)
def _(t: Tables) -> DataFrame:
    values = stats.histogram_bins(t.events, "value", bins=30).select(F.lit("value").alias("what"), "*")
    sizes = stats.histogram_bins(t.part, "p_size", edges=list(range(0, 51, 5))).select(F.lit("size").alias("what"), "*")
    return rounded(values.unionByName(sizes), 6, "bin_lo", "bin_hi")


EDGES = [1, 2, 5, 10, 20, 21, 40, 49.5]


@query(
    "histogram_bins__uneven",
    f"""WITH e AS (SELECT unnest(range({len(EDGES) - 1}))::INTEGER AS bin, unnest({EDGES[:-1]}::DOUBLE[]) AS bin_lo, unnest({EDGES[1:]}::DOUBLE[]) AS bin_hi)
       SELECT bin, bin_lo, bin_hi, count(l_quantity) AS n FROM e
       LEFT JOIN lineitem ON l_quantity >= bin_lo AND (l_quantity < bin_hi OR bin = {len(EDGES) - 2} AND l_quantity = bin_hi) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return stats.histogram_bins(t.lineitem, "l_quantity", edges=EDGES)


@query(
    "box_stats",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3
              FROM orders GROUP BY 1)
       SELECT o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
              min(o_totalprice) FILTER (o_totalprice >= q1 - 0.4 * (q3 - q1)) AS whisker_lo,
              max(o_totalprice) FILTER (o_totalprice <= q3 + 0.4 * (q3 - q1)) AS whisker_hi,
              count(*) FILTER (o_totalprice < q1 - 0.4 * (q3 - q1) OR o_totalprice > q3 + 0.4 * (q3 - q1)) AS outliers
       FROM orders JOIN q USING (o_orderpriority) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    # 0.4 IQRs, as at 1.5 these prices have no outliers
    return rounded(stats.box_stats(t.orders, ["o_orderpriority"], "o_totalprice", k=0.4), 4, "q1", "median", "q3")


@query(
    "kde_density",
    """WITH s AS (SELECT count(*) AS n, stddev_samp(p_retailprice) * power(count(*), -0.2) AS h, min(p_retailprice) - 0.5 * (max(p_retailprice) - min(p_retailprice)) AS lo,
              2 * (max(p_retailprice) - min(p_retailprice)) / 49 AS step FROM part),
            g AS (SELECT unnest(range(50))::INTEGER AS i)
       SELECT i, round(lo + i * step, 6) AS x, round(sum(exp(-0.5 * power((lo + i * step - p_retailprice) / h, 2))) / (n * h * sqrt(2 * pi())), 10) AS density
       FROM g CROSS JOIN s CROSS JOIN part GROUP BY i, lo, step, n, h""",
)
def _(t: Tables) -> DataFrame:
    return rounded(rounded(stats.kde_density(t.part, "p_retailprice", 50), 6, "x"), 10, "density")


QUARTERLY = "(SELECT *, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders)"


def quarterly(t: Tables) -> DataFrame:
    return t.orders.withColumn("quarter", cal.period_labels("o_orderdate", "quarter"))


@query(
    "category_mean_bars",
    f"SELECT quarter, o_orderpriority, round(avg(o_totalprice), 4) AS mean_o_totalprice FROM {QUARTERLY} GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    bars = agg.category_mean_bars(quarterly(t), "quarter", "o_orderpriority", "o_totalprice")
    return rounded(bars, 4, "mean_o_totalprice")


@query(
    "category_stack_sum",
    f"SELECT quarter, o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {QUARTERLY} GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    bars = agg.category_stack_sum(quarterly(t), "quarter", "o_orderpriority", "o_totalprice")
    return rounded(bars, 2, "sum_o_totalprice")


@query(
    "category_max_bars",
    f"SELECT quarter, o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM {QUARTERLY} GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    return agg.category_max_bars(quarterly(t), "quarter", "o_orderpriority", "o_totalprice")


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{b}' AS row_col, '{a}' AS col_col, round(corr({a}, {b}), 6) AS corr FROM lineitem"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
)
def _(t: Tables) -> DataFrame:
    return rounded(stats.corr_matrix(t.lineitem, NUMERIC), 6, "corr")


# 45 columns made of five, some with gaps
WIDE = {f"c{i}": (i % 5, i // 5) for i in range(45)}


@query(
    "corr_matrix__wide",
    "WITH w AS (SELECT "
    + ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % 11 >= {m} THEN {NUMERIC[c]} + {m} * l_tax END AS {n}" for n, (c, m) in WIDE.items())
    + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{b}' AS row_col, '{a}' AS col_col, round(corr({a}, {b}), 6) AS corr FROM w" for a, b in combinations(WIDE, 2)),
)
def _(t: Tables) -> DataFrame:
    there = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    wide = t.lineitem.select(*[F.when(there >= m, F.col(NUMERIC[c]) + m * F.col("l_tax")).alias(n) for n, (c, m) in WIDE.items()])
    return rounded(stats.corr_matrix(wide, list(WIDE)), 6, "corr")


# the 0.975 quantile of Student's t for n - 2 degrees of freedom, by its expansion about the normal's (1.959963984540054)
T_975 = """(SELECT z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3)
    + (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / (92160 * v ** 4) FROM (SELECT 1.959963984540054::DOUBLE AS z, (n - 2)::DOUBLE AS v))"""


@query(
    "linear_fit__band",
    f"""WITH f AS (SELECT count(*)::DOUBLE AS n, regr_slope(p_retailprice, p_size) AS a, regr_intercept(p_retailprice, p_size) AS b, avg(p_size) AS m,
            regr_sxx(p_retailprice, p_size) AS sxx, (regr_syy(p_retailprice, p_size) - power(regr_sxy(p_retailprice, p_size), 2) / regr_sxx(p_retailprice, p_size))
            / (count(*) - 2) AS s2 FROM part),
        p AS (SELECT unnest(range(1, 51))::INTEGER AS x, a, b, n, sqrt(s2 * (1 / n + power(x - m, 2) / sxx)) AS e, {T_975} AS t FROM f)
       SELECT x, round(a * x + b, 6) AS predicted, round(e, 8) AS std_err_mean, round(a * x + b - t * e, 6) AS low, round(a * x + b + t * e, 6) AS high FROM p""",
)
def _(t: Tables) -> DataFrame:
    line = stats.linear_fit(t.part, "p_size", "p_retailprice", predict=(1, 50), level=0.95)
    return rounded(rounded(line, 6, "predicted", "low", "high"), 8, "std_err_mean")


@query(
    "linear_fit",
    """SELECT regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
              round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
              round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity))
                   / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS std_err FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    fit = stats.linear_fit(t.lineitem, "l_quantity", "l_extendedprice")
    return fit.select(
        "n",
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 3).alias("intercept"),
        F.round("r2", 6).alias("r2"),
        F.round("std_err", 4).alias("std_err"),
    )
