"""Sources, sinks and the incremental load.

Files are written from the given tables to the shared scratch folder first, so
each read covers the whole table.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from ..sources import bars, files
from ..streaming.bars import ohlc_closed, ohlc_incremental, read_bars
from .registry import Tables, query

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def as_csv(t: Tables, d: DataFrame, label: str) -> str:
    path = scratch_path(t.spark, label)
    d.write.option("header", True).csv(path)
    return path


@query("csv_scan", "SELECT * FROM customer")
def _(t: Tables) -> DataFrame:
    return files.csv_scan(t.spark, as_csv(t, t.customer, "customer"), CUSTOMER)


@query(
    "csv_null_marker",
    "SELECT c_custkey, c_name, c_nationkey, nullif(c_acctbal, 0) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer",
)
def _(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    marked = t.customer.withColumn("c_mktsegment", F.when(segment == "BUILDING", F.lit(" ?")).otherwise(segment))
    return files.csv_null_marker(t.spark, as_csv(t, marked, "marked"), CUSTOMER, "?")


@query(
    "csv_parse_dates",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
)
def _(t: Tables) -> DataFrame:
    written = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "M/d/yyyy"))
    schema = (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate date, o_orderpriority string"
    )
    return files.csv_parse_dates(t.spark, as_csv(t, written, "orders"), schema, "M/d/yyyy")


@query("table_scan", "SELECT * FROM nation")
def _(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("shiftboard_nation")
    return files.table_scan(t.spark, "shiftboard_nation")


SLA = [("1-URGENT", 1), ("2-HIGH", 3), ("3-MEDIUM", 7), ("4-NOT SPECIFIED", 14), ("5-LOW", 30)]


@query(
    "inline_config",
    """SELECT o_orderpriority, sla_days, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 3), ('3-MEDIUM', 7),
       ('4-NOT SPECIFIED', 14), ('5-LOW', 30)) sla(o_orderpriority, sla_days) USING (o_orderpriority) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    sla = files.inline_config(t.spark, SLA, "o_orderpriority string, sla_days int")
    return t.orders.join(sla, "o_orderpriority").groupBy("o_orderpriority", "sla_days").agg(F.count("*").alias("n"))


@query(
    "skip_leading_rows",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 6 AS row_id FROM orders
       QUALIFY row_number() OVER (ORDER BY o_orderkey) > 5""",
)
def _(t: Tables) -> DataFrame:
    path = as_csv(t, t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), "ordered")
    read = files.csv_scan(t.spark, path, "o_orderkey bigint, o_totalprice double")
    return files.skip_leading_rows(read, 5)


HOURLY = """SELECT upper(event_type) || 'USD' AS pair, date_trunc('hour', ts) AS close_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2"""


def hourly(t: Tables) -> DataFrame:
    """Hourly bars per event type, standing in for a traded pair."""
    at = F.struct("ts", "event_id")
    return t.events.groupBy(
        bars.pair_name("event_type").alias("pair"), F.date_trunc("hour", "ts").alias("close_time")
    ).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.round(F.sum("value"), 4).alias("volume"),
        F.count("*").alias("count"),
    )


def payloads(rows: DataFrame) -> DataFrame:
    """One exchange response per pair and day: at most 24 hourly bars each."""
    numbers = [
        F.unix_seconds("close_time"), "open", "high", "low", "close", F.lit("0"), "volume", "count"
    ]
    bar = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in numbers])
    day = F.to_date("close_time").alias("day")
    grouped = rows.groupBy("pair", day).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    body = F.concat(
        F.lit('{"error":[],"result":{"'), "pair", F.lit('":'), F.to_json("bars"), F.lit(',"last":"1"}}')
    )
    return grouped.select("day", body.alias("value"))


@query("ohlc_ingest", HOURLY.replace("date_trunc('hour', ts) AS close_time", "strftime(ts, '%Y-%m-%d %H:00') AS close_time"))
def _(t: Tables) -> DataFrame:
    good = payloads(hourly(t)).select("value")
    failed = good.select(F.lit('{"error":["EQuery:Unknown asset pair"]}').alias("value")).distinct()
    read = bars.ohlc_ingest(good.unionByName(failed), "value")
    return read.withColumn("close_time", F.date_format("close_time", "yyyy-MM-dd HH:mm"))


RESTATED = HOURLY.replace("date_trunc('hour', ts) AS close_time", "strftime(ts, '%Y-%m-%d %H:00') AS close_time").replace(
    "round(sum(value), 4)", "round(sum(value), 4) + CASE WHEN min(ts) >= TIMESTAMP '2024-01-13' THEN 1 ELSE 0 END"
)


@query("ohlc_incremental", RESTATED)
def _(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "bars")
    landing, sink, progress, rejects = (posixpath.join(base, x) for x in ("landing", "sink", "progress", "rejects"))
    first = hourly(t)
    # two landings that overlap by a week; the second restates its bars and brings an error and a bad number
    second = first.withColumn("volume", F.col("volume") + 1).filter(F.col("close_time") >= "2024-01-13")
    bad = t.spark.range(1).select(
        F.explode(F.array(F.lit('{"error":["EService:Busy"]}'), F.lit('{"error":[],"result":{"X":[["oops"]],"last":"1"}}'))).alias("value")
    )
    for landed in (payloads(first.filter(F.col("close_time") < "2024-01-21")), payloads(second).select("value").unionByName(bad)):
        landed.select("value").write.mode("append").json(landing)
        ohlc_incremental(t.spark, landing, "value string", progress, sink, rejects).awaitTermination()
    read = read_bars(t.spark, sink).drop("landed_at")
    return read.withColumn("close_time", F.date_format("close_time", "yyyy-MM-dd HH:mm"))


@query(
    "ohlc_incremental__closed",
    """WITH h AS (SELECT upper(event_type) || 'USD' AS pair, date_trunc('hour', ts) AS close_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
            min(value) AS low, last(value ORDER BY ts, event_id) AS close, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2),
        last_one AS (SELECT max(close_time) AS t FROM h)
       SELECT pair, strftime(time_bucket(INTERVAL 6 HOUR, close_time), '%Y-%m-%d %H:00') AS window_start, first(open ORDER BY close_time) AS open,
            max(high) AS high, min(low) AS low, last(close ORDER BY close_time) AS close, round(sum(volume), 4) AS volume, count(*) AS bars FROM h, last_one
       GROUP BY pair, time_bucket(INTERVAL 6 HOUR, close_time), t HAVING time_bucket(INTERVAL 6 HOUR, close_time) + INTERVAL 6 HOUR <= t - INTERVAL 2 HOUR""",
)
def _(t: Tables) -> DataFrame:
    """Six-hour windows closed by two landings; the second repeats the last day of the first."""
    base = scratch_path(t.spark, "closed")
    landing, sink, progress = (posixpath.join(base, x) for x in ("landing", "sink", "progress"))
    rows = hourly(t)
    for landed in (rows.filter(F.col("close_time") < "2024-01-21"), rows.filter(F.col("close_time") >= "2024-01-20")):
        payloads(landed).select("value").write.mode("append").json(landing)
        ohlc_closed(t.spark, landing, "value string", progress, sink, "6 hours").awaitTermination()
    read = t.spark.read.parquet(sink).drop("window_end").withColumn("volume", F.round("volume", 4))
    return read.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "bundle_sink",
    """SELECT 'by_status' AS part, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'by_priority', o_orderpriority, count(*) FROM orders GROUP BY 2
       UNION ALL SELECT 'total', 'all', count(*) FROM orders""",
)
def _(t: Tables) -> DataFrame:
    def count_by(c: str) -> DataFrame:
        return t.orders.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n"))

    frames = {
        "by_status": count_by("o_orderstatus"),
        "by_priority": count_by("o_orderpriority"),
        "total": t.orders.agg(F.count("*").alias("n")).select(F.lit("all").alias("key"), "n"),
    }
    base = scratch_path(t.spark, "bundle")
    files.bundle_sink(frames, base)
    held = files.read_bundle(t.spark, base)
    parts = [held[name].select(F.lit(name).alias("part"), "key", "n") for name in frames]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
