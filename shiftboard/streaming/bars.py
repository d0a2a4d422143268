"""Incremental load of hourly bars with Structured Streaming."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..session import pin
from ..sources import manifest
from ..sources.bars import NUMBERS, ohlc_ingest, ohlc_rows

KEY = ("pair", "close_time")
LANDED = "landed_at"
BARS = "pair string, close_time timestamp, open double, high double, low double, close double, volume double, landed_at timestamp"


def read_bars(spark: SparkSession, sink: str, days: list[str] | None = None) -> DataFrame | None:
    """The sink's bars (of some days), as of its newest whole batch; None before the first."""
    held = manifest.read(spark, sink)
    if held is None:
        return None
    paths = [posixpath.join(sink, p) for day, found in held["parts"].items() if days is None or day in days for p in found]
    reader = spark.read.schema(BARS)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], BARS)


def newest(bars: DataFrame) -> DataFrame:
    """One row per ``KEY``: the one that landed last, by its values on a tie."""
    rest = [c for c in bars.columns if c not in KEY]
    row = F.struct(LANDED, *[c for c in rest if c != LANDED])
    return bars.groupBy(*KEY).agg(F.max(row).alias("row")).select(*KEY, *[F.col(f"row.{c}").alias(c) for c in rest])


def merge_bars(batch: DataFrame, sink: str) -> None:
    """Put the batch's bars into the sink; the version that landed last stays.

    Bars lie in a folder per day.  Only the batch's days are read; they are written anew, beside the old ones, and the
    manifest that names each day's folder is replaced last.  So readers see all of a batch or none of it, and a batch repeated
    after a failure gives the same rows.
    """
    spark = batch.sparkSession
    fresh = batch.select(*[F.col(c) for c in spark.createDataFrame([], BARS).columns])
    days = sorted(str(r[0]) for r in fresh.select(F.to_date("close_time")).distinct().collect())  # as many as a batch spans
    if not days:
        return
    held = read_bars(spark, sink, days)
    merged = fresh if held is None else fresh.unionByName(held)
    version = manifest.new_version(sink)
    rows = newest(merged).withColumn("day", F.to_date("close_time")).hint("rebalance", "day")
    rows.write.partitionBy("day").parquet(version)
    before = (manifest.read(spark, sink) or {"parts": {}})["parts"]
    written = {day: [posixpath.relpath(posixpath.join(version, f"day={day}"), sink)] for day in days}
    manifest.commit(spark, sink, {"parts": before | written})


def landed_payloads(spark: SparkSession, landing: str, schema: StructType | str, **options: str) -> DataFrame:
    """A stream of landed payload files, with the time each file landed."""
    landed = spark.readStream.schema(schema).options(**options).json(landing)
    return landed.select("*", F.col("_metadata.file_modification_time").alias(LANDED))


def ohlc_incremental(
    spark: SparkSession,
    landing: str,
    schema: StructType | str,
    checkpoint: str,
    sink: str,
    rejects: str | None = None,
    json_col: str = "value",
) -> StreamingQuery:
    """Pick up newly landed payload files, merge their bars into ``sink`` (see ``read_bars``); then stop.

    A bar pulled again replaces the earlier version, however late it comes.  Payloads, lists and bars that give no
    bar go to ``rejects`` (one folder per batch, so a repeated batch adds none), with the reason.  A batch's payloads are read
    once, into a stored table of bars and rejects.
    """

    def load(batch: DataFrame, number: int) -> None:
        held = [c for c in batch.columns if c in (json_col, LANDED)]
        # only what gives no bar keeps its payload
        rows = ohlc_rows(batch.select(held), json_col, held)
        rows = pin(rows.withColumn(json_col, F.when(F.col("reason").isNotNull(), F.col(json_col))))
        merge_bars(rows.filter(F.col("reason").isNull()).select(*KEY, *NUMBERS, LANDED), sink)
        if rejects is not None:
            bad = rows.filter(F.col("reason").isNotNull()).select(json_col, LANDED, "pair", "bar", "reason")
            bad.write.mode("overwrite").parquet(posixpath.join(rejects, f"batch={number}"))

    writer = landed_payloads(spark, landing, schema).writeStream.foreachBatch(load)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(bars: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """``(pair, window_start, window_end, open, high, low, close, volume, bars)`` of a stream of bars, each window once.

    A window is closed when the watermark, ``lateness`` behind the latest bar time, has passed its end.  Of a bar that landed several
    times before that, the last version counts; a repeated one counts once.  What comes later no longer changes a closed window
    (the merged sink has it).  Both steps keep their state in the state store: bars of open windows, and open windows.
    """
    fixed: list[Column] = [F.col(c) for c in ("open", "high", "low", "close", "volume")]
    timed = bars.withWatermark("close_time", lateness)
    # as a number: of two event-time columns Spark could not tell which one closes a window
    once = timed.groupBy("pair", F.window("close_time", width).alias("held"), F.unix_micros("close_time").alias("at")).agg(
        F.max(F.struct(F.col(LANDED), *fixed)).alias("bar")
    )
    at = F.col("at")
    rolled = once.groupBy("pair", F.window(F.window_time("held"), width).alias("window")).agg(
        F.min_by("bar.open", at).alias("open"),
        F.max("bar.high").alias("high"),
        F.min("bar.low").alias("low"),
        F.max_by("bar.close", at).alias("close"),
        F.sum("bar.volume").alias("volume"),
        F.count("*").alias("bars"),
    )
    edges = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return rolled.select("pair", *edges, "open", "high", "low", "close", "volume", "bars")


def ohlc_closed(
    spark: SparkSession,
    landing: str,
    schema: StructType | str,
    checkpoint: str,
    sink: str,
    width: str = "1 hour",
    lateness: str = "2 hours",
    json_col: str = "value",
    **options: str,
) -> StreamingQuery:
    """Append the windows that newly landed payloads close to ``sink`` (parquet, each window exactly once); then stop.

    The next run goes on from the state and offsets in ``checkpoint``.
    """
    bars = ohlc_ingest(landed_payloads(spark, landing, schema, **options), json_col, [LANDED])
    writer = closed_windows(bars, width, lateness).writeStream.format("parquet").outputMode("append")
    return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
