"""Sources, sinks and the incremental load."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shiftboard.session import scratch_path, shared_dir
from shiftboard.sources import bars, files
from shiftboard.streaming.bars import ohlc_incremental, read_bars

from conftest import as_set


def test_shared_dir_follows_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(configured)


def test_csv_null_marker_and_header(spark, tmp_path):
    (tmp_path / "people.csv").write_text("age,job\n39, State-gov\n50, ?\n")
    d = files.csv_null_marker(spark, str(tmp_path), "age int, job string", "?")
    assert as_set(d) == [(39, "State-gov"), (50, None)]
    with pytest.raises(Exception):
        files.csv_scan(spark, str(tmp_path), "age int, work string").collect()


def test_csv_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text("d,v\n1/9/2025,1\n12/31/2024,2\n")
    d = files.csv_parse_dates(spark, str(tmp_path), "d date, v int", "M/d/yyyy")
    assert as_set(d) == [(dt.date(2024, 12, 31), 2), (dt.date(2025, 1, 9), 1)]


def test_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS demo")
    spark.range(3).write.mode("overwrite").saveAsTable("demo.numbers")
    assert files.table_scan(spark, "demo.numbers").count() == 3
    assert files.table_scan(spark, "spark_catalog.demo.numbers").count() == 3


def test_inline_config_types(spark):
    d = files.inline_config(spark, [("a", 1), ("b", None)], "k string, n bigint")
    assert dict(d.dtypes) == {"k": "string", "n": "bigint"}
    assert as_set(d) == [("a", 1), ("b", None)]


def test_skip_leading_rows_over_files_and_blocks(spark, tmp_path):
    for part, start in (("a", 0), ("b", 300), ("c", 600)):
        (tmp_path / f"{part}.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(start, start + 300)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        read = files.csv_scan(spark, str(tmp_path), "v int")
        assert read.rdd.getNumPartitions() > 3
        got = files.skip_leading_rows(read, 5).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.v, r.row_id) for r in got] == [(i + 5, i) for i in range(895)]


def test_bundle_round_trip(spark, tmp_path):
    frames = {"wide": spark.range(3), "total": spark.range(1).withColumn("wk", F.lit(7))}
    files.bundle_sink(frames, str(tmp_path / "b"), partition_by={"total": ["wk"]})
    files.bundle_sink(frames, str(tmp_path / "c"), format="csv")
    read = files.read_bundle(spark, str(tmp_path / "b"))
    assert read["wide"].count() == 3 and as_set(read["total"]) == [(0, 7)]
    assert list((tmp_path / "b" / "versions").glob("*/total/wk=7"))
    assert files.read_bundle(spark, str(tmp_path / "c"))["wide"].dtypes == frames["wide"].dtypes
    assert files.read_bundle(spark, str(tmp_path / "c"))["wide"].count() == 3


def test_bundle_is_written_whole_or_not_at_all(spark, tmp_path):
    from shiftboard.sources import manifest

    place = str(tmp_path / "b")
    files.bundle_sink({"a": spark.range(3), "b": spark.range(5)}, place)
    bad = spark.range(4).withColumn("id", F.when(F.col("id") < 9, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="broken"):  # the first part is written by then
            files.bundle_sink({"a": spark.range(100), "b": bad.select(F.col("id").cast("bigint"))}, place, mode=mode)
        read = files.read_bundle(spark, place)
        assert (read["a"].count(), read["b"].count()) == (3, 5)
    files.bundle_sink({"a": spark.range(7)}, place, mode="append")
    read = files.read_bundle(spark, place)
    assert (read["a"].count(), read["b"].count()) == (10, 5)
    with pytest.raises(ValueError, match="other columns"):
        files.bundle_sink({"a": spark.range(7).withColumn("x", F.lit(1))}, place, mode="append")
    # a reader that began before the next write ends undisturbed; older versions go
    for n in range(4):
        before = files.read_bundle(spark, place)["a"]
        files.bundle_sink({"a": spark.range(n)}, place)
        assert before.count() == (10 if n == 0 else n - 1)
    assert len(manifest.numbers(spark, place)) == manifest.KEPT
    assert list(files.read_bundle(spark, place)) == ["a"]
    with pytest.raises(FileNotFoundError):
        files.read_bundle(spark, str(tmp_path / "none"))


def test_of_two_writers_one_raises(spark, tmp_path, monkeypatch):
    from shiftboard.sources import manifest

    place = str(tmp_path / "b")
    manifest.commit(spark, place, {"parts": {}})
    monkeypatch.setattr(manifest, "numbers", lambda *_: [])  # the other writer's manifest came in between
    with pytest.raises(RuntimeError, match="came first"):
        manifest.commit(spark, place, {"parts": {"x": []}})
    assert sorted(x.name for x in tmp_path.glob("b/*.json")) == ["manifest-000000000000.json"]


def test_a_block_without_its_start_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(50)))
    read = files.csv_scan(spark, str(tmp_path), "v int")
    from pyspark.sql.types import StructType

    seen = read.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.col("_metadata.file_block_length").alias("__length"), F.monotonically_increasing_id().alias("__id"),
    )
    counted = seen.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.max("__length").alias("__held"))
    assert files.numbered(seen, files.block_starts(counted), "n").agg(F.max("n")).first()[0] == 49
    assert isinstance(counted.schema, StructType)
    for other in (counted.limit(0), counted.withColumn("__held", F.col("__held") + 1)):
        with pytest.raises(Exception, match="cut otherwise"):
            files.numbered(seen, files.block_starts(other), "n").collect()


# --- bars ------------------------------------------------------------------

def payload(pair, hours, error=()):
    rows = [[3600 * h, "1.5", "2", "1", "1.75", "1.6", "10.25", 3] for h in hours]
    return json.dumps({"error": list(error), "result": {pair: rows, "last": 99}})


def test_ingest_and_rejects(rows):
    texts = [
        payload("XBTUSD", [1, 2]),
        json.dumps({"error": ["EQuery:Unknown asset pair"]}),
        json.dumps({"error": [], "result": {"last": 5}}),
        json.dumps({"error": [], "result": {"XBTUSD": [], "last": 5}}),
        "not json",
    ]
    d = rows([(t,) for t in texts], "value string")
    got = bars.ohlc_ingest(d, "value")
    assert as_set(got, F.unix_seconds("close_time"), "open", "high", "low", "close", "volume") == [
        (3600, 1.5, 2.0, 1.0, 1.75, 10.25),
        (7200, 1.5, 2.0, 1.0, 1.75, 10.25),
    ]
    reasons = {r["value"]: r.reason for r in bars.ohlc_rejects(d, "value").collect()}
    assert reasons == {texts[1]: "EQuery:Unknown asset pair", texts[2]: "no pair", texts[4]: "unreadable"}


def test_pair_names(rows):
    d = rows([("btc",), ("eth",), ("Ltc",)], "s string")
    assert [r[0] for r in d.select(bars.pair_name("s")).collect()] == ["XBTUSD", "ETHUSD", "LTCUSD"]


def test_ingest_skips_what_it_cannot_read(rows):
    bad = json.dumps({"error": [], "result": {"P": [["3600", "oops", "2", "1", "1.75", "1.6", "10", 3], ["7200", "1", "2", "1", "1.75", "1.6", "10", 3]]}})
    broken = json.dumps({"error": [], "result": {"Q": "no list", "P": [["x"]]}})
    d = rows([(bad,), (broken,)], "value string")
    assert as_set(bars.ohlc_ingest(d, "value"), F.unix_seconds("close_time"), "open") == [(7200, 1.0)]
    assert sorted((r.pair, r.reason) for r in bars.ohlc_rejects(d, "value").collect()) == [
        ("P", "unreadable close_time, open, high, low, close, volume"), ("P", "unreadable open"), ("Q", "unreadable bars"),
    ]


def test_newest_version_wins(spark, tmp_path):
    landing, sink, progress, rejects = (str(tmp_path / n) for n in ("landing", "sink", "progress", "rejects"))
    (tmp_path / "landing").mkdir()
    for number, price in enumerate(("495.0", "495.5")):
        rows = [["3600", price, "2", "1", "1.75", "1.6", "10", 3], ["90000", "7", "2", "1", "1.75", "1.6", price if number == 0 else "oops", 3]]
        body = json.dumps({"error": [], "result": {"P": rows}})
        failed = json.dumps({"error": ["EGeneral:Internal error"]})
        (tmp_path / "landing" / f"{number}.json").write_text("\n".join(json.dumps({"value": x}) for x in (body, failed)) + "\n")
        ohlc_incremental(spark, landing, "value string", progress, sink, rejects).awaitTermination()
    got = as_set(read_bars(spark, sink), F.unix_seconds("close_time"), "open", "volume")
    assert got == [(3600, 495.5, 10.0), (90000, 7.0, 495.0)]
    reasons = sorted(r.reason for r in spark.read.parquet(rejects).collect())
    assert reasons == ["EGeneral:Internal error", "EGeneral:Internal error", "unreadable volume"]


def test_only_the_days_of_a_batch_are_read(spark, tmp_path):
    from shiftboard.sources import manifest
    from shiftboard.streaming.bars import merge_bars, read_bars

    landed = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("landed_at")
    batch = bars.ohlc_ingest(spark.createDataFrame([(payload("P", range(60)),)], "value string"), "value").select("*", landed)
    sink = str(tmp_path / "sink")
    assert read_bars(spark, sink) is None
    for _ in range(2):  # a repeated batch gives the same rows
        merge_bars(batch, sink)
        assert read_bars(spark, sink).count() == 60
    before = manifest.read(spark, sink)["parts"]
    merge_bars(batch.filter(F.to_date("close_time") == "1970-01-02"), sink)
    after = manifest.read(spark, sink)["parts"]
    assert {d for d in after if after[d] != before[d]} == {"1970-01-02"} and len(after) == 3
    one_day = read_bars(spark, sink, ["1970-01-02"])
    assert len(one_day.inputFiles()) == 1 and one_day.count() == 24
    merge_bars(batch.limit(0), sink)
    assert read_bars(spark, sink).count() == 60


def test_closed_windows_come_once(spark, tmp_path):
    """Late, repeated and restated bars in three landings, each run starting from the folder of the one before."""
    from shiftboard.streaming.bars import ohlc_closed

    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    (tmp_path / "landing").mkdir()

    def land(number, found):
        rows = [[60 * m, str(p), str(p + 1), str(p - 1), str(p + 0.5), "0", str(v), 1] for m, p, v in found]
        body = json.dumps({"error": [], "result": {"P": rows}})
        (tmp_path / "landing" / f"{number}.json").write_text(json.dumps({"value": body}) + "\n")
        ohlc_closed(spark, landing, "value string", progress, sink, "1 hour", "2 hours").awaitTermination()
        held = spark.read.parquet(sink)
        at = (F.unix_seconds("window_start") / 3600).cast("int").alias("hour")
        return sorted(tuple(r) for r in held.select(at, "open", "high", "low", "close", "volume", "bars").collect())

    # minutes of hours 0 to 4; the watermark is at 02:30, so hours 0 and 1 are closed
    first = [(m, 10 + m / 60, 1.0) for m in range(0, 300, 30)]
    one = land(1, [*first, first[0]])
    hour_0, hour_1 = (0, 10.0, 11.5, 9.0, 11.0, 2.0, 2), (1, 11.0, 12.5, 10.0, 12.0, 2.0, 2)
    assert one == [hour_0, hour_1]
    # a bar of hour 1 is too late, one of hour 2 is restated, one of hour 3 is late but in time; nothing closes yet
    two = land(2, [(75, 99.0, 9.0), (120, 50.0, 3.0), (195, 20.0, 1.0)])
    assert two == one
    # 08:00 closes hours 2 to 4
    three = land(3, [(480, 1.0, 1.0)])
    assert three == [hour_0, hour_1, (2, 50.0, 51.0, 11.5, 13.0, 4.0, 2), (3, 13.0, 21.0, 12.0, 14.0, 3.0, 3), (4, 14.0, 15.5, 13.0, 15.0, 2.0, 2)]
    # a run without new files changes nothing
    ohlc_closed(spark, landing, "value string", progress, sink, "1 hour", "2 hours").awaitTermination()
    assert spark.read.parquet(sink).count() == 5


def test_incremental_equals_batch(spark, tmp_path):
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    (tmp_path / "landing").mkdir()

    def land(name, hours):
        line = json.dumps({"value": payload("XBTUSD", [1000 + h for h in hours])})
        (tmp_path / "landing" / name).write_text(line + "\n")

    def run():
        ohlc_incremental(spark, landing, "value string", progress, sink).awaitTermination()
        hours = read_bars(spark, sink).select((F.unix_seconds("close_time") / 3600 - 1000).cast("int")).collect()
        return sorted(r[0] for r in hours)

    land("a.json", range(0, 30))
    assert run() == list(range(30))
    assert run() == list(range(30))  # nothing new landed
    land("b.json", range(20, 40))
    assert run() == list(range(40))
    # a bar a week late and a full repeat
    land("c.json", range(200, 203))
    land("d.json", range(0, 30))
    assert run() == [*range(40), *range(200, 203)]
