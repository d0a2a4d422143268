"""Shape of the physical plans: what must not appear whatever the data size."""

import re

import pytest
from pyspark.sql import functions as F

from shiftboard.bindings import load
from shiftboard.operators import joins, ordered, reshape

from conftest import plan

SF = "/root/testdata/sf0.001"
REGISTRY = load()
# one-task windows that are meant: each runs over one row per slice or file block, and is known by its order
ONE_TASK = {
    "row_number_global": 1,  # tables of one slice
    "label_encode": 1,
    "report_metric_hierarchy": 1,  # rows before each metric and day
    "skip_leading_rows": 1,  # rows before each file block
    "row_number_global__sliced": 0,
    "backfill_next": 1,  # a table of one slice
    "backfill_next__sliced": 2,  # values of later slices, and how many slices there are
}
WRITES = {"bundle_sink", "ohlc_incremental", "ohlc_incremental__closed"}
ORDERED = ("row_number_global", "row_number_global__sliced", "backfill_next", "backfill_next__sliced", "label_encode")


@pytest.fixture(scope="module")
def static(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


# columns by columns sums of wide tables are matrix products
MATRICES = {"corr_matrix__wide"}


@pytest.mark.parametrize("key", sorted(set(REGISTRY.QUERIES) - WRITES - MATRICES))
def test_no_python_and_no_cross_product(static, key):
    text = plan(REGISTRY.QUERIES[key](static, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text
    assert one_task_windows(text) <= ONE_TASK.get(key, 0)


def one_task_windows(text: str) -> int:
    """Windows whose rows all meet in one task."""
    lines = text.splitlines()
    found = [i for i, line in enumerate(lines) if re.search(r"\bWindow \[", line)]
    return sum(any("SinglePartition" in x for x in lines[i : i + 3]) for i in found)


@pytest.mark.parametrize("key", ORDERED)
def test_order_stores_nothing(static, key):
    """Slices come from literals: no stored frame, and no sampled range partitioning."""
    text = plan(REGISTRY.QUERIES[key](static, SF))
    assert "ExistingRDD" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("key", ["dedupe_rows", "flag_duplicates"])
def test_texts_do_not_travel_as_keys(static, key):
    for line in plan(REGISTRY.QUERIES[key](static, SF)).splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line.replace("__digest_text", "")


def test_quantiles_shuffle_only_bracketed_values(static):
    d = static.range(50_000).select((F.col("id") * 1.0).alias("v"))
    q = ordered.exact_quantiles(d, [], "v", {"m": 0.5})
    q.collect()
    assert "RangePartitioning" not in plan(q) and "rangepartitioning" not in plan(q)


@pytest.mark.parametrize("key", ["corr_matrix", "report_health_screen__corr"])
def test_correlations_are_compiled(static, key):
    """No aggregate has more fields than Spark compiles."""
    lines = [x for x in plan(REGISTRY.QUERIES[key](static, SF)).splitlines() if "Aggregate(" in x]
    assert lines and all(re.search(r"\*\(\d+\) HashAggregate\(", x) for x in lines)


def pushed(d) -> str:
    mode = d.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = d._jdf.queryExecution().explainString(mode)
    return "\n".join(x for x in text.splitlines() if x.startswith(("PushedFilters", "ReadSchema")))


@pytest.mark.parametrize(
    "key, column",
    [
        ("filter_date_floor", "ts"),
        ("filter_relative_months", "o_orderdate"),
        ("filter_period", "o_orderdate"),
        ("report_cancellation", "l_shipdate"),
        ("report_ops_metrics", "l_shipdate"),
        ("report_quarterly_review", "l_shipdate"),
        ("quantile_trim", "l_extendedprice"),
    ],
)
def test_date_bounds_reach_the_scan(static, key, column):
    assert re.search(rf"Than(OrEqual)?\({column},", pushed(REGISTRY.QUERIES[key](static, SF)))


def test_text_dates_reach_the_scan(static, tmp_path):
    from shiftboard.plans.quarterly import QuarterlyConfig, report_quarterly_review

    path = str(tmp_path / "late")
    static.sql(
        "select 'F' as facility_code, '1998-02-01T00:00:00.000Z' as balance_date, 1.0D as defect_rate, 1L as raw_late_count"
    ).write.parquet(path)
    late = static.read.parquet(path)
    outbound = static.createDataFrame([], "facility_code string, process_path string, category string, clean_date string, performance_score double, weekly_percentage double")
    tasks = static.read.parquet(f"{SF}/lineitem.parquet").select(
        F.lit("w").alias("warehouse_id"), F.to_date("l_shipdate").alias("date"), F.lit("g").alias("process_group"), F.lit(1).alias("total_units"),
        *[F.lit(1.0).alias(c) for c in ("execution_score", "compliance_score", "event_score", "capacity_score", "uncategorized_score", "accuracy_score", "workload_score", "planning_score")],
    )
    review = report_quarterly_review({"late": late, "outbound": outbound, "tasks": tasks}, QuarterlyConfig(quarters=("1998-Q1", "1998-Q3")))
    text = pushed(review["late"])
    assert "GreaterThanOrEqual(balance_date,1998-01-01)" in text and "LessThan(balance_date,1998-10-01)" in text


def test_unpivot_reads_once(static):
    d = static.read.parquet(f"{SF}/lineitem.parquet")
    catalog = [{"metric": c, "column": c} for c in ("l_quantity", "l_tax", "l_discount")]
    text = plan(reshape.metric_unpivot(d, ["l_suppkey"], catalog, True))
    assert text.count("FileScan") == 1 and "Union" not in text


def test_full_outer_chain_shuffles_once(static):
    frames = [
        static.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias(n)).distinct() for n in ("a", "b", "c")
    ]
    pre = [f.groupBy("k").agg(F.max(f.columns[1]).alias(f.columns[1])) for f in frames]
    stacked = plan(joins.join_full_outer_chain(pre, ["k"]))
    assert stacked.count("SortMergeJoin") == 0


def test_full_outer_chain_gathers_no_rows(static):
    """The repeating frame meets the others in one join, which Spark can split; there is no window by key."""
    hot = static.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    once = static.range(3).select(F.col("id").cast("int").alias("k"), F.col("id").alias("b"))
    more = static.range(5).select(F.col("id").cast("int").alias("k"), F.col("id").alias("c"))
    joined = joins.join_full_outer_chain([hot, once, more], ["k"], repeats=0)
    text = plan(joined)
    assert "collect_list" not in text and "Window" not in text and text.count("FullOuter") == 1 and joined.count() == 1004


def test_left_join_then_not_null_is_inner(static):
    a = static.read.parquet(f"{SF}/documents.parquet")
    b = static.read.parquet(f"{SF}/labels.parquet")
    joined = joins.join_left_then_notnull(a, b, "doc_id", "quality")
    assert "LeftOuter" not in joined._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key, scans", [("agg_multi_grain", 1), ("percent_of_total", 1), ("cost_share_bps", 1), ("report_cancellation", 5), ("report_metric_hierarchy", 0)])
def test_facts_are_read_once(spark, key, scans):
    """Totals beside their parts come from the same shuffle, grains from one pass."""
    d = REGISTRY.QUERIES[key](spark, SF)
    d.collect()
    final = plan(d).split("Initial Plan")[0]
    assert final.count("FileScan") == scans and final.count("FileScan parquet [l_") <= 1
