"""Operators on small frames, against plain Python or pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shiftboard.operators import aggregate as agg, filters as flt, joins, ordered, project, quality, reshape, sets, stats, windows as win

from conftest import as_set


# --- filters ---------------------------------------------------------------

def test_date_floor_modes(rows):
    day = dt.datetime(2025, 1, 10)
    seconds = {"start": 0, "second": 1, "close": 86_399, "next": 86_400}
    for kind in ("timestamp_ntz", "timestamp"):
        d = rows([(n, day + dt.timedelta(seconds=s)) for n, s in seconds.items()], f"n string, ts {kind}")
        kept = {
            m: {r[0] for r in flt.filter_date_floor(d, "ts", day.date(), m).select("n").collect()}
            for m in ("after_instant", "after_day", "after_close", "from")
        }
        assert kept == {
            "after_instant": {"second", "close", "next"},
            "after_day": {"next"},
            "after_close": {"next"},
            "from": {"start", "second", "close", "next"},
        }


def test_not_in_keeps_missing(rows):
    d = rows([("a",), ("b",), (None,)], "x string")
    assert as_set(flt.filter_not_in(d, "x", ["a"])) == sorted([("b",), (None,)], key=repr)
    assert as_set(flt.filter_not_in(d, "x", ["a"], keep_null=False)) == [("b",)]


def test_sentinel(rows):
    d = rows([("null", 1), ("5", 2), (None, 3)], "x string, i int")
    assert as_set(flt.sentinel_to_null(d, ["x"])) == [("5", 2)]
    assert flt.sentinel_to_null(d, ["x"], drop=False).filter("x is null").count() == 2


def test_quarter_ranges(rows):
    d = rows([(dt.date(1999, 12, 31),), (dt.date(2000, 1, 1),), (dt.date(1999, 9, 30),)], "d date")
    assert as_set(flt.filter_period(d, "d", quarters=["1999-Q4"])) == [(dt.date(1999, 12, 31),)]


# --- joins -----------------------------------------------------------------

def frames(rows):
    a = rows([(1, 1, 10), (1, 2, 11), (None, 5, 12), (None, 5, 13)], "k int, d int, a int")
    b = rows([(1, 1, 20), (2, 1, 21), (None, 5, 22)], "k int, d int, b int")
    c = rows([(1, 1, 30), (3, 3, 31)], "k int, d int, c int")
    return a, b, c


def test_full_outer_forms_agree(rows):
    a, b, c = frames(rows)
    want = sorted(
        [
            (1, 1, 10, 20, 30), (1, 2, 11, None, None), (2, 1, None, 21, None), (3, 3, None, None, 31),
            (None, 5, 12, None, None), (None, 5, 13, None, None), (None, 5, None, 22, None),
        ],
        key=repr,
    )
    for unique in (True, False):
        joined = joins.join_full_outer_chain([a, b, c], ["k", "d"], check_unique=unique)
        assert as_set(joined, "k", "d", "a", "b", "c") == want


def test_full_outer_keeps_equal_null_key_rows(rows):
    a = rows([(None, 1), (None, 1)], "k int, a int")
    b = rows([(None, 1)], "k int, b int")
    assert joins.join_full_outer_chain([a, b], ["k"]).count() == 3


def test_full_outer_repeats(rows):
    a = rows([(1, 1), (1, 2), (1, 2), (3, 7)], "k int, a int")
    b = rows([(1, 5), (2, 6)], "k int, b int")
    want = sorted([(1, 1, 5), (1, 2, 5), (1, 2, 5), (2, None, 6), (3, 7, None)], key=repr)
    for unique in (True, False):  # one frame may repeat a key
        assert as_set(joins.join_full_outer_chain([a, b], ["k"], unique, repeats=0), "k", "a", "b") == want
        assert as_set(joins.join_full_outer_chain([b, a], ["k"], unique, repeats=1), "k", "a", "b") == want
    both = [a, rows([(1, 5), (1, 6)], "k int, b int")]
    for frames_, repeats in (([a, both[1]], None), (both, 0), (both, 1), ([a, b], None), ([a, b], 1)):
        with pytest.raises(Exception, match="more than once"):
            joins.join_full_outer_chain(frames_, ["k"], repeats=repeats).collect()
    assert joins.join_full_outer_chain(both, ["k"], check_unique=False).count() == 7


def test_full_outer_with_a_third_of_all_rows_under_one_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    once = spark.range(500).select((F.col("id") * 2).alias("k"), (-F.col("id")).alias("b"))
    last = spark.range(40).select((F.col("id") + 2990).alias("k"), F.col("id").alias("c"))
    got = joins.join_full_outer_chain([many, once, last], ["k"], repeats=0)
    want = joins.join_full_outer_chain([many, once, last], ["k"], check_unique=False)
    assert as_set(got, "k", "a", "b", "c") == as_set(want, "k", "a", "b", "c")


def test_full_outer_coalesces_shared_columns(rows):
    a = rows([(1, "x")], "k int, region string")
    b = rows([(1, "y"), (2, "z")], "k int, region string")
    for unique in (True, False):
        assert as_set(joins.join_full_outer_chain([a, b], ["k"], unique), "k", "region") == [(1, "x"), (2, "z")]


def test_many_to_many_totals(rows):
    a = rows([(1, 10.0), (1, 20.0), (2, 1.0)], "k int, x double")
    b = rows([(1, 1.0), (1, 2.0), (1, 3.0), (3, 9.0)], "k int, y double")
    got = joins.join_many_to_many(a, b, ["k"], {"x": F.col("x")}, {"y": F.col("y")})
    brute = a.join(b, "k").groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert as_set(got, "k", "row_multiplier", "x", "y") == as_set(brute) == [(1, 6, 90.0, 12.0)]


# --- aggregation -----------------------------------------------------------

def test_count_distinct_with_missing(rows):
    d = rows([("a",), ("a",), (None,)], "x string")
    assert agg.count_distinct(d, ["x"]).first()[0] == 1
    assert agg.count_distinct(d, ["x"], count_null=True).first()[0] == 2
    assert agg.count_distinct(d.limit(0), ["x"], count_null=True).first()[0] == 0


def test_cost_share_matches_row_by_row(rows):
    random.seed(3)
    data = [
        (random.choice(["f1", "f2", None]), random.randrange(3), random.choice("abc"), random.randrange(-1, 2), float(random.randrange(1, 50)))
        for _ in range(200)
    ]
    d = rows(data, "fac string, wk int, cat string, over int, cost double")
    got = agg.cost_share_bps(d, ["fac", "wk"], ["fac", "wk", "cat"], "cost", F.col("over") > 0)
    p = pd.DataFrame(data, columns=["fac", "wk", "cat", "over", "cost"])
    p["hit"] = np.where(p.over > 0, p.cost, 0.0)
    weekly = p.dropna().groupby(["fac", "wk"]).agg(aff=("hit", "sum"), plan=("cost", "sum")).reset_index()
    m = p.merge(weekly, on=["fac", "wk"], how="left")
    m["bps"] = np.where((m.over > 0) & (m.aff > 0), m.aff / m.plan * (m.cost / m.aff) * 10_000, 0.0)
    want = m.groupby(["fac", "wk", "cat"], dropna=False).bps.sum()
    for r in got.collect():
        key = (r.fac if r.fac else np.nan, r.wk, r.cat)
        expected = want[[k == key or (r.fac is None and pd.isna(k[0]) and k[1:] == key[1:]) for k in want.index]].iloc[0]
        assert r.variance_bps == pytest.approx(expected)


def test_percent_of_total_sums_to_100(rows):
    d = rows([(y, m, float(y * m + 1)) for y in range(3) for m in range(12)], "y int, m int, v double")
    shares = agg.percent_of_total(d, ["y", "m"], "v", ["y"]).groupBy("y").agg(F.sum("pct")).collect()
    assert all(r[1] == pytest.approx(100) for r in shares)
    whole = agg.percent_of_total(d, ["y"], "v", []).agg(F.sum("pct")).first()[0]
    assert whole == pytest.approx(100)


def test_value_counts_skip_missing(rows):
    d = rows([("b",), ("a",), ("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in agg.value_counts(d, "x").collect()] == [("a", 2), ("b", 2)]


# --- ordered recipes -------------------------------------------------------

def test_grouped_row_number_matches_naive(spark):
    d = spark.range(500).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 != 0, F.col("id") % 11).alias("b"), "id")
    got = {r.id: r.n for r in ordered.row_number_grouped(d, ["a", "b"], ["id"], "n").collect()}
    rows = sorted(d.collect(), key=lambda r: (r.a, r.b is not None, r.b or 0, r.id))
    assert got == {r.id: i for i, r in enumerate(rows, 1)}


def test_row_number_matches_naive(spark):
    d = spark.range(0, 1000, 1, 7).select((F.col("id") % 13).alias("g"), "id", F.xxhash64("id").alias("h"))
    got = ordered.row_number_global(d, ["g", F.desc("h")], "rn")
    want = sorted(d.collect(), key=lambda r: (r.g, -r.h))
    assert [r.rn for r in sorted(got.collect(), key=lambda r: (r.g, -r.h))] == list(range(1, 1001))
    assert len(want) == got.select("rn").distinct().count()


def test_slices_are_the_same_on_every_run(spark):
    """Slices follow from the plan's literals: a lost one is made again as it was, whatever the partitioning."""
    order = ["g", F.desc("h")]
    d = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 5 > 0, F.xxhash64("id").cast("string")).alias("h"))
    d = d.withColumn("h", F.coalesce("h", F.when(F.col("id") > 9, F.concat(F.lit("x"), "id"))))  # a few nulls
    s = ordered.slices(d, order, rows_per_slice=300)
    assert len(s.before) > 10 and s.before == sorted(s.before)

    def dealt(rows):
        return {r.id: (r[ordered.SLICE], r.start) for r in rows.select("id", ordered.SLICE, s.start().alias("start")).collect()}

    once = dealt(s.rows)
    assert dealt(s.rows.repartition(7)) == once and dealt(s.rows.filter("id % 2 = 0")) == {i: x for i, x in once.items() if i % 2 == 0}
    sizes = [sum(1 for x, _ in once.values() if x == i) for i in range(len(s.before))]
    assert max(sizes) < 3 * 300
    # in order: every row of a slice comes before every row of the next
    place = {r.id: i for i, r in enumerate(d.orderBy("g", F.desc("h")).collect())}
    assert all(once[i][1] <= place[i] < once[i][1] + sizes[once[i][0]] for i in place if place[i] > 0)


@pytest.mark.parametrize("per_slice", [10**6, 100, 7])
def test_row_number_in_slices(spark, per_slice):
    d = spark.range(0, 1000, 1, 7).select((F.col("id") % 13).alias("g"), "id", F.xxhash64("id").alias("h"))
    got = ordered.row_number_global(d, ["g", F.desc("h")], "rn", per_slice).collect()
    assert [r.rn for r in sorted(got, key=lambda r: (r.g, -r.h))] == list(range(1, 1001))
    assert ordered.row_number_global(d.limit(0), ["id"], "rn", per_slice).count() == 0


def test_order_takes_named_columns_only(spark):
    assert ordered.Key.of(F.desc_nulls_first("a b")) == ordered.Key("a b", True, True)
    assert ordered.Key.of("a") == ordered.Key("a", False, True) == ordered.Key.of(F.asc("a"))
    assert ordered.Key.of(F.desc("a")) == ordered.Key("a", True, False)


@pytest.mark.parametrize("per_slice", [10**6, 60, 3])
def test_trends_in_slices_equal_the_plain_window(spark, per_slice):
    """One long group, short ones, and slices shorter than the reach."""
    from shiftboard.operators import windows as win

    d = spark.range(600).select(F.when(F.col("id") % 9 > 1, "long").when(F.col("id") % 9 == 1, "short").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), F.col("id").alias("day"), (F.col("id") * 7 % 11 + 1.0).alias("v"))

    def columns(part):
        return {
            "before": win.lag_n("v", 5, part, ["day"]),
            "change": win.wow_change("v", 5, part, ["day"]),
            "mean": win.moving_avg_7("v", part, ["day"]),
        }

    want = d.withColumns(columns(["g"]))
    got = ordered.trend_columns(d, ["g"], ["day"], 7, columns, per_slice)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_trend_task_holds_the_whole_group(spark):
    """One group of all rows: the windows' tasks hold a slice and its halo."""
    d = spark.range(20_000).select(F.lit("all").alias("g"), F.col("id").alias("day"), F.col("id").alias("v"))
    s = ordered.slices(d, ["g", "day"], rows_per_slice=1000)
    held = ordered.with_halo(s, 7).groupBy(ordered.SLICE, "g").count()
    assert held.agg(F.max("count")).first()[0] < 2_000 and held.count() > 10
    assert ordered.with_halo(s, 7).filter(ordered.HALO).count() == 7 * (len(s.before) - 1)


@pytest.mark.parametrize("per_slice", [10**6, 40])
@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_backfill_matches_pandas(spark, hot, per_slice):
    random.seed(5)
    data = [
        (i, "hot" if random.random() < hot else f"g{random.randrange(4)}", random.choice([None, None, None, None, float(i)]), random.choice([None, str(i)]))
        for i in range(400)
    ]
    data += [(400, "g0", None, None), (401, "alone", None, None)]
    d = spark.createDataFrame(data, "i int, g string, v double, w string").repartition(5)
    p = pd.DataFrame(data, columns=["i", "g", "v", "w"])

    def check(got, want):
        got = got.toPandas().sort_values("i").reset_index(drop=True)
        for c in ("v", "w"):
            mine, theirs = got[c].astype(object).where(got[c].notna(), None), want[c].astype(object).where(want[c].notna(), None)
            assert list(mine) == list(theirs)

    check(ordered.backfill_next(d, ["v", "w"], ["i"], rows_per_slice=per_slice), p.bfill())
    check(ordered.backfill_next(d, ["v", "w"], ["i"], ["g"], per_slice), p.assign(**{c: p.groupby("g")[c].bfill() for c in ("v", "w")}))


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1001])
def test_quantiles_match_numpy(spark, n):
    random.seed(n)
    values = [float(random.choice([1, 1, 1, 2, 3, random.random() * 100])) for _ in range(n)]
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = {"a": 0.0, "b": 0.025, "c": 0.25, "d": 0.5, "e": 0.975, "f": 1.0}
    got = ordered.exact_quantiles(d, [], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("most", [0, 3, 50])
def test_narrowed_quantiles_match_numpy(spark, most):
    """Brackets narrowed round by round, over repeated values, hot groups, groups of one row and NaN."""
    rng = random.Random(most)
    data = [("a", float(rng.choice([1, 1, 1, 1, 2, 3, rng.random() * 100]))) for _ in range(900)]
    data += [("b", rng.random()) for _ in range(300)] + [("c", 5.0)] * 50 + [("d", 1.0), (None, 2.0), (None, 4.0), ("d", float("nan")), ("e", None)]
    d = spark.createDataFrame(data, "k string, v double")
    probs = {"lo": 0.0, "p": 0.025, "q": 0.25, "m": 0.5, "z": 0.975, "hi": 1.0}
    want = {}
    for k, v in data:
        if v is not None and v == v:
            want.setdefault(k, []).append(v)
    got = {r.k: r for r in ordered.exact_quantiles(d, ["k"], "v", probs, most).collect()}
    assert set(got) == set(want)
    for k, values in want.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p)), (k, name)


def test_no_quantile_task_orders_many_values(spark):
    """Ten million distinct values, at most 500 of them between the ends of a bracket."""
    n, probs = 10_000_000, {"q1": 0.25, "m": 0.5, "p": 0.999}
    d = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"))
    rows = d.select(F.col("v").alias("__v"))
    first = ordered.brackets(rows, [], probs)
    narrow = ordered.narrowed(rows, [], first, probs, 500)

    def widest(around):
        return max(b.hi - b.lo for b in around.first()["__brackets"])

    assert 500 < widest(first) <= ordered.inside_bound(n) and widest(narrow) <= 502
    got = ordered.exact_quantiles(d, [], "v", probs, 500).first()
    assert (got.q1, got.m, got.p) == pytest.approx(((n - 1) / 4, (n - 1) / 2, 0.999 * (n - 1)))


def test_quantiles_by_group_with_hot_key(spark):
    random.seed(1)
    data = [("hot" if random.random() < 0.8 else random.choice("abc"), random.randrange(50) / 4) for _ in range(3000)] + [("none", None)]
    d = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.q1, r.m) for r in ordered.exact_quantiles(d, ["k"], "v", {"q1": 0.25, "m": 0.5}).collect()}
    p = pd.DataFrame(data, columns=["k", "v"]).dropna().groupby("k").v
    want = {k: (g.quantile(0.25), g.median()) for k, g in p}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.fixture
def no_small_sides(spark):
    """Join sides count as large unless they are hinted, as aggregates of large tables do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joins_by_sorting(d) -> int:
    return d._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


@pytest.mark.parametrize("most", [ordered.MOST_INSIDE, 3])
def test_brackets_of_few_groups_go_to_the_rows(no_small_sides, most):
    """The rows of two groups are not sorted by two tasks; more groups than allowed are joined by key, with the same result."""
    d = no_small_sides.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    few, many = (ordered.exact_quantiles(d, ["k"], "v", {"q": 0.1, "m": 0.5}, most, groups) for groups in (2, 1))
    assert joins_by_sorting(few) == 0 < joins_by_sorting(many)
    assert as_set(few) == as_set(many) == [(0, pytest.approx(99.8), 499.0), (1, pytest.approx(100.8), 500.0)]


@pytest.mark.parametrize("most", [ordered.MOST_INSIDE, 3])
def test_a_hot_group_among_many_is_not_sorted(no_small_sides, most):
    """With more groups than are broadcast, only rows of the small ones are joined by key."""
    row = F.col("id")
    key = F.when(row % 10 == 0, (row / 10 % 20).cast("int")).when(row % 10 != 1, F.lit(-1))
    d = no_small_sides.range(2000).select(key.alias("k"), (row * 7 % 2000).cast("double").alias("v"))
    found = ordered.exact_quantiles(d, ["k"], "v", {"q": 0.1, "m": 0.5}, most, 3)
    p = d.toPandas().groupby("k", dropna=False).v
    want = [(None if k != k else int(k), pytest.approx(g.quantile(0.1)), g.median()) for k, g in p]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    sorted_rows = ordered._met(d.withColumn("__v", F.col("v")), ["k"], ordered.brackets(d.withColumn("__v", F.col("v")), ["k"], {"m": 0.5}), 200)
    assert joins_by_sorting(sorted_rows) == 1 and "LeftAnti" in sorted_rows._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_fences_go_to_the_rows(no_small_sides):
    d = no_small_sides.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    assert joins_by_sorting(stats.quantile_bounds(d, ["k", "v"], 0.1, 0.9)) == 0
    assert joins_by_sorting(stats.box_stats(d, ["k"], "v")) == 0


def test_summary_sorts_no_rows(no_small_sides):
    d = no_small_sides.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    assert joins_by_sorting(stats.summary_stats(d, ["k", "v"])) == 1  # its two frames of one row a column


def test_quantiles_of_nothing(rows):
    d = rows([(None,)], "v double")
    assert ordered.exact_quantiles(d, [], "v", {"m": 0.5}).first()["m"] is None


# --- statistics ------------------------------------------------------------

def test_box_stats_whiskers(rows):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    d = rows([(v,) for v in values], "v double")
    r = stats.box_stats(d, [], "v").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert (r.q1, r.q3, r.whisker_lo, r.whisker_hi, r.outliers) == (q1, q3, 1.0, 5.0, 1)


def test_histogram_matches_numpy(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=500)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.n for r in stats.histogram_bins(d, "v", bins=20).orderBy("bin").collect()]
    assert got == list(np.histogram(values, 20)[0])
    edges = list(range(-4, 5, 2))
    fixed = [r.n for r in stats.histogram_bins(d, "v", edges=edges).orderBy("bin").collect()]
    assert fixed == list(np.histogram(values, edges)[0])


def test_histogram_of_one_value(rows):
    d = rows([(3.0,), (3.0,)], "v double")
    assert [r.n for r in stats.histogram_bins(d, "v", bins=3).orderBy("bin").collect()] == [0, 2, 0]


def test_kde_integrates_to_one(spark):
    values = [float(x) for x in np.random.default_rng(1).normal(size=200)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    rows_ = stats.kde_density(d, "v", 200).orderBy("i").collect()
    x = np.array([r.x for r in rows_])
    y = np.array([r.density for r in rows_])
    assert float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(x))) == pytest.approx(1, abs=0.01)
    h = np.std(values, ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - np.array(values)) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert y == pytest.approx(want)


def test_weighted_fit_counts_repeats(rows):
    data = [(1.0, 2.0, 1), (2.0, 3.5, 3), (3.0, 9.0, 2), (4.0, None, 5)]
    repeated = rows([(x, y) for x, y, w in data for _ in range(w)], "x double, y double")
    plain = stats.linear_fit(repeated, "x", "y").first().asDict()
    d = rows([(i % 2, x, y) for i, (x, y, _) in enumerate(data)], "k int, x double, y double")
    by_key = {0: 2, 1: 3}
    again = rows([(x, y) for i, (x, y, _) in enumerate(data) for _ in range(by_key[i % 2])], "x double, y double")
    weighted = stats.weighted_fit(d, ["k"], "x", "y", rows(list(by_key.items()), "k int, times bigint")).first()
    assert weighted.asDict() == pytest.approx(stats.linear_fit(again, "x", "y").first().asDict())
    x, y = zip(*[(x, y) for x, y, w in data if y is not None for _ in range(w)])
    assert (plain["slope"], plain["intercept"]) == pytest.approx(tuple(np.polyfit(x, y, 1)))


def test_corr_lower_triangle(rows):
    d = rows([(float(i), float(i * i), float(-i)) for i in range(6)], "a double, b double, c double")
    got = {(r.row_col, r.col_col): r.corr for r in stats.corr_matrix(d, ["a", "b", "c"]).collect()}
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    assert got["c", "a"] == pytest.approx(-1)


def test_correlations_keep_their_digits(spark):
    """Far from 0, and where the rows of a pair differ from those of its columns."""
    n, rng = 400, np.random.default_rng(1)
    values = rng.normal(size=(n, 14))
    values[:, 1] = values[:, 1] * 1e-4 + 1e8
    values[:, 2] = np.where(np.arange(n) < 200, 1e7 + values[:, 2] * 1e-3, -1e9)
    values[:, 3] = 1e9 / 3
    for gaps in (False, True):
        if gaps:
            values[200:, 4], values[rng.random(n) < 0.3, 5], values[1:, 6], values[:, 7] = np.nan, np.nan, np.nan, np.nan
        data = [[None if np.isnan(v) else float(v) for v in row] for row in values]
        d = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(14))).repartition(3)
        found = {(r.row_col, r.col_col): r.corr for r in stats.corr_matrix(d, d.columns).collect()}
        assert set(found) == {(f"c{j}", f"c{i}") for j in range(14) for i in range(j)}
        for (b, a), r in found.items():
            x, y = (values[:, int(c[1:])].astype(np.longdouble) for c in (a, b))
            both = ~(np.isnan(x) | np.isnan(y))
            x, y = x[both], y[both]
            if both.sum() < 2 or x.min() == x.max() or y.min() == y.max():
                assert r is None, (a, b)
            else:
                x, y = x - x.mean(), y - y.mean()
                assert r == pytest.approx(float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())), abs=1e-9), (a, b)


def test_t_quantiles(rows):
    from shiftboard.functions.distributions import student_t_quantile, student_t_tail

    # two-sided 95 % points of the tables, and others found by the closed form for even degrees of freedom
    known = {1: 12.706204736174694, 2: 4.302652729749464, 5: 2.5705818356363137, 30: 2.0422724563012373, 100: 1.983971518523552, 1000: 1.9623390808264078}
    d = rows([(float(n), t) for n, t in known.items()] + [(0.0, None), (-1.0, None), (None, None)], "df double, want double")
    for r in d.select("df", "want", student_t_quantile(0.975, F.col("df")).alias("got")).collect():
        assert r.got is None if r.want is None else r.got == pytest.approx(r.want, rel=1e-12), r.df

    def even_tail(t, n):
        angle, term, total = np.arctan(t / np.sqrt(n)), 1.0, 1.0
        for k in range(1, n // 2):
            term *= (2 * k - 1) / (2 * k) * np.cos(angle) ** 2
            total += term
        return 0.5 - 0.5 * np.sin(angle) * total

    d = rows([(float(n), t) for n in (4, 10, 64, 400, 998) for t in (0.1, 1.0, 2.5, 9.0)], "df double, t double")
    for r in d.select("df", "t", student_t_tail(F.col("t"), F.col("df")).alias("got")).collect():
        assert r.got == pytest.approx(even_tail(r.t, int(r.df)), rel=1e-9, abs=1e-15), r


def test_fit_band_matches_a_written_out_check(rows):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.1, 3.9, 6.2, 7.8, 10.1, 11.7]
    d = rows([*zip(x, y), (None, 1.0), (9.0, None)], "x double, y double")
    got = {r.x: r for r in stats.linear_fit(d, "x", "y", predict=(0, 7), level=0.95).collect()}
    slope, intercept = np.polyfit(x, y, 1)
    residual = np.sum((np.array(y) - slope * np.array(x) - intercept) ** 2) / 4
    for at, r in got.items():
        error = np.sqrt(residual * (1 / 6 + (at - 3.5) ** 2 / 17.5))
        line, t = slope * at + intercept, 2.7764451051977987  # 0.975 quantile, 4 degrees of freedom
        assert (r.predicted, r.std_err_mean, r.low, r.high) == pytest.approx((line, error, line - t * error, line + t * error), abs=1e-9)
    two = stats.linear_fit(rows([(1.0, 1.0), (2.0, 3.0)], "x double, y double"), "x", "y", predict=(1, 1), level=0.95).first()
    assert two.predicted == pytest.approx(1.0) and two.low is None and two.high is None


def test_weighted_band_counts_repeats(rows):
    data, times = [(0, 1.0, 2.0), (1, 2.0, 3.5), (0, 3.0, 9.0), (1, 5.0, 6.0)], {0: 2, 1: 3}
    d = rows(data, "k int, x double, y double")
    again = rows([(x, y) for k, x, y in data for _ in range(times[k])], "x double, y double")
    got = stats.weighted_fit(d, ["k"], "x", "y", rows(list(times.items()), "k int, times bigint"), band=(5, 0.9))
    want = {r.x: r for r in stats.linear_fit(again, "x", "y", predict=(1, 5), level=0.9).collect()}
    assert sorted(r.x for r in got.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    for r in got.collect():
        assert tuple(r) == pytest.approx(tuple(want[r.x]))


def test_correlation_of_500_columns_with_gaps(spark):
    n, rng = 500, np.random.default_rng(4)
    base = rng.normal(size=(80, 20))
    values = base @ rng.normal(size=(20, n)) + 1e6 + rng.normal(size=(80, n))
    values[rng.random(values.shape) < 0.2] = np.nan
    values[:, 7], values[1:, 8], values[:, 9] = 3.25, np.nan, np.nan  # no spread, one value, none
    table = pd.DataFrame(values, columns=[f"c{i}" for i in range(n)])
    data = [[None if np.isnan(v) else float(v) for v in row] for row in values]
    d = spark.createDataFrame(data, ", ".join(f"c{i} double" for i in range(n))).repartition(3)
    want = table.corr(min_periods=2)
    got = stats.corr_matrix(d, list(table.columns)).collect()
    assert len(got) == n * (n - 1) // 2
    for r in got:
        expected = want.loc[r.row_col, r.col_col]
        assert r.corr is None if np.isnan(expected) else r.corr == pytest.approx(expected, abs=1e-6), r
    some = ["c0", "c1", "c2", "c7"]
    few = {(r.row_col, r.col_col): r.corr for r in stats.corr_matrix(d, some, lower=False).collect()}
    both = {(r.row_col, r.col_col): r.corr for r in stats.wide_correlation(d, some, lower=False).collect()}
    assert few.keys() == both.keys() and all(both[k] == (pytest.approx(few[k], abs=1e-9) if few[k] is not None and few[k] == few[k] else None) for k in few)


def test_uneven_edges_match_numpy(rows):
    values = [0.0, 0.5, 1.0, 1.5, 7.0, 9.99, 10.0, 10.01, -1.0, 100.0, None, float("nan")]
    edges = [0, 1, 1.25, 7, 10]
    got = stats.histogram_bins(rows([(v,) for v in values], "v double"), "v", edges=edges).orderBy("bin").collect()
    assert [r.n for r in got] == list(np.histogram([v for v in values if v is not None and v == v], edges)[0])
    assert [(r.bin_lo, r.bin_hi) for r in got] == list(zip(edges, edges[1:]))
    with pytest.raises(ValueError):
        stats.histogram_bins(rows([(1.0,)], "v double"), "v", edges=[1, 1, 2])


@pytest.mark.parametrize("n", [11, 1500, 2999, 3000, 4000])
def test_leaders_of_many_slices_need_few_bounds(spark, monkeypatch, n):
    """Slices of one row or so, found in rounds, over nulls and repeated values."""
    cut, plain = [], ordered.slices
    monkeypatch.setattr(ordered, "slices", lambda *a, **k: cut.append(plain(*a, **k)) or cut[-1])
    monkeypatch.setattr(ordered, "MOST_CUTS", 8)
    values = [None if i % 50 == 0 else float(i * 7919 % 1000) for i in range(3000)]
    d = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    want = [i for i, _ in sorted(enumerate(values), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    kept = {"merged": 10, "rows_per_slice": 2}
    assert [r.id for r in sets.top_n(d, "v", n, "id", **kept).collect()] == want[:n]
    assert len(cut) >= 2 and max(len(s.before) for s in cut) < 30
    assert sorted(r.id for r in sets.skip_top_n(d, "v", n, "id", **kept).collect()) == sorted(want[n:])


def test_alias_tables_hold_the_weights():
    rng = random.Random(2)
    for n in (1, 2, 7, 1000):
        weights = [rng.choice([0, 1, rng.random() * 50]) for _ in range(n - 1)] + [3.0]
        stays, other = sets.alias_table(weights)
        share = np.array(stays)
        for i, o in enumerate(other):
            share[o] += 1 - stays[i]
        assert share / n == pytest.approx(np.array(weights) / sum(weights))
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            sets.alias_table(bad)


def test_draws_from_many_values(spark):
    n = 100_000
    weights = [1.0 + i % 10 for i in range(n)]
    d = spark.range(300_000)
    drawn = sets.weighted_draw(d, "id", [f"v{i}" for i in range(n)], weights, 11)
    by_weight = drawn.groupBy((F.substring("drawn", -1, 1).cast("int") + 1).alias("w")).count().collect()
    for r in by_weight:  # six standard errors
        share = r.w / 55
        assert abs(r["count"] - 300_000 * share) < 6 * np.sqrt(300_000 * share * (1 - share))
    again = sets.weighted_draw(d.repartition(13), "id", [f"v{i}" for i in range(n)], weights, 11)
    assert again.select(F.sum(F.xxhash64("id", "drawn").cast("decimal(38,0)"))).first() == drawn.select(F.sum(F.xxhash64("id", "drawn").cast("decimal(38,0)"))).first()


def test_many_leaders_without_a_single_merge(spark):
    d = spark.range(20_000).select("id", F.when(F.col("id") % 50 > 0, F.xxhash64("id") % 40).alias("v"))
    kept = {"merged": 10, "rows_per_slice": 500}
    rows_ = d.collect()
    down = [r.id for r in sorted(rows_, key=lambda r: (r.v is None, -(r.v or 0), r.id))]
    up = [r.id for r in sorted(rows_, key=lambda r: (r.v is None, r.v or 0, r.id))]
    for n in (2_000, 19_900, 20_000, 50_000):
        assert [r.id for r in sets.top_n(d, "v", n, "id", **kept).collect()] == down[:n]
        assert [r.id for r in sets.bottom_n(d, "v", n, "id", **kept).collect()] == up[:n]
        assert sorted(r.id for r in sets.skip_top_n(d, "v", n, "id", **kept).collect()) == sorted(down[n:])
    few, many = (sets.sample_n(d, 3_000, 5, "id", merged=m, rows_per_slice=500) for m in (10**6, 10))
    assert few.collect() == many.collect()
    text = many._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in text for bad in ("TakeOrderedAndProject", "GlobalLimit", "CollectLimit"))
    assert sets.top_n(d, "v", 20, "id")._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 1


def test_distinct_sketches_unite(spark):
    d = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") * 31 % 20_011).alias("who"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("id") % 90)).alias("what"))
    daily = agg.distinct_sketches(d, ["day"], ["who", "what"])
    bound = 4 * 1.04 / 2**6
    for keys in (["day"], []):
        got = {r["day"] if keys else None: r for r in agg.united_distinct(daily, keys, ["who", "what"]).collect()}
        exact = d.groupBy(*keys).agg(F.count_distinct("who").alias("who"), F.count_distinct("what").alias("what")).collect()
        for r in exact:
            mine = got[r["day"] if keys else None]
            assert abs(mine.who / r.who - 1) < bound and abs(mine.what / r.what - 1) < bound


def test_code_tables(rows):
    d = rows([("a", 1), ("b", 2), (None, 3), ("z", 4)], "c string, n int")
    codes = rows([("a", "Alpha"), ("b", "Beta"), (None, "none"), ("q", "Queue")], "code string, label string")
    assert as_set(joins.join_code_label(d, "c", codes)) == as_set(rows([("Alpha", 1), ("Beta", 2), (None, 3), ("z", 4)], "c string, n int"))
    with pytest.raises(Exception, match="more than once"):
        joins.join_code_label(d, "c", codes.unionByName(codes)).collect()


def test_rules_are_repaired_in_turn(rows):
    d = rows([(1, 5, 2), (2, 1, 9), (3, None, 4)], "id int, hi int, lo int")
    rules = {"order": F.col("hi") >= F.col("lo"), "small": F.col("hi") <= 8, "known": F.col("hi").isNotNull()}
    swap = {"hi": F.col("lo"), "lo": F.col("hi")}
    fixed = quality.rule_repair(d, rules, {"order": swap, "small": {"hi": F.lit(8)}})
    assert as_set(fixed) == as_set(rows([(1, 5, 2), (2, 8, 1), (3, None, 4)], "id int, hi int, lo int"))
    assert [(r.id, r.rule) for r in quality.rule_check(fixed, rules).collect()] == [(3, "known")]
    with pytest.raises(ValueError):
        quality.rule_repair(d, rules, {"other": {}})


# --- reshape and encode ----------------------------------------------------

def test_melt_then_pivot_round_trip(rows):
    d = rows([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k int, a double, b double")
    long = reshape.melt_long(d, ["k"], ["a", "b"], "name", "v")
    assert as_set(reshape.pivot_wide_plain(long, ["k"], "name", "v", ["a", "b"])) == as_set(d)
    assert as_set(reshape.pivot_wide_sum(long, ["k"], "name", "v", ["a", "b"])) == as_set(d)


def test_pivot_fills_and_sums(rows):
    d = rows([("s", 10, 1.0), ("s", 10, 2.0), ("s", 9, None), ("t", 9, 5.0)], "site string, wk int, v double")
    wide = reshape.pivot_wide_sum(d, ["site"], "wk", "v", [9, 10])
    assert wide.columns == ["site", "9", "10"]
    assert as_set(wide) == [("s", 0.0, 3.0), ("t", 5.0, 0.0)]


def test_pivot_loses_no_level(rows):
    d = rows([("s", 1, 1.0), ("s", 2, 2.0), ("t", 9, 12.0), ("t", None, 5.0)], "site string, wk int, v double")
    for wide in (reshape.pivot_wide_sum(d, ["site"], "wk", "v"), reshape.pivot_wide_plain(d, ["site"], "wk", "v")):
        assert wide.columns == ["site", "1", "2", "9"]
        cells = [x for r in wide.collect() for x in r[1:] if x is not None]
        assert sum(cells) == 15.0
    for pivot in (reshape.pivot_wide_sum, reshape.pivot_wide_plain):
        with pytest.raises(Exception, match="not a declared level: 9"):
            pivot(d, ["site"], "wk", "v", [1, 2]).collect()
    assert as_set(reshape.pivot_wide_sum(d, ["site"], "wk", "v", [1, 2], drop_other=True)) == [("s", 1.0, 2.0)]


def test_pivot_plain_rejects_repeats(rows):
    d = rows([("s", 1, 1.0), ("s", 1, 2.0)], "site string, wk int, v double")
    with pytest.raises(Exception, match="more than one row"):
        reshape.pivot_wide_plain(d, ["site"], "wk", "v", [1]).collect()


def test_one_hot_and_codes(rows):
    d = rows([("b",), ("a",), (None,)], "x string")
    assert as_set(reshape.one_hot(d, "x", prefix="is_")) == sorted([("b", 0, 1), ("a", 1, 0), (None, 0, 0)], key=repr)
    assert as_set(win.label_encode(d, "x")) == sorted([("b", 1), ("a", 0), (None, -1)], key=repr)
    assert as_set(reshape.one_hot_long(d, "x", [])) == [("a", 1), ("b", 1)]
    d.sparkSession.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError, match="pivotMaxValues"):
            reshape.one_hot(d, "x")
    finally:
        d.sparkSession.conf.unset("spark.sql.pivotMaxValues")


def test_quantile_cut_ties_share_a_bin(rows):
    d = rows([(1,), (2,), (2,), (2,), (9,), (None,)], "v int")
    cut = {(r.v, r.bucket) for r in win.quantile_cut(d, "v", 2, ["low", "high"]).collect()}
    assert cut == {(1, "low"), (2, "low"), (9, "high"), (None, None)}


def test_lag_counts_rows_not_days(rows):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(9) if i != 3]
    d = rows([("f", x, float(i)) for i, x in enumerate(days)] + [("g", days[0], 1.0)], "f string, d date, v double")
    got = d.select("f", "v", win.lag_n("v", 7, ["f"], ["d"]).alias("l"), win.moving_avg_7("v", ["f"], ["d"]).alias("m"))
    r = {(x.f, x.v): (x.l, x.m) for x in got.collect()}
    assert r["f", 7.0] == (0.0, 4.0)
    assert r["f", 0.0] == (None, 0.0) and r["g", 1.0] == (None, 1.0)


# --- sets and quality ------------------------------------------------------

def test_duplicates_keep_first(rows):
    d = rows([(3, "a", None), (1, "a", None), (2, "b", 1), (4, "b", 2)], "i int, k string, v int")
    flags = {r.i: r.is_duplicate for r in sets.flag_duplicates(d, ["k", "v"], "i").collect()}
    assert flags == {1: False, 2: False, 3: True, 4: False}
    assert {r.i for r in sets.dedupe_rows(d, ["k"], "i").collect()} == {1, 2}
    assert sets.dedupe_rows(d.drop("i")).count() == 3


def test_sample_ignores_partitioning(spark):
    d = spark.range(500)
    one, two = (sets.sample_n(x, 20, 1, "id") for x in (d.repartition(3), d.repartition(11)))
    assert as_set(one) == as_set(two) and one.count() == 20


def test_weighted_draw_follows_weights(spark):
    drawn = sets.weighted_draw(spark.range(20_000), "id", ["x", "y"], [1, 3], 7)
    share = drawn.filter("drawn = 'y'").count() / 20_000
    assert share == pytest.approx(0.75, abs=0.02)


def test_grains_stack_with_typed_nulls(rows):
    a = rows([("f", dt.date(2024, 1, 1), 1)], "f string, day date, n int")
    b = rows([("f", 3)], "f string, n int")
    got = sets.union_all_grains({"daily": a, "weekly": b}, ["f", "day", "n"])
    assert dict(got.dtypes)["day"] == "date"
    assert as_set(got) == [("daily", "f", dt.date(2024, 1, 1), 1), ("weekly", "f", None, 3)]


def test_skip_top(rows):
    d = rows([("a", 3), ("b", 9), ("c", 9), ("d", 1)], "k string, v int")
    assert as_set(sets.skip_top_n(d, "v", 2, "k"), "k") == [("a",), ("d",)]


def test_missing_reports(rows):
    d = rows([(1, "a", None), (2, None, None), (3, "c", 1)], "i int, x string, y int")
    assert as_set(quality.missing_counts(d)) == [("i", 0, False), ("x", 1, True), ("y", 2, True)]
    r = quality.missing_cost_report(d).first()
    assert (r.cells, r.cells_after_row_drop, r.cells_after_col_drop) == (9, 3, 3)
    assert quality.drop_missing_cols(d).columns == ["i"]
    assert quality.rows_with_missing(d).count() == 2
    profile = {r["column"]: (r.dtype, r.non_null) for r in quality.table_profile(d).collect()}
    assert profile == {"i": ("int", 3), "x": ("string", 2), "y": ("int", 1)}


def test_domain_and_rules(rows):
    d = rows([("FinTech", -1), ("Fintech", 2), ("Zoo", 3), (None, None)], "x string, span int")
    found = quality.domain_check(d, "x", ["Fintech"], {"FinTech": "Fintech"})
    assert as_set(found) == [("after", "Zoo", 1), ("before", "FinTech", 1), ("before", "Zoo", 1)]
    broken = quality.rule_check(d, {"span": F.col("span") >= 0})
    assert as_set(broken) == [("FinTech", -1, "span")]
    fixed = project.point_update(d, F.col("x") == "FinTech", {"span": 4})
    assert quality.rule_check(fixed, {"span": F.col("span") >= 0}).count() == 0


def test_positional_header(rows):
    d = rows([(1, 2, 3)], "a int, b int, c int")
    assert project.positional_header(d, ["x", "", ""]).columns == ["x", "temp_col_1", "temp_col_2"]
