"""Grouped aggregation.

All aggregates here combine before the shuffle, so a hot group costs one
partial row per task, not its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import week_start_monday
from ..functions.ratios import ratio_or_null, ratio_or_zero

_FN = {
    "sum": F.sum,
    "avg": F.avg,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def agg_group_basic(d: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """``{column: function}``; outputs are named ``function_column``."""
    return d.groupBy(*keys).agg(*[_FN[fn](c).alias(f"{fn}_{c}") for c, fn in measures.items()])


def agg_named(d: DataFrame, keys: Sequence[str], **outputs: Column) -> DataFrame:
    return d.groupBy(*keys).agg(*[c.alias(n) for n, c in outputs.items()])


def agg_conditional(
    d: DataFrame, keys: Sequence[str], value: Column | str, cases: Mapping[str, Column]
) -> DataFrame:
    """One sum per named predicate; rows outside it add 0."""
    v = F.col(value) if isinstance(value, str) else value
    return d.groupBy(*keys).agg(*[F.sum(F.when(cond, v).otherwise(F.lit(0))).alias(n) for n, cond in cases.items()])


def agg_reason_family(
    d: DataFrame, keys: Sequence[str], reason: str, value: str, families: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Sum ``value`` into one column per family of reasons."""
    return agg_conditional(d, keys, value, {n: F.col(reason).isin(*rs) for n, rs in families.items()})


def agg_multi_grain(
    d: DataFrame, fine: Sequence[str], coarse: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Sums at the fine grain, each beside its total at the coarse grain (``total_*``).

    ``coarse`` must be part of ``fine``; totals come from the reduced fine rows.
    """
    sums = d.groupBy(*fine).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    return beside_totals(sums, coarse, {f"total_{n}": F.sum(n) for n in measures})


def beside_totals(sums: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Reduced rows beside totals of their groups; NULL keys are a group of their own.

    Totals are joined back rather than taken over a window: a window puts a whole
    group in one task, and few large groups would leave most of a cluster idle.
    Both sides read the same shuffle of ``sums``.
    """
    keys = list(keys)
    grouped = sums.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    match = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = sums.alias("s").join(grouped.alias("t"), match, "left")
    return joined.select("s.*", *[F.col(f"t.{n}") for n in totals])


def agg_distinct_rows(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    return d.select(*cols).distinct()


def count_rows(d: DataFrame, keys: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    if where is not None:
        d = d.filter(where)
    return d.groupBy(*keys).agg(F.count("*").alias("n"))


def value_counts(d: DataFrame, c: str, n: int | None = None) -> DataFrame:
    """Frequencies, highest first, missing values left out; ties go by value."""
    counts = d.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    counts = counts.orderBy(F.desc("n"), c)
    return counts.limit(n) if n is not None else counts


def distinct_values(d: DataFrame, c: str) -> DataFrame:
    return d.select(c).distinct()


def count_distinct(d: DataFrame, cols: Sequence[str], count_null: bool = False) -> DataFrame:
    """Distinct values per column; ``count_null`` counts a missing value as one more."""
    out = []
    for c in cols:
        n = F.count_distinct(c)
        if count_null:
            n = n + F.max(F.col(c).isNull().cast("int"))
        out.append(F.coalesce(n, F.lit(0)).cast("bigint").alias(c))
    return d.agg(*out)


#: sketches have 2 ** this many registers; their standard error is about 1.04 / sqrt of that (1.6 %)
SKETCH_SIZE = 12


def distinct_sketches(d: DataFrame, keys: Sequence[str], cols: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A sketch of each column's distinct values per group, in a few kB: ``(keys…, cols…)`` to be stored.

    Missing values are not counted.  Sketches of finer groups unite to those of coarser ones (``united_distinct``), so weeks and
    totals need no second pass over the rows.
    """
    whole = {"tinyint", "smallint", "int", "bigint", "string", "binary"}
    typed = {c: F.col(c) if kind in whole else F.col(c).cast("string") for c, kind in d.dtypes if c in cols}
    return d.groupBy(*keys).agg(*[F.hll_sketch_agg(typed[c], F.lit(size)).alias(c) for c in cols])


def united_distinct(sketches: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Estimated distinct values per group of stored sketches."""
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in cols])


def cost_share_bps(
    d: DataFrame, coarse: Sequence[str], fine: Sequence[str], cost: str, flag: Column
) -> DataFrame:
    """Over-budget ratio of each coarse group, shared out to its fine rows in bps.

    A fine row gets the group's ratio times its part of the affected cost.  The
    share is linear in cost, so rows are summed to ``fine`` before the group
    totals: no join back onto the facts.  A group with a NULL key has no ratio.
    """
    over = F.when(flag, F.col(cost)).otherwise(F.lit(0.0))
    sums = d.groupBy(*fine).agg(F.sum(over).alias("affected"), F.sum(cost).alias("planned"))
    # a coarse group (a facility's week) holds a row per category and region here,
    # so a window keeps this to one reading of the facts
    group = Window.partitionBy(*coarse)
    keyed = F.lit(True)
    for k in coarse:
        keyed = keyed & F.col(k).isNotNull()
    totals = sums.withColumns(
        {
            "group_affected": F.when(keyed, F.sum("affected").over(group)),
            "group_planned": F.when(keyed, F.sum("planned").over(group)),
        }
    )
    ratio = ratio_or_zero("group_affected", "group_planned")
    return totals.withColumn("variance_ratio", ratio).withColumn(
        "variance_bps",
        F.col("variance_ratio") * ratio_or_zero("affected", "group_affected") * 10_000,
    )


def percent_of_total(d: DataFrame, keys: Sequence[str], value: str, over: Sequence[str]) -> DataFrame:
    """Group sums and their percentage of the total over the ``over`` keys."""
    sums = d.groupBy(*keys).agg(F.sum(value).alias("part"))
    if over:
        sums = beside_totals(sums, over, {"total": F.sum("part")})
    else:
        sums = sums.withColumn("total", sums.agg(F.sum("part")).scalar())
    return sums.withColumn("pct", ratio_or_null("part", "total") * 100)


def avg_of_ratios_weekly(
    d: DataFrame, keys: Sequence[str], date: str, ratios: Mapping[str, tuple[Column, Column]]
) -> DataFrame:
    """Weekly unweighted mean of daily ratios (not the ratio of weekly sums)."""
    days = d.groupBy(*keys, F.to_date(date).alias("__day")).agg(
        *[F.sum(num).alias(f"__n_{n}") for n, (num, _) in ratios.items()],
        *[F.sum(den).alias(f"__d_{n}") for n, (_, den) in ratios.items()],
    )
    return days.groupBy(*keys, week_start_monday("__day").alias("week_start")).agg(
        *[F.avg(ratio_or_null(f"__n_{n}", f"__d_{n}")).alias(n) for n in ratios],
        F.count("*").alias("days"),
    )


def argmax_key(d: DataFrame, key: str, value: str) -> DataFrame:
    """The key with the largest value, first by key on ties."""
    return d.filter(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(key)).limit(1)


def _category(d: DataFrame, x: str, hue: str, agg: Column, name: str) -> DataFrame:
    return d.groupBy(x, hue).agg(agg.alias(name))


def category_mean_bars(d: DataFrame, x: str, hue: str, value: str) -> DataFrame:
    """Bar heights of a categorical chart that draws means."""
    return _category(d, x, hue, F.avg(value), f"mean_{value}")


def category_stack_sum(d: DataFrame, x: str, hue: str, value: str) -> DataFrame:
    """Heights of stacked columns."""
    return _category(d, x, hue, F.sum(value), f"sum_{value}")


def category_max_bars(d: DataFrame, x: str, hue: str, value: str) -> DataFrame:
    """Heights left visible when bars are drawn over each other."""
    return _category(d, x, hue, F.max(value), f"max_{value}")

