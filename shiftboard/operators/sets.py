"""Ordering, limits, draws, stacking and duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import POS, ROWS_PER_SLICE, SLICE, Key, split_at


def sort_multi(d: DataFrame, order: Sequence[tuple[str | Column, str, str]]) -> DataFrame:
    """``(column, "asc"|"desc", "first"|"last")`` per key, null place stated."""
    keys = []
    for c, direction, nulls in order:
        c = F.col(c) if isinstance(c, str) else c
        keys.append(getattr(c, f"{direction}_nulls_{nulls}")())
    return d.orderBy(*keys)


#: leaders that one task may merge; more are found by a threshold
MOST_MERGED = 100_000


def first_rows(
    d: DataFrame, order: Sequence[str | Column], n: int, merged: int = MOST_MERGED, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame | None]:
    """The ``n`` first rows in a total order, and the others (None if ``n`` is small: only large ones are told apart here).

    A few are merged by one task.  For many, the slice that holds the n-th row is the threshold: rows of slices before it are in,
    those after it out, and only that slice's rows are put in order.
    """
    if n <= merged:
        return d.orderBy(*order).limit(n), None
    earlier, around, later, passed = split_at(d, order, n, rows_per_slice)
    place = F.row_number().over(Window.partitionBy(SLICE).orderBy(*[Key.of(c).sorted() for c in order]))
    split = around.withColumn(POS, place)
    inside = F.col(POS) <= n - passed
    leaders = earlier.unionByName(split.filter(inside).select(*d.columns))
    return leaders.orderBy(*order), later.unionByName(split.filter(~inside).select(*d.columns))


def top_n(d: DataFrame, c: str, n: int, tie: str, merged: int = MOST_MERGED, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The ``n`` rows with the largest values, in order; ties by ``tie``."""
    return first_rows(d, [F.col(c).desc_nulls_last(), tie], n, merged, rows_per_slice)[0]


def bottom_n(d: DataFrame, c: str, n: int, tie: str, merged: int = MOST_MERGED, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    return first_rows(d, [F.col(c).asc_nulls_last(), tie], n, merged, rows_per_slice)[0]


def skip_top_n(d: DataFrame, c: str, n: int, tie: str, merged: int = MOST_MERGED, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All rows but the ``n`` first by value: those ``n`` are found, then left out."""
    leaders, others = first_rows(d, [F.col(c).desc_nulls_last(), tie], n, merged, rows_per_slice)
    return d.join(leaders.select(tie), tie, "left_anti") if others is None else others


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _uniform(digest: Column, part: int) -> Column:
    """A number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / float(2**32)


def sample_n(d: DataFrame, n: int, seed: int, key: str, merged: int = MOST_MERGED, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``n`` rows drawn without replacement; the same rows on every run, in the order of their digests."""
    drawn = d.withColumn("__digest", _digest(key, seed))
    return first_rows(drawn, ["__digest", key], n, merged, rows_per_slice)[0].drop("__digest")


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """For each slot the share that stays with it, and the slot that has the rest.

    A slot drawn evenly, then kept or left by its share, follows the weights.
    """
    total, n = float(sum(weights)), len(weights)
    if n == 0 or total <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative, and one of them positive")
    stays, other = [w * n / total for w in weights], list(range(n))
    poor, rich = [i for i in range(n) if stays[i] < 1], [i for i in range(n) if stays[i] >= 1]
    while poor and rich:
        a, b = poor.pop(), rich.pop()
        other[a] = b
        stays[b] -= 1 - stays[a]
        (poor if stays[b] < 1 else rich).append(b)
    for i in (*poor, *rich):  # nothing but rounding is left
        stays[i] = 1.0
    return stays, other


def weighted_draw(d: DataFrame, key: str, values: Sequence[Any], weights: Sequence[float], seed: int,
                  name: str = "drawn") -> DataFrame:
    """One weighted draw, with replacement, for each row of ``d``.

    Two numbers hashed from the key choose a slot of an alias table and whether to keep it, so a draw costs one look-up however many
    values there are, and does not depend on partitioning.  Spark broadcasts the table if it is small.
    """
    if len(values) != len(weights):
        raise ValueError("one weight for each value")
    stays, other = alias_table(weights)
    slots = [(i, stays[i], values[i], values[other[i]]) for i in range(len(values))]
    table = d.sparkSession.createDataFrame(slots, ["__slot", "__stays", "__own", "__else"])
    digest = F.col("__digest")
    slot = F.floor(_uniform(digest, 0) * len(values))
    drawn = d.withColumn("__digest", _digest(key, seed)).withColumn("__slot", F.coalesce(slot, F.lit(0).cast("bigint")))
    kept = F.when(_uniform(digest, 1) < F.col("__stays"), F.col("__own")).otherwise(F.col("__else"))
    return drawn.join(table, "__slot").select(*d.columns, kept.alias(name))


def union_all_grains(grains: Mapping[str, DataFrame], cols: Sequence[str], tag: str = "aggregation_level") -> DataFrame:
    """Stack grains under a tag; a column a grain lacks is a NULL of the others' type."""
    types = {}
    for d in grains.values():
        for f in d.schema.fields:
            types.setdefault(f.name, f.dataType)

    def shaped(label: str, d: DataFrame) -> DataFrame:
        return d.select(
            F.lit(label).alias(tag),
            *[F.col(c) if c in d.columns else F.lit(None).cast(types[c]).alias(c) for c in cols],
        )

    return reduce(lambda a, b: a.unionByName(b), [shaped(k, d) for k, d in grains.items()])


def concat_frames(frames: Sequence[DataFrame], drop: Sequence[str] = ()) -> DataFrame:
    """Stack frames by column name after dropping extra columns."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.drop(*drop) for f in frames]
    )


def _digests(d: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Keys of a fixed size for a shuffle: text and binary columns stand as SHA-256, others as they are."""
    long = [f.name for f in d.schema.fields if f.name in keys and f.dataType.simpleString() in ("string", "binary")]
    digested = {f"__digest_{c}": F.sha2(F.col(c).cast("binary"), 256) for c in long}
    return d.withColumns(digested) if digested else d, [f"__digest_{c}" if c in long else c for c in keys]


def dedupe_rows(d: DataFrame, keys: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Without ``keys``: drop exact repeats.  With ``keys``: keep each key's first row.

    ``order`` must be unique.  First rows are found by a combined minimum and
    joined back on ``order``, so a hot key never gathers in one task; long texts are
    grouped by their digest and do not travel as keys.
    """
    if not keys:
        return d.dropDuplicates()
    if order is None:
        raise ValueError("keeping the first row needs an order column")
    short, by = _digests(d, keys)
    firsts = short.groupBy(*by).agg(F.min(order).alias(order)).select(order)
    return d.join(firsts, order, "left_semi")


def flag_duplicates(d: DataFrame, keys: Sequence[str], order: str, name: str = "is_duplicate") -> DataFrame:
    """True for the second and later rows of equal ``keys`` in ``order`` (unique)."""
    short, by = _digests(d, keys)
    firsts = short.groupBy(*by).agg(F.min(order).alias(order)).select(order, F.lit(False).alias(name))
    return d.join(firsts, order, "left").select(*d.columns, F.coalesce(name, F.lit(True)).alias(name))


def set_difference(d: DataFrame, c: str, allowed: Sequence[Any]) -> DataFrame:
    """Distinct values outside the allowed list."""
    return d.filter(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).select(c).distinct()
