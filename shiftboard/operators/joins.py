"""Joins.

No join here carries a broadcast hint: Spark broadcasts a side by its measured
size (``spark.sql.autoBroadcastJoinThreshold``, re-checked at run time) and
shuffles otherwise, splitting skewed partitions.  Constant configuration lists
are exploded as literals and need no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def join_inner(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "inner")


def join_left_multi_key(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left")


def join_dim_enrich(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add dimension attributes, keeping facts without a match."""
    keys = [on] if isinstance(on, str) else list(on)
    return fact.join(dim.select(*keys, *cols), keys, "left")


def join_code_label(d: DataFrame, c: str, codes: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """``code_to_label`` from a table: ``c`` as its label, or as it is where the code is not listed.

    For maps too large for a literal.  A code that the table lists twice raises, as rows would be repeated.
    """
    listed = codes.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code")).agg(
        F.max(label).alias("__label"), F.count("*").alias("__n")
    )
    once = F.when(F.col("__n") == 1, F.col("__label")).otherwise(
        F.raise_error(F.concat(F.lit("a code is listed more than once: "), F.col("__code").cast("string"))).cast("string")
    )
    listed = listed.select("__code", once.alias("__label"))
    joined = d.join(listed, F.col(f"`{c}`") == F.col("__code"), "left")
    return joined.select(*[F.coalesce("__label", F.col(f"`{n}`")).alias(n) if n == c else F.col(f"`{n}`") for n in d.columns])


def join_computed_key(
    a: DataFrame, b: DataFrame, keys: Mapping[str, tuple[Column, Column]], how: str = "left"
) -> DataFrame:
    """Join on expressions: each side's key is computed once, then joined by equality."""
    left = a.withColumns({k: pair[0] for k, pair in keys.items()})
    right = b.withColumns({k: pair[1] for k, pair in keys.items()})
    return left.join(right, list(keys), how)


def join_left_then_notnull(a: DataFrame, b: DataFrame, on: str | Sequence[str], c: str) -> DataFrame:
    """Left join, then require ``c`` from the right side; Catalyst plans an inner join."""
    return a.join(b, on, "left").filter(F.col(c).isNotNull())


def join_semi_rows(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def join_full_outer_chain(
    frames: Sequence[DataFrame], keys: Sequence[str], check_unique: bool = True, repeats: int | None = None
) -> DataFrame:
    """Full outer join of several frames on shared keys.

    Columns that several frames share beyond the keys are coalesced in frame
    order.  With ``check_unique`` the frames are stacked and grouped, one shuffle for
    the whole chain; a key that a frame holds twice raises while running.  The frame numbered ``repeats`` may hold a
    key any number of times: the others are grouped to one row per key, and it is joined to those rows, so a hot key
    is a skewed join, which Spark splits.  Without ``check_unique`` the frames are joined pairwise, and any
    repeats fan out.  Rows with a NULL key never match another frame's.
    """
    keys = list(keys)
    if not check_unique:
        return reduce(lambda x, y: _full_outer_pair(x, y, keys), frames)

    outputs: list[str] = []
    for f in frames:
        outputs += [c for c in f.columns if c not in keys and c not in outputs]
    null_key = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    once = [i for i in range(len(frames)) if i != repeats]

    def row_of(f: DataFrame) -> Column:
        return F.struct(*[c for c in f.columns if c not in keys], F.lit(1).alias("__there"))

    def shaped(i: int) -> DataFrame:
        f = frames[i]
        # rows with a NULL key never meet: not other frames', and not each other
        apart = F.when(null_key, F.concat(F.lit(f"{i}:"), F.monotonically_increasing_id().cast("string")))
        return f.select(*keys, row_of(f).alias(f"__{i}"), apart.alias("__apart"))

    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), map(shaped, once))

    def only(i: int) -> Column:
        one = F.when(F.count(f"__{i}") <= 1, F.first(f"__{i}", ignorenulls=True))
        return one.otherwise(F.raise_error(F.lit("a frame holds a join key more than once")).cast(union.schema[f"__{i}"].dataType))

    joined = union.groupBy(*keys, "__apart").agg(*[only(i).alias(f"__{i}") for i in once]).drop("__apart")
    if repeats is not None:
        many = frames[repeats]
        joined = many.select(*keys, row_of(many).alias(f"__{repeats}")).join(joined, keys, "full")
    merged = [
        F.coalesce(*[F.col(f"__{i}.{c}") for i, f in enumerate(frames) if c in f.columns]).alias(c)
        for c in outputs
    ]
    return joined.select(*keys, *merged)


def _full_outer_pair(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    shared = [c for c in x.columns if c in y.columns and c not in keys]
    y = y.withColumnsRenamed({c: f"__r__{c}" for c in shared})
    joined = x.join(y, keys, "full")
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__r__{c}")) for c in shared})
    return joined.drop(*[f"__r__{c}" for c in shared])


def join_cross_config(d: DataFrame, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Every row of ``d`` with every row of a constant configuration list.

    The list is part of the plan as literals, so this is a narrow ``explode``.
    A value may be a Column, e.g. the metric each configuration row picks.
    """
    structs = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in row.items()]) for row in rows
    ]
    return d.select("*", F.explode(F.array(*structs)).alias("__cfg")).select(
        *d.columns, *[F.col(f"__cfg.{k}").alias(k) for k in rows[0]]
    )


def join_many_to_many(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str],
    left: Mapping[str, Column] | None = None,
    right: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Totals of a join on a key neither side holds once, without making its pairs.

    Returns per key: ``n_left``, ``n_right``, ``row_multiplier`` (rows the join
    would give), and each named sum as it would come out over the joined rows.
    Each side is reduced to one row per key first, so a hot key stays one row.
    """
    left, right, on = dict(left or {}), dict(right or {}), list(on)
    la = a.groupBy(*on).agg(F.count("*").alias("n_left"), *[F.sum(c).alias(n) for n, c in left.items()])
    rb = b.groupBy(*on).agg(F.count("*").alias("n_right"), *[F.sum(c).alias(n) for n, c in right.items()])
    j = la.join(rb, on, "inner")
    return j.select(
        *on,
        "n_left",
        "n_right",
        (F.col("n_left") * F.col("n_right")).alias("row_multiplier"),
        *[(F.col(n) * F.col("n_right")).alias(n) for n in left],
        *[(F.col(n) * F.col("n_left")).alias(n) for n in right],
    )


def join_aligned_ratio(a: DataFrame, b: DataFrame, key: str, value: str, scale: float = 100.0) -> DataFrame:
    """``a.value / b.value`` aligned by key; a key missing on one side gives NULL."""
    x = a.select(key, F.col(value).alias("__a"))
    y = b.select(key, F.col(value).alias("__b"))
    ratio = F.try_divide(F.col("__a").cast("double"), F.col("__b").cast("double")) * scale
    return x.join(y, key, "full").select(key, ratio.alias("ratio"))
