"""Whole-table order without a single-task sort.

Rows are dealt into *slices* of their order.  The slices' bounds (splitters) are read once, from a sample that a hash of the order's
columns chooses, and stand in the plan as literals, as does the number of rows before each slice.  So a slice holds the
same rows on every run and in every recomputed task; nothing is stored, and a table of any size is numbered by windows over
slices.  The number of slices follows from the number of rows.  Small tables are one slice.

Quantiles need no order: they narrow down to the values around each rank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..session import pin

SLICE, POS, HALO = "__slice", "__pos", "__halo"
#: rows of a slice, about: a table has as many slices as it holds of these
ROWS_PER_SLICE = 4_000_000
#: sampled rows for each slice; slices differ in size by about the inverse of its root
SAMPLED = 64
#: bounds that a plan carries; beyond this many slices (200 billion rows) slices grow instead
MOST_SLICES = 50_000


@dataclass(frozen=True)
class Key:
    """One column of an order."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    @classmethod
    def of(cls, c: Column | str) -> Key:
        """A column's name, or ``F.asc``/``F.desc`` of one."""
        if isinstance(c, str):
            return cls(c)
        found = re.fullmatch(r"Column<'`?(.+?)`?(?: (ASC|DESC) NULLS (FIRST|LAST))?'>", str(c))
        if found is None:
            raise ValueError(f"order by a column's name: {c}")
        return cls(found[1], found[2] == "DESC", found[3] != "LAST")

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def sorted(self, backwards: bool = False) -> Column:
        way = "desc" if self.descending != backwards else "asc"
        place = "first" if self.nulls_first != backwards else "last"
        return getattr(self.column, f"{way}_nulls_{place}")()

    def after(self, bound: Column) -> Column:
        """Whether the row's value comes later than ``bound``."""
        later = self.column < bound if self.descending else self.column > bound
        one_null = (bound.isNull() & self.column.isNotNull()) if self.nulls_first else (self.column.isNull() & bound.isNotNull())
        return F.when(self.column.isNull() | bound.isNull(), one_null).otherwise(later)


def places_passed(n: int, at_or_after: Callable[[Column], Column]) -> Column:
    """How many of ``n`` ordered bounds a row has reached, by binary search.

    ``at_or_after`` says so for the bound at a place.
    """
    steps = [1 << i for i in reversed(range(max(n, 1).bit_length()))]

    def step(passed: Column, width: Column) -> Column:
        on = passed + width
        return F.when((on <= F.lit(n)) & at_or_after(on - 1), on).otherwise(passed)

    return F.aggregate(F.lit(steps), F.lit(0), step)


@dataclass
class Slices:
    """A table with its slice numbers, and the number of rows before each slice."""

    rows: DataFrame
    before: list[int]
    order: list[Key]
    bounds: list[Row]  # where each slice but the first begins

    @property
    def single(self) -> bool:
        return len(self.before) == 1

    def start(self) -> Column:
        """Rows before the row's slice."""
        return F.get(F.lit(self.before).cast("array<bigint>"), F.col(SLICE))


def at_or_after(keys: Sequence[Key], bound: Callable[[Key], Column]) -> Column:
    """Whether a row's place in the order is that of a bound, given by column, or later."""
    out = F.lit(True)
    for key in reversed(keys):
        out = key.after(bound(key)) | (key.column.eqNullSafe(bound(key)) & out)
    return out


def slices(d: DataFrame, order: Sequence[Column | str], rows_per_slice: int = ROWS_PER_SLICE, n: int | None = None) -> Slices:
    """``d`` with its slice numbers in ``order``; rows that are equal in it share a slice.

    Counts the rows, if ``n`` does not say how many there are; with more than one slice also reads the sample, and counts each slice.
    """
    keys = [Key.of(c) for c in order]
    n = d.count() if n is None else n
    wanted = min(-(-n // rows_per_slice), MOST_SLICES)
    whole = Slices(d.withColumn(SLICE, F.lit(0)), [0], keys, [])
    if wanted <= 1:
        return whole
    share = min(1.0, SAMPLED * wanted / n)
    drawn = F.shiftrightunsigned(F.xxhash64(*[k.column for k in keys]), 32) < int(share * (1 << 32))
    sample = d.filter(drawn).select(*[k.column.alias(k.name) for k in keys]).distinct()
    place = F.row_number().over(Window.orderBy(*[k.sorted() for k in keys]))
    # bounded by SAMPLED rows a slice, about
    numbered = sample.withColumn(POS, place)
    each = max(1, sample.count() // wanted)
    bounds = numbered.filter(F.col(POS) % each == 0).orderBy(POS).drop(POS).collect()
    if not bounds:
        return whole
    types = dict(d.dtypes)
    arrays = {k.name: F.array(*[F.lit(b[k.name]).cast(types[k.name]) for b in bounds]) for k in keys}

    def reached(at: Column) -> Column:
        return at_or_after(keys, lambda k: F.get(arrays[k.name], at))

    cut = d.withColumn(SLICE, places_passed(len(bounds), reached))
    held = {r[SLICE]: r["n"] for r in cut.groupBy(SLICE).agg(F.count("*").alias("n")).collect()}
    before, seen = [], 0
    for i in range(len(bounds) + 1):
        before.append(seen)
        seen += held.get(i, 0)
    return Slices(cut, before, keys, bounds)


#: slices that a round of ``split_at`` cuts
MOST_CUTS = 256


def split_at(d: DataFrame, order: Sequence[Column | str], n: int, rows_per_slice: int = ROWS_PER_SLICE) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The rows before the slice that holds the ``n``-th row, that slice, the rows after it, and how many come before it.

    Each round cuts what may hold the row into ``MOST_CUTS`` slices at most, so plans carry no more bounds in large tables, and a table of
    a million slices takes three rounds.
    """
    types, size = dict(d.dtypes), d.count()
    none = F.lit(False)
    part, passed, first, past = d, 0, ~none, none
    while True:
        s = slices(part, order, max(rows_per_slice, -(-size // MOST_CUTS)), size)
        at = max(i for i, before in enumerate(s.before) if i == 0 or passed + before < n)
        held = (s.before + [size])[at + 1] - s.before[at]

        def reached(bound: Row) -> Column:
            return at_or_after(s.order, lambda k: F.lit(bound[k.name]).cast(types[k.name]))

        first = reached(s.bounds[at - 1]) if at else first
        past = reached(s.bounds[at]) if at < len(s.bounds) else past
        passed += s.before[at]
        if held <= rows_per_slice or held == size:
            return d.filter(~first), s.rows.filter(F.col(SLICE) == at), d.filter(past), passed
        part, size = d.filter(first & ~past), held


def row_number_global(
    d: DataFrame, order: Sequence[Column | str], name: str = "row_num", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """1-based row number over the whole table.  ``order`` must be total."""
    s = slices(d, order, rows_per_slice)
    within = F.row_number().over(Window.partitionBy(SLICE).orderBy(*[k.sorted() for k in s.order]))
    return s.rows.withColumn(POS, within).select(*d.columns, (s.start() + F.col(POS)).alias(name))


def row_number_grouped(d: DataFrame, lead: Sequence[str], rest: Sequence[str], name: str = "row_num") -> DataFrame:
    """1-based row number in the order of ``lead``, then ``rest``; the order must be total.

    For orders whose leading columns name many groups of a bounded size, such as metric and day: the groups are the
    slices, so nothing is sampled or stored, and a recomputed task numbers its rows alike.  Only one count per group
    is put in order by one task.
    """
    lead = list(lead)
    before = Window.orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*lead).agg(F.count("*").alias("__n"))
    offsets = counts.select(
        *[F.col(c).alias(f"__k_{c}") for c in lead], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy(*lead).orderBy(*rest)
    numbered = d.withColumn("__place", F.row_number().over(within))
    joined = numbered.join(offsets, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in lead])
    return joined.select(*d.columns, (F.col("__before") + F.col("__place")).alias(name))


def backfill_next(
    d: DataFrame, cols: Sequence[str], order: Sequence[str], part: Sequence[str] | None = None, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Fill each missing value with the next non-missing one in ``order``.

    ``part`` keeps the search inside a group; a group may span slices.
    """
    part, cols = list(part or []), list(cols)
    s = slices(d, [*part, *order], rows_per_slice)
    group = [SLICE, *part]

    # within a slice: walk backwards, keep the last value seen
    backwards = Window.partitionBy(*group).orderBy(*[k.sorted(backwards=True) for k in s.order]).rowsBetween(Window.unboundedPreceding, 0)
    local = s.rows.withColumns({f"__local_{c}": F.last(c, ignorenulls=True).over(backwards) for c in cols})
    if s.single:
        return local.select(*[F.col(f"__local_{c}").alias(c) if c in cols else F.col(f"`{c}`") for c in d.columns])

    # across slices: the first value of each later slice the group reaches into;
    # a slice edge cuts one group at most, so these rows number two per slice
    place = F.struct(*[k.column for k in s.order])
    firsts = s.rows.groupBy(*group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in cols])
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    later = whole.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        firsts.withColumns({f"__carry_{c}": F.last(c, ignorenulls=True).over(later) for c in cols})
        .withColumn("__spans", F.count("*").over(whole))
        .filter(F.col("__spans") > 1)
        .drop("__spans", *cols)
    )
    match = [F.col(f"l.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group]
    joined = local.alias("l").join(F.broadcast(carry).alias("c"), match, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"l.{c}"), F.col(f"l.__local_{c}"), F.col(f"c.__carry_{c}")).alias(c)
            if c in cols
            else F.col(f"l.{c}")
            for c in d.columns
        ]
    )


def with_halo(s: Slices, reach: int) -> DataFrame:
    """The rows of all slices and, marked as ``HALO``, copies of the ``reach`` rows before each slice.

    Those rows may lie in several slices, if some hold fewer.
    """
    # the last rows of each slice: a task hands on no more than ``reach`` of them
    from_end = Window.partitionBy(SLICE).orderBy(*[k.sorted(backwards=True) for k in s.order])
    tails = s.rows.withColumn(POS, F.row_number().over(from_end)).filter(F.col(POS) <= reach)
    n = len(s.before)
    starts = F.lit(s.before).cast("array<bigint>")
    # rows before this one, over the whole table; the next slice starts after the slice's last row
    position = F.get(starts, F.col(SLICE) + 1) - F.col(POS)
    near = places_passed(n, lambda at: F.get(starts, at) <= position + reach) - 1
    copies = tails.filter(F.col(SLICE) < n - 1).withColumn("__into", F.when(near > F.col(SLICE), F.sequence(F.col(SLICE) + 1, near)))
    copies = copies.select(*s.rows.drop(SLICE).columns, F.explode("__into").alias(SLICE), F.lit(True).alias(HALO))
    return s.rows.withColumn(HALO, F.lit(False)).unionByName(copies)


def trend_columns(
    d: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    reach: int,
    columns: Callable[[Sequence[str]], Mapping[str, Column]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Window columns that look at most ``reach`` rows back, where a group may be longer than a task should hold.

    ``columns`` makes them from the partition columns, e.g. ``lambda part: {"before": lag_n("v", 7, part, ["day"])}``.
    Groups are dealt into slices, each with the rows before it, so one group of all rows is as many tasks as slices.
    ``part`` and ``order`` together must be total.
    """
    part = list(part)
    s = slices(d, [*part, *order], rows_per_slice)
    if s.single:
        return d.withColumns(dict(columns(part)))
    made = dict(columns([SLICE, *part]))
    return with_halo(s, reach).withColumns(made).filter(~F.col(HALO)).select(*d.columns, *made)


#: rank error of a sketch: one row in so many
ACCURACY = 20_000
#: percentiles that a narrowing round takes of the values inside a bracket
GRID = 2_000
#: rows inside a bracket from which on it is narrowed; equal ones are counted, so one task orders no more values
MOST_INSIDE = 100_000
#: groups whose one row each (some 200 bytes) goes to all tasks, so that the table's rows stay where they are
MOST_BROADCAST = 50_000


def exact_quantiles(
    d: DataFrame, keys: Sequence[str], c: str, probs: dict[str, float], most: int = MOST_INSIDE, groups: int = MOST_BROADCAST
) -> DataFrame:
    """Exact quantiles by group with linear interpolation; NULL and NaN are skipped.

    ``probs`` maps output names to probabilities.  A first pass brackets each wanted rank by approximate
    percentiles, whose rank error is bounded.  While a bracket may hold more than ``most`` rows, another pass takes percentiles of the
    values inside it and narrows it (``narrowed``).  The last pass counts what lies below and above a bracket, one row per task
    and group, and shuffles only the values inside it, equal ones counted.  A rank outside its bracket would
    raise; it cannot be answered wrongly.  No task orders more than ``most`` values, whatever the size of a group.
    Up to ``groups`` brackets are broadcast, those of the largest groups: joined by key, a large group's rows would be sorted by one task.
    """
    keys, names = list(keys), list(probs)
    v = F.col(c).cast("double")
    rows = d.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    around = pin(brackets(rows, keys, probs))
    above, largest = broadcast_above(around, groups), around.agg(F.max("__total")).first()[0]
    if inside_bound(largest or 0) > most:
        around = narrowed(rows, keys, around, probs, most, above)
    met = _met(rows, keys, around, above).select(*keys, "__total", "__v", F.explode("__brackets").alias("__b"))
    side = F.when(F.col("__v") < F.col("__b.lo"), -1).when(F.col("__v") > F.col("__b.hi"), 1).otherwise(0)
    counted = (
        met.select(*keys, "__total", F.col("__b.i").alias("__i"), side.alias("__side"), "__v")
        .groupBy(*keys, "__i", "__side", F.when(F.col("__side") == 0, F.col("__v")).alias("__inside"))
        .agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.first("__total").alias("__total"))
    )
    # places from 0: below the bracket only the last value is known, above it only the first
    upto = Window.partitionBy(*keys, "__i").orderBy("__side", "__inside").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("__to", F.sum("__n").over(upto) - 1).withColumn("__from", F.col("__to") - F.col("__n") + 1)
    rank = _share(probs, F.col("__i")) * (F.col("__total") - 1)

    def value_at(place: Column) -> Column:
        known = (
            F.when(F.col("__side") == 0, F.col("__inside"))
            .when((F.col("__side") < 0) & (place == F.col("__to")), F.col("__high"))
            .when((F.col("__side") > 0) & (place == F.col("__from")), F.col("__low"))
            .otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
        )
        return F.max(F.when((F.col("__from") <= place) & (place <= F.col("__to")), known))

    found = placed.withColumn("__rank", rank).groupBy(*keys, "__i").agg(
        value_at(F.floor("__rank")).alias("__a"), value_at(F.ceil("__rank")).alias("__b"), F.max("__rank").alias("__rank")
    )
    value = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__rank") - F.floor("__rank"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, value)).alias(n) for i, n in enumerate(names)])


def brackets(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Per group: its keys (as ``__k_…``), the number of rows and a bracket around each wanted rank."""
    margin = 2.0 / ACCURACY
    edges = [min(max(p + side * margin, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    around = rows.groupBy(*keys).agg(F.percentile_approx("__v", edges, ACCURACY).alias("__edges"), F.count("*").alias("__total"))
    each = [
        F.struct(F.lit(i).alias("i"), F.get("__edges", F.lit(2 * i)).alias("lo"), F.get("__edges", F.lit(2 * i + 1)).alias("hi"))
        for i in range(len(probs))
    ]
    return around.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__total", F.array(*each).alias("__brackets"))


def inside_bound(total: int) -> int:
    """Rows that a first bracket holds at most, its ends aside."""
    return 6 * total // ACCURACY + 2


def is_few(pinned: DataFrame, groups: int = MOST_BROADCAST) -> bool:
    """Whether a stored frame may be broadcast."""
    return pinned.limit(groups + 1).count() <= groups


def broadcast_above(around: DataFrame, groups: int) -> int:
    """The number of rows beyond which a group's bracket is broadcast; 0 if all may be."""
    if is_few(around, groups):
        return 0
    return around.orderBy(F.desc("__total")).limit(groups).agg(F.min("__total")).first()[0]


def _met(rows: DataFrame, keys: Sequence[str], around: DataFrame, above: int) -> DataFrame:
    if not keys:
        return rows.withColumns({n: around.select(n).scalar() for n in ("__total", "__brackets")})
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    large = F.broadcast(around.filter(F.col("__total") > above))
    found = rows.join(large, match)
    # the rows of small groups go by key
    return found.unionByName(rows.join(large, match, "left_anti").join(around, match)) if above else found


def _share(probs: Mapping[str, float], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), i + 1)


def narrowed(rows: DataFrame, keys: Sequence[str], around: DataFrame, probs: Mapping[str, float], most: int, above: int = 0) -> DataFrame:
    """Brackets with at most ``most`` rows between their ends; rows equal to an end are only counted.

    A round counts what lies below a bracket, at its ends and between them, and sketches what lies between.  The wanted ranks'
    places among those choose two of ``GRID`` percentiles as new ends, one more apart than the sketch can err.  What lies between shrinks by a
    factor of some ``GRID / 4`` a round; values that repeat become an end and leave it.  Each round is one pass over the
    rows, its brackets one row per group, stored.
    """
    keys, steps = list(keys), [i / GRID for i in range(GRID + 1)]
    while around.agg(F.max("__total")).first()[0] or 0:
        met = _met(rows, keys, around, above).select(*keys, "__total", "__v", F.explode("__brackets").alias("__b"))
        v, lo, hi = F.col("__v"), F.col("__b.lo"), F.col("__b.hi")
        between = (v > lo) & (v < hi)
        seen = met.groupBy(*keys, F.col("__b.i").alias("__i")).agg(
            F.first(lo).alias("__lo"),
            F.first(hi).alias("__hi"),
            F.first("__total").alias("__total"),
            F.count_if(v <= lo).alias("__upto"),
            F.count_if(between).alias("__inside"),
            F.percentile_approx(F.when(between, v), steps, ACCURACY).alias("__grid"),
        )
        rank = _share(probs, F.col("__i")) * (F.col("__total") - 1)
        # places among the values between the ends
        first, last = F.floor(rank) - F.col("__upto"), F.ceil(rank) - F.col("__upto")
        per = F.lit(float(GRID)) / F.greatest("__inside", F.lit(1))
        a, b = F.floor(first * per).cast("int") - 1, F.ceil((last + 1) * per).cast("int") + 1
        low = F.when(first >= F.col("__inside"), F.col("__hi")).when(a < 1, F.col("__lo")).otherwise(F.get("__grid", a))
        high = F.when(last < 0, F.col("__lo")).when((last >= F.col("__inside")) | (b >= GRID), F.col("__hi")).otherwise(F.get("__grid", b))
        span = F.least(b, F.lit(GRID)) - F.greatest(a, F.lit(0))
        left = F.ceil(F.col("__inside") * (span / GRID + 4.0 / ACCURACY)) + 2
        left = F.when(F.col("__new_lo") >= F.col("__new_hi"), 0).otherwise(F.least(left, F.col("__inside")))
        seen = seen.withColumns({"__new_lo": low, "__new_hi": high}).withColumn("__left", left)
        each = F.struct(F.col("__i").alias("i"), F.col("__new_lo").alias("lo"), F.col("__new_hi").alias("hi"))
        again = seen.groupBy(*keys).agg(
            F.first("__total").alias("__total"), F.array_sort(F.collect_list(each)).alias("__brackets"), F.max("__left").alias("__left")
        )
        around = pin(again.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__total", "__brackets", "__left"))
        if (around.agg(F.max("__left")).first()[0] or 0) <= most:
            break
    return around.select(*[f"__k_{k}" for k in keys], "__total", "__brackets")
