"""Distribution, correlation and trend statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distributions import student_t_quantile
from ..session import pin
from .ordered import exact_quantiles, is_few, places_passed

#: exp(-z * z / 2) is 0 in a double from here on
REACH = 39.0
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def long_values(d: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, column, value)`` rows for numeric columns, in one scan."""
    typed = d.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(list(keep), list(cols), "column", "value")


def summary_stats(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sd, min, quartiles (exact) and max of each column, one row per column."""
    rows = long_values(d, cols)
    moments = rows.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(rows, ["column"], "value", QUARTILES)
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q1", "median", "q3", "max"
    )


def median_by_group(d: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    return exact_quantiles(d, keys, c, {"median": 0.5})


def quantile_bounds(d: DataFrame, cols: Sequence[str], lo: float, hi: float) -> DataFrame:
    """``(column, lo, hi)``: one row per column."""
    return exact_quantiles(long_values(d, cols), ["column"], "value", {"lo": lo, "hi": hi})


def quantile_trim(d: DataFrame, cols: Sequence[str], lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Rows inside the ``[lo, hi]`` quantiles of every column.

    All bounds come from the untrimmed frame.  They are read first, one row per
    column, and become literals the scan can filter by.
    """
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in quantile_bounds(d, cols, lo, hi).collect()}
    for c in cols:
        if c not in bounds:
            return d.limit(0)
        d = d.filter((F.col(c) >= bounds[c][0]) & (F.col(c) <= bounds[c][1]))
    return d


def histogram_bins(
    d: DataFrame, c: str, bins: int | None = None, edges: Sequence[float] | None = None
) -> DataFrame:
    """Counts per bin, empty bins included; only the last bin holds its upper edge.

    ``bins`` equal widths span the data.  ``edges`` may be spaced in any way and are found by binary search; values outside
    them are not counted.
    """
    v = F.col(c).cast("double")
    if edges is not None:
        return _binned_by_edges(d, v, [float(e) for e in edges])
    d = d.filter(v.isNotNull())
    n = int(bins)
    # a single value sits in the middle of a range of one
    spread = F.max(v) - F.min(v)
    span = d.agg(
        F.when(spread == 0, F.min(v) - 0.5).otherwise(F.min(v)).alias("lo"),
        (F.when(spread == 0, F.lit(1.0)).otherwise(spread) / n).alias("width"),
    )
    s = span.select(F.struct("lo", "width")).scalar()
    lo, width = s["lo"], s["width"]
    index = F.least(F.floor((v - lo) / width), F.lit(n - 1))
    counts = d.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = span.select("lo", "width", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _binned_by_edges(d: DataFrame, v: Column, edges: list[float]) -> DataFrame:
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must rise, and there must be two at least")
    n, bounds = len(edges) - 1, F.lit(edges)
    inside = d.filter((v >= edges[0]) & (v <= edges[-1]))
    passed = places_passed(n + 1, lambda at: v >= F.get(bounds, at))
    counts = inside.groupBy((F.least(passed, F.lit(n)) - 1).alias("bin")).agg(F.count("*").alias("n"))
    every = d.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", F.get(bounds, F.col("bin")).alias("bin_lo"), F.get(bounds, F.col("bin") + 1).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def box_stats(d: DataFrame, keys: Sequence[str], c: str, k: float = 1.5) -> DataFrame:
    """Quartiles by group, and whiskers: the furthest values inside ``k`` IQRs."""
    q = exact_quantiles(d, keys, c, QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumns({"__lo": F.col("q1") - k * iqr, "__hi": F.col("q3") + k * iqr})
    # one fence row per group meets the rows; what leaves a task is one row per group
    values = d.filter(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("__v"))
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    if keys:
        fences = pin(fences)
        fenced = values.join(F.broadcast(fences) if is_few(fences) else fences, list(keys))
    else:
        f = fences.first()
        fenced = values.withColumns({n: F.lit(f[n]).cast("double") for n in fences.columns})
    return (
        fenced.groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def kde_density(d: DataFrame, c: str, grid: int = 1000, bw: str = "scott") -> DataFrame:
    """Gaussian kernel density on ``grid`` points from half a range below to half above.

    Scott bandwidth: sd * n^(-1/5).  Values are counted first; each counted value
    adds its kernel to the grid points where it is not 0 in a double (``REACH`` bandwidths; the more values, the
    fewer points), and partial sums leave the tasks.
    """
    if bw != "scott":
        raise ValueError("only the Scott bandwidth is defined")
    v = F.col(c).cast("double")
    d = d.filter(v.isNotNull())
    span = d.agg(
        F.count(v).alias("n"),
        (F.stddev_samp(v) * F.pow(F.count(v).cast("double"), F.lit(-0.2))).alias("h"),
        (F.min(v) - 0.5 * (F.max(v) - F.min(v))).alias("lo"),
        (2 * (F.max(v) - F.min(v)) / (grid - 1)).alias("step"),
    )
    s = span.select(F.struct("n", "h", "lo", "step")).scalar()
    counted = d.groupBy(v.alias("v")).agg(F.count("*").alias("w"))
    low = F.greatest(F.lit(0), F.ceil((F.col("v") - REACH * s["h"] - s["lo"]) / s["step"]).cast("int"))
    high = F.least(F.lit(grid - 1), F.floor((F.col("v") + REACH * s["h"] - s["lo"]) / s["step"]).cast("int"))
    reached = F.when(low <= high, F.sequence(low, high))
    points = counted.select("v", "w", F.explode(reached).alias("i"))
    x = s["lo"] + F.col("i") * s["step"]
    kernel = F.exp(-0.5 * F.pow((x - F.col("v")) / s["h"], F.lit(2)))
    sums = points.groupBy("i").agg(F.sum(F.col("w") * kernel).alias("k"))
    every = d.sparkSession.range(grid).select(F.col("id").cast("int").alias("i")).filter(s["n"] > 0)
    sums = every.join(sums, "i", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    norm = s["n"] * s["h"] * F.sqrt(2 * F.pi())
    return sums.select("i", x.alias("x"), (F.col("k") / norm).alias("density"))


#: up to this many columns every pair is a sum of one plan; beyond, pairs are summed in blocks of rows
MOST_PAIRED = 40
#: sums of one aggregate: Spark compiles no aggregate of more than 100 fields (spark.sql.codegen.maxFields)
MOST_SUMS = 90
#: pairs of so many columns by so many share an aggregate, about
TILE = 7


def corr_matrix(d: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """Pairwise Pearson correlation as ``(row_col, col_col, corr)``, over the rows that have both.

    Values are centred by means that are read first, so that sums of products lose no digits; then each aggregate of ``MOST_SUMS`` sums is
    a pass.  A column's sums are shared by all its pairs, but where the other column has gaps: those sums are over the rows of the pair.
    Null for a column without spread.  Wide tables (``MOST_PAIRED``) go through ``wide_correlation``.
    """
    if len(cols) > MOST_PAIRED:
        return wide_correlation(d, cols, lower)
    place = {c: i for i, c in enumerate(cols)}
    pairs = sorted(combinations(cols, 2), key=lambda p: (place[p[0]] // TILE, place[p[1]] // TILE))
    v = {c: F.col(c).cast("double") for c in cols}
    held = _read(d, {("n",): F.count("*"), **{("n", c): F.count(v[c]) for c in cols}, **{("sum", c, None): F.sum(v[c]) for c in cols}})
    gaps = {c for c in cols if held["n", c] < held["n",]}
    # a column's figures beside another: its own, if that has no gaps
    beside = {(a, b): (a, b if b in gaps else None) for p in pairs for a, b in (p, p[::-1])}
    value = {(a, b): F.when(v[b].isNotNull(), v[a]) if b else v[a] for a, b in beside.values()}
    both = {(a, b): F.count(value[beside[a, b]]) for a, b in pairs if a in gaps and b in gaps}
    held |= _read(d, {**{("n", *p): n for p, n in both.items()}, **{("sum", *k): F.sum(x) for k, x in value.items() if k[1]}})

    def rows(a: str, b: str) -> int:
        if (a, b) in both:
            return held["n", a, b]
        return min(held["n", a], held["n", b])

    mean = {}
    for a, b in pairs:
        for key in (beside[a, b], beside[b, a]):
            m = (held["sum", *key] or 0.0) / max(rows(a, b) if key[1] else held["n", key[0]], 1)
            mean[key] = m if m - m == 0 else 0.0
    z = {k: x - F.lit(mean[k]) for k, x in value.items()}
    plans: list[dict[tuple, Column]] = []
    found: list[list[tuple[str, str]]] = []
    for a, b in pairs:
        x, y = beside[a, b], beside[b, a]
        needs = {("s", x): z[x], ("s", y): z[y], ("q", x): z[x] * z[x], ("q", y): z[y] * z[y], ("p", x, y): z[x] * z[y]}
        if not plans or len(plans[-1] | needs) > MOST_SUMS:
            plans.append({})
            found.append([])
        plans[-1] |= needs
        found[-1].append((a, b))

    parts = []
    for sums, of in zip(plans, found):
        name = {k: f"__{i}" for i, k in enumerate(sums)}
        structs = []
        for a, b in of:
            x, y = beside[a, b], beside[b, a]
            figures = {f"{f}{side}": F.col(name[f, k]) for side, k in (("x", x), ("y", y)) for f in ("s", "q")} | {"p": F.col(name["p", x, y])}
            figures |= {"n": F.lit(rows(a, b) if rows(a, b) > 1 else None).cast("double"), "mx": F.lit(mean[x]), "my": F.lit(mean[y])}
            for r, c in ((b, a),) if lower else ((b, a), (a, b)):
                structs.append(F.struct(F.lit(r).alias("row_col"), F.lit(c).alias("col_col"), *[v.alias(k) for k, v in figures.items()]))
        one = d.agg(*[F.sum(x).alias(name[k]) for k, x in sums.items()])
        parts.append(one.select(F.inline(F.array(*structs))))

    def spread(side: str) -> Column:
        """Sum of squares about the mean; null if no more than what is left of rounding."""
        s, n = F.col(f"s{side}"), F.col("n")
        middle, out = F.col(f"m{side}") + s / n, F.col(f"q{side}") - s * s / n
        return F.when(out > 1e-28 * n * middle * middle, out)

    products = F.col("p") - F.col("sx") * F.col("sy") / F.col("n")
    corr = F.try_divide(products, F.sqrt(spread("x") * spread("y")))
    return reduce(DataFrame.unionAll, parts).select("row_col", "col_col", corr.alias("corr"))


def _read(d: DataFrame, figures: Mapping[tuple, Column]) -> dict[tuple, float]:
    """Aggregates over the whole table, in passes of ``MOST_SUMS``."""
    keys, found = list(figures), {}
    for at in range(0, len(keys), MOST_SUMS):
        some = keys[at : at + MOST_SUMS]
        found |= zip(some, d.agg(*[figures[k].alias(f"__{i}") for i, k in enumerate(some)]).first())
    return found


def co_moments(n: int, centers: Sequence[float]) -> Callable[[Iterator], Iterator]:
    """Sums over a task's rows for every pair of columns, as matrices: one row of each per column.

    Columns are centred first, so that sums of squares lose no digits.  A pair counts the rows that have both: products with
    the 0/1 mask of the other column leave the rest out.
    """

    def step(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        middle = np.array(centers)
        both, sums, squares, products = (np.zeros((n, n)) for _ in range(4))
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
                x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
                x = (x - middle) * there
                both += there.T @ there
                sums += x.T @ there
                squares += (x * x).T @ there
                products += x.T @ x
        if both.any():
            matrices = {"n": both, "x": sums, "y": sums.T, "xx": squares, "yy": squares.T, "xy": products}
            columns = [pa.array(range(n), pa.int32()), *(pa.array(m.tolist(), pa.list_(pa.float64())) for m in matrices.values())]
            yield pa.RecordBatch.from_arrays(columns, ["i", *matrices])

    return step


def wide_correlation(d: DataFrame, cols: Sequence[str], lower: bool = True) -> DataFrame:
    """``corr_matrix`` of hundreds of columns: a task adds up its rows as matrix products, Spark adds up the tasks.

    A task holds a few matrices of columns by columns, however many rows it has.  Pairs without spread or with less than two common rows
    have a null correlation.  This is the only step outside ``llm`` that runs in Python.
    """
    names, n = list(cols), len(cols)
    typed = d.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = typed.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(n)]).first()
    centers = [0.0 if m is None or m != m else m for m in means]
    shape = "i int, " + ", ".join(f"{c} array<double>" for c in ("n", "x", "y", "xx", "yy", "xy"))
    rows = typed.mapInArrow(co_moments(n, centers), shape)
    cells = rows.select("i", F.posexplode(F.arrays_zip("n", "x", "y", "xx", "yy", "xy")).alias("j", "m")).filter("i > j")
    total = cells.groupBy("i", "j").agg(*[F.sum(f"m.{c}").alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    def spread(squares: str, a: str, b: str) -> Column:
        """Sum of products about the means; what is left of rounding counts as none."""
        out = F.col(squares) - F.col(a) * F.col(b) / F.col("n")
        return F.when(F.abs(out) > 1e-14 * F.abs(squares), out).otherwise(F.lit(0.0))

    both = total.filter("n > 0")
    corr = F.when(F.col("n") > 1, F.try_divide(spread("xy", "x", "y"), F.sqrt(spread("xx", "x", "x") * spread("yy", "y", "y"))))
    labels = F.lit(names)
    found = both.select(F.get(labels, F.col("i")).alias("row_col"), F.get(labels, F.col("j")).alias("col_col"), corr.alias("corr"))
    # pairs without a common row
    every = d.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j")).filter("i > j")
    every = every.select(F.get(labels, F.col("i")).alias("row_col"), F.get(labels, F.col("j")).alias("col_col"))
    out = every.join(found, ["row_col", "col_col"], "left")
    if lower:
        return out
    return out.unionByName(out.select(F.col("col_col").alias("row_col"), F.col("row_col").alias("col_col"), "corr"))


def fit_aggregates(x: Column, y: Column) -> Mapping[str, Column]:
    """Least squares of ``y`` on ``x``: n, slope, intercept, r2, std_err of the slope."""
    x, y = x.cast("double"), y.cast("double")
    n = F.count_if(x.isNotNull() & y.isNotNull()).cast("double")
    return _fit(n, F.regr_avgx(y, x), F.regr_avgy(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x))


def weighted_fit(
    d: DataFrame, keys: Sequence[str], x: str, y: str, times: DataFrame, band: tuple[int, float] | None = None
) -> DataFrame:
    """The fit over ``d`` with each row repeated as often as ``times`` holds its key.

    ``times`` is ``(keys…, times)``.  Rows are reduced to moments per key before
    the two meet, so neither a hot key nor the repeats are ever spread out.  With ``band=(points, level)`` the result is
    the fitted line with its band (``fit_band``) at that many evenly spaced places.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = d.filter(a.isNotNull() & b.isNotNull())
    moments = both.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.min(a).alias("least"),
        F.max(a).alias("most"),
        F.avg(a).alias("mx"),
        F.avg(b).alias("my"),
        F.regr_sxx(b, a).alias("sxx"),
        F.regr_syy(b, a).alias("syy"),
        F.regr_sxy(b, a).alias("sxy"),
    )
    groups = moments.join(times, list(keys)).withColumn("w", F.col("n") * F.col("times"))
    # spread within the groups, repeated, to which the spread of their means is added
    whole = groups.select(
        "w",
        "mx",
        "my",
        "least",
        "most",
        *[(F.col(c) * F.col("times")).alias(c) for c in ("sxx", "syy", "sxy")],
    )
    n = F.sum("w")
    mean_x, mean_y = F.try_divide(F.sum(F.col("w") * F.col("mx")), n), F.try_divide(F.sum(F.col("w") * F.col("my")), n)
    sums = {
        "sxx": F.sum(F.col("sxx") + F.col("w") * F.col("mx") * F.col("mx")) - n * mean_x * mean_x,
        "syy": F.sum(F.col("syy") + F.col("w") * F.col("my") * F.col("my")) - n * mean_y * mean_y,
        "sxy": F.sum(F.col("sxy") + F.col("w") * F.col("mx") * F.col("my")) - n * mean_x * mean_y,
    }
    moments = (n, mean_x, mean_y, sums["sxx"], sums["syy"], sums["sxy"])
    if band is None:
        return whole.agg(*[c.alias(name) for name, c in _fit(*moments).items()])
    points, level = band
    one = whole.agg(*[c.alias(name) for name, c in _fit_spread(*moments).items()], F.min("least").alias("least"), F.max("most").alias("most"))
    step = (F.col("most") - F.col("least")) / (points - 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("least") + i * step)
    return fit_band(one, places, level)


def _fit(n: Column, mean_x: Column, mean_y: Column, sxx: Column, syy: Column, sxy: Column) -> Mapping[str, Column]:
    slope = F.try_divide(sxy, sxx)
    r2 = F.try_divide(sxy * sxy, sxx * syy)
    residual = F.greatest(syy - slope * sxy, F.lit(0.0))
    return {
        "n": n.cast("bigint"),
        "slope": slope,
        "intercept": mean_y - slope * mean_x,
        "r2": r2,
        "std_err": F.when(n > 2, F.sqrt(F.try_divide(F.try_divide(residual, n - 2), sxx))),
    }


def _fit_spread(n: Column, mean_x: Column, mean_y: Column, sxx: Column, syy: Column, sxy: Column) -> Mapping[str, Column]:
    """What a band needs beside the fit: the middle and spread of x, and the variance about the line."""
    residual = F.greatest(syy - F.try_divide(sxy, sxx) * sxy, F.lit(0.0))
    variance = F.when(n > 2, F.try_divide(residual, n - 2))
    return {**_fit(n, mean_x, mean_y, sxx, syy, sxy), "mean_x": mean_x, "sxx": sxx, "variance": variance}


def fit_band(fit: DataFrame, places: Column, level: float) -> DataFrame:
    """``(x, predicted, std_err_mean, low, high)``: a fitted line at some x, with the confidence band of its mean.

    ``fit``: one row of ``_fit_spread``; ``places``: an array of x.  With two rows or fewer there is a line and no band.
    """
    t = student_t_quantile((1 + level) / 2, F.col("n") - 2)
    at = fit.withColumn("t", t).select("*", F.explode(places).alias("x"))
    error = F.sqrt(F.col("variance") * (1.0 / F.col("n") + F.try_divide(F.pow(F.col("x") - F.col("mean_x"), F.lit(2)), F.col("sxx"))))
    out = at.select("x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("predicted"), error.alias("std_err_mean"), "t")
    edges = {"low": F.col("predicted") - F.col("t") * F.col("std_err_mean"), "high": F.col("predicted") + F.col("t") * F.col("std_err_mean")}
    return out.withColumns(edges).drop("t")


def linear_fit(
    d: DataFrame,
    x: str,
    y: str,
    where: Column | None = None,
    predict: tuple[int, int] | None = None,
    level: float | None = None,
) -> DataFrame:
    """One row of fit figures, or with ``predict=(first, last)`` a row per whole ``x``.

    ``level`` (0.95, say) adds the confidence band of the mean to the predicted rows.
    """
    if where is not None:
        d = d.filter(where)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    if predict is not None and level is not None:
        n = F.count_if(a.isNotNull() & b.isNotNull()).cast("double")
        moments = (n, F.regr_avgx(b, a), F.regr_avgy(b, a), F.regr_sxx(b, a), F.regr_syy(b, a), F.regr_sxy(b, a))
        one = d.agg(*[c.alias(name) for name, c in _fit_spread(*moments).items()])
        return fit_band(one, F.sequence(F.lit(predict[0]), F.lit(predict[1])), level)
    fit = d.agg(*[c.alias(n) for n, c in fit_aggregates(F.col(x), F.col(y)).items()])
    if predict is None:
        return fit
    first, last = predict
    return fit.select(
        "slope", "intercept", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("x")
    ).select("x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("predicted"))
