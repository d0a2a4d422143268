"""Student's t as column expressions, evaluated to double precision.

The regularised incomplete beta function is a continued fraction, run as a fold of a fixed number of steps; a quantile
is found by Newton's method from the Cornish-Fisher expansion.  These run once per fitted line, not per row.  From ``LARGE``
degrees of freedom on the expansion itself is exact to 12 digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, functions as F

#: Lanczos coefficients for g = 7; fixed values
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
FRACTION_STEPS = 160
NEWTON_STEPS = 6
LARGE = 1000.0


def _bound(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` with the values worked out once."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(n) for n, v in values.items()])), use)[0]


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 0.5."""
    y = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + float(i))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""

    def away(v: Column) -> Column:
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(state: Column, term: Column) -> Column:
        d = 1.0 / away(1.0 + term * state["d"])
        c = away(1.0 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    def step(state: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return _bound({"odd": odd, **{n: half(state, even)[n] for n in "cdh"}}, lambda s: half(s, s["odd"]))

    first = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised I_x(a, b) for 0 <= x <= 1 and a, b >= 0.5."""

    def side(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(v["rest"]))
        return scale * _fraction(x, a, b) / a

    # the fraction converges fast on the side of the mean where x is; the other side is its complement
    low = x < (a + 1.0) / (a + b + 2.0)
    near = {"x": F.when(low, x).otherwise(1.0 - x), "rest": F.when(low, 1.0 - x).otherwise(x)}
    near |= {"a": F.when(low, a).otherwise(b), "b": F.when(low, b).otherwise(a)}
    found = _bound(near, side)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(low, found).otherwise(1.0 - found)


def student_t_tail(t: Column, df: Column) -> Column:
    """Probability of a value above ``t`` >= 0."""
    return 0.5 * incomplete_beta(df / (df + t * t), df / 2.0, F.lit(0.5))


def _density(t: Column, df: Column) -> Column:
    scale = log_gamma((df + 1.0) / 2.0) - log_gamma(df / 2.0) - 0.5 * F.log(df * math.pi)
    return F.exp(scale - (df + 1.0) / 2.0 * F.log(1.0 + t * t / df))


def _expansion(z: float, df: Column) -> Column:
    """Cornish-Fisher terms to the fourth order in 1 / df."""
    terms = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    out = F.lit(0.0)
    for term in reversed(terms):
        out = out / df + float(term)
    return out


def student_t_quantile(p: float, df: Column) -> Column:
    """The value that a share ``p`` (0.5 to below 1) lies below; NULL without a degree of freedom."""
    if not 0.5 <= p < 1:
        raise ValueError("p must be from 0.5 to below 1")
    df = df.cast("double")

    def step(t: Column, _: Column) -> Column:
        return t + (student_t_tail(t, df) - (1.0 - p)) / _density(t, df)

    expanded = _expansion(NormalDist().inv_cdf(p), df)
    newton = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), expanded, step)
    one = F.lit(math.tan(math.pi * (p - 0.5)))
    two = F.lit((2 * p - 1) * math.sqrt(2 / (4 * p * (1 - p))))
    return F.when(df >= LARGE, expanded).when(df >= 3, newton).when(df == 2, two).when(df == 1, one)
