"""Column expressions for windows, caliper tests and reconstructed p-values."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill import fixed


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def side(x: Column, center: float, delta: float) -> Column:
    """-1 in [center - delta, center], 1 in (center, center + delta], else 0 (also for null and NaN).

    The bounds are what double arithmetic makes of center and delta: 0.045 is not in 0.05 +- 0.005.
    """
    low, high = center - delta, center + delta
    return F.when(_known(x) & (x >= low) & (x <= center), -1).when(_known(x) & (x > center) & (x <= high), 1).otherwise(0)


def bin_side(x: Column, low: float, mid: float, high: float) -> Column:
    """As ``side``, with bounds as given."""
    return F.when(_known(x) & (x >= low) & (x <= mid), -1).when(_known(x) & (x > mid) & (x <= high), 1).otherwise(0)


def side_counts(sides: Column) -> Column:
    """Struct of left, right and total counts of a column of sides (an aggregate)."""
    return F.struct(F.count_if(sides == -1).alias("left"), F.count_if(sides == 1).alias("right"), F.count_if(sides != 0).alias("total"))


def array_side_counts(values: Column, low: float, mid: float, high: float) -> Column:
    """Struct of left, right and total of an array of values in a window given by its bounds."""
    left = F.size(F.filter(values, lambda v: (v >= low) & (v <= mid)))
    right = F.size(F.filter(values, lambda v: (v > mid) & (v <= high)))
    return F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"), (left + right).cast("long").alias("total"))


def caliper_z(left: Column, right: Column, direction: str = "left") -> Column:
    """(left - right) / sqrt(n), or its negative for direction "right"; 0 without counts."""
    n = left + right
    gap = right - left if direction == "right" else left - right
    return F.when(n <= 0, F.lit(0.0)).otherwise(gap / F.sqrt(n.cast("double")))


def normalized_ratio(left: Column, right: Column) -> Column:
    """(left - right) / total, 0 without counts."""
    n = left + right
    return F.when(n <= 0, F.lit(0.0)).otherwise((left - right) / F.greatest(n, F.lit(1)))


def _fraction(x: Column, over: tuple[float, ...], under: tuple[float, ...]) -> Column:
    """A fraction of two polynomials, each from the highest power down."""
    top, bottom = (functools.reduce(lambda sum_, c: sum_ * x + c, coefficients[1:], F.lit(coefficients[0])) for coefficients in (over, under))
    return top / bottom


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, in doubles: rational approximations in three ranges."""

    def parts(z: Column) -> Column:
        square = z * z
        near = 1 - z * _fraction(square, *fixed.ERF_NEAR)
        middle = F.exp(-square) * _fraction(z, *fixed.ERF_MIDDLE)
        inverse = 1 / square
        far = F.exp(-square) / z * (1 / math.sqrt(math.pi) - inverse * _fraction(inverse, *fixed.ERF_FAR))
        return F.when(z <= 0.46875, near).when(z <= 4, middle).otherwise(far)

    return F.get(F.transform(F.array(x), parts), F.lit(0))  # x is worked out once


def p_of_t(abs_t: Column) -> Column:
    """Two-sided normal p-value."""
    return erfc(abs_t / math.sqrt(2))


def p_at_most(abs_t: Column, p: float) -> Column:
    """p(abs_t) <= p, as a bound on abs_t (p falls as abs_t grows)."""
    return abs_t >= fixed.Z_OF_P[p]


def p_side(abs_t: Column, center: float, delta: float) -> Column:
    """The side of p(abs_t) in the window center +- delta, as bounds on abs_t."""
    z = fixed.Z_OF_P
    low, high = round(center - delta, 3), round(center + delta, 3)
    return F.when(_known(abs_t) & (abs_t >= z[center]) & (abs_t <= z[low]), -1).when(_known(abs_t) & (abs_t < z[center]) & (abs_t >= z[high]), 1).otherwise(0)


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided p of k of n at one half; beyond n = 400 the normal form; null for n <= 0 or k outside 0..n."""
    k, n = k.cast("int"), n.cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), F.least(k, n - k)),
        F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("pmf"), F.lit(0.0).alias("cdf")),
        lambda a, x: F.struct((a["pmf"] * (n - x) / (x + 1)).alias("pmf"), (a["cdf"] + a["pmf"]).alias("cdf")),
        lambda a: a["cdf"],
    )
    exact = F.when(2 * k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
    normal = erfc(F.abs(2 * k - n) / F.sqrt(n.cast("double")) / math.sqrt(2))
    return F.when((n > 0) & (k >= 0) & (k <= n), F.when(n > fixed.EXACT_N, normal).otherwise(exact))


def cap01(x: Column) -> Column:
    """x kept within 0 and 1; null and NaN are 0."""
    return F.when(_known(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))).otherwise(F.lit(0.0))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two spans share."""
    return F.greatest(F.lit(0.0), F.least(F.greatest(a0, a1), F.greatest(b0, b1)) - F.greatest(F.least(a0, a1), F.least(b0, b1)))


def risk_level(score: Column, levels: tuple[int, int] = fixed.LEVELS) -> Column:
    """High, Moderate or Low; a null score is 0."""
    s = F.coalesce(score, F.lit(0))
    return F.when(s >= levels[0], "High").when(s >= levels[1], "Moderate").otherwise("Low")


def year_like(x: Column) -> Column:
    """Whether x, rounded half to even, is in 1800..2100."""
    return F.coalesce(F.bround(x).between(1800, 2100), F.lit(False))


def small_int_like(x: Column, most: int = 30, tol: float = 1e-9) -> Column:
    """Whether x is a whole number, but for tol, of size 1..most."""
    return F.coalesce(_known(x) & (F.abs(x) >= tol) & (F.abs(x - F.bround(x)) <= tol) & F.abs(F.bround(x)).between(1, most), F.lit(False))


def exactly_two(abs_t: Column) -> Column:
    return F.abs(abs_t - 2.0) < 1e-9


def valid_p(p: Column) -> Column:
    return F.coalesce(_known(p) & p.between(0.0, 1.0), F.lit(False))


def retry_delay(attempt: int, jitter: float = 0.0) -> float:
    """Seconds before a further attempt (driver side)."""
    return min(20.0, 2.0 ** (attempt - 1)) + jitter
