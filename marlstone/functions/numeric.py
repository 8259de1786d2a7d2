"""Column functions for numbers: missing values, ranks, regression sums, rounding, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x where it is a finite number, else null: null, NaN and infinities are all missing."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def parse_number(x: Column) -> Column:
    """A number from text with thousand separators, percent signs and blanks; anything else is missing."""
    return finite(F.regexp_replace(F.trim(x), "[,%]", "").try_cast("double"))


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1 within by, ties sharing the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0


def rank_bin(value: Column, tie: Column, by: list[str], bins: int) -> Column:
    """Equal-count bin from 0: place * bins div count, ties by the tie key; not ntile, which fills the first bins."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) - 1
    return F.least(F.lit(bins - 1), F.floor(place * bins / F.count("*").over(Window.partitionBy(*by)))).cast("int")


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate: correlation, null for a constant side (corr raises there)."""
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), True) if isinstance(x, str) and isinstance(y, str) else F.lit(True)
    px, py = (F.when(both, F.col(c) if isinstance(c, str) else c) for c in (x, y))
    return F.try_divide(F.covar_pop(px, py), F.sqrt(F.var_pop(px)) * F.sqrt(F.var_pop(py)))


def slope(y: Column, x: Column) -> Column:
    """Aggregate: regression slope of y on x, null for a constant x."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(x))


def full_window(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """A rolling aggregate that is missing unless all n values of the window are there."""
    return F.when(F.count(x).over(w) == n, agg.over(w))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to 1.2e-7 (rational Chebyshev fit; its ten coefficients are fixed values)."""
    t = 1 / (1 + x / 2)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    return t * F.exp(-x * x + poly)


def normal_cdf(x: Column) -> Column:
    tail = erfc(F.abs(x) / 2**0.5) / 2
    return F.when(x < 0, tail).otherwise(1 - tail)


def age_weight(at: Column, as_of: Column, half_life: float = 30.0, floor: float = 0.05) -> Column:
    """Exponential decay by age in days with a floor; an unreadable time weighs 1, a future one too."""
    days = F.greatest((F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))) / 86_400_000.0, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(floor), F.pow(F.lit(0.5), days / half_life)), F.lit(1.0))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) of the Wilson interval; null without cases."""
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))
