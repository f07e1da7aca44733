"""Null-safe arithmetic, rolling windows, ranks and correlations as Column expressions.

One null: NaN and infinities become NULL where data enters, so every function
here may treat NULL as the only missing value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Num = Column | str


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def finite(x: Num) -> Column:
    """x as double, NULL for NaN and infinities."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def number(x: Num) -> Column:
    """Text or number to a finite double, NULL where it can't be parsed."""
    return finite(_c(x).cast("string").try_cast("double"))


def clamp(x: Num, low: float, high: float) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def series(*more: str):
    """Window over one symbol's history."""
    return Window.partitionBy(*more, "symbol").orderBy("timestamp")


def rolling(f: Callable[[Column], Column], x: Num, n: int, least: int, over=None) -> Column:
    """f over the last n rows, NULL with fewer than `least` non-null values of x."""
    w = (series() if over is None else over).rowsBetween(-(n - 1), 0)
    x = _c(x)
    return F.when(F.count(x).over(w) >= least, f(x).over(w))


def doubled_rank(x: Num, *keys: str) -> Column:
    """Twice the 1-based rank of x within keys, ties averaged: a whole number."""
    x = _c(x)
    return (2 * F.rank().over(Window.partitionBy(*keys).orderBy(x)) + F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1).cast("long")


def average_rank(x: Num, *keys: str) -> Column:
    """1-based rank of x within keys, ties averaged."""
    return doubled_rank(x, *keys) / F.lit(2.0)


def correlation(x: Num, y: Num) -> Column:
    """Aggregate: Pearson correlation, NULL under three rows or where a side is constant."""
    x, y = _c(x), _c(y)
    # corr() raises on constant input in ANSI mode, so it is built from its parts.
    r = div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count(F.lit(1)) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), r)


def rank_correlation(a: Num, b: Num) -> Column:
    """Aggregate: correlation of all rows' doubled ranks a and b, NULL under three rows or where a side is constant.

    Sums of whole numbers in decimals, so the order of rows changes no bit, and
    opposite ranks give exactly opposite correlations. Ranks up to about 10^12 rows.
    """
    a, b = (_c(x).cast("decimal(15,0)") for x in (a, b))
    n = F.count(F.lit(1))
    # Doubled ranks sum to n (n + 1), whatever the ties.
    middle = n.cast("decimal(13,0)") * (n + 1).cast("decimal(13,0)") * (n + 1).cast("decimal(13,0)")
    product, left, right = (F.sum(x * y) - middle for x, y in ((a, b), (a, a), (b, b)))
    r = div(product, F.sqrt(left.cast("double")) * F.sqrt(right.cast("double")))
    return F.when((n >= 3) & (left > 0) & (right > 0), r)


def quantile_bucket(rank: Column, n: Column, q: Column) -> Column:
    """0-based bucket of a rank in 1..n for q in 2..5 equal-probability buckets, edges interpolated linearly and closed on the right."""
    out = F.lit(0)
    for k in range(1, 5):
        p = (F.lit(float(k)) / q) * F.lit(100.0) / F.lit(100.0) * (n - 1)
        low = F.floor(p)
        part = p - low
        edge = F.when(part >= 0.5, (low + 2) - (F.lit(1.0) - part)).otherwise(low + 1 + part)
        out = out + F.when((F.lit(k) < q) & (rank > edge), 1).otherwise(0)
    return out


def rounded(df, digits: int = 6, significant: tuple[str, ...] = ()):
    """Doubles of df rounded, so that two engines' results compare; columns of any magnitude as text of 9 significant digits."""

    def one(f):
        c = F.col(f"`{f.name}`")
        if f.name in significant:
            return F.when(c.isNotNull(), F.format_string("%.8e", c + F.lit(0.0))).alias(f.name)
        # Adding 0.0 turns -0.0 into 0.0.
        return (F.round(c, digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else c

    return df.select(*map(one, df.schema))
