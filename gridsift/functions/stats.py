"""Column expressions for statistics whose definition differs from Spark's built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN as null: comparisons with NaN are true in Spark."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def skewness_g1(c: Column | str) -> Column:
    """Bias-corrected skewness: null under three values, 0 where all are equal."""
    c = _col(c)
    n = F.count(c).cast("double")
    g1 = F.coalesce(finite(F.skewness(c)), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_g2(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis: null under four values, 0 where all are equal."""
    c = _col(c)
    n = F.count(c).cast("double")
    g2 = finite(F.kurtosis(c))
    corrected = ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def mean_where(c: Column | str, condition: Column) -> Column:
    return F.avg(F.when(condition, _col(c)))


def bin_of(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Number, from 1, of the equal-width bin of [low, high]; the last bin is closed."""
    place = F.floor(F.try_divide((c - low) * bins, high - low)).cast("int") + 1
    return F.when(c.isNotNull(), F.greatest(F.lit(1), F.least(F.coalesce(place, F.lit(1)), F.lit(bins))))


def missing_cells(columns: list[str]) -> Column:
    """Aggregate: nulls in all the columns."""
    return sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).cast("long")
