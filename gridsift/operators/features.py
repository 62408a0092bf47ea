"""Features of consumers: shape of the day, periods, weekends, variability and scale.

All features of a consumer come from a single aggregation, so a panel is shuffled once, and with
partial sums before it.  Only the median has to see a consumer's values together; it is left out
unless scale features are asked for.  Where a consumer may have more values than a task can hold,
``spread_medians`` takes the medians from ``exact_quantiles``, which never gathers a consumer's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.functions.quantiles import exact_quantiles
from gridsift.functions.stats import kurtosis_g2, mean_where, ratio, skewness_g1
from gridsift.schema import BEHAVIORAL, KEY, MEASURES, PERIODS, SCALE, SHAPE, VALUE, numeric_columns

FEATURE_SETS = ("behavioral", "scale", "combined")


def hourly_means(panel: DataFrame) -> DataFrame:
    """(consumer_id, hour, mean_kwh, share): the share of the sum of a consumer's hourly means."""
    from pyspark.sql import Window

    means = panel.where(f"{KEY} IS NOT NULL AND hour IS NOT NULL").groupBy(KEY, "hour").agg(F.avg(VALUE).alias("mean_kwh"))
    total = F.sum("mean_kwh").over(Window.partitionBy(KEY))
    return means.withColumn("share", ratio(F.col("mean_kwh"), total))


def _sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))


def behavioral_aggregates() -> dict[str, Column]:
    """Aggregates from which ``behavioral_columns`` derives the features."""
    hour, value = F.col("hour"), F.col(VALUE)
    out = {f"_h{h}": mean_where(VALUE, hour == h) for h in range(24)}
    out |= {f"{p}_usage": mean_where(VALUE, (hour >= a) & (hour < b)) for p, (a, b) in PERIODS.items()}
    mean = F.avg(value)
    out["weekend_ratio"] = ratio(mean_where(VALUE, F.col("is_weekend")), mean_where(VALUE, ~F.col("is_weekend")))
    out["peak_to_avg_ratio"] = F.when(mean > 0, F.max(value) / mean)
    out["coefficient_of_variation"] = F.when(mean > 0, F.stddev_samp(value) / mean)
    out["skewness"] = skewness_g1(VALUE)
    out["kurtosis"] = kurtosis_g2(VALUE)
    return out


def behavioral_columns() -> dict[str, Column]:
    """Features by name, over a row with ``behavioral_aggregates``."""
    means = [F.col(f"_h{h}") for h in range(24)]
    total = _sum_of(means)
    shape = {name: ratio(m, total) for name, m in zip(SHAPE, means, strict=True)}
    return shape | {c: F.col(c) for c in BEHAVIORAL if c not in shape}


def scale_aggregates(columns: list[str], *, total: bool = True, median: bool = True) -> dict[str, Column]:
    """Mean, max, min, median, std and sum of the consumption; means of the measures that are present.

    ``total=False`` leaves the sum out, as the older scale set does.
    """
    value = F.col(VALUE)
    kinds = {"mean": F.avg, "max": F.max, "min": F.min, **({"median": F.median} if median else {}), "std": F.stddev_samp, **({"sum": F.sum} if total else {})}
    out = {f"{VALUE}_{name}": f(value) for name, f in kinds.items()}
    return out | {f"{m}_mean": F.avg(m) for m in MEASURES if m in columns}


def consumer_medians(panel: DataFrame) -> DataFrame:
    """(consumer_id, median) of the consumption, exact, with no consumer's values in one task."""
    found = exact_quantiles(panel.where(F.col(KEY).isNotNull()), [VALUE], [0.5], [KEY])
    return found.select(KEY, F.col("value").alias(f"{VALUE}_median"))


def raw_features(panel: DataFrame, feature_set: str = "combined", *, total: bool = True, spread_medians: bool = False) -> DataFrame:
    """One row for each consumer with its features as they are, nulls included."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set: {feature_set}")
    behavior = behavioral_aggregates() if feature_set != "scale" else {}
    scale = scale_aggregates(panel.columns, total=total, median=not spread_medians) if feature_set != "behavioral" else {}
    rows = panel.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(*(c.alias(n) for n, c in (behavior | scale).items()))
    named = behavioral_columns() if behavior else {}
    found = rows.select(KEY, *(c.alias(n) for n, c in named.items()), *scale)
    if not (scale and spread_medians):
        return found
    names = [*named, *scale_aggregates(panel.columns, total=total)]
    return found.join(consumer_medians(panel), KEY, "left").select(KEY, *names)


def varying_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns with at least two different values, nulls apart; one row of extremes is read."""
    columns = columns or numeric_columns(df)
    row = df.agg(*((F.min(c) < F.max(c)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def consumer_features(panel: DataFrame, feature_set: str = "behavioral") -> DataFrame:
    """Features without constant columns, nulls as 0."""
    raw = raw_features(panel, feature_set)
    return raw.select(KEY, *varying_columns(raw)).na.fill(0.0)


def select_features(features: DataFrame, feature_set: str = "behavioral", exclude: tuple[str, ...] = ()) -> DataFrame:
    """The key and the columns of a feature set that are present."""
    if feature_set == "behavioral":
        names = [c for c in BEHAVIORAL if c in features.columns]
    elif feature_set == "scale":
        names = [c for c in SCALE if c in features.columns]
    else:
        names = [c for c in features.columns if c != KEY]
    return features.select(*([KEY] if KEY in features.columns else []), *(c for c in names if c not in exclude))


def weekend_share(panel: DataFrame) -> DataFrame:
    """The older meaning of the weekend ratio: share of a consumer's rows that fall on weekends."""
    return panel.groupBy(KEY).agg(F.avg(F.col("is_weekend").cast("double")).alias("weekend_share"))
