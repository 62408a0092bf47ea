"""Descriptive tables of a panel or of features: what a report or a plot shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.functions.quantiles import FEW, exact_quantiles
from gridsift.functions.stats import bin_of, kurtosis_g2, ratio, skewness_g1
from gridsift.operators import matrices
from gridsift.operators.scaling import pair_table
from gridsift.schema import ARCHETYPE, KEY, TIME, VALUE, numeric_columns

BINS = 30


def hourly_profile(panel: DataFrame) -> DataFrame:
    """Mean consumption of all consumers at each hour."""
    return panel.where("hour IS NOT NULL").groupBy("hour").agg(F.avg(VALUE).alias("mean_kwh"))


def weekend_profile(panel: DataFrame) -> DataFrame:
    return panel.groupBy("is_weekend").agg(F.avg(VALUE).alias("mean_kwh"))


def consumer_variability(panel: DataFrame) -> DataFrame:
    """Mean, standard deviation and coefficient of variation of each consumer."""
    mean, std = F.avg(VALUE), F.stddev_samp(VALUE)
    return panel.where(f"{KEY} IS NOT NULL").groupBy(KEY).agg(mean.alias("mean_kwh"), std.alias("std_kwh"), ratio(std, mean).alias("cv"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each numeric column: mean, std, min, quartiles, max, skewness, kurtosis.

    Moments come from one aggregation, quartiles from ``exact_quantiles``.
    """
    columns = columns or numeric_columns(df)
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "skewness": skewness_g1, "kurtosis": kurtosis_g2}
    wide = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}:{k}") for c in columns for k, f in kinds.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}:{k}`").alias(k) for k in kinds)) for c in columns))
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    spread = quartiles.groupBy("column").agg(*(F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))))
    return wide.select(F.inline(rows)).join(F.broadcast(spread), "column", "left").select(
        "column", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair a < b by position: Pearson's r over rows where both are known; null where a column is constant.

    Sums of products come from masked matrix products, a task's rows at a time.
    """
    columns = columns or numeric_columns(df)
    return pair_table(df, columns, matrices.pairwise(df, columns)[1], "r", 1)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n) of equal-width bins from minimum to maximum; bins without rows are left out."""
    row = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    lo, hi = F.lit(row["lo"]).cast("double"), F.lit(row["hi"]).cast("double")
    counted = df.where(F.col(column).isNotNull()).groupBy(bin_of(F.col(column).cast("double"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return counted.select("bin", (lo + (F.col("bin") - 1) * width).alias("low"), (lo + F.col("bin") * width).alias("high"), "n")


def box_statistics(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles of each group, whiskers at the last values within 1.5 quartile ranges, outliers beyond.

    Groups may be many: their quartiles are broadcast only where they are few.
    """
    q = exact_quantiles(df.where(F.col(by).isNotNull()), [column], [0.25, 0.5, 0.75], [by])
    spread = q.groupBy(by).agg(*(F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))))
    few = spread.limit(FEW + 1).count() <= FEW
    joined = df.where(F.col(column).isNotNull()).join(F.broadcast(spread) if few else spread, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    rows = joined.groupBy(F.struct(by, "q1", "q2", "q3").alias("key")).agg(
        F.min(F.when(inside, F.col(column))).alias("low_whisker"),
        F.max(F.when(inside, F.col(column))).alias("high_whisker"),
        F.count_if(~inside).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return rows.select("key.*", "low_whisker", "high_whisker", "outliers", "n")


def explore(panel: DataFrame, first: int = 6) -> dict[str, DataFrame]:
    """The tables of the exploratory report; histograms of the first numeric columns."""
    columns = numeric_columns(panel)
    return {
        "describe": describe(panel, columns),
        "hourly": hourly_profile(panel),
        "weekend": weekend_profile(panel),
        "correlations": correlations(panel, columns),
        "variability": consumer_variability(panel),
        **{f"histogram_{c}": histogram(panel, c) for c in columns[:first]},
        **{f"box_{by}": box_statistics(panel, VALUE, by) for by in ("hour", "day_of_week", "is_weekend")},
    }


def overview(panel: DataFrame) -> DataFrame:
    """One row: consumers, rows, first and last time, missing values of the consumption."""
    return panel.agg(
        F.count_distinct(KEY).alias("consumers"),
        F.count(F.lit(1)).alias("rows"),
        F.min(TIME).alias("first_time"),
        F.max(TIME).alias("last_time"),
        F.count_if(F.col(VALUE).isNull()).alias("missing"),
    )


def archetype_statistics(panel: DataFrame) -> DataFrame:
    """Means and deviations, over the consumers of an archetype, of their own statistics."""
    mean, std = F.avg(VALUE), F.stddev_samp(VALUE)
    own = panel.groupBy(KEY, ARCHETYPE).agg(mean.alias("mean"), ratio(std, mean).alias("cv"), F.max(VALUE).alias("max"), F.min(VALUE).alias("min"))
    return own.where(f"{ARCHETYPE} IS NOT NULL").groupBy(ARCHETYPE).agg(
        F.avg("mean").alias("avg_mean"),
        F.stddev_samp("mean").alias("std_mean"),
        F.avg("cv").alias("avg_cv"),
        F.stddev_samp("cv").alias("std_cv"),
        F.avg("max").alias("avg_max"),
        F.avg("min").alias("avg_min"),
    )


def archetype_profile(panel: DataFrame, *by: str) -> DataFrame:
    """Mean consumption by archetype, hour and whatever else (``consumer_id`` for variation within)."""
    return panel.where(f"{ARCHETYPE} IS NOT NULL AND hour IS NOT NULL").groupBy(*by, ARCHETYPE, "hour").agg(F.avg(VALUE).alias("mean_kwh"))


def first_consumers(panel: DataFrame, n: int = 10) -> DataFrame:
    """The n smallest consumer ids of each archetype: the sample that a plot of variation shows."""
    own = panel.where(f"{KEY} IS NOT NULL").select(KEY, ARCHETYPE).distinct()
    order = Window.partitionBy(ARCHETYPE).orderBy(KEY)
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def attach_archetype(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Adds each consumer's archetype; a consumer without one is left out."""
    return df.join(panel.where(f"{ARCHETYPE} IS NOT NULL").select(KEY, ARCHETYPE).distinct(), KEY)


def attach_archetype_by_time(df: DataFrame, panel: DataFrame) -> DataFrame:
    """Adds the archetype by consumer and time; rows without a match keep null, and those with several archetypes come once for each."""
    return df.join(panel.select(KEY, TIME, ARCHETYPE).distinct(), [KEY, TIME], "left")


def validate(panel: DataFrame) -> dict[str, DataFrame]:
    """The tables of the report that checks a generated panel; consumers are counted once each."""
    counts = panel.groupBy(ARCHETYPE).agg(F.count_distinct(KEY).alias("consumers"), F.count(F.lit(1)).alias("rows"))
    hourly = panel if "hour" in panel.columns else panel.withColumn("hour", F.hour(TIME))
    return {
        "overview": overview(panel),
        "consumers": counts,
        "statistics": archetype_statistics(panel),
        "profiles": archetype_profile(hourly),
        "variation": archetype_profile(hourly.join(first_consumers(panel).select(KEY), KEY, "left_semi"), KEY),
    }
