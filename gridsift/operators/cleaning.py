"""Cleaning of panels: duplicates, timestamps, impossible values, gaps and outliers.

Work that belongs to a consumer is a window over (consumer, time); a consumer has one row for each
time, so its window is bounded by the length of the panel.  Work over all rows never orders them
in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.functions.calendar import parse_time, with_calendar
from gridsift.functions.quantiles import exact_quantiles
from gridsift.functions.stats import missing_cells
from gridsift.schema import CALENDAR, KEY, TIME, VALUE, numeric_columns

#: Lowest and highest valid value of each column.
VALID = {
    VALUE: (0.0, 1000.0),
    "voltage_v": (0.0, 500.0),
    "current_a": (0.0, 500.0),
    "power_factor": (0.0, 1.1),
    "temperature_c": (-50.0, 60.0),
}
#: The narrower ranges of the older rules.
VALID_NARROW = {
    VALUE: (0.0, 100.0),
    "voltage_v": (200.0, 250.0),
    "current_a": (0.0, 100.0),
    "power_factor": (0.0, 1.0),
    "temperature_c": (-20.0, 50.0),
}
IMPUTATIONS = ("forward_fill", "backward_fill", "mean", "drop")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """``df`` itself; ValueError if a required column is missing."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """One of each set of rows that are equal in all columns, nulls included."""
    return df.dropDuplicates()


def blank_invalid(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Values outside their range, NaN among them, become null; columns that are absent are passed over."""
    present = {c: r for c, r in (ranges or VALID).items() if c in df.columns}
    return df.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in present.items()}) if present else df


def invalid_counts(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row: for each column with a range, how many values lie outside."""
    present = {c: r for c, r in (ranges or VALID).items() if c in df.columns}
    return df.agg(*(F.count_if(F.col(c).isNotNull() & ~F.col(c).between(lo, hi)).alias(c) for c, (lo, hi) in present.items()))


def missing_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.agg(missing_cells(columns or df.columns).alias("missing"))


def _fillable(df: DataFrame, columns: list[str] | None, by: str) -> list[str]:
    return [c for c in (columns or df.columns) if c != by]


def _both_ways(by: list[str], order: list[str]) -> tuple[Window, Window]:
    """Rows of a group up to the current one, in the given order and in its reverse.

    A frame that only grows is kept up row by row; one that ends at the last row would be read
    again for each row.
    """
    upto = lambda keys: Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return upto([F.col(c).asc_nulls_last() for c in order]), upto([F.col(c).desc_nulls_first() for c in order])


def _nearest(c: str, frame: Window) -> Column:
    return F.last(c, ignorenulls=True).over(frame)


def fill(df: DataFrame, columns: list[str] | None = None, *, forward: bool = True, by: str = KEY, order: list[str] | None = None) -> DataFrame:
    """Each null takes the nearest value before it of the same consumer, else the nearest after it.

    ``forward=False`` looks after it first.  ``order`` breaks ties of time.
    """
    before, after = _both_ways([by], order or [TIME])
    first, second = (before, after) if forward else (after, before)
    return df.withColumns({c: F.coalesce(_nearest(c, first), _nearest(c, second)) for c in _fillable(df, columns, by)})


def fill_ungrouped(df: DataFrame, columns: list[str], *, forward: bool = True, time: str = TIME, order: list[str] | None = None) -> DataFrame:
    """``fill`` over the whole table in order of time, for tables without consumers."""
    return _fill_by_day(df, columns, [], order or [time], forward)


def fill_long(df: DataFrame, columns: list[str] | None = None, *, forward: bool = True, by: str = KEY, order: list[str] | None = None) -> DataFrame:
    """``fill`` with the same result, for tables in which one consumer may hold more rows than a task should take.

    All consumers alike are filled day by day, so their days are dealt to tasks.
    """
    return _fill_by_day(df, _fillable(df, columns, by), [by], order or [TIME], forward)


def _fill_by_day(df: DataFrame, columns: list[str], by: list[str], order: list[str], forward: bool) -> DataFrame:
    """Days are filled on their own; what a day takes from its neighbours comes from a table with a row for each day
    (of each consumer).  Rows without time are the last day.
    """
    time = F.col(order[0]).cast("timestamp_ntz")
    rows = df.withColumn("_day", F.coalesce(F.date_trunc("day", time).cast("date"), F.lit("9999-12-31").cast("date")))
    before, after = _both_ways([*by, "_day"], order)
    rank = F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in order))
    ends = rows.groupBy(*by, "_day").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_last_{c}") for c in columns),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_first_{c}") for c in columns),
    )
    carried = _carried(ends, columns, by)
    same = F.lit(True)
    for k in [*by, "_day"]:
        same = same & rows[k].eqNullSafe(carried[f"_of_{k}"])
    out = rows.join(carried, same)
    filled = {}
    for c in columns:
        back = F.coalesce(_nearest(c, before), F.col(f"_before_{c}"))
        ahead = F.coalesce(_nearest(c, after), F.col(f"_after_{c}"))
        filled[c] = F.coalesce(back, ahead) if forward else F.coalesce(ahead, back)
    return out.withColumns(filled).select(*(f"`{c}`" for c in df.columns))


def _carried(ends: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """For each day the last values before it and the first ones after it.

    A scan in two steps: days within their year, and years among themselves, so a window holds the days of a year
    or the years of a consumer.
    """
    earlier, later = (lambda w: w.rowsBetween(Window.unboundedPreceding, -1)), (lambda w: w.rowsBetween(1, Window.unboundedFollowing))
    days = ends.withColumn("_year", F.year("_day"))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_day"))
    years = days.groupBy(*by, "_year").agg(
        *(F.max_by(f"_last_{c}", known(f"_last_{c}")).alias(f"_last_{c}") for c in columns),
        *(F.min_by(f"_first_{c}", known(f"_first_{c}")).alias(f"_first_{c}") for c in columns),
    )
    among = Window.partitionBy(*by).orderBy("_year")
    years = years.select(
        *(F.col(k).alias(f"_of_{k}") for k in by), F.col("_year").alias("_of_year"),
        *(F.last(f"_last_{c}", ignorenulls=True).over(earlier(among)).alias(f"_y_before_{c}") for c in columns),
        *(F.first(f"_first_{c}", ignorenulls=True).over(later(among)).alias(f"_y_after_{c}") for c in columns),
    )
    within = Window.partitionBy(*by, "_year").orderBy("_day")
    own = days.select(
        *by, "_day", "_year",
        *(F.last(f"_last_{c}", ignorenulls=True).over(earlier(within)).alias(f"_d_before_{c}") for c in columns),
        *(F.first(f"_first_{c}", ignorenulls=True).over(later(within)).alias(f"_d_after_{c}") for c in columns),
    )
    same = own["_year"] == years["_of_year"]
    for k in by:
        same = same & own[k].eqNullSafe(years[f"_of_{k}"])
    return own.join(years, same).select(
        *(own[k].alias(f"_of_{k}") for k in [*by, "_day"]),
        *(F.coalesce(f"_d_{way}_{c}", f"_y_{way}_{c}").alias(f"_{way}_{c}") for c in columns for way in ("before", "after")),
    )


def fill_mean(df: DataFrame, columns: list[str] | None = None, *, by: str = KEY) -> DataFrame:
    """Nulls of numeric columns take their consumer's mean, else the mean of all rows filled so."""
    columns = [c for c in numeric_columns(df, without=(by,)) if columns is None or c in columns]
    if not columns:
        return df
    means = df.groupBy(by).agg(*(F.avg(c).alias(f"_mean_{c}") for c in columns), *(F.sum(c).alias(f"_sum_{c}") for c in columns), *(F.count(c).alias(f"_n_{c}") for c in columns), F.count(F.lit(1)).alias("_rows"))
    # A consumer with values counts with all its rows at its mean where they were null.
    whole = means.agg(
        *(F.try_divide(F.sum(F.col(f"_sum_{c}") + (F.col("_rows") - F.col(f"_n_{c}")) * F.col(f"_mean_{c}")), F.sum(F.when(F.col(f"_n_{c}") > 0, F.col("_rows")))).alias(f"_all_{c}") for c in columns)
    ).first()
    own = means.select(F.col(by).alias("_by"), *(f"_mean_{c}" for c in columns))
    joined = df.join(own, df[by].eqNullSafe(own["_by"]), "left")
    return joined.withColumns({c: F.coalesce(c, f"_mean_{c}", F.lit(whole[f"_all_{c}"])) for c in columns}).select(*df.columns)


def impute(df: DataFrame, method: str = "forward_fill", columns: list[str] | None = None, *, by: str | None = KEY, order: list[str] | None = None, long_groups: bool = False) -> DataFrame:
    """Fill or drop nulls by one of ``IMPUTATIONS``; ``by=None`` fills over the whole table, ``long_groups`` fills day by day."""
    if method not in IMPUTATIONS:
        raise ValueError(f"unknown imputation: {method}")
    if method == "drop":
        return df.na.drop("any", subset=columns)
    if method == "mean":
        return fill_mean(df, columns, by=by or KEY) if by else _fill_whole_mean(df, columns)
    forward = method == "forward_fill"
    if by is None:
        return fill_ungrouped(df, [c for c in (columns or df.columns) if c != TIME], forward=forward, order=order)
    return (fill_long if long_groups else fill)(df, columns, forward=forward, by=by, order=order)


def _fill_whole_mean(df: DataFrame, columns: list[str] | None) -> DataFrame:
    columns = columns or numeric_columns(df)
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in columns})


@dataclass(frozen=True)
class Outliers:
    """What counts as an outlier of a column: strictly outside [low, high], or a z-score above the threshold."""

    column: str
    method: str
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None
    threshold: float | None = None

    @property
    def flag(self) -> Column:
        c = F.col(self.column)
        if self.method == "iqr":
            test = (c < self.low) | (c > self.high) if self.low is not None else F.lit(False)
        else:
            test = F.abs(c - self.mean) / self.std > self.threshold if self.std else F.lit(False)
        return F.coalesce(test, F.lit(False))


def find_outliers(df: DataFrame, column: str = VALUE, method: str = "iqr", threshold: float = 5.0) -> Outliers:
    """Bounds from exact quartiles, or mean and deviation, of all rows."""
    if method == "iqr":
        rows = {r["probability"]: r["value"] for r in exact_quantiles(df, [column], [0.25, 0.75]).collect()}
        if not rows:
            return Outliers(column, method)
        q1, q3 = rows[0.25], rows[0.75]
        return Outliers(column, method, low=q1 - threshold * (q3 - q1), high=q3 + threshold * (q3 - q1))
    if method == "zscore":
        row = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).first()
        return Outliers(column, method, mean=row["mean"], std=row["std"], threshold=threshold)
    raise ValueError(f"unknown outlier method: {method}")


def without_outliers(df: DataFrame, column: str = VALUE, method: str = "iqr", threshold: float = 5.0) -> DataFrame:
    return df.where(~find_outliers(df, column, method, threshold).flag)


def flag_outliers(df: DataFrame, column: str = VALUE, method: str = "iqr", threshold: float = 5.0) -> DataFrame:
    """Adds the boolean ``is_outlier``."""
    return df.withColumn("is_outlier", find_outliers(df, column, method, threshold).flag)


def clean(
    df: DataFrame,
    *,
    required: list[str] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    imputation: str = "forward_fill",
    remove_outliers: bool = False,
    threshold: float = 5.0,
    order: list[str] | None = None,
    long_consumers: bool = False,
) -> DataFrame:
    """Duplicates, times, calendar, ranges, gaps and, if asked for, outliers, in that order.

    Rows are dealt by consumer once, before duplicates are looked for; everything up to the
    consumer's features uses that partitioning.  With ``long_consumers`` no task has to hold a consumer: duplicates are
    looked for by whole rows, and gaps filled day by day.
    """
    rows = require_columns(df, required or [])
    rows = rows.repartition(KEY) if KEY in rows.columns and not long_consumers else rows
    rows = with_calendar(parse_time(drop_repeated_rows(rows)))
    rows = blank_invalid(rows, ranges)
    if imputation == "drop":
        rows = impute(rows, "drop")
    else:
        rows = impute(rows, imputation, [c for c in rows.columns if c != KEY and c not in CALENDAR], by=KEY if KEY in rows.columns else None, order=order, long_groups=long_consumers)
        if imputation != "mean" and TIME in rows.columns:  # a time that was filled gives the calendar, but for is_weekend
            rows = with_calendar(rows.withColumn("_weekend", F.col("is_weekend"))).withColumn("is_weekend", F.col("_weekend")).drop("_weekend")
    return without_outliers(rows, threshold=threshold) if remove_outliers else rows
