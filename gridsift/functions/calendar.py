"""Calendar columns of a naive timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.schema import TIME


def is_weekend(time: Column) -> Column:
    """Saturday or Sunday; false for a null time."""
    return F.coalesce(F.weekday(time) >= 5, F.lit(False))


def with_calendar(df: DataFrame, time: str = TIME) -> DataFrame:
    """Adds hour, day_of_week (Monday is 0), is_weekend and month; without a time column, nothing."""
    if time not in df.columns:
        return df
    t = F.col(time)
    return df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "is_weekend": is_weekend(t), "month": F.month(t)})


def parse_time(df: DataFrame, time: str = TIME) -> DataFrame:
    """Casts text to a naive timestamp; what cannot be read becomes null."""
    if time not in df.columns or dict(df.dtypes)[time] in ("timestamp_ntz", "timestamp"):
        return df
    return df.withColumn(time, F.col(time).cast("string").try_cast("timestamp_ntz"))
