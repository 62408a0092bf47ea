"""Column names and types of a panel: one row for each consumer and time."""

from __future__ import annotations

from pyspark.sql import types as T

KEY, TIME, VALUE = "consumer_id", "timestamp", "energy_consumption_kwh"
ARCHETYPE = "archetype"
#: Measurements besides the consumption, in the order of the panel.
MEASURES = ["voltage_v", "current_a", "power_factor", "temperature_c"]
CALENDAR = ["hour", "day_of_week", "is_weekend", "month"]

PANEL = T.StructType(
    [
        T.StructField(KEY, T.LongType(), False),
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField(VALUE, T.DoubleType()),
        *(T.StructField(name, T.DoubleType()) for name in MEASURES),
        T.StructField(ARCHETYPE, T.StringType()),
    ]
)

SHAPE = [f"hour_{h}_shape" for h in range(24)]
#: First hour and first hour after each period of the day.
PERIODS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24), "night": (0, 6)}
PERIOD_USAGE = [f"{p}_usage" for p in PERIODS]
VARIABILITY = ["peak_to_avg_ratio", "coefficient_of_variation", "skewness", "kurtosis"]
BEHAVIORAL = [*SHAPE, *PERIOD_USAGE, "weekend_ratio", *VARIABILITY]
SCALE = [f"{VALUE}_{s}" for s in ("mean", "max", "min", "median", "std", "sum")] + [f"{m}_mean" for m in MEASURES]


def numeric_columns(df, *, without: tuple[str, ...] = (KEY,)) -> list[str]:
    """Names of the numeric columns of ``df``; identifiers are left out."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]
