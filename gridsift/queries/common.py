"""What the registered queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.functions.calendar import with_calendar
from gridsift.schema import ARCHETYPE, PERIODS, SCALE, VALUE
from gridsift.sources.tables import events_panel

#: The panel made of ``events``, with calendar columns.
PANEL = f"""panel AS (
  SELECT event_id, user_id AS consumer_id, ts AS timestamp, value AS {VALUE}, event_type AS archetype,
    CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    coalesce(isodow(ts) >= 6, false) AS is_weekend, CAST(month(ts) AS INTEGER) AS month
  FROM events)"""
#: The same with every tenth value missing, by event_id.
GAPPY = f"gappy AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN NULL ELSE {VALUE} END AS {VALUE}) FROM panel)"


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return with_calendar(events_panel(spark, folder, "event_id", F.col("event_type").alias(ARCHETYPE)))


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    return panel(spark, folder).withColumn(VALUE, F.when(F.col("event_id") % 10 != 0, F.col(VALUE)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show; minus zero is zero."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_features_sql(source: str = "panel", *, fill: bool = False, scale: bool = True) -> str:
    """SELECT of one row for each consumer with the features, in double precision."""
    e = VALUE
    inner = [f"avg({e}) FILTER (hour = {h}) AS h{h}" for h in range(24)]
    inner += [f"avg({e}) FILTER (hour >= {a} AND hour < {b}) AS {p}_usage" for p, (a, b) in PERIODS.items()]
    inner += [f"avg({e}) FILTER (is_weekend) / nullif(avg({e}) FILTER (NOT is_weekend), 0) AS weekend_ratio"]
    inner += [f"CASE WHEN avg({e}) > 0 THEN max({e}) / avg({e}) END AS peak_to_avg_ratio", f"CASE WHEN avg({e}) > 0 THEN stddev_samp({e}) / avg({e}) END AS coefficient_of_variation"]
    inner += [moment_sql("skewness", e, 3), moment_sql("kurtosis", e, 4)]
    if scale:
        inner += [f"avg({e}) AS {e}_mean", f"max({e}) AS {e}_max", f"min({e}) AS {e}_min", f"quantile_cont({e}, 0.5) AS {e}_median", f"stddev_samp({e}) AS {e}_std", f"sum({e}) AS {e}_sum"]
    total = " + ".join(f"coalesce(h{h}, 0)" for h in range(24))
    names = [*(f"{p}_usage" for p in PERIODS), "weekend_ratio", "peak_to_avg_ratio", "coefficient_of_variation", "skewness", "kurtosis"]
    names += [s for s in SCALE if s.startswith(e)] if scale else []
    show = (lambda x: f"coalesce({x}, 0)") if fill else (lambda x: x)
    outer = [f"{show(f'h{h} / nullif({total}, 0)')} AS hour_{h}_shape" for h in range(24)] + [f"{show(n)} AS {n}" for n in names]
    return f"SELECT consumer_id, {', '.join(outer)} FROM (SELECT consumer_id, {', '.join(inner)} FROM {source} WHERE consumer_id IS NOT NULL GROUP BY consumer_id)"


def moment_sql(kind: str, e: str, least: int, name: str | None = None) -> str:
    return f"CASE WHEN count({e}) < {least} THEN NULL WHEN stddev_pop({e}) = 0 THEN 0 ELSE {kind}({e}) END AS {name or kind}"


def rounded_sql(select: str, doubles: list[str], digits: int = 6) -> str:
    """The rows of ``select`` with some columns rounded."""
    shown = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({shown}) FROM ({select})"
