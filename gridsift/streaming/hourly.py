"""Hourly means of a stream of panel rows, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.schema import KEY, PANEL, TIME, VALUE


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Parquet files with panel rows, as they arrive."""
    return spark.readStream.schema(PANEL).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def hourly_means(stream: DataFrame, late: str = "2 hours", width: str = "1 hour", *by: str) -> DataFrame:
    """(window start, *by, mean_kwh, n) of tumbling windows.

    State holds a sum and a count for each open window and group; rows later than ``late`` are dropped.
    """
    rows = stream.where(F.col(KEY).isNotNull() & F.col(TIME).isNotNull()).withColumn("at", F.col(TIME).cast("timestamp"))
    windows = rows.withWatermark("at", late).groupBy(F.window("at", width), *by)
    return windows.agg(F.avg(VALUE).alias("mean_kwh"), F.count(VALUE).alias("n")).select(F.col("window.start").alias("start"), *by, "mean_kwh", "n")


def write_stream(means: DataFrame, target: str, checkpoint: str):
    """Closed windows as Parquet; all that is there is handled, then the query ends."""
    return means.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(target)
