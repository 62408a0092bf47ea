"""Readers and writers of panels and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsift.functions.stats import finite
from gridsift.schema import KEY, PANEL, TIME, VALUE


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PANEL) -> DataFrame:
    """A CSV file or folder with a header, under a declared schema.

    A column that cannot be read as its type is null; a missing path raises at once.
    """
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


#: Types from narrow to wide; a column gets the first that enough of its values fit, else string.
LATTICE = ["boolean", "long", "double", "date", "timestamp_ntz"]
_BAD = "_corrupt_record"


def infer_types(spark: SparkSession, path: str, names: list[str] | None = None, tolerance: float = 0.0) -> T.StructType:
    """Types of the columns of CSV files, from one pass over all values with partial sums.

    A type fits if no more than the share ``tolerance`` of a column's values cannot be read as it; those are what
    ``read_csv_checked`` puts aside.  A column without values is a string.  With ``names`` the files have no header.
    """
    text = _csv(spark, names is None).csv(path)
    text = text.toDF(*names) if names else text
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(map(_quoted, text.columns))]
    fits = [F.count(_as(F.col(c), kind)).alias(f"{kind}{i}") for i, c in enumerate(map(_quoted, text.columns)) for kind in LATTICE]
    row = text.agg(*counts, *fits).first()

    def kind(i: int) -> str:
        n = row[f"n{i}"]
        return next((k for k in LATTICE if n and row[f"{k}{i}"] >= (1 - tolerance) * n), "string")

    types = {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "string": T.StringType()}
    return T.StructType([T.StructField(c, types[kind(i)]) for i, c in enumerate(text.columns)])


def _csv(spark: SparkSession, header: bool):
    return spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnPruning", False)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _as(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.when(F.lower(value).isin("true", "false"), value)
    if kind == "date":  # a time of day would be lost
        return F.when(value.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"), value.try_cast("date"))
    return value.try_cast(kind)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | None = None, names: list[str] | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The rows that can be read whole, and the lines (line, fields) that cannot: too few or too many fields, or a value of another type.

    Without a schema, ``infer_types`` gives one.  No value becomes null because it could not be read.  Lines are parsed
    once; what was parsed is stored in the shared folder, and both tables read from there.
    """
    schema = schema or infer_types(spark, path, names, tolerance)
    whole = _csv(spark, names is None).schema(T.StructType([*(f for f in schema if f.name != _BAD), T.StructField(_BAD, T.StringType())])).option("columnNameOfCorruptRecord", _BAD).csv(path)
    known = [c for c in schema.names if c != _BAD]
    stored = scratch(spark, "parsed")
    whole.select(F.struct(*map(_quoted, known)).alias("fields"), F.col(_BAD).alias("line")).write.parquet(stored)
    rows = spark.read.parquet(stored)
    return rows.where("line IS NULL").select("fields.*"), rows.where("line IS NOT NULL").select("line", "fields")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_panel(df: DataFrame, key: str | Column, time: str | Column, value: str | Column, *extra: str | Column) -> DataFrame:
    """Any table as a panel (consumer_id, timestamp, energy_consumption_kwh, extra columns).

    NaN consumption becomes null.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_column(key).cast("long").alias(KEY),
        as_column(time).alias(TIME),
        finite(as_column(value).cast("double")).alias(VALUE),
        *extra,
    )


def events_panel(spark: SparkSession, folder: str, *extra: str | Column) -> DataFrame:
    """The ``events`` table: users are consumers, values their consumption."""
    return as_panel(spark.read.parquet(f"{folder}/events.parquet"), "user_id", "ts", "value", *extra)


def write_csv(df: DataFrame, path: str, *, files: int | None = 1) -> None:
    """A CSV folder with a header; ``files`` is 1 for the small tables of reports, None for any others."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def store_panel(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """The panel as a table dealt by consumer into buckets and sorted by time, one file each.

    What goes by consumer later (features, fills, duplicates of a consumer) finds its rows together and shuffles nothing.
    The table's files lie in the shared folder; its name is known to this session.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"gridsift_panel_{uuid.uuid4().hex}"
    order = [KEY, TIME] if TIME in df.columns else [KEY]
    df.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(*order).option("path", scratch(spark, "panel")).saveAsTable(name)
    return spark.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, in a local session only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-gridsift-")
    return f"{folder.rstrip('/')}/gridsift/{name}-{uuid.uuid4().hex}"
