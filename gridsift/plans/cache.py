"""Results kept under what they were made from: settings, order of repeated rows, and the panel's content.

The fingerprint of a panel is a number of rows and two sums of hashes of whole rows, taken in one pass with
partial sums: it does not depend on partitions or the order of rows, and a row that is there twice counts twice.

A run writes its tables into a folder of its own and commits them by one small marker, written aside and moved
into place, that names the run and its tables.  Readers see committed runs only; of two runs that were made at the same time they all take
the one whose name sorts first, so tables of different runs are never mixed.  A run that broke off has no marker and is made again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_fingerprint(df: DataFrame) -> str:
    """Equal for tables with the same columns and the same rows, each as often, in any order."""
    columns = []
    for i, field in sorted(enumerate(df.schema), key=lambda f: f[1].name):
        value = df[i] if isinstance(field.dataType, T.AtomicType) else F.to_json(F.struct(df[i].alias("v")))
        columns += [value, df[i].isNull()]  # a hash passes over nulls, so they are told apart from values that follow
    wide = T.DecimalType(38, 0)
    row = df.select(*(F.xxhash64(F.lit(salt), *columns).cast(wide).alias(f"h{salt}") for salt in (1, 2))).agg(F.count(F.lit(1)).alias("n"), F.sum("h1").alias("a"), F.sum("h2").alias("b")).first()
    names = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return hashlib.sha256(json.dumps([names, row["n"], str(row["a"] or 0), str(row["b"] or 0)]).encode()).hexdigest()[:32]


class Store:
    """Committed runs below a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> dict | None:
        """The marker of the first run by name, or None."""
        home = self.path(f"{self.folder}/committed")
        names = sorted(f.getPath().getName() for f in self.files.listStatus(home)) if self.files.exists(home) else []
        if not names:
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/committed/{names[0]}").collect()))

    def write(self, tables: dict[str, DataFrame]) -> None:
        run = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/runs/{run}/{name}")
        self.commit(run, list(tables))

    def commit(self, run: str, names: list[str]) -> None:
        aside = f"{self.folder}/runs/{run}/marker"
        self.spark.createDataFrame([(json.dumps({"run": run, "tables": names}),)], "value string").coalesce(1).write.text(aside)
        self.files.mkdirs(self.path(f"{self.folder}/committed"))
        if not self.files.rename(self.path(aside), self.path(f"{self.folder}/committed/{run}")):
            raise OSError(f"{self.folder}: run {run} could not be committed")

    def read(self, marker: dict) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.folder}/runs/{marker['run']}/{name}") for name in marker["tables"]}


def kept(spark: SparkSession, folder: str, made_from: list, make: Callable[[], tuple[dict[str, DataFrame], Callable[[], None]]]) -> tuple[dict[str, DataFrame], bool]:
    """Tables kept below ``folder`` under ``made_from``, and whether they were made now.

    ``make`` gives the tables and what to call once they are written.
    """
    key = hashlib.sha256(json.dumps(made_from).encode()).hexdigest()[:32]
    store = Store(spark, f"{folder.rstrip('/')}/{key}")
    marker = store.committed()
    if marker is None:
        tables, release = make()
        store.write(tables)
        release()
        return store.read(store.committed()), True
    return store.read(marker), False
