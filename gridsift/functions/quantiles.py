"""Exact quantiles of whole tables or of groups, linearly interpolated, without gathering the values of a group in one task.

A bounded sketch of each group brackets every wanted rank; one pass counts what lies below each bracket, and
only the values inside a bracket, counted by value, are ordered.  Groups whose bracket misses its rank
take a second pass over their whole range, so the answer is exact whatever the sketch says.

The brackets are a table with a row for each group, column and probability, written to the shared folder: none of it
comes to the driver.  It is broadcast where it has few rows; else it is joined by group, and since the sums after the join go by
group and value, a group that holds most rows may be split over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsift.sources.tables import scratch

#: Relative error of the sketch is one over this.
ACCURACY = 2_000
#: Most rows of a table of brackets that is broadcast.
FEW = 20_000


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    rows = df.select(*by, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))))
    return rows.where("x IS NOT NULL AND NOT isnan(x)")


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(*by, column, probability, value) for each column, probability and group with values; any number of groups, of any size."""
    by = by or []
    keys = [*by, "column"]
    long = _long(df, columns, by)
    step = 1.5 / ACCURACY
    edges = [(max(0.0, p - step), min(1.0, p + step)) for p in probabilities]
    flat = [e for pair in edges for e in pair]
    sketch = long.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", flat, ACCURACY).alias("at"))
    wanted = F.array(
        *(
            F.struct(F.lit(float(p)).alias("probability"), F.when(F.lit(a) > 0, F.col("at")[2 * i]).otherwise(F.col("low")).alias("lo"), F.when(F.lit(b) < 1, F.col("at")[2 * i + 1]).otherwise(F.col("high")).alias("hi"))
            for i, (p, (a, b)) in enumerate(zip(probabilities, edges, strict=True))
        )
    )
    brackets = _written(sketch.select(*keys, "n", "low", "high", F.inline(wanted)))
    found = _written(_between(long, brackets, keys))
    missed = found.where("value IS NULL").select(*keys, "probability")
    if not missed.isEmpty():
        whole = brackets.join(missed, _same(brackets, missed, [*keys, "probability"]), "left_semi").withColumns({"lo": F.col("low"), "hi": F.col("high")})
        found = found.where("value IS NOT NULL").union(_between(long, whole, keys))
    return found.select(*keys, "probability", "value")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def _between(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, probability, value): null where a bracket misses its rank."""
    few = brackets.limit(FEW + 1).count() <= FEW
    b = brackets.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", "probability", "lo", "hi")
    same = reduce(lambda x, y: x & y, (long[k].eqNullSafe(b[f"_{k}"]) for k in keys))
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    # One key for group and value, so that sums are dealt anew and a large group need not stay in one task.
    key = F.struct(*keys, "probability", "n", F.when(inside, F.col("x")).alias("x"))
    seen = long.join(F.broadcast(b) if few else b, same).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("x") < F.col("lo")).alias("below"))
    group = Window.partitionBy(*keys, "probability")
    rows = seen.select("key.*", "m", "below").withColumn("below", F.max(F.when(F.col("x").isNull(), F.col("below"))).over(group)).where("x IS NOT NULL")
    last = F.coalesce("below", F.lit(0)) + F.sum("m").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rank = (F.col("n") - 1) * F.col("probability")
    first = F.col("last") - F.col("m") + 1
    at = lambda r: F.max(F.when((first <= r) & (r <= F.col("last")), F.col("x")))
    ends = rows.withColumn("last", last).groupBy(*keys, "probability", "n").agg(at(F.floor(rank)).alias("a"), at(F.ceil(rank)).alias("b"))
    return ends.select(*keys, "probability", (F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias("value"))
