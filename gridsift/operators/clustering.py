"""K-Means with restarts, the sweep over K, the vote for K, and stability over seeds.

All fits of a sweep, or of all runs of a stability test, share their passes over the points (``kmeans``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsift.operators import kmeans, metrics
from gridsift.operators.kmeans import MAX_ITER, Clusters
from gridsift.schema import KEY
from gridsift.shipping import ship

RESTARTS = 10
SEED = 42
TOP = 3


def fit_all(points: DataFrame, wanted: list[tuple[int, int]], max_iter: int = MAX_ITER, x: str = "pc", key: str = KEY) -> list[Clusters]:
    """A model for each (k, seed)."""
    return kmeans.fit(points, wanted, key, x, max_iter)


def _best(models: list[Clusters]) -> Clusters:
    return min(models, key=lambda m: m.inertia)


def fit_kmeans(points: DataFrame, k: int, seed: int = SEED, restarts: int = RESTARTS, max_iter: int = MAX_ITER, x: str = "pc", key: str = KEY) -> Clusters:
    """The model of least inertia among ``restarts`` starts; of equal ones, the first."""
    return _best(fit_all(points, [(k, seed + i) for i in range(restarts)], max_iter, x, key))


def labelings(points: DataFrame, models: list[Clusters], x: str = "pc") -> DataFrame:
    """``points`` with ``clusters``, an array with the label under each model, in one pass."""
    ship(points.sparkSession)
    return points.withColumn("clusters", kmeans.nearest(models)(F.col(x)))


def label(points: DataFrame, model: Clusters, x: str = "pc") -> DataFrame:
    """``points`` with ``cluster``, the nearest centre of a model."""
    return labelings(points, [model], x).withColumn("cluster", F.get("clusters", F.lit(0))).drop("clusters")


def sweep(points: DataFrame, ks: range, x: str = "pc", key: str = KEY, seed: int = SEED, restarts: int = RESTARTS, error: float | None = None) -> tuple[DataFrame, dict[int, Clusters]]:
    """(k, inertia, silhouette, ch, db) for each K, and the models.

    All labelings are one table, so distances between points are taken once for all K.  Silhouettes are exact at every
    size; with an ``error`` they are taken against drawn points of each cluster.
    """
    fitted = fit_all(points, [(k, seed + i) for k in ks for i in range(restarts)], x=x, key=key)
    models = {k: _best(fitted[i * restarts : (i + 1) * restarts]) for i, k in enumerate(ks)}
    wide = labelings(points.select(F.col(key).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")), list(models.values()), "x").persist()
    found = metrics.metrics_of_labelings(wide, len(models), error)
    wide.unpersist()
    rows = [(k, model.inertia, own["silhouette"], own["ch"], own["db"]) for (k, model), own in zip(models.items(), found, strict=True)]
    return points.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, ch double, db double"), models


def votes(table: DataFrame, top: int = TOP) -> DataFrame:
    """(k, votes, place): one vote for each of the three metrics that has K among its best.

    Silhouette and Calinski-Harabasz are better when higher, Davies-Bouldin when lower; among
    equal values the smaller K is better.  ``place`` is where K first appears in the three lists.
    """
    lists = [("silhouette", F.desc("silhouette")), ("ch", F.desc("ch")), ("db", F.asc_nulls_last("db"))]
    ranked = [
        table.where(F.col(c).isNotNull()).select("k", (F.row_number().over(Window.orderBy(order, "k")) + F.lit(i * top)).alias("place")).where(F.col("place") <= (i + 1) * top)
        for i, (c, order) in enumerate(lists)
    ]
    chosen = ranked[0].union(ranked[1]).union(ranked[2])
    return chosen.groupBy("k").agg(F.count(F.lit(1)).alias("votes"), F.min("place").alias("place"))


def choose_k(table: DataFrame, top: int = TOP) -> int:
    """K with most votes; among equals the one that is listed first."""
    return votes(table, top).orderBy(F.desc("votes"), "place").first()["k"]


def choose_k_by_elbow(table: DataFrame, low: int = 3, high: int = 6) -> int:
    """The older rule: best silhouette if that K is in [low, high], else the K after the sharpest
    bend of the inertia if that is, else best silhouette."""
    rows = table.select("k", "silhouette", "inertia").orderBy("k").collect()
    best = max(rows, key=lambda r: (r["silhouette"], -r["k"]))["k"]
    if low <= best <= high or len(rows) < 3:
        return best
    bend = table.withColumn("bend", F.lag("inertia").over(Window.orderBy("k")) - 2 * F.col("inertia") + F.lead("inertia").over(Window.orderBy("k")))
    row = bend.where("bend IS NOT NULL").orderBy(F.desc("bend"), "k").first()
    return row["k"] if low <= row["k"] <= high else best


def stability(points: DataFrame, k: int, runs: int = 10, seed: int = SEED, restarts: int = 1, x: str = "pc", key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """Per-pair adjusted Rand indices (a, b, ari) and per-run inertia (run, inertia)."""
    fitted = fit_all(points, [(k, seed + i + 1000 * j) for i in range(runs) for j in range(restarts)], x=x, key=key)
    models = [_best(fitted[i * restarts : (i + 1) * restarts]) for i in range(runs)]
    wide = labelings(points.select(x), models, x).groupBy("clusters").agg(F.count(F.lit(1)).alias("n"))  # few rows, however many points
    of = lambda i: F.get("clusters", F.lit(i))
    both = F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), of(a).alias("x"), of(b).alias("y")) for a, b in combinations(range(runs), 2))))
    ari = metrics.rand_table(wide.select("n", both), "x", "y", "a", "b", number="n")
    inertia = points.sparkSession.createDataFrame([(i, m.inertia) for i, m in enumerate(models)], "run int, inertia double")
    return ari, inertia


def stability_summary(ari: DataFrame, inertia: DataFrame, k: int) -> dict[str, float]:
    """Means and population deviations over pairs and runs."""
    a = np.array([r["ari"] for r in ari.collect()])  # runs * (runs - 1) / 2 rows
    i = np.array([r["inertia"] for r in inertia.collect()])
    return {"k": k, "n_runs": len(i), "mean_ari": float(a.mean()), "std_ari": float(a.std()), "mean_inertia": float(i.mean()), "std_inertia": float(i.std())}


def lloyd_step(points: DataFrame, centers: list[list[float]], x: str = "x", key: str = "id") -> DataFrame:
    """(key, cluster): the nearest of fixed centres, the first among equals."""
    far = [metrics.squared_distance(F.col(x), F.array(*map(F.lit, c))) for c in centers]
    return points.withColumn("_d", F.array(*far)).select(key, (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("cluster"), x)


def sizes(labels: DataFrame) -> DataFrame:
    """(cluster, size) of a labeling."""
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def balance(labels: DataFrame) -> DataFrame:
    """One row: the smallest cluster's size over the largest's."""
    return sizes(labels).agg((F.min("size") / F.max("size")).alias("balance"))
