"""K-Means of many (K, seed) at once: every pass over the points advances all models that still move.

A pass is one scan of kept batches of points.  A task stacks the centres of all models, takes the distances of a
stretch of points to all of them by one matrix product, and hands on how many points each centre has, their sum
and their cost.  Spark adds up what many tasks have, so the driver sees as many rows as there are centres.  A model
whose centres have come to rest leaves, and later passes cost less.

Starts are drawn by D^2 oversampling for all models in shared passes too.  A point's chance to be drawn is
proportional to its squared distance to the candidates so far: each point gets an exponential time
over that distance, from a hash of its key, the seed and the round, and the earliest ``2 * K`` points
join.  The draw needs no sum over all points first, and no partition or order of rows changes it.  Candidates
are weighed by the points nearest to them, and the K starts are drawn from that small table.

Points are (key, x array<double>) without nulls.  With fewer distinct points than K a model has fewer centres.
Equal points are one row with their number, which weighs in draws, sums and costs as they would: a pass
costs what the different points cost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridsift.shipping import ship

MAX_ITER = 300
TOLERANCE = 1e-4
#: Rounds of oversampling.
ROUNDS = 2
#: Distances that a task holds at a time, and that it takes in a pass at least, if it can have so many.
CELLS, SHARE = 1_000_000, 20_000_000
#: Rows of sums that the driver adds up itself; of more, Spark does.
FEW = 20_000
#: Points of a batch with how many each stands for.
Batch = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Clusters:
    """A fitted model: its centres, the cost of all points under them and the passes it took."""

    k: int
    seed: int
    centers: np.ndarray
    inertia: float
    passes: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.k, self.seed, self.inertia, self.passes, c.tolist()) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cluster int, k int, seed long, inertia double, passes int, center array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Clusters:
        rows = spark.read.parquet(path).orderBy("cluster").collect()  # K rows
        return Clusters(rows[0]["k"], rows[0]["seed"], np.array([r["center"] for r in rows]), rows[0]["inertia"], rows[0]["passes"])


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances; both sides are moved near the origin first, so little is lost by subtraction."""
    middle = centers.mean(0)
    x, centers = x - middle, centers - middle
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)[None], 0)


class Stack:
    """Centres of several models, one below the other."""

    def __init__(self, centers: list[np.ndarray]) -> None:
        self.first = np.cumsum([0, *map(len, centers)])[:-1]
        self.all = np.concatenate(centers)
        sizes = np.array([*map(len, centers)])
        cuts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]).tolist()
        #: Models next to each other with equally many centres: from, to, centres of each.
        self.alike = [(a, b, int(sizes[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def nearest(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For stretches of points: the points, their nearest centre in each model (by its place in the stack), its squared distance."""
        step = max(1, CELLS // len(self.all))
        middle = self.all.mean(0)
        centers = self.all - middle
        norms = (centers * centers).sum(1)[:, None]
        for some in (x[i : i + step] for i in range(0, len(x), step)):
            moved = some - middle
            far = centers @ (-2 * moved).T  # a row for each centre, so that the least of few is found along whole rows
            far += norms
            far += (moved * moved).sum(1)
            np.maximum(far, 0, out=far)
            at, least = np.zeros((len(self.first), len(some)), np.int32), np.empty((len(self.first), len(some)))
            for a, b, k in self.alike:
                own = far[self.first[a] : self.first[a] + (b - a) * k].reshape(b - a, k, len(some))
                least[a:b] = own[:, 0]
                for j in range(1, k):
                    nearer = own[:, j] < least[a:b]
                    np.minimum(least[a:b], own[:, j], out=least[a:b])
                    np.maximum(at[a:b], nearer * np.int32(j), out=at[a:b])  # the last that is nearer than all before it
            at += self.first[:, None].astype(np.int32)
            yield some, at.T, least.T


def _different(points: DataFrame, key: str, x: str) -> DataFrame:
    """(x, _key, _n): each different point once, with the least hash of its keys and how many there are."""
    return points.groupBy(x).agg(F.min(F.xxhash64(key)).alias("_key"), F.count(F.lit(1)).cast("double").alias("_n"))


def _gathered(points: DataFrame, centers: int) -> DataFrame:
    """``points`` in no more partitions than their work in a pass is worth."""
    return points.coalesce(max(1, math.ceil(points.count() * centers / SHARE)))


def _points_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy()
    return values.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def _packed(points: DataFrame, x: str) -> RDD[Batch]:
    """Batches of points (x, _n) as arrays, kept: a pass over them needs no plan of its own and ships the centres only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [batch.column("_n").to_numpy().tobytes(), np.ascontiguousarray(_points_of(batch, x), float).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in own], names=["n", "x"])

    def arrays(row: tuple[bytes, bytes]) -> Batch:
        n = np.frombuffer(row[0])
        return n, np.frombuffer(row[1]).reshape(len(n), -1)

    return points.select(x, "_n").mapInArrow(run, "n binary, x binary").rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(points: RDD[Batch], stack: Stack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, their sum and their cost for each centre of the stack, in one pass."""
    size, width = stack.all.shape

    def run(batches: Iterator[Batch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, total, cost = np.zeros(size), np.zeros((size, width)), np.zeros(size)
        for number, x in batches:
            first = 0
            for some, at, far in stack.nearest(x):
                own = number[first : first + len(some)]
                first += len(some)
                place = at.T.ravel()
                n += np.bincount(place, np.tile(own, at.shape[1]), size)
                cost += np.bincount(place, (far.T * own).ravel(), size)
                member = np.zeros((size, len(some)))
                member[at.T, np.arange(len(some))] = own
                total += member @ some
        yield n, total, cost

    def add(a: tuple, b: tuple) -> tuple:
        return tuple(p + q for p, q in zip(a, b, strict=True))

    zero = np.zeros(size), np.zeros((size, width)), np.zeros(size)
    parts = points.mapPartitions(run)
    if points.getNumPartitions() * size > FEW:
        return parts.treeAggregate(zero, add, add)
    return reduce(add, parts.collect(), zero)  # a row for each centre of a few tasks


def lloyd(points: DataFrame, starts: list[np.ndarray], x: str, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE, number: str | None = None) -> list[tuple[np.ndarray, float, int]]:
    """(centres, cost, passes) of every model from its given starts.

    A model rests once no centre moves by more than ``tolerance``; a centre without points stays.  A row may stand for
    a ``number`` of equal points.
    """
    ship(points.sparkSession)
    centers, passes = [np.array(s, float) for s in starts], [0] * len(starts)
    packed = _packed(_gathered(points.select(x, (F.col(number) if number else F.lit(1.0)).alias("_n")), sum(map(len, starts))), x)
    active = list(range(len(starts)))
    for _ in range(max_iter):
        if not active:
            break
        n, total, _ = _sums(packed, Stack([centers[m] for m in active]))
        at, moving = 0, []
        for m in active:
            some = slice(at, at + len(centers[m]))
            at = some.stop
            new = np.where(n[some, None] > 0, total[some] / np.maximum(n[some, None], 1), centers[m])
            if ((new - centers[m]) ** 2).sum(1).max() > tolerance**2:
                moving.append(m)
            centers[m], passes[m] = new, passes[m] + 1
        active = moving
    stack = Stack(centers)
    cost = np.add.reduceat(_sums(packed, stack)[2], stack.first)
    packed.unpersist()
    return [(c, float(v), p) for c, v, p in zip(centers, cost, passes, strict=True)]


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1] from hashes of keys and a salt."""
    z = keys.astype(np.uint64) + np.array([(salt * 0x9E3779B97F4A7C15) % 2**64], np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.array([factor], np.uint64)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 1) / 2.0**53


def _earliest(points: DataFrame, x: str, models: list[tuple[int, int]], stack: Stack | None, turn: int) -> dict[int, np.ndarray]:
    """For each model the points drawn in a round, in the order of their times; the first one is drawn evenly among all points."""
    wanted = [2 * k if stack else 1 for k, _ in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, list[float]]]] = [[] for _ in models]
        for batch in batches:
            keys, number, at = batch.column("_key").to_numpy(), batch.column("_n").to_numpy(), 0
            stretches = stack.nearest(_points_of(batch, x)) if stack else [(_points_of(batch, x), None, None)]
            for some, _, far in stretches:
                own, n = keys[at : at + len(some)], number[at : at + len(some)]
                at += len(some)
                for m, (_, seed) in enumerate(models):
                    time = -np.log(_uniform(own, (seed * 1_000_003 + turn) * 1_000_003 + models[m][0])) / n
                    if far is not None:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            time = np.where(far[:, m] > 0, time / far[:, m], np.inf)
                    first = np.argsort(time, kind="stable")[: wanted[m]] if len(time) <= wanted[m] else np.argpartition(time, wanted[m] - 1)[: wanted[m]]
                    best[m] += [(float(time[i]), int(own[i]), some[i].tolist()) for i in first if np.isfinite(time[i])]
                    if len(best[m]) > 4 * wanted[m]:
                        best[m] = sorted(best[m])[: wanted[m]]
        for m, found in enumerate(best):
            found = sorted(found)[: wanted[m]]
            if found:
                yield pa.RecordBatch.from_pydict({"model": [m] * len(found), "time": [f[0] for f in found], "_key": [f[1] for f in found], "x": [f[2] for f in found]})

    drawn = points.mapInArrow(run, "model long, time double, _key long, x array<double>")
    place = F.row_number().over(Window.partitionBy("model").orderBy("time", "_key", "x"))
    limits = F.array(*map(F.lit, wanted))
    rows = drawn.withColumn("place", place).where(F.col("place") <= F.get(limits, F.col("model").cast("int"))).orderBy("model", "place").collect()  # 2 K rows for each model
    return {m: np.array([r["x"] for r in rows if r["model"] == m]) for m in range(len(models))}


def _reduce(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """K of the weighted candidates: each next one by weight times squared distance to those chosen, then a few Lloyd rounds among the candidates."""
    chosen = [int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))] if weights.sum() > 0 else [0]
    far = distances(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k:
        odds = weights * far
        if odds.sum() <= 0:
            break
        chosen.append(int(min(np.searchsorted(np.cumsum(odds), rng.random() * odds.sum()), len(odds) - 1)))
        far = np.minimum(far, distances(candidates, candidates[chosen[-1:]])[:, 0])
    centers = candidates[chosen].copy()
    for _ in range(30):
        own = distances(candidates, centers).argmin(1)
        new = np.array([np.average(candidates[own == j], axis=0, weights=weights[own == j]) if weights[own == j].sum() > 0 else c for j, c in enumerate(centers)])
        if np.allclose(new, centers):
            break
        centers = new
    return centers


def starts(points: DataFrame, models: list[tuple[int, int]], key: str, x: str) -> list[np.ndarray]:
    """Starting centres for each (k, seed); all models share every pass."""
    return _starts(_different(points, key, x), models, x)


def _starts(different: DataFrame, models: list[tuple[int, int]], x: str) -> list[np.ndarray]:
    ship(different.sparkSession)
    keyed = _gathered(different, sum(k for k, _ in models))
    first = _earliest(keyed, x, models, None, 0)
    held = [first[m] for m in range(len(models))]
    if not len(held[0]):
        raise ValueError("no points to cluster")
    for turn in range(1, ROUNDS + 1):
        more = _earliest(keyed, x, models, Stack(held), turn)
        held = [np.concatenate([c, more[m]]) if len(more[m]) else c for m, c in enumerate(held)]
    held = [np.unique(c, axis=0) for c in held]
    packed, stack = _packed(keyed, x), Stack(held)
    weights = _sums(packed, stack)[0]
    packed.unpersist()
    split = np.split(weights, stack.first[1:])
    return [_reduce(c, w, k, np.random.default_rng([seed, k])) for c, w, (k, seed) in zip(held, split, models, strict=True)]


def fit(points: DataFrame, models: list[tuple[int, int]], key: str, x: str, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[Clusters]:
    """A model for each (k, seed), in shared passes."""
    different = _different(points, key, x).persist()
    found = lloyd(different, _starts(different, models, x), x, max_iter, tolerance, "_n")
    different.unpersist()
    return [Clusters(k, seed, centers, cost, passes) for (k, seed), (centers, cost, passes) in zip(models, found, strict=True)]


def nearest(models: list[Clusters]) -> Callable[[Column], Column]:
    """A column function: the labels of a vector under each of the models, as array<int>."""
    stack = Stack([m.centers for m in models])

    @F.arrow_udf("array<int>")
    def labels(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, stack.all.shape[1]))
        at = [(place - stack.first[None]).astype(np.int32) for _, place, _ in stack.nearest(rows)]
        flat = np.concatenate(at).ravel() if at else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(models)), pa.array(flat))

    return labels
