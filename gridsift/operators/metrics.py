"""Quality of a clustering: inertia, silhouette, Calinski-Harabasz, Davies-Bouldin, adjusted Rand.

Points are rows (id, cluster, x array<double>).  Centroids and counts come from vector sums with
partial aggregation; the table of clusters has a row for each cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.shipping import ship

#: Points of a block of the silhouette, at least; a task compares two blocks.  Beyond ``SPREAD`` blocks they hold more
#: points, up to ``MOST``, since every point is sent to as many tasks as there are blocks.
BLOCK, SPREAD, MOST = 2048, 24, 32_768
#: Points whose sums travel in one row.
SLICE = 1024
#: Sides of the tile of distances that a task holds at a time.
TILE, WIDE_TILE = 512, 1024
#: Stretches of equal labels in a side of a tile that are added up one by one; of more, one matrix product adds up all.
STRETCHES = 64
#: Up to so many components distances are taken component by component; beyond, squares that are this small beside the norms are taken again.
NARROW, LOST = 6, 1e-5
#: Different points from which silhouettes take ``ERROR`` although none is given: none, they are exact at every size.
EXACT_UPTO = math.inf
ERROR, DOUBT = 0.05, 0.01


def points(df: DataFrame, key: str, cluster: str, x: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(cluster).cast("int").alias("cluster"), F.col(x).cast("array<double>").alias("x"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def centroids(pts: DataFrame) -> DataFrame:
    """(cluster, n, centroid array<double>)."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("x"))))
    return pts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), mean.alias("centroid"))


def _with_centroids(pts: DataFrame) -> DataFrame:
    return pts.join(F.broadcast(centroids(pts)), "cluster")


def inertia(pts: DataFrame) -> DataFrame:
    """One row: the sum of squared distances to the own centroid."""
    return _with_centroids(pts).agg(F.sum(squared_distance(F.col("x"), F.col("centroid"))).alias("inertia"))


def _within(pts: DataFrame) -> list:
    """For each cluster: size, centroid, sums of squared and plain distances to it."""
    return within_labelings(pts.select("id", F.array("cluster").alias("clusters"), "x")).get(0, [])


def within_labelings(pts: DataFrame) -> dict[int, list]:
    """The same for each labeling of points (id, clusters array<int>, x), in one pass after that for the centroids."""
    long = pts.select("x", F.posexplode("clusters").alias("labeling", "cluster"))
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("x"))))
    middle = long.groupBy("labeling", "cluster").agg(F.count(F.lit(1)).alias("n"), mean.alias("centroid"))
    d2 = squared_distance(F.col("x"), F.col("centroid"))
    near = long.join(F.broadcast(middle), ["labeling", "cluster"]).withColumn("d2", d2).groupBy("labeling", "cluster")
    out: dict[int, list] = {}
    for row in near.agg(F.first("n").alias("n"), F.first("centroid").alias("c"), F.sum("d2").alias("d2"), F.sum(F.sqrt("d2")).alias("d")).orderBy("labeling", "cluster").collect():  # a row for each cluster
        out.setdefault(row["labeling"], []).append(row)
    return out


def calinski_harabasz(pts: DataFrame) -> float | None:
    return _calinski_harabasz(_within(pts))


def _calinski_harabasz(rows: list) -> float | None:
    n, k = sum(r["n"] for r in rows), len(rows)
    if k < 2 or n <= k:
        return None
    c = np.array([r["c"] for r in rows])
    sizes = np.array([r["n"] for r in rows], float)
    middle = sizes @ c / n
    between = float(sizes @ ((c - middle) ** 2).sum(1))
    within = sum(r["d2"] for r in rows)
    return 1.0 if within == 0 else between * (n - k) / (within * (k - 1))


def davies_bouldin(pts: DataFrame) -> float | None:
    return _davies_bouldin(_within(pts))


def _davies_bouldin(rows: list) -> float | None:
    if len(rows) < 2:
        return None
    c = np.array([r["c"] for r in rows])
    s = np.array([r["d"] / r["n"] for r in rows])
    apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    return float(np.where(apart > 0, (s[:, None] + s[None]) / np.where(apart > 0, apart, 1), 0).max(1).mean())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, component by component."""
    square, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for p, q in zip(a.T, np.ascontiguousarray(b.T), strict=True):
        np.subtract(p[:, None], q[None], out=step)
        step *= step
        square += step
    return square


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of a tile: of few components one by one, else by one matrix product, whose lost digits are taken again."""
    if a.shape[1] <= NARROW:
        square = _squares(a, b)
    else:
        middle = b.mean(0)
        a, b = a - middle, b - middle
        norms = np.einsum("ij,ij->i", a, a)
        # Both norms are two more components of the product.
        square = np.c_[a, norms, np.ones(len(a))] @ np.c_[-2 * b, np.ones(len(b)), np.einsum("ij,ij->i", b, b)].T
        # Where a square is small beside the norms, both norms are nearly the same.
        least = 2.1 * LOST * norms
        near = np.flatnonzero(square.min(1, initial=np.inf) < least)
        lost = square[near] < least[near, None]
        n = np.count_nonzero(lost)
        if n > square.size // 16:
            square = _squares(a, b)
        elif n:
            i, j = np.nonzero(lost)
            i = near[i]
            square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(square, out=square)


def _matrix(lists: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """n lists of one length as rows."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // max(n, 1))


def _tiles(n: int, side: int) -> list[slice]:
    return [slice(i, min(i + side, n)) for i in range(0, n, side)]


class _Block:
    """Points in an order that depends on them alone, with equal labels together, and their places among all clusters of all labelings."""

    def __init__(self, table: pa.Table, names: list[np.ndarray]) -> None:
        ids, w = table.column("id").to_numpy(), table.column("w").to_numpy()
        x, clusters = _matrix(table.column("x"), len(ids)), _matrix(table.column("clusters"), len(ids))
        order = np.lexsort((*x.T, ids, *clusters.T))
        self.ids, self.w, self.x, self.clusters = ids[order], w[order], x[order], clusters[order]
        first = np.cumsum([0, *map(len, names)])
        self.width = int(first[-1])
        self.place = np.stack([at + np.searchsorted(own, self.clusters[:, i]) for i, (at, own) in enumerate(zip(first, names, strict=False))], 1)
        self.known: dict[tuple[int, int], tuple[list[tuple[int, int]], np.ndarray, np.ndarray]] = {}

    def members(self, some: slice) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Stretches of ``some`` with equal labels, the places that they have, and which stretch counts there; of many, the weights of the points there.

        Kept, as a block is cut in the same way for all tiles.
        """
        key = some.start, some.stop
        if key not in self.known:
            place, w = self.place[some], self.w[some, None]
            cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)])
            stretches = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(w)], strict=True))
            if len(cuts) > STRETCHES:
                stretches = []
            else:
                place, w = place[cuts], np.ones((len(cuts), 1))
            at, own = np.unique(place, return_inverse=True)
            weights = np.zeros((len(place), len(at)))
            np.put_along_axis(weights, own.reshape(place.shape), w, 1)
            self.known[key] = stretches, at, weights
        return self.known[key]

    def add(self, out: np.ndarray, far: np.ndarray, some: slice) -> None:
        """To ``out`` (rows, clusters) the sums of ``far`` (rows, points of ``some``) by cluster."""
        stretches, at, weights = self.members(some)
        w = self.w[some]
        if stretches:
            far = np.stack([far[:, i:j] @ w[i:j] for i, j in stretches], 1)
        out[:, at] += far @ weights


_SUMS = "block int, slice int, other int, ids array<long>, w array<double>, clusters array<int>, totals array<double>"


def _sums_of_pair(names: list[np.ndarray]) -> Callable[[tuple, pa.Table], pa.Table]:
    """Sums of distances from each point of block i to those of block j by their cluster in each labeling, and of j to i; a row for each slice of points."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        side = table.column("block").to_numpy()
        blocks = {k: _Block(table.filter(pa.array(side == k)), names) for k in {i, j}}
        sums = {k: np.zeros((len(b.ids), b.width)) for k, b in blocks.items()}
        one, two = blocks[i], blocks[j]
        for p in _tiles(len(one.ids), TILE):
            for q in _tiles(len(two.ids), WIDE_TILE):
                far = _distances(one.x[p], two.x[q])
                if i == j:
                    same = np.arange(max(p.start, q.start), min(p.stop, q.stop))
                    far[same - p.start, same - q.start] = 0
                two.add(sums[i][p], far, q)
                if i != j:
                    one.add(sums[j][q], far.T, p)
        rows: list[tuple] = []
        for k, b in blocks.items():
            for n, some in enumerate(_tiles(len(b.ids), SLICE)):
                known = (b.ids[some], b.w[some], b.clusters[some].ravel()) if i == j else ((), (), ())
                rows.append((k, n, i + j - k, *known, sums[k][some].ravel()))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _SUMS.split(", ")])

    return run


def _silhouettes_of_slice(names: list[np.ndarray], sizes: list[np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """Silhouettes of a slice of points from its sums against all blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("other").combine_chunks()
        totals = sum(t.values.to_numpy() for t in table.column("totals"))
        own = next(i for i, known in enumerate(table.column("ids")) if len(known))
        ids, w, clusters = (table.column(c)[own].values.to_numpy() for c in ("ids", "w", "clusters"))
        totals, clusters = totals.reshape(len(ids), -1), clusters.reshape(len(ids), -1)
        at, parts, first = np.arange(len(ids)), [], 0
        for labeling, (known, n) in enumerate(zip(names, sizes, strict=True)):
            mean, place = totals[:, first : first + len(n)] / n, np.searchsorted(known, clusters[:, labeling])
            first += len(n)
            mates = n[place]
            a = mean[at, place] * mates / np.maximum(mates - 1, 1)
            mean[at, place] = np.inf
            parts.append((np.full(len(ids), labeling), ids, clusters[:, labeling], _silhouette(a, mean.min(1), mates), w))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], ["labeling", "id", "cluster", "silhouette", "w"])

    return run


def _silhouette(a: np.ndarray, b: np.ndarray, mates: np.ndarray) -> np.ndarray:
    """From mean distances to the own and the nearest other cluster; 0 for a point alone in its cluster, or without another one."""
    some = (mates > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
    return np.where(some, (np.where(some, b, 0) - a) / np.where(some, np.maximum(a, b), 1), 0.0)


def silhouettes_of_labelings(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(labeling, id, cluster, silhouette) for points (id, clusters array<int>, x) with a label for each labeling.

    Blocks of points are compared two at a time, once for all labelings; what leaves a task is a
    sum for each point, labeling and cluster, never a pair.  A point alone in its cluster has
    silhouette 0.  The work grows with the square of the number of points, what is shuffled with that over ``MOST``.
    """
    return _weighted_silhouettes(pts.withColumn("w", F.lit(1.0)), block).drop("w")


def _blocks(n: int, block: int) -> int:
    return max(1, math.ceil(n / MOST), min(SPREAD, math.ceil(n / block)))


def _weighted_silhouettes(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same, and w, for points that each stand for w equal ones."""
    ship(pts.sparkSession)
    long = pts.select("w", F.posexplode("clusters").alias("labeling", "cluster"))
    found = long.groupBy("labeling", "cluster").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy("labeling", "cluster").collect()  # a row for each cluster
    labelings = range(1 + max((r["labeling"] for r in found), default=-1))
    names = [np.array([r["cluster"] for r in found if r["labeling"] == i], np.int32) for i in labelings]
    sizes = [np.array([r["n"] for r in found if r["labeling"] == i]) for i in labelings]
    n = sum(r["rows"] for r in found if r["labeling"] == 0)
    blocks = _blocks(n, block)
    placed = pts.select("id", "w", "clusters", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    spread = placed.withColumn("against", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.withColumns({"i": F.least("block", "against"), "j": F.greatest("block", "against")}).drop("against")
    spread = spread.repartition(min(blocks * (blocks + 1) // 2, 256), "i", "j")
    sums = spread.groupBy("i", "j").applyInArrow(_sums_of_pair(names), _SUMS)
    return sums.groupBy("block", "slice").applyInArrow(_silhouettes_of_slice(names, sizes), "labeling int, id long, cluster int, silhouette double, w double")


def _different(pts: DataFrame) -> DataFrame:
    """Points (id, clusters, x) with equal ones as one, and w, their number: they have the same silhouette."""
    return pts.groupBy("clusters", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))


def coreset_size(error: float, doubt: float = DOUBT) -> int:
    """Draws from a cluster after which a point's mean distance to it is off by more than ``error`` times itself with a chance below ``doubt``.

    A point y of a cluster with n points is drawn with odds q(y) = (1 + d(y, c) / r) / 2n, where c is the centroid and r
    the mean distance to it, and weighs 1 / (n q(y)).  Then no term of the sum for a point x exceeds 2 max(d(x, c), r), which is
    at most 4 times its mean distance D, and Bernstein's inequality for m Poisson draws gives the chance of an error above
    e D as at most 2 exp(-m e^2 / (8 + 8 e / 3)).
    """
    return math.ceil((8 + 8 * error / 3) * math.log(2 / doubt) / error**2)


def coresets(pts: DataFrame, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Points, weights and clusters of the drawn points, and the sizes of all clusters.

    A cluster of up to ``size`` points is taken whole.  Draws come from hashes of the ids, so partitions do not change them; what
    comes to the driver is about ``size`` points of each cluster, however many it has.
    """
    return _drawn(pts, _within(pts), size, seed)


def _drawn(pts: DataFrame, within: list, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    rows = [(r["cluster"], r["n"], r["c"], r["d"]) for r in within]
    table = pts.sparkSession.createDataFrame(rows, "cluster int, n long, centroid array<double>, total double")
    away = F.sqrt(squared_distance(F.col("x"), F.col("centroid")))
    share = F.when(F.col("n") <= size, F.lit(None)).otherwise((1 + F.coalesce(F.try_divide(away * F.col("n"), F.col("total")), F.lit(1.0))) / (2 * F.col("n")))
    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    odds = pts.join(F.broadcast(table), "cluster").select("cluster", "x", "n", (share * size).alias("rate"), uniform.alias("u"))
    # Draws of a point: how many steps of the Poisson distribution its number lies beyond; below the first step it is not drawn.
    drawn = odds.where(F.col("rate").isNull() | (F.col("u") > F.exp(-F.col("rate")))).toArrow()
    cluster, n, rate, u = (drawn.column(c).to_numpy() for c in ("cluster", "n", "rate", "u"))
    x = _matrix(drawn.column("x"), len(cluster))
    whole = np.isnan(rate)
    rate = np.where(whole, 1.0, rate)
    times, step = np.zeros(len(u)), np.exp(-rate)
    upto = step.copy()
    while (more := ~whole & (u > upto) & (step > 0)).any():
        times[more] += 1
        step[more] *= rate[more] / times[more]
        upto[more] += step[more]
    weight = np.where(whole, 1, times) / (n * rate)
    order = np.lexsort((u, *x.T[::-1], cluster))
    return x[order], weight[order], cluster[order].astype(int), {c: n for c, n, _, _ in rows}


def silhouettes_by_coreset(pts: DataFrame, error: float = ERROR, doubt: float = DOUBT, seed: int = 1) -> DataFrame:
    """(id, cluster, silhouette) against drawn points of each cluster; the work grows in proportion to the points.

    With d the distance to the centroid of a cluster and R^2 the mean squared one of its points to it, the mean distance to them
    lies between d and sqrt(d^2 + R^2).  A cluster whose least is more than another's most is not the nearest, and is passed over.
    """
    ship(pts.sparkSession)
    within = _within(pts)
    x, weight, cluster, sizes = _drawn(pts, within, coreset_size(error, doubt), seed)
    names = np.array(sorted(sizes), int)
    n = np.array([sizes[c] for c in names.tolist()], float)
    centers, spread = np.array([r["c"] for r in within]), np.array([r["d2"] / r["n"] for r in within])
    cuts = np.searchsorted(cluster, [*names, names[-1] + 1]) if len(names) else []

    def means(points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Mean distances to the own cluster and all that may be the nearest other one; infinite for the rest."""
        near = np.sqrt(_squares(points, centers))
        most = np.sqrt(near**2 + spread)
        at = np.arange(len(own))
        most[at, own] = np.inf
        wanted = near <= most.min(1)[:, None] * (1 + 1e-9)
        wanted[at, own] = True
        out = np.where(wanted, 0.0, np.inf)
        for c in range(len(names)):
            rows = np.flatnonzero(wanted[:, c])
            if len(rows):
                some = points[rows]
                for q in _tiles(cuts[c + 1] - cuts[c], WIDE_TILE):
                    q = slice(q.start + cuts[c], q.stop + cuts[c])
                    out[rows, c] += _distances(some, x[q]) @ weight[q]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(names, batch.column("cluster").to_numpy())
            points, values = _matrix(batch.column("x"), batch.num_rows), np.zeros(len(own))
            for some in _tiles(len(own), TILE):
                mean, at = means(points[some], own[some]), np.arange(some.stop - some.start)
                mates = n[own[some]]
                a = mean[at, own[some]] * mates / np.maximum(mates - 1, 1)
                mean[at, own[some]] = np.inf
                values[some] = _silhouette(a, mean.min(1), mates)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(values)], ["id", "cluster", "silhouette"])

    return pts.select("id", "cluster", "x").mapInArrow(run, "id long, cluster int, silhouette double")


def silhouettes(pts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, cluster, silhouette) of every point against all points, by Euclidean distance."""
    return silhouettes_of_labelings(pts.select("id", F.array("cluster").alias("clusters"), "x"), block).select("id", "cluster", "silhouette")


def silhouette(pts: DataFrame, block: int = BLOCK, error: float | None = None) -> float | None:
    """The mean silhouette: exact, whatever the number of points, unless an error is given."""
    if error is not None:
        return silhouettes_by_coreset(pts, error).agg(F.avg("silhouette").alias("s")).first()["s"]
    return _mean_silhouettes(pts.select("id", F.array("cluster").alias("clusters"), "x"), 1, block)[0]


def _mean_silhouettes(pts: DataFrame, n: int, block: int = BLOCK) -> list[float | None]:
    """The mean silhouette of each labeling, exact; equal points count once, with their number."""
    different = _different(pts).persist()
    if different.count() > EXACT_UPTO:
        found = [silhouette(pts.select("id", F.get("clusters", F.lit(i)).alias("cluster"), "x"), error=ERROR) for i in range(n)]
    else:
        means = _weighted_silhouettes(different, block).groupBy("labeling").agg((F.sum(F.col("w") * F.col("silhouette")) / F.sum("w")).alias("s"))
        by = {r["labeling"]: r["s"] for r in means.collect()}  # a row for each labeling
        found = [by.get(i) for i in range(n)]
    different.unpersist()
    return found


def all_metrics(pts: DataFrame) -> dict[str, float | None]:
    """Inertia, silhouette, ch and db of the given labels."""
    return _from_centroids(_within(pts)) | {"silhouette": silhouette(pts)}


def _from_centroids(rows: list) -> dict[str, float | None]:
    return {"inertia": sum(r["d2"] for r in rows), "ch": _calinski_harabasz(rows), "db": _davies_bouldin(rows)}


def metrics_of_labelings(pts: DataFrame, n: int, error: float | None = None) -> list[dict[str, float | None]]:
    """``all_metrics`` of each of n labelings of points (id, clusters array<int>, x); exact distances are taken once."""
    if error is not None:
        means = [silhouette(pts.select("id", F.get("clusters", F.lit(i)).alias("cluster"), "x"), error=error) for i in range(n)]
    else:
        means = _mean_silhouettes(pts, n)
    within = within_labelings(pts)
    return [_from_centroids(within.get(i, [])) | {"silhouette": means[i]} for i in range(n)]


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n - 1) / 2


def rand_table(labelings: DataFrame, a: str, b: str, *by: str, number: str | None = None) -> DataFrame:
    """(*by, ari): adjusted Rand index of two labelings from their contingency table; 1 if they agree fully.

    A row may stand for a ``number`` of points.
    """
    cells = labelings.groupBy(*by, a, b).agg((F.sum(number) if number else F.count(F.lit(1))).alias("n"))
    joint = cells.groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias("s_ab"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(_pairs(F.col("n"))).alias(name))
    parts = [joint, side(a, "s_a"), side(b, "s_b")]
    if by:
        merged = parts[0].join(parts[1], list(by)).join(parts[2], list(by))
    else:
        one = lambda d: d.withColumn("_one", F.lit(1))
        merged = one(parts[0]).join(one(parts[1]), "_one").join(one(parts[2]), "_one").drop("_one")
    expected = F.try_divide(F.col("s_a") * F.col("s_b"), _pairs(F.col("total")))
    most = (F.col("s_a") + F.col("s_b")) / 2
    return merged.select(*by, F.coalesce(F.try_divide(F.col("s_ab") - expected, most - expected), F.lit(1.0)).alias("ari"))
