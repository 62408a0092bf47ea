"""Centroid clustering by Lloyd's rounds with Hamerly's bounds, exact in integers.

Every vector keeps its centroid, one upper bound on the distance to it and one lower bound on the distance to
the second nearest.  When centroids move, the upper bound grows by the own centroid's drift and the lower one
shrinks by the largest drift of the others; a vector whose upper bound stays below the lower one, or below half
the distance from its centroid to the nearest other one, keeps its centroid without being looked at.  Of the
others the upper bound is taken anew, and where that does not decide, all centroids are scanned in exact
integers.  Bounds are rounded outwards, and a vector is skipped only on strict inequality, so ties go to the
smaller number as in a full scan.

Vectors and bounds are one table that is written anew in every round, so a lost executor costs one round's
share at most.  Sums change by the vectors that changed their centroid only, added up by Spark before the
driver sees a row for each centroid.

Defined results: kept are vectors with exactly ``width`` components, none null, non-finite or beyond ``LARGEST``
after scaling; all others have no row.  A row without vec_id is clustered like any other but is never a first
centroid; rows that repeat a vec_id are vectors of their own, and of equal hashes the smaller vector comes first.
With fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common

CENTROIDS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, 2
#: Largest absolute component after scaling; squared distances of up to 2 ** 10 components fit in 64 bits.
LARGEST = 2**26
#: Relative margin by which bounds are rounded outwards; far above the error of a double.
MARGIN = 1e-12
_STATE = "vec_id long, x array<int>, before int, cluster int, upper double, lower double, scans int, distance long"


def scaled(df: DataFrame, scale: int, width: int | None = None) -> DataFrame:
    """(vec_id, x array<int>): floor(scale * component) of the vectors that take part."""
    placed, _ = common.by_place(df, "vec_id", "embedding")
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) <= LARGEST))
    good = F.col("embedding").isNotNull() & F.coalesce(fits, F.lit(False))
    if width is not None:
        good = good & (F.size("embedding") == width)
    return placed.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<int>").alias("x"))


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to all centroids."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centers).max(initial=0)), 1)
    kind = np.float64 if 4 * x.shape[1] * most**2 < 2**53 else np.int64  # products of doubles are exact below that
    a, b = x.astype(kind), centers.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - MARGIN), 0)


class Step:
    """Centroids of a round, how far each has moved since the last one, and half the gap to its nearest other one."""

    def __init__(self, centers: np.ndarray, old: np.ndarray | None) -> None:
        self.centers = centers
        k = len(centers)
        apart = squared(centers, centers).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half_gap = _down(np.sqrt(apart.min(1, initial=np.inf)) / 2)
        moved = ((centers - old) ** 2).sum(1).astype(float) if old is not None else np.zeros(k)
        self.drift = _up(np.sqrt(moved))
        order = np.argsort(-self.drift, kind="stable")
        self.others_drift = np.full(k, self.drift[order[0]] if k else 0.0)
        if k:
            self.others_drift[order[0]] = self.drift[order[1]] if k > 1 else 0.0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroids, new bounds, and which vectors were scanned; a cluster of -1 was never assigned."""
        known = cluster >= 0
        upper = np.where(known, _up(upper + self.drift[cluster]), np.inf)
        lower = np.where(known, _down(lower - self.others_drift[cluster]), 0.0)
        safe = np.maximum(lower, np.where(known, self.half_gap[cluster], 0.0))
        unsure = np.flatnonzero(upper >= safe)
        tight = unsure[known[unsure]]
        upper[tight] = _up(np.sqrt(((x[tight] - self.centers[cluster[tight]]) ** 2).sum(1).astype(float)))
        scan = unsure[upper[unsure] >= safe[unsure]]
        cluster, scanned = cluster.copy(), np.zeros(len(x), bool)
        for some in (scan[i : i + 4096] for i in range(0, len(scan), 4096)):
            far = squared(x[some], self.centers)
            near = far.argmin(1)
            rows = np.arange(len(some))
            upper[some] = _up(np.sqrt(far[rows, near].astype(float)))
            far[rows, near] = np.iinfo(np.int64).max
            lower[some] = _down(np.sqrt(far.min(1).astype(float)))
            cluster[some] = near
        scanned[scan] = True
        return cluster, upper, lower, scanned

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((x - self.centers[cluster]) ** 2).sum(1)


def _pass(state: DataFrame, step: Step) -> DataFrame:
    """The table of vectors and bounds after one assignment."""
    width = step.centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy().reshape(-1, width).astype(np.int64)
            old = column("cluster")
            new, upper, lower, scanned = step.assign(x, old, column("upper"), column("lower"))
            made = {"before": old, "cluster": new.astype(np.int32), "upper": upper, "lower": lower, "scans": column("scans") + scanned.astype(np.int32), "distance": step.distance(x, new)}
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), *map(pa.array, made.values())], names=["vec_id", "x", *made])

    return state.mapInArrow(run, _STATE)


def _moves(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to, and take from, counts and sums of each."""
    changed = state.where("cluster != before").select("x", F.inline(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")))))
    sums = changed.where("c >= 0").groupBy("c").agg(F.sum("sign").alias("n"), *(F.sum(F.get("x", F.lit(i)).cast("long") * F.col("sign")).alias(f"s{i}") for i in range(width)))
    counts, totals = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for row in sums.collect():  # a row for each centroid
        counts[row["c"]], totals[row["c"]] = row["n"], [row[f"s{i}"] for i in range(width)]
    return counts, totals


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in rows], np.int64)


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans) of every kept vector, and the final centroids.

    ``scans`` counts the passes, of rounds + 1, in which all centroids were scanned for the vector.
    """
    spark = df.sparkSession
    common.ship(spark)
    vectors = scaled(df, scale, width)
    start = vectors.withColumns({"before": F.lit(-1), "cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0), "scans": F.lit(0), "distance": F.lit(0).cast("long")})
    state = common.materialise(start, "cluster-state")
    centers = first_centroids(state, k, seed)
    if not len(centers):
        if state.isEmpty():
            return state.select("vec_id", "cluster", "distance", "scans"), np.zeros((0, width), np.int64)
        centers = np.array([state.select(F.min("x")).first()[0]], np.int64)  # vectors, but none with an id
    counts, totals = np.zeros(len(centers), np.int64), np.zeros((len(centers), width), np.int64)
    old = None
    for turn in range(rounds + 1):
        before, state = state, common.materialise(_pass(state, Step(centers, old)), "cluster-state")
        common.discard(before)
        if turn < rounds:
            n, s = _moves(state, len(centers), width)
            counts, totals, old = counts + n, totals + s, centers
            centers = np.where(counts[:, None] > 0, totals // np.maximum(counts, 1)[:, None], old)  # rounds down, whatever the sign
    return state.select("vec_id", "cluster", "distance", "scans"), centers


def centroid_digests(centers: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centers = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    rows = [(i, sums.get(i, 0), sum(sums.values()), digest) for i, digest in enumerate(centroid_digests(centers))]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out; components are whole numbers in doubles, so sums and products are exact."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x AS m FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CENTROIDS})",
    ]
    near = "SELECT id, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, m) + list_inner_product(m, m), c := cluster)) AS s FROM v, c{r} GROUP BY id"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT s.c AS cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r} JOIN v USING (id))")
            parts.append(f"m{r} AS (SELECT cluster, list(e ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(e) / count(*)) AS e FROM s{r} GROUP BY cluster, i) GROUP BY cluster)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (cluster))")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(s.c AS INTEGER) AS cluster, CAST(s.d AS BIGINT) AS distance, CAST(sum(s.d) OVER (PARTITION BY s.c) AS BIGINT) AS cluster_inertia, CAST(sum(s.d) OVER () AS BIGINT) AS inertia,
          sha256(list_aggregate(list_transform(m, lambda e: CAST(e AS BIGINT)), 'string_agg', ',')) AS centroid_sha256
        FROM a{last} JOIN v USING (id) JOIN c{last} ON c{last}.cluster = s.c"""


ORACLE = _oracle()
