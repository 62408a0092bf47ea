"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Every table rotates a unit vector three times (random signs, then a fast Walsh-Hadamard
transform) for each of ``HASHES`` functions; a function's code is the axis nearest to the
rotated vector, with its sign.  A vector goes to the bucket of its codes and, as multiprobe,
to those with one code replaced by the runner-up.  Vectors of a bucket with equal labels are
compared in double precision, in blocks (small buckets many at a time); a pair is counted in the first table and the smallest
bucket where it meets, so no pair list is shuffled.  Blocks bound the rows of a task, whatever
the size of a bucket.

Equal vectors with equal labels form one class and are compared once.  Classes are found, and rows
matched with them, by salted keys, so a vector that very many rows share is spread over tasks.

Defined results: vectors that are null, zero or hold null or non-finite components, and those
without a label, link with nothing: n_links 0, their own component; vectors of different lengths
do not link with each other.  Rows that repeat a vec_id keep the smallest vector, rows without one
are left out; other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common
from gridsift.llm.components import connected_components

MIN_COSINE = 0.93
TABLES = 6
HASHES = 2
ROTATIONS = 3
#: Rows of a block of a bucket; a comparison takes two blocks.
BLOCK = 512
#: Rows of small buckets that a task takes at a time.
SLOT = 1_000
#: Parts of the rows that share one vector.
SALTS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def codes(unit: np.ndarray, tables: int = TABLES, seed: int = 11) -> np.ndarray:
    """Buckets of each unit vector: rows x tables x (1 + HASHES), its own bucket first."""
    n, dim = unit.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    out = np.zeros((n, tables, 1 + HASHES), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for h in range(HASHES):
            signs = np.random.default_rng([seed, t, h]).choice([-1.0, 1.0], (ROTATIONS, width))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            top = size.argmax(1)
            code = 2 * top + (y[rows, top] < 0)
            size[rows, top] = -1
            runner = size.argmax(1)
            best.append(code)
            second.append(2 * runner + (y[rows, runner] < 0))
        for probe in range(1 + HASHES):
            bucket = np.zeros(n, np.int64)
            for h in range(HASHES):
                bucket = bucket * (2 * width) + (second[h] if probe == h + 1 else best[h])
            out[:, t, probe] = bucket
    return out


def unit_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Which rows can be compared, and by length of a row: their positions and unit vectors in double precision."""
    ends = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    inner = column.values.slice(ends[0], ends[-1] - ends[0])
    flat = inner.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat) | ~inner.is_valid().to_numpy(zero_copy_only=False))])
    begin = ends[:-1] - ends[0]
    fine = (size > 0) & (bad[begin + size] == bad[begin])
    found, good = {}, np.zeros(len(column), bool)
    for dim in np.unique(size[fine]):
        at = np.flatnonzero(fine & (size == dim))
        x = flat[begin[at][:, None] + np.arange(dim)]
        top = np.abs(x).max(1)
        at, x = at[top > 0], x[top > 0] / top[top > 0, None]
        found[int(dim)] = (at, x / np.linalg.norm(x, axis=1, keepdims=True))
        good[at] = True
    return good, found


def hashed(classes: DataFrame, tables: int = TABLES) -> DataFrame:
    """(rep, label, weight, embedding, buckets) of every class whose vector can be compared."""
    common.ship(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, units = unit_rows(batch.column("embedding"))
            buckets = np.zeros((batch.num_rows, tables * (1 + HASHES)), np.int64)
            for at, x in units.values():
                buckets[at] = codes(x, tables).reshape(len(at), -1)
            kept = batch.filter(pa.array(good))
            ends = np.arange(kept.num_rows + 1, dtype=np.int32) * buckets.shape[1]
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets[good].ravel()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("rep", "label", "weight", "embedding")), places], ["rep", "label", "weight", "embedding", "buckets"])

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    return classes.select("rep", "label", "weight", "embedding").mapInArrow(
        run, f"rep long, label {kinds['label']}, weight long, embedding {kinds['embedding']}, buckets array<long>"
    )


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[q] = p
            out.append((a, b))
    return out


def _pairs_of(t: int, bucket: int, own: np.ndarray, other: np.ndarray, x: np.ndarray, buckets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of linked pairs of two blocks of a bucket that meet here first; one block against itself if ``other`` is ``own``."""
    near = x[own] @ x[other].T >= threshold
    if own is other:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = own[i], other[j]
    new = np.ones(len(i), bool)
    for earlier in range(t + 1):
        bi, bj = buckets[i, earlier], buckets[j, earlier]
        met = bi[:, :, None] == bj[:, None, :]
        if earlier < t:
            new &= ~met.any((1, 2))
        else:  # in this table, the smallest bucket where they meet counts
            new &= np.where(met, bi[:, :, None], np.iinfo(np.int64).max).min((1, 2)) == bucket
    return i[new], j[new]


def _compare(table: pa.Table, threshold: float, probes: int) -> pa.Table:
    """Links found in a slot of buckets: for each class the weight of new neighbours, and forest edges."""
    rows = table.combine_chunks().sort_by([(c, "ascending") for c in ("t", "label", "bucket", "i", "j")])
    vectors, hashes = (rows.column(c).combine_chunks() for c in ("embedding", "buckets"))
    t, bucket, block, bi, bj, rep, weight = (rows.column(c).to_numpy() for c in ("t", "bucket", "block", "i", "j", "rep", "weight"))
    code = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    _, units = unit_rows(vectors)
    size, x = np.zeros(len(rep), np.int64), np.zeros((len(rep), max(units, default=0)))
    for dim, (at, unit) in units.items():
        size[at] = dim
        x[at, :dim] = unit
    starts = hashes.offsets.to_numpy()
    buckets = hashes.values.to_numpy()[starts[0] : starts[-1]].reshape(len(rep), -1, probes)
    keys = np.stack([t, code, bucket, bi, bj])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
    links = np.zeros(len(rep), np.int64)
    edges: list[tuple[int, int]] = []
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rep)], strict=True):
        for dim in np.unique(size[lo:hi]):
            at = lo + np.flatnonzero(size[lo:hi] == dim)
            own = at[block[at] == bi[lo]]
            other = own if bi[lo] == bj[lo] else at[block[at] == bj[lo]]
            i, j = _pairs_of(int(t[lo]), int(bucket[lo]), own, other, x, buckets, threshold)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            edges += [(lo + a, lo + b) for a, b in _forest(hi - lo, i - lo, j - lo)]
    hit = np.flatnonzero(links)
    a, b = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    return pa.table(
        {
            "a": pa.array(np.concatenate([rep[hit], rep[a]]), pa.int64()),
            "b": pa.array(np.concatenate([rep[hit], rep[b]]), pa.int64()),
            "links": pa.array(np.concatenate([links[hit], np.zeros(len(edges), np.int64)]), pa.int64()),
        }
    )


def link(vectors: DataFrame, threshold: float = MIN_COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", "label").where("vec_id IS NOT NULL")
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("d")).first()
    if count["n"] != count["d"]:
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("r")).select("vec_id", "r.*")
    # A first step by salted keys: what of it belongs to one class is at most SALTS rows.
    parts = rows.where("label IS NOT NULL AND embedding IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    local = parts.groupBy("label", "embedding", "salt").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    local = common.materialise(local, "embedding-parts")
    classes = local.groupBy("label", "embedding").agg(F.min("first").alias("rep"), F.sum("weight").alias("weight"))
    good = common.materialise(hashed(classes, tables), "embedding-classes")
    probes = 1 + HASHES
    spots = F.transform(F.sequence(F.lit(0), F.lit(tables * probes - 1)), lambda i: F.struct(F.floor(i / probes).cast("int").alias("t"), F.get("buckets", i).alias("bucket")))
    placed = good.select("rep", "label", F.explode(F.array_distinct(spots)).alias("s")).select("rep", "label", "s.t", "s.bucket")
    sizes = placed.groupBy("t", "label", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = (
        placed.join(sizes, ["t", "label", "bucket"])
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "t", "label", "bucket", "block", "blocks", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"))
    )
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    slots = max(1, math.ceil(total / SLOT))
    alone = F.xxhash64("t", "label", "bucket", "i", "j")
    slot = F.when(F.col("blocks") > 1, alone).otherwise(F.pmod(F.xxhash64("t", "label", "bucket"), F.lit(slots)))
    full = spread.withColumn("slot", slot).drop("blocks").join(good.drop("label"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, threshold, probes)

    found = full.groupBy("slot").applyInArrow(compare, "a long, b long, links long")
    found = common.materialise(found, "embedding-links")
    counts = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("found"))
    named = local.select("label", "embedding", "salt").join(good.select("label", "embedding", "rep", "weight"), ["label", "embedding"])
    members = common.materialise(parts.join(named, ["label", "embedding", "salt"]).select("vec_id", "rep", "weight"), "embedding-members")
    common.discard(local)
    components = connected_components(found.where("links = 0").select("a", "b"))
    linked = members.join(counts, "rep", "left").join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        "vec_id",
        (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    return (
        rows.select("vec_id")
        .join(linked, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of equal labels, and the smallest id reachable over links.
ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e != 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {MIN_COSINE}),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
