"""Exact top-k search by inner product with block-at-a-time pruning.

A component and its sign are a term, and rows are documents.  Documents are put in an order in which like ones are
neighbours (by the nearest of ``PIVOTS`` vectors, drawn by a hash), and ranges of ``BLOCK`` documents are
blocks.  A block stores its forward index (the documents' components) and the largest and the smallest value of
every component, that is the maxima of both terms.  The sum of a query's weights times a block's term maxima bounds
every score in it.  For each query blocks are ordered by that bound and scored through their forward
indexes, some at a time, until the bounds fall below the k-th best score; a block whose bound equals it is
scored only if it holds an id that would win the tie.

Blocks are dealt to shards of up to ``SHARD`` documents.  A query is first searched in the shard where its own vector
lies, which gives a k-th score to beat; then the shards whose own term maxima can beat it are found by
comparing groups of queries with chunks of shard summaries, and only there the query is searched.
Tasks hold one shard and one group of queries, so memory is bounded, and neither queries nor summaries are
broadcast or collected.

Defined results: vectors that are null, or hold null or non-finite components or one beyond ``centroid_clusters.LARGEST`` after scaling, and rows
without an id take no part; of rows that repeat an id the smallest vector stays; where lengths differ, a missing component
counts as 0; ties go to the smaller id; a query with fewer than k others gets all of them; an empty table, or
one without queries, gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm import common
from gridsift.llm.centroid_clusters import scaled, squared

K, SCALE, EVERY = 10, 1024, 100
#: Documents of a block and of a shard, queries of a group, shards of a chunk of summaries.
BLOCK, SHARD, GROUP, CHUNK = 128, 65_536, 16_384, 1_024
#: Vectors that give the order of documents; the order changes the work, never the result.
PIVOTS = 256
#: Queries scored at a time within a task, and cells of a matrix of bounds or scores.
AT_ONCE, CELLS = 512, 4_000_000
_BLOCKS = "shard int, block int, ids binary, x binary, asked binary, top binary, low binary"
_ASKED = "query_id long, x binary, shard int"
_HITS = "query_id long, vec_id long, score long"
_ROUTED = "query_id long, group int, x binary, limit_score long, limit_id long, shard int"
#: What any candidate beats.
_LEAST, _NO_ID = -(2**63), 2**63 - 1


def _matrix(rows: list, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int32).reshape(-1, width)


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, np.int32).tobytes()


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where all products and their sums are exact in them."""
    most = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1)
    return np.float64 if most * a.shape[1] < 2**53 else np.int64


def bounds(queries: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with anything between ``low`` and ``top``."""
    kind = _kind(queries, np.concatenate([top, low]))
    q = queries.astype(kind)
    return (np.maximum(q, 0) @ top.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T).astype(np.int64)


class Best:
    """The k best (score, id) of some queries, and what a candidate has to beat."""

    def __init__(self, n: int, k: int, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.k, self.query, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.limit, self.limit_id = score.copy(), vec_id.copy()

    def beats(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
        """Whether a candidate is better than the k-th one known so far, or is that one."""
        limit = self.limit[query]
        return (score > limit) | ((score == limit) & (vec_id <= self.limit_id[query]))

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        query, score, vec_id = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, vec_id)))
        order = np.lexsort((vec_id, -score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        first = np.searchsorted(query, query, "left")
        place = np.arange(len(query)) - first
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], vec_id[kept]
        full = place == self.k - 1
        q, s, i = query[full], score[full], vec_id[full]
        better = (s > self.limit[q]) | ((s == self.limit[q]) & (i < self.limit_id[q]))
        self.limit[q[better]], self.limit_id[q[better]] = s[better], i[better]


class Shard:
    """Blocks of documents with their term maxima and forward indexes."""

    def __init__(self, blocks: pa.Table, width: int) -> None:
        column = lambda name: blocks.column(name).to_pylist()
        self.ids = [np.frombuffer(b, np.int64) for b in column("ids")]
        self.x = [_matrix([b], width) for b in column("x")]
        self.top, self.low = _matrix(column("top"), width), _matrix(column("low"), width)
        self.first = np.array([i.min() for i in self.ids], np.int64)
        self.scored = 0  # pairs of a query and a block

    def search(self, ids: np.ndarray, queries: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> Best:
        """The documents that beat (score, vec_id), up to k for each query, without the query's own."""
        best = Best(len(ids), k, score, vec_id)
        bound = bounds(queries, self.top, self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        at, step, alive = 0, 1, np.arange(len(ids))
        while at < len(self.ids) and len(alive):
            blocks = order[alive, at : at + step]
            able = best.beats(np.repeat(alive, blocks.shape[1]), bound[alive, at : at + step].ravel(), self.first[blocks].ravel())
            pairs_query, pairs_block = np.repeat(alive, blocks.shape[1])[able], blocks.ravel()[able]
            by_block = np.argsort(pairs_block, kind="stable")
            cuts = np.flatnonzero(np.diff(pairs_block[by_block], prepend=-1))
            for rows in np.split(by_block, cuts[1:]) if len(by_block) else ():
                self._score(int(pairs_block[rows[0]]), pairs_query[rows], ids, queries, best)
            at, step = at + step, 2 * step
            if at < len(self.ids):
                alive = alive[bound[alive, at] >= best.limit[alive]]
        return best

    def _score(self, block: int, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        self.scored += len(rows)
        x, own = self.x[block], self.ids[block]
        kind = _kind(queries, x)
        found = (queries[rows].astype(kind) @ x.astype(kind).T).astype(np.int64)
        better = (found > best.limit[rows, None]) | ((found == best.limit[rows, None]) & (own[None] <= best.limit_id[rows, None]))
        better &= own[None] != ids[rows, None]
        q, d = np.nonzero(better)
        if len(q):
            best.add(rows[q], found[q, d], own[d])


def blocks_of(vectors: DataFrame, is_query: Column, width: int, n: int) -> DataFrame:
    """Documents (vec_id, x) in order, as blocks in shards; ``asked`` are the places of queries in a block."""
    digest = F.sha2(F.col("vec_id").cast("string"), 256)
    drawn = vectors.select("x", digest.alias("d"), "vec_id").orderBy("d", "vec_id").limit(PIVOTS).collect()  # PIVOTS rows
    pivots = np.array([r["x"] + [0] * (width - len(r["x"])) for r in drawn], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = padded(some.column("x"), width)
                far = squared(x, pivots)  # whole numbers: a task that runs again deals its rows alike
                columns = [some.column("vec_id"), some.column("asked"), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "asked", "x", "cell", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in enumerate(_in_stretches(batches, BLOCK)):
            x, ids = _matrix(table.column("x").to_pylist(), width), table.column("vec_id").to_numpy().astype(np.int64)
            asked = np.flatnonzero(table.column("asked").to_numpy()).astype(np.int32)
            row = {"shard": table.column("shard")[0].as_py(), "block": block, "ids": ids.tobytes(), "x": _packed(x), "asked": asked.tobytes(), "top": _packed(x.max(0)), "low": _packed(x.min(0))}
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for v in row.values()], names=list(row))

    shards = max(math.ceil(n / SHARD), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(n / BLOCK)), 1)
    marked = vectors.select("vec_id", "x", F.coalesce(is_query, F.lit(False)).alias("asked"))
    order = ["cell", "far", "vec_id"]
    ordered = marked.mapInArrow(place, "vec_id long, asked boolean, x binary, cell int, far long").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return ordered.select("vec_id", "asked", "x", F.spark_partition_id().alias("shard")).mapInArrow(pack, _BLOCKS)


def queries_of(blocks: DataFrame, width: int, n: int) -> DataFrame:
    """(query_id, x, shard, group): groups of about ``GROUP`` queries that lie near each other."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, x, asked in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "x", "asked")), strict=True):
                at = np.frombuffer(asked, np.int32)
                rows = [row.tobytes() for row in _matrix([x], width)[at]]
                columns = [pa.array(np.frombuffer(ids, np.int64)[at]), pa.array(rows, pa.binary()), pa.array([shard] * len(at), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "x", "shard"])

    rows = blocks.select("shard", "ids", "x", "asked").mapInArrow(unpack, _ASKED)
    return rows.repartitionByRange(math.ceil(n / GROUP), "shard", "query_id").withColumn("group", F.spark_partition_id())


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers of equal width; missing components are 0."""
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    out = np.zeros((len(lists), width), np.int32)
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], lengths)] = values[ends[0] : ends[-1]]
    return out


def _in_stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows of all batches, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, min(size - rows, batch.num_rows - at))
            held.append(part)
            at, rows = at + part.num_rows, rows + part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _searcher(width: int, k: int):
    """Searches the queries of a group in the blocks of a shard."""

    def run(_key: tuple, blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if blocks.num_rows and asked.num_rows:
            shard = Shard(blocks, width)
            ids, x = asked.column("query_id").to_numpy(), _matrix(asked.column("x").to_pylist(), width)
            score, vec_id = asked.column("limit_score").to_numpy(), asked.column("limit_id").to_numpy()
            step = max(1, min(AT_ONCE, CELLS // blocks.num_rows))
            for some in (slice(i, i + step) for i in range(0, len(ids), step)):
                best = shard.search(ids[some], x[some], score[some], vec_id[some], k)
                found.append((ids[some][best.query], best.id, best.score))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def _router(width: int):
    """The shards of a chunk in which a query can still find something, but for its own."""

    def run(_key: tuple, summaries: pa.Table, asked: pa.Table) -> pa.Table:
        shards, first = summaries.column("shard").to_numpy(), summaries.column("first_id").to_numpy()
        top, low = (summaries.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width) for c in ("top", "low"))
        x, home, place = _matrix(asked.column("x").to_pylist(), width), asked.column("home").to_numpy(), []
        score, vec_id = asked.column("limit_score").to_numpy(), asked.column("limit_id").to_numpy()
        for i in range(0, len(x), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            bound = bounds(x[some], top, low)
            able = (bound > score[some, None]) | ((bound == score[some, None]) & (first[None] < vec_id[some, None]))
            able &= shards[None] != home[some, None]
            q, s = np.nonzero(able)
            place.append((q + i, shards[s]))
        q, s = (np.concatenate(p) for p in zip(*place, strict=True)) if place else (np.zeros(0, np.int64),) * 2
        return asked.select(["query_id", "group", "x", "limit_score", "limit_id"]).take(pa.array(q)).append_column("shard", pa.array(s, pa.int32()))

    return run


def _summaries(blocks: DataFrame, width: int) -> DataFrame:
    """(shard, first_id, top, low) of every shard: a row for each partition's stretch first, then one for each shard."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for shard, ids, top, low in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "top", "low")), strict=True):
                top, low, first = np.frombuffer(top, np.int32), np.frombuffer(low, np.int32), int(np.frombuffer(ids, np.int64).min())
                old = found.get(shard)
                found[shard] = [first, top, low] if old is None else [min(first, old[0]), np.maximum(top, old[1]), np.minimum(low, old[2])]
        for shard, (first, top, low) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([top.tolist()], pa.list_(pa.int32())), pa.array([low.tolist()], pa.list_(pa.int32()))], names=["shard", "first_id", "top", "low"])

    parts = blocks.select("shard", "ids", "top", "low").mapInArrow(merge, "shard int, first_id long, top array<int>, low array<int>")
    each = lambda name, f: F.array(*(f(F.get(name, F.lit(i))) for i in range(width))).alias(name)
    return parts.groupBy("shard").agg(F.min("first_id").alias("first_id"), each("top", F.max), each("low", F.min))


def search(df: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of every row for which ``is_query``, a condition on vec_id, holds."""
    spark = df.sparkSession
    common.ship(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors = common.materialise(common.unique_by_id(scaled(df, scale).where("vec_id IS NOT NULL"), "vec_id", "x"), "topk-vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.count_if(is_query).alias("queries")).first()
    if not size["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size["width"])
    blocks = common.materialise(blocks_of(vectors, is_query, width, size["n"]), "topk-blocks")
    asked = common.materialise(queries_of(blocks, width, size["queries"]), "topk-queries")
    common.discard(vectors)

    unknown = asked.withColumns({"limit_score": F.lit(_LEAST), "limit_id": F.lit(_NO_ID)})
    home = blocks.groupBy("shard").cogroup(unknown.groupBy("shard")).applyInArrow(_searcher(width, k), _HITS)
    home = common.materialise(home, "topk-home")
    worst = F.max(F.struct((-F.col("score")).alias("score"), "vec_id"))
    last = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), worst.alias("worst")).where(F.col("found") >= k)
    known = asked.withColumnRenamed("shard", "home").join(last, "query_id", "left")
    known = known.withColumns({"limit_score": F.coalesce(-F.col("worst.score"), F.lit(_LEAST)), "limit_id": F.coalesce("worst.vec_id", F.lit(_NO_ID))}).drop("found", "worst")

    summaries = common.materialise(_summaries(blocks, width).withColumn("chunk", (F.col("shard") / CHUNK).cast("int")), "topk-summaries")
    upto = lambda df, c: F.explode(F.sequence(F.lit(0), F.lit(df.agg(F.max(c)).first()[0])))
    asking, answering = known.withColumn("chunk", upto(summaries, "chunk")), summaries.withColumn("group", upto(asked, "group"))
    routed = answering.groupBy("chunk", "group").cogroup(asking.groupBy("chunk", "group")).applyInArrow(_router(width), _ROUTED)
    routed = common.materialise(routed, "topk-routed")
    copies = blocks.join(routed.select("shard", F.col("group").alias("for_group")).distinct(), "shard")
    away = copies.groupBy("shard", "for_group").cogroup(routed.groupBy("shard", "group")).applyInArrow(_searcher(width, k), _HITS)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.union(away).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
