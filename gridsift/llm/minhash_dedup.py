"""Near-duplicates by bottom-k sketches of word shingles from one hash function.

1. Each text gets its set of distinct shingles (hashes of ``WIDTH`` words), their number, a hash
   of the whole set and the ``SKETCH`` smallest values.  Texts with equal sets form one class.
2. Inverted lists: a class enters the lists of its ``KEYS`` smallest values but for its most
   frequent ones.  Two classes at the threshold with more than ``KEYS`` values share
   ``MUST_SHARE`` of these but for odds of about 5 in 100,000.  A set of n <= ``KEYS`` values
   shares at least ``PERCENT`` of its own; a partner with more than ``KEYS`` has at most
   n * (100 - ``PERCENT``) / ``PERCENT`` values that the set lacks, so of its keys at least
   ``KEYS`` less that many are shared, whatever the hashes.  Leaving out one less than the
   values surely shared, in one order of all values, keeps a list for the pair (prefix
   filtering); passages that many documents share thus stop making lists.
3. Pairs of a list pass if their sizes allow the threshold and the estimate from the sketch of
   the union is not clearly below it, which is exact where both sets fit in their sketches; full
   sets, made from the texts again, confirm them.
4. Only components are asked for, so pairs already joined are not compared again.  In star rounds
   the members of a list are compared with one of them: first the most typical one, whose values
   are the most frequent, as an original is among its edited copies; then one at random.  A last
   round compares the members of a list that are still in different components by their sketches,
   in blocks, so that only pairs that pass leave a task.  A group of n near copies of one original
   costs about n comparisons.

Defined results: a text without words, or null, has no shingle and links with nothing; one with
fewer than ``WIDTH`` words has the whole sequence as its only shingle; texts are used whole;
rows that repeat a doc_id count once, with the smallest text; rows without doc_id are left out; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm import common
from gridsift.llm.components import connected_components

WIDTH = 5
PERCENT = 75
#: Values of a sketch, as their upper 31 bits.
SKETCH = 128
KEYS = 48
MUST_SHARE = 24
#: A pair is dropped if its estimate is so many standard deviations below the threshold.
DEVIATIONS = 4.0
STAR_ROUNDS = 3
#: Members of a block of a list in the last round, and members that a task takes at a time.
BLOCK = 1_024
SLOT = 4_000
#: Parts of the texts that share one set.
SALTS = 32
#: Pairs whose sketches are compared at a time.
_AT_ONCE = 8_192
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text."""
    words = text.lower().split()
    hashes = common.word_hashes().of(words)
    if not words:
        return hashes
    if len(words) < width:
        whole = np.array([len(words)], np.uint64)
        for h in hashes:
            whole = whole * _FACTOR + h
        return common.mix(whole) >> _ONE
    n = len(hashes) - width + 1
    rolled = hashes[:n].copy()
    for i in range(1, width):
        rolled *= _FACTOR
        rolled += hashes[i : i + n]
    return np.unique(common.mix(rolled) >> _ONE)


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_sum, set_xor, keys, sketch) for every text.

    ``keys`` are the ``KEYS`` smallest hashes, ``sketch`` the upper 31 bits of the ``SKETCH`` smallest.
    """
    common.ship(docs.sparkSession)

    def lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, xors, keys, kept = [], [], [], [], []
            with np.errstate(over="ignore"):
                for text in common.text_bytes(batch.column("text")):
                    own = shingles(text or b"", width)
                    n.append(len(own))
                    spread = common.mix(own + _FACTOR)
                    sums.append(spread.sum(dtype=np.uint64).astype(np.int64))
                    xors.append(np.bitwise_xor.reduce(spread).astype(np.int64))
                    keys.append(own[:KEYS].astype(np.int64))
                    kept.append((own[:SKETCH] >> np.uint64(32)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), lists(keys, np.int64), lists(kept, np.int32)],
                ["doc_id", "n_shingles", "set_sum", "set_xor", "keys", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_sum long, set_xor long, keys array<long>, sketch array<int>")


def _shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of common values of the rows of two matrices, and the smallest one."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = both[:, 1:] == both[:, :-1]
    least = np.where(same, both[:, 1:], np.iinfo(np.int64).max).min(1)
    return same.sum(1), least


def passes(common_values: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether pairs are not clearly below the threshold.

    Up to the smaller of the two largest sketched values both sketches hold everything;
    ``upto`` counts values up to there.  The rest of the union is unknown.
    """
    seen = upto_a + upto_b - common_values
    union = (n_a + n_b) / (1 + PERCENT / 100)
    spread = np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / np.maximum(seen, 1) * np.maximum(0, 1 - seen / union))
    return common_values >= (PERCENT / 100 - DEVIATIONS * spread - 1e-9) * seen


def _upto(sketch: np.ndarray, size: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Number of a row's sketched values that are at most ``largest``."""
    inside = np.arange(sketch.shape[1]) < size[:, None]
    return ((sketch <= largest[:, None]) & inside).sum(1)


def near_pairs(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows pass by size and estimate."""
    out = np.zeros(len(i), bool)
    size = np.minimum(n, SKETCH)
    whole = n <= SKETCH
    last = np.where(whole, np.iinfo(np.int64).max, sketch[np.arange(len(n)), np.maximum(size, 1) - 1]) if len(n) else n
    for s in range(0, len(i), _AT_ONCE):
        p, q = i[s : s + _AT_ONCE], j[s : s + _AT_ONCE]
        fits = np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * PERCENT
        at = np.flatnonzero(fits)
        p, q = p[at], q[at]
        shared, _ = _shared(sketch[p], sketch[q])
        largest = np.minimum(last[p], last[q])
        out[s + at] = passes(shared, _upto(sketch[p], size[p], largest), _upto(sketch[q], size[q], largest), n[p], n[q])
    return out


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(rep, n, typical, v): the values under which a class is listed, where at least two classes are.

    ``typical`` adds up how often the values of a class occur.  Values of one class only come first
    in the order of frequency, so their number is enough.
    """
    entries = reps.select("rep", "n", F.explode("keys").alias("v"))
    often = entries.groupBy("v").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = entries.join(often, "v").select("rep", "n", F.struct("often", "v").alias("e"))
    own = ranked.groupBy("rep", "n").agg(F.sort_array(F.collect_list("e")).alias("es"))
    count = F.least(F.col("n"), F.lit(KEYS))
    fewest = F.least(F.ceil(count * PERCENT / 100), F.lit(KEYS) - F.floor(count * (100 - PERCENT) / PERCENT))
    must = F.when(F.col("n") <= KEYS, fewest).otherwise(MUST_SHARE)
    listed = F.size("es") - must + 1
    typical = F.aggregate("es", F.lit(0).cast("long"), lambda s, e: s + e["often"])
    first = F.when(listed > 0, F.slice("es", F.lit(1), F.greatest(listed, F.lit(1)).cast("int")))
    return own.select("rep", "n", typical.alias("typical"), F.explode(first).alias("e")).select("rep", "n", "typical", F.col("e.v").alias("v"))


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                made: dict[int, np.ndarray] = {}
                keep = []
                columns = [batch.column(c).to_pylist() for c in ("a", "b")] + [common.text_bytes(batch.column(c)) for c in ("text_a", "text_b")]
                for a, b, text_a, text_b in zip(*columns, strict=True):
                    sets = []
                    for key, text in ((a, text_a), (b, text_b)):
                        if key not in made:
                            made[key] = shingles(text, width)
                        sets.append(made[key])
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(sets[0]) + len(sets[1]) - both))
                    if len(made) > 512:
                        made.clear()
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = texts.join(ends, "doc_id", "left_semi")
    left, right = (needed.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that pass by their sketches, with the number of values they share."""
    left, right = (reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    both = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, _AT_ONCE) for i in range(0, whole.num_rows, _AT_ONCE)):
                m = batch.num_rows
                n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
                sketch = _matrix(pa.concat_arrays([batch.column("sketch_a"), batch.column("sketch_b")]), SKETCH, -1)
                i, j = np.arange(m), np.arange(m, 2 * m)
                shared, _ = _shared(sketch[i], sketch[j])
                near = near_pairs(n, sketch, i, j)
                rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared / np.minimum(np.maximum(n[i], n[j]), SKETCH))], ["a", "b", "estimate"])
                yield rows.filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long, estimate double")


def _matrix(column: pa.Array, width: int, first: int) -> np.ndarray:
    """A list column as a matrix; rows are filled up with values below ``first`` that occur once."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    rows, size = len(column), np.diff(ends)
    out = first - np.arange(rows * width, dtype=np.int64).reshape(rows, width)
    inside = np.arange(width) < size[:, None]
    out[inside] = values[ends[0] : ends[-1]]
    return out


def _block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of one slot: members of a list in different components that pass by their sketches.

    A pair counts in the list of the smallest value under which both are listed.
    """
    rows = table.combine_chunks().sort_by([("v", "ascending"), ("i", "ascending"), ("j", "ascending")])
    arrays = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    rep, n, v, component, block, bi, bj = (arrays[c].to_numpy() for c in ("rep", "n", "v", "component", "block", "i", "j"))
    sketch, listed = _matrix(arrays["sketch"], SKETCH, -1), _matrix(arrays["listed"], KEYS, -1)
    change = np.flatnonzero((v[1:] != v[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    found_a, found_b = [], []
    for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(v)], strict=True):
        if bi[lo] == bj[lo]:
            p, q = np.triu_indices(hi - lo, 1)
        else:
            own = np.flatnonzero(block[lo:hi] == bi[lo])
            other = np.flatnonzero(block[lo:hi] == bj[lo])
            p, q = np.repeat(own, len(other)), np.tile(other, len(own))
        p, q = p + lo, q + lo
        apart = component[p] != component[q]
        found_a.append(p[apart])
        found_b.append(q[apart])
    p, q = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b))
    keep = np.zeros(len(p), bool)
    for s in range(0, len(p), _AT_ONCE):
        a, b = p[s : s + _AT_ONCE], q[s : s + _AT_ONCE]
        keep[s : s + _AT_ONCE] = _shared(listed[a], listed[b])[1] == v[a]
    p, q = p[keep], q[keep]
    near = near_pairs(n, sketch, p, q)
    a, b = rep[p[near]], rep[q[near]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _last_pairs(now: DataFrame, reps: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a list that are in different components and pass by their sketches.

    ``now`` has (rep, n, v, component).  Lists of up to ``BLOCK`` members share slots; larger ones
    are cut into blocks that are compared two at a time, each pair of blocks in a task of its own.
    """
    mixed = now.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    total = mixed.agg(F.sum("members").alias("n")).first()["n"] or 0
    slots = max(1, math.ceil(total / SLOT))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = lists.groupBy("rep").agg(F.collect_list("v").alias("listed"))
    here = (
        now.join(mixed.select("v", "members"), "v")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("against", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"i": F.least("block", "against"), "j": F.greatest("block", "against")})
        .withColumn("slot", F.when(F.col("members") <= BLOCK, F.pmod(F.xxhash64("v"), F.lit(slots))).otherwise(F.xxhash64("v", "i", "j")))
    )
    full = here.select("slot", "rep", "n", "v", "component", "block", "i", "j").join(reps.select("rep", "sketch"), "rep").join(own, "rep")
    return full.groupBy("slot").applyInArrow(_block_pairs, "a long, b long")


def link(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    texts = common.unique_by_id(common.by_place(docs, "doc_id", "text")[0], "doc_id", "text").where("doc_id IS NOT NULL")
    sketched = common.materialise(sketches(texts, width), "sketches")
    same = ["n_shingles", "set_sum", "set_xor"]
    # By salted keys, so that a set that very many texts share is spread over tasks.
    salted = sketched.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = salted.where("n_shingles > 0").groupBy(*same, "salt").agg(F.min("doc_id").alias("first"))
    parts = common.materialise(parts, "equal-sets")
    named = parts.select(*same, "salt").join(parts.groupBy(*same).agg(F.min("first").alias("rep")), same)
    members = salted.join(named, [*same, "salt"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    members = common.materialise(members, "members")
    common.discard(parts)
    reps = sketched.where("n_shingles > 0").join(members.select("doc_id", "rep").where("doc_id = rep"), "doc_id")
    reps = common.materialise(reps.select("rep", F.col("n_shingles").alias("n"), "keys", "sketch"), "classes")
    lists = common.materialise(inverted_lists(reps), "lists")
    listed = lists.select(F.col("rep").alias("doc_id")).distinct()
    texts = common.materialise(texts.join(listed, "doc_id", "left_semi"), "listed-texts")

    components, found = None, []
    for turn in range(STAR_ROUNDS + 1):
        now = lists.withColumn("component", F.col("rep"))
        if components is not None:
            now = lists.join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component_id", "rep")).drop("component_id")
        if turn < STAR_ROUNDS:
            first = F.struct(F.col("rep").alias("first"), F.col("n").alias("first_n"), F.col("component").alias("first_component"))
            by = F.struct("typical", -F.col("rep")) if turn == 0 else F.struct(F.xxhash64("rep", F.lit(turn)), "rep")
            mixed = now.groupBy("v").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max_by(first, by).alias("head"))
            mixed = mixed.where("least < most").select("v", "head.*")
            pairs = now.join(mixed, "v").where((F.col("component") != F.col("first_component")) & _sizes_fit("n", "first_n"))
            rated = _promising(pairs.select(F.least("rep", "first").alias("a"), F.greatest("rep", "first").alias("b")), reps)
            best = Window.partitionBy("a").orderBy(F.desc("estimate"), "b")
            chosen = rated.union(rated.select("b", "a", "estimate")).withColumn("place", F.row_number().over(best)).where("place <= 2")
            pairs = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            pairs = _last_pairs(now.select("rep", "n", "v", "component"), reps, lists)
        pairs = common.materialise(pairs.select("a", "b"), "pairs")
        edges = common.materialise(_verify(pairs, texts, width), "confirmed")
        common.discard(pairs)
        if edges.limit(1).count():
            found.append(edges)
            components = connected_components(reduce(DataFrame.union, found))
    common.discard(sketched, reps, lists, texts, *found)
    if components is not None:
        out = members.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = members.withColumn("component_id", F.lit(None).cast("long"))
    component = F.coalesce("component_id", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Full sets of shingles as text, all pairs that share one, and the smallest id reachable over links.
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {WIDTH} - 1], ' ')))) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""
