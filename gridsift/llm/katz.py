"""Language-model scoring by Katz backoff with Good-Turing discounts.

Tokens are the words of a text and one end.  Documents are cut into blocks of about
``BLOCK_BYTES`` by ranges of doc_id.  Texts travel packed, many in one compressed row.

1. A block asks for each n-gram it holds, by 64-bit hash: its distinct n-grams of every order,
   with their counts in training documents, go to the reducer of their hash range.
2. A reducer adds up the counts, notes counts of counts, stores its range of the count table, and
   answers each block in the order of the block's own sorted n-grams, so no hash travels back.
   It also names one block as the owner of each n-gram.
3. For each context the owners add up the discounted and the lower-order probabilities of its
   n-grams, which gives the exact backoff weight; blocks ask for weights in the same way.
4. A block evaluates its tokens: recursively, the discounted probability of a retained n-gram,
   else the backoff weight times the probability of the shorter one.

Every n-gram seen in training is retained, those seen once (``MIN_COUNT``) with their Good-Turing
discount; what the discounts leave goes to backoff.  All unknown tokens are one type, whose probability is the mass that discounts
leave at order 1.  Everything that grows with the corpus stays in partitioned tables.

Defined results: a null or empty text has the end as its only token; rows are scored one by one,
so repeated rows count and score like any others (where very many are equal they are carried as one row with
their number, and written out again at the end); without training tokens every probability is
that of the unknown type, 1.  Rows without doc_id belong to no fold and are not learned from; they
are dealt to all blocks by their texts.  Texts are used whole, however long; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common

ORDER = 2
MIN_COUNT = 1
#: Counts above this are not discounted.
GOOD_TURING_MAX = 5
BLOCK_BYTES = 12_000_000
MIN_BLOCKS = 64
MAX_RANGES = 1024
#: Most keys of very often repeated rows that are broadcast.
MOST_BROADCAST = 100_000
#: Text bytes that a task holds before it hands on what it made of them.
FLUSH_BYTES = 15_000_000
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashes of the tokens and n-grams of some texts, one text after the other."""

    def __init__(self, texts: pa.Array, order: int) -> None:
        pads = order - 1
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        coded = split.flatten().dictionary_encode()
        distinct = common.as_binary(coded.dictionary).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        which = coded.indices.to_numpy()
        if b"" in distinct:  # around white space at the ends
            filled = which != (empty := distinct.index(b""))
            which, owner = which[filled] - (which[filled] > empty), owner[filled]
            hashes = np.delete(hashes, empty)
        self.sizes = np.bincount(owner, minlength=len(texts)) + 1
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(len(self.doc)) + (self.doc + 1) * pads
        self.table = np.append(hashes, END)
        self.word = np.full(len(self.doc), len(hashes))
        self.word[np.arange(len(which)) + owner] = which
        flat = np.full(len(self.doc) + pads * len(texts), START, np.uint64)
        flat[at] = self.table[self.word]
        self.first = np.zeros(len(self.doc), bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.grams, self.contexts = {1: flat[at]}, {}
        with np.errstate(over="ignore"):
            shorter = flat
            for n in range(2, order + 1):
                before = np.roll(shorter, 1)
                longer = common.mix(before * _FACTOR + flat)
                self.contexts[n] = before[at]
                self.grams[n] = longer[at]
                shorter = longer


    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted n-grams, and the place of each token's; words are sorted as a table, not token by token."""
        if n == 1:
            ordered, place = np.unique(self.table, return_inverse=True)
            return ordered, place[self.word]
        return np.unique(self.grams[n], return_inverse=True)


def _cuts(ordered: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, begins in sorted hashes; then the length."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    return np.r_[0, np.searchsorted(ordered, edges), len(ordered)]


def packed(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte plane by byte plane: the upper planes are zeros, which compress."""
    return np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _request_rows(block: int, texts: pa.Array, weight: np.ndarray, order: int, buckets: int) -> Iterator[tuple]:
    grams = Grams(texts, order)
    learned = weight[grams.doc]
    for n in range(1, order + 1):
        distinct, at = grams.distinct(n)
        counts = np.bincount(at, learned, len(distinct))
        counts = counts.astype("<u4" if counts.max(initial=0) < 2**32 else "<u8")
        cuts = _cuts(distinct, buckets)
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                part = slice(cuts[b], cuts[b + 1])
                yield n, b, block, packed(distinct[part]), counts[part].tobytes()


_REQUEST = "n int, bucket int, block int, hashes binary, counts binary"


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def requests(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    kinds = [("n", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                table = pa.Table.from_batches(parts).combine_chunks()
                weight = table.column("copies").to_numpy() * table.column("train").to_numpy()
                weight = weight.astype(np.uint8) if weight.max(initial=0) < 256 else weight  # one byte a token
                yield _table(list(_request_rows(block, table.column("text").combine_chunks(), weight, order, buckets)), kinds)
            held.clear()

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for at in common.portions(batch.column("text"), FLUSH_BYTES):
                part, own = batch.slice(at.start, at.stop - at.start), blocks[at]
                for block in np.unique(own):
                    held.setdefault(int(block), []).append(part.filter(pa.array(own == block)))
                size += part.nbytes
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("block", "train", "copies", "text").mapInArrow(run, _REQUEST)


def _by_block(table: pa.Table, *columns: str) -> dict[int, list[list]]:
    out: dict[int, list[list]] = {}
    for block, *values in zip(table.column("block").to_pylist(), *(table.column(c).to_pylist() for c in columns), strict=True):
        out.setdefault(block, []).append(values)
    return out


def _answer_counts(key: tuple, table: pa.Table) -> pa.Table:
    """Totals for each block, the stored range of the count table, and counts of counts."""
    n, bucket = key[0].as_py(), key[1].as_py()
    asked = {}
    for block, parts in _by_block(table, "hashes", "counts").items():
        hashes = np.concatenate([unpacked(h) for h, _ in parts])
        sizes = [len(h) // 8 for h, _ in parts]
        counts = np.concatenate([np.frombuffer(c, "<u4" if len(c) == 4 * n else "<u8") for (_, c), n in zip(parts, sizes, strict=True)])
        asked[block] = (hashes, counts)
    every = np.concatenate([h for h, _ in asked.values()])
    distinct, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in asked.values()]), len(distinct)).astype(np.int64)
    owner = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owner, at, np.repeat(list(asked), [len(h) for h, _ in asked.values()]))
    rows = []
    for block, (hashes, _) in asked.items():
        place = np.searchsorted(distinct, np.unique(hashes))
        rows.append(("answer", n, bucket, block, total[place].astype("<u8").tobytes(), np.packbits(owner[place] == block).tobytes()))
    kept = total >= (1 if n == 1 else MIN_COUNT)
    rows.append(("table", n, bucket, -1, total[kept].astype("<u8").tobytes(), packed(distinct[kept])))
    seen = total[total > 0]
    stats = np.r_[np.bincount(np.minimum(seen, GOOD_TURING_MAX + 2), minlength=GOOD_TURING_MAX + 3)[: GOOD_TURING_MAX + 2], len(seen), seen.sum()]
    rows.append(("stats", n, bucket, -1, stats.astype("<i8").tobytes(), b""))
    kinds = [("kind", pa.string()), ("n", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("totals", pa.binary()), ("more", pa.binary())]
    return pa.Table.from_batches([_table(rows, kinds)])


@dataclass
class Discounts:
    """What is known of the whole corpus: small, whatever its size."""

    order: int
    buckets: int
    documents: int
    tokens: int
    types: int
    by_order: dict[int, np.ndarray]  # factor of a count, the last one for all larger counts
    unigram_scale: float = 1.0
    unknown: float = 1.0
    counts_of_counts: dict[int, np.ndarray] = field(default_factory=dict)


def good_turing(counts_of_counts: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to k + 1 (counts_of_counts[r] n-grams occur r times)."""
    k = GOOD_TURING_MAX
    factors = np.ones(k + 2)
    n = counts_of_counts.astype(float)
    if n[1] > 0:
        common_part = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            if n[r] > 0 and common_part < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common_part) / (1 - common_part)
                if 0 < d < 1:
                    factors[r] = d
    return factors


def _discounts(sums: dict[int, np.ndarray], order: int, buckets: int, documents: int) -> Discounts:
    k = GOOD_TURING_MAX
    by_order = {n: good_turing(s[: k + 2]) for n, s in sums.items()}
    types, tokens = int(sums[1][-2]), int(sums[1][-1])
    out = Discounts(order, buckets, documents, tokens, types, by_order, counts_of_counts={n: s[: k + 2] for n, s in sums.items()})
    if tokens:
        n = sums[1][: k + 2].astype(float)
        kept = 1.0 - sum((1 - by_order[1][r]) * r * n[r] for r in range(1, k + 1)) / tokens
        out.unknown = max(1.0 - kept, 1.0 / (tokens + 1))
        out.unigram_scale = (1.0 - out.unknown) / kept
    return out


class Evaluator:
    """A block's n-grams with the answers to its requests."""

    def __init__(self, texts: pa.Array, answers: pa.Table, d: Discounts) -> None:
        self.d, self.g = d, Grams(texts, d.order)
        self.totals, self.owned, self.place, self.distinct, self.sums, self.seen = {}, {}, {}, {}, {}, {}
        rows: dict[tuple, list] = {}
        for kind, n, bucket, totals, more in zip(*(answers.column(c).to_pylist() for c in ("kind", "n", "bucket", "totals", "more")), strict=True):
            rows.setdefault((kind, n), []).append((bucket, totals, more))
        for n in range(1, d.order + 1):
            self.distinct[n], self.place[n] = self.g.distinct(n)
            own = sorted(rows.get(("answer", n), []))
            self.totals[n] = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(t, "<i8") for _, t, _ in own)])
            self.owned[n] = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m, np.uint8), count=len(t) // 8).astype(bool) for _, t, m in own)])
        for n in range(2, d.order + 1):
            if sums := sorted(rows.get(("sums", n), [])):
                self.sums[n] = tuple(np.concatenate([np.frombuffer(row[k], "<f8") for row in sums]) for k in (1, 2))

    def context_counts(self, n: int) -> np.ndarray:
        """How often the context of each token's n-gram occurs in training."""
        before = np.roll(self.totals[n - 1][self.place[n - 1]], 1)
        return np.where(self.g.first, self.d.documents, before)

    def contexts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted contexts of order n, and the place of each token's: the n-gram one shorter that ends
        at the token before it, or the padding for a first token."""
        if n not in self.seen:
            before, first = np.roll(self.place[n - 1], 1), self.g.first
            used = np.zeros(len(self.distinct[n - 1]), bool)
            used[before[~first]] = True
            found, padding = self.distinct[n - 1][used], self.g.contexts[n][0]
            cut = int(np.searchsorted(found, padding))
            at = (np.cumsum(used) - 1)[before]
            at += at >= cut
            at[first] = cut
            self.seen[n] = np.insert(found, cut, padding), at
        return self.seen[n]

    def discounted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Each token's discounted relative frequency at order n, and whether it is retained."""
        count = self.totals[n][self.place[n]]
        factors = self.d.by_order[n]
        numerator = count * factors[np.minimum(count, GOOD_TURING_MAX + 1)]
        if n == 1:
            return self.d.unigram_scale * numerator / max(self.d.tokens, 1), count > 0
        return numerator / np.maximum(self.context_counts(n), 1), count >= MIN_COUNT

    def probability(self, n: int) -> np.ndarray:
        """P(token | n - 1 tokens before it), recursively."""
        p, retained = self.discounted(n)
        if n == 1:
            return np.where(retained, p, self.d.unknown)
        _, at = self.contexts(n)
        higher, lower = self.sums[n]
        count = np.maximum(self.context_counts(n), 1)
        scale, weight = backoff(higher[at], lower[at], count)
        return np.where(retained, p * scale, weight * self.probability(n - 1))

    def context_sums(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All contexts of order n with the sums over the retained n-grams that this block owns."""
        contexts, at = self.contexts(n)
        where = np.zeros(len(self.distinct[n]), np.int64)  # one token for each distinct n-gram
        where[self.place[n]] = np.arange(len(self.place[n]))
        p, retained = self.discounted(n)
        mine = where[retained[where] & self.owned[n][self.place[n][where]]]
        lower = self.probability(n - 1)
        return contexts, np.bincount(at[mine], p[mine], len(contexts)), np.bincount(at[mine], lower[mine], len(contexts))


def backoff(higher: np.ndarray, lower: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the retained probabilities and backoff weight, so that they sum to one exactly.

    A context whose discounts leave nothing keeps 1 / (count + 1) for backoff.
    """
    most = count / (count + 1.0)
    scale = np.where(higher > most, most / np.maximum(higher, 1e-300), 1.0)
    return scale, (1.0 - higher * scale) / np.maximum(1.0 - lower, 1e-12)


_ANSWER = "kind string, n int, bucket int, block int, totals binary, more binary"


def _ask_sums(packs: pa.Table, answers: pa.Table, d: Discounts, n: int) -> pa.Table:
    kinds = [("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("higher", pa.binary()), ("lower", pa.binary())]
    if not packs.num_rows:
        return pa.Table.from_batches([_table([], kinds)])
    contexts, higher, lower = Evaluator(_unpack_texts(packs).column("text").combine_chunks(), answers, d).context_sums(n)
    cuts, block, rows = _cuts(contexts, d.buckets), packs.column("block")[0].as_py(), []
    for b in range(d.buckets):
        part = slice(cuts[b], cuts[b + 1])
        if cuts[b] < cuts[b + 1]:
            rows.append((b, block, packed(contexts[part]), higher[part].tobytes(), lower[part].tobytes()))
    return pa.Table.from_batches([_table(rows, kinds)])


def _answer_sums(key: tuple, table: pa.Table, n: int) -> pa.Table:
    bucket = key[0].as_py()
    asked = {b: [unpacked(parts[0][0]), *(np.frombuffer(x, "<f8") for x in parts[0][1:])] for b, parts in sorted(_by_block(table, "hashes", "higher", "lower").items())}
    every = np.concatenate([v[0] for v in asked.values()])
    distinct, at = np.unique(every, return_inverse=True)
    sums = [np.bincount(at, np.concatenate([v[k] for v in asked.values()]), len(distinct)) for k in (1, 2)]
    rows = []
    for block, (hashes, _, _) in asked.items():
        place = np.searchsorted(distinct, hashes)
        rows.append(("sums", n, bucket, block, sums[0][place].tobytes(), sums[1][place].tobytes()))
    kinds = [("kind", pa.string()), ("n", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("totals", pa.binary()), ("more", pa.binary())]
    return pa.Table.from_batches([_table(rows, kinds)])


def _evaluate(packs: pa.Table, answers: pa.Table, d: Discounts) -> pa.Table:
    names = ["doc_id", "copies", "n_tokens", "n_known", "base_score", "score"]
    kinds = [(c, pa.float64() if "score" in c else pa.int64()) for c in names]
    if not packs.num_rows:
        return pa.Table.from_batches([_table([], kinds)])
    own = _unpack_texts(packs)
    ids, copies, texts = (own.column(c).combine_chunks() for c in ("doc_id", "copies", "text"))
    del own
    e = Evaluator(texts, answers, d)
    docs, owner = len(texts), e.g.doc
    count = e.totals[1][e.place[1]]
    base = np.log10((count + 1.0) / (d.tokens + d.types + 1.0))
    score = np.log10(e.probability(d.order))
    columns = [ids, copies, e.g.sizes, np.bincount(owner, count > 0, docs).astype(np.int64), np.bincount(owner, base, docs), np.bincount(owner, score, docs)]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def packs_of(docs: DataFrame) -> DataFrame:
    """(block, pack): the ids and texts of a block, some megabytes in a row, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(block, _pack_texts(pa.Table.from_batches(parts))) for block, parts in held.items()]
            held.clear()
            yield _table(rows, [("block", pa.int32()), ("pack", pa.binary())])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text", "copies")], ["doc_id", "text", "copies"])
            for block in np.unique(blocks):
                held.setdefault(int(block), []).append(rows.filter(pa.array(blocks == block)))
            size += batch.nbytes
            if size > FLUSH_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.select("block", "doc_id", "text", "copies").mapInArrow(run, "block int, pack binary")


def _pack_texts(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpack_texts(packs: pa.Table) -> pa.Table:
    """doc_id, text and copies of a block, in one order however its packs come."""
    parts = [pa.ipc.open_stream(p).read_all() for p in sorted(packs.column("pack").to_pylist())]
    return pa.concat_tables(parts).combine_chunks()


def _collapsed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text, train and copies, and whether any row stands for several.

    Rows that repeat an id and a text so often that together they would fill a good part of a block become one
    row with their number; partial sums do so before anything is shuffled.
    """
    key = F.xxhash64("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    many = docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > BLOCK_BYTES // 4))
    many = common.materialise(many.select("key"), "katz-repeats")
    one = F.lit(1).cast("long").alias("copies")
    if many.isEmpty():
        common.discard(many)
        return docs.select("doc_id", "text", "train", one), False
    keyed = docs.withColumn("key", key)
    few = many.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    side = F.broadcast(many) if few else many
    rest = keyed.join(side, "key", "left_anti").select("doc_id", "text", "train", one)
    hot = keyed.join(side, "key", "left_semi").groupBy("doc_id", "text", "train").agg(F.count(F.lit(1)).alias("copies"))
    return rest.union(common.materialise(hot, "katz-repeated")), True


def with_blocks(docs: DataFrame, train) -> tuple[DataFrame, int, int, bool]:
    """doc_id, text, copies, train and block; the number of blocks and of training documents; whether any row stands for several.

    Blocks are ranges of doc_id with about equally many rows; a range with more bytes than a block should have is cut further, by hash.
    """
    facts = docs.select("doc_id", train.alias("train"), F.octet_length("text").alias("size")).agg(
        F.sum("size").alias("bytes"), F.sum(F.col("train").cast("long")).alias("train")
    ).first()
    ranges = min(max(MIN_BLOCKS, math.ceil((facts["bytes"] or 0) / BLOCK_BYTES)), MAX_RANGES)
    edges = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    edges = sorted({int(e) for e in edges})
    docs, repeated = _collapsed(docs.select("doc_id", "text", train.alias("train")))
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("doc_id"))) if edges else F.lit(0)
    held = docs.where("doc_id IS NOT NULL").groupBy(place.alias("place")).agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each range
    within = np.ones(len(edges) + 1, int)
    for row in held:
        within[row["place"]] = max(1, round((row["bytes"] or 0) / BLOCK_BYTES))  # a block has one and a half times its bytes at most
    blocks, first = int(within.sum()), np.cumsum(within) - within
    at = lambda values: F.get(F.array(*(F.lit(int(v)) for v in values)), place)
    block = at(first) + F.pmod(F.xxhash64("doc_id", "text"), at(within).cast("long"))
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks))).otherwise(block)
    return docs.select("doc_id", "text", "copies", block.cast("int").alias("block"), "train"), blocks, facts["train"] or 0, repeated


def _summed(stats: DataFrame, order: int) -> dict[int, np.ndarray]:
    """Counts of counts, types and tokens of each order, added up by Spark: a row for each order comes to the driver."""
    width = GOOD_TURING_MAX + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((order + 1, width), np.int64)
        for batch in batches:
            for n, totals in zip(batch.column("n").to_pylist(), batch.column("totals").to_pylist(), strict=True):
                sums[n] += np.frombuffer(totals, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(1, order + 1), pa.int32()), *(pa.array(sums[1:, i]) for i in range(width))], ["n", *(f"s{i}" for i in range(width))])

    parts = stats.mapInArrow(run, ", ".join(["n int", *(f"s{i} long" for i in range(width))]))
    rows = parts.groupBy("n").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()
    found = {n: np.zeros(width, np.int64) for n in range(1, order + 1)}
    return found | {r["n"]: np.array([r[f"s{i}"] for i in range(width)], np.int64) for r in rows}


def score(docs: DataFrame, train, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``train`` is a boolean column expression: the documents that are learned from.
    """
    common.ship(docs.sparkSession)
    placed, _ = common.by_place(docs.withColumn("_train", F.coalesce(train, F.lit(False))), "doc_id", "text", "_train")
    docs, blocks, documents, repeated = with_blocks(placed.select("doc_id", "text", "_train"), F.col("_train"))
    asked = requests(docs, order, blocks)
    answers = common.materialise(asked.groupBy("n", "bucket").applyInArrow(_answer_counts, _ANSWER), "katz-counts", "kind")
    d = _discounts(_summed(answers.where("kind = 'stats'").select("n", "totals"), order), order, blocks, documents)
    texts = packs_of(docs).groupBy("block")
    known = answers.where("kind = 'answer'").select(*(c.split()[0] for c in _ANSWER.split(", ")))
    for n in range(2, order + 1):
        known = known.union(_backoff_sums(texts, known, d, n))
    out = texts.cogroup(known.groupBy("block")).applyInArrow(
        lambda t, a: _evaluate(t, a, d), "doc_id long, copies long, n_tokens long, n_known long, base_score double, score double"
    )
    if repeated:
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy")
    return out.drop("copies").withColumn("train_tokens", F.lit(d.tokens).cast("long"))


def _backoff_sums(texts, known: DataFrame, d: Discounts, n: int) -> DataFrame:
    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        return _ask_sums(own, answers, d, n)

    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        return _answer_sums(key, asked, n)

    sums = texts.cogroup(known.groupBy("block")).applyInArrow(ask, "bucket int, block int, hashes binary, higher binary, lower binary")
    return sums.groupBy("bucket").applyInArrow(answer, _ANSWER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = common.crc_mod(F.col("doc_id"), 7) == 2
    return score(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
