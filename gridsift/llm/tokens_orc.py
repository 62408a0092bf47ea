"""Token-ID output: ORC files of token ids in ascending document order.

ORC gives integer run-length encoding of the ids, a row index for every
``row_index_stride`` rows and Bloom filters on ``doc_id``, so a reader that asks for
some documents skips stripes and row groups by metadata, and stripes are read in parallel.

Defined results: a null text counts as empty and gets only the end id; rows that repeat
a ``doc_id`` are written one after the other, rows without one come first; an empty table gives an
empty set of files; other columns are ignored.  Ids are those of the library's own
``encode(text, add_special_tokens=False)``, so the literal of a special token inside a text is that
token; ``plain_literals`` encodes it as ordinary characters instead.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm import common

END_ID = 1
#: Words and other pieces whose ids a Python worker keeps, and text bytes it handles at a time.
PIECES_KEPT = 600_000
PORTION = 8_000_000
#: Letters below U+0250 whose lower case is one letter, and marks that the tokenizer cuts off after them.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` one after the other, and their lengths."""
    lengths = length[places]
    at = np.repeat(start[places] - np.cumsum(lengths) + lengths, lengths)
    at += np.arange(len(at))
    return flat[at], lengths


class Encoder:
    """Encodes texts with the tokenizers library, each distinct chunk between ASCII white space once.

    The tokenizer never joins text across white space, so a text's ids are those of its chunks.  It
    lower-cases and cuts between letters and marks, so a chunk of plain letters with marks after it
    has the ids of the lower-case word and of the marks.  Words not met yet are encoded many at a
    time; each ends with a token marked as a word's end.  Ids are kept in one flat array.
    """

    def __init__(self, path: str, plain_literals: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_literals
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.uses = np.zeros(1, np.int32)  # of each piece: how many portions held it

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.start), len(self.start) + len(pieces)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(lengths), np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        return _gather(self.flat, self.start, self.length, places)

    def _encode(self, pieces: list[str]) -> None:
        if pieces:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            self._add(pieces, np.concatenate([np.array(i, np.uint32) for i in ids]), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _encode_words(self, words: list[str]) -> None:
        for some in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            parts = [" ".join(some[j : j + 1_000]) for j in range(0, len(some), 1_000)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                self._add(some, ids, np.diff(np.r_[0, cuts]))
            else:
                self._encode(some)

    def _make_room(self, pieces: list[str]) -> None:
        """Forget pieces that one portion held only; where that is not enough, all but those given."""
        kept = [c for c, i in self.place.items() if i and self.uses[i] > 1]
        if len(kept) > PIECES_KEPT // 2:
            kept = [c for c in pieces if self.place.get(c)]
        places = np.fromiter(map(self.place.__getitem__, kept), np.int64, len(kept))
        (ids, lengths), uses = self.gather(places), self.uses[places]
        self.reset()
        self._add(kept, ids, lengths)
        self.uses[1:] = uses

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of distinct pieces are; those not met yet are encoded."""
        fresh = [c for c in pieces if c not in self.place]
        if fresh:
            plain = re.compile(_PLAIN).match
            self._encode_words([c for c in fresh if plain(c)])
            self._encode([c for c in fresh if not plain(c)])
        places = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        self.uses[places] += 1
        return places

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and how many each has."""
        bare = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(bare, _PLAIN)
        heads = pc.if_else(plain, pc.utf8_lower(bare), chunks).dictionary_encode()
        marked = pc.and_(plain, pc.less(pc.binary_length(bare), pc.binary_length(chunks)))
        sizes = pc.utf8_length(bare.filter(marked)).to_pylist()
        tails = [chunk[n:] for chunk, n in zip(chunks.filter(marked).to_pylist(), sizes, strict=True)]
        pieces, some = heads.dictionary.to_pylist(), list(dict.fromkeys(tails))
        if len(self.place) > PIECES_KEPT:
            self._make_room(pieces)
        self._places(some)
        both = np.zeros((len(chunks), 2), np.int64)
        both[:, 0] = self._places(pieces)[heads.indices.to_numpy()]
        both[marked.to_numpy(zero_copy_only=False), 1] = np.fromiter(map(self.place.__getitem__, tails), np.int64, len(tails))
        ids, lengths = self.gather(both.ravel())
        return ids, lengths.reshape(-1, 2).sum(1)

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = np.diff(split.offsets.to_numpy())
        flat, sizes = self._chunks(coded.dictionary)
        found, lengths = _gather(flat, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(words)]
        own = np.diff(upto, prepend=0) + 1
        ids = np.full(len(found) + len(own), end_id, np.uint32)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(own) - 1] = True
        ids[~last] = found
        return ids, own


def encode(docs: DataFrame, path: str | None = None, end_id: int = END_ID, *, plain_literals: bool = False) -> DataFrame:
    """(doc_id, ids) for every document, in the order and partitions of ``docs``."""
    common.ship(docs.sparkSession)
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.tenant(f"encoder {path} {plain_literals}", lambda: Encoder(path, plain_literals))
        for batch in batches:
            for at in common.portions(batch.column("text"), PORTION):
                part = batch.slice(at.start, at.stop - at.start)
                values, lengths = encoder.ids(part.column("text"), end_id)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def write_orc(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID, row_index_stride: int = 1000, *, plain_literals: bool = False) -> None:
    """Write ids in ascending ``doc_id`` order; file n holds smaller ids than file n + 1.

    Texts are shuffled, not ids: they are smaller.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = encode(ordered, path, end_id, plain_literals=plain_literals).select(
        "doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "ids"
    )
    (
        coded.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.create.index", "true")
        .orc(target)
    )


def read_orc(spark: SparkSession, source: str) -> DataFrame:
    """The written files: doc_id, part (file order), row (order inside), ids."""
    return spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(source)


def summarise(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from what ``read_orc`` gives.

    Starts are running sums inside a part plus the totals of earlier parts; the table of
    totals has one row for each part.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
            )

    rows = tokens.mapInArrow(digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    rows = common.materialise(rows, "token-digests")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("upto", F.sum("n_tokens").over(inside))
        .join(before, "part")
        .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = common.new_path(spark, "tokens-orc")
    write_orc(docs, target)
    return summarise(read_orc(spark, target))
