"""Fill-in-the-middle: documents cut in three parts that are put in another order.

One Aho-Corasick automaton scans a text once.  Its patterns are the ASCII characters that change the
class of what follows (white space, digits and marks, by the kind of unit) and the sentinels.  Between two
events lies a gap of one class, whose number of units follows from its length by arithmetic, so a cut
after so many units is found from the running counts at the events and a division inside one gap; nothing
is kept for the units themselves.  A text that holds a sentinel stays as it is, so what the operator
writes can always be taken apart again: ``restore`` does so from the output and the form alone.

Kinds of units (``UNITS``): ``characters`` are code points; ``words`` are maximal runs free of ASCII white
space, and single white-space characters; ``pieces`` are such runs, cut at digits and marks too, of up to
four code points.

Defined results: a null text counts as empty, an empty text stays plain with no units; a row without doc_id is
drawn as if its id were written with no digits; rows that repeat a doc_id are handled alike, one by one;
texts are used whole, however long; an empty table gives an empty result; other columns pass through, but for
those called like an added column, in whatever case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsift.llm import common

SEED = 1
#: Of 100 documents, those left plain, and of 100 others, those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of texts that a task handles at a time.
PORTION = 8_000_000
ADDED = ["fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
_CONTROL = "\t\n\v\f\r"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Units:
    """``events``: ASCII characters that are units of their own; ``width``: most code points of a unit in a gap, None for any number."""

    events: str
    width: int | None

    def of_gap(self, length):
        return np.minimum(length, 1) if self.width is None else -(-length // self.width)


UNITS = {"characters": Units(_CONTROL, 1), "words": Units(_CONTROL + " ", None), "pieces": Units(_CONTROL + " " + "0123456789" + _MARKS, 4)}


class Scanner:
    """The automaton of a kind of units and of the sentinels."""

    def __init__(self, units: Units, sentinels: tuple[str, ...]) -> None:
        import ahocorasick

        self.units = units
        self.automaton = ahocorasick.Automaton()
        for character in units.events:
            self.automaton.add_word(character, 0)
        for sentinel in sentinels:
            self.automaton.add_word(sentinel, 1)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, bool]:
        """Places of class-changing characters, and whether a sentinel occurs."""
        found = np.array(list(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        return found[found[:, 1] == 0, 0], bool(found[:, 1].any())

    def ranks(self, places: np.ndarray, length: int) -> Ranks:
        return Ranks(self.units, places, length)


class Ranks:
    """Where so many units end: a search among the counts at the events, then arithmetic inside a gap."""

    def __init__(self, units: Units, places: np.ndarray, length: int) -> None:
        self.units, self.length = units, length
        self.start = np.concatenate([[0], places + 1])  # of each gap
        gap = np.append(places, length) - self.start
        own = units.of_gap(gap)
        self.before = np.concatenate([[0], np.cumsum(own[:-1] + 1)])  # units before each gap: an event is one
        self.gap, self.total = gap, int(self.before[-1] + own[-1])

    def end_of(self, n: int) -> int:
        """Code points up to the end of the n-th unit."""
        i = int(np.searchsorted(self.before, n, "right")) - 1
        inside = n - int(self.before[i])
        if inside == 0:
            return int(self.start[i])
        return int(self.start[i] + (self.gap[i] if self.units.width is None else min(self.gap[i], inside * self.units.width)))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 for a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(scanner: Scanner, text: str, h: tuple[int, int, int, int], plain: int, suffix_first: int, sentinels: tuple[str, str, str]) -> tuple:
    places, marked = scanner.scan(text)
    ranks = scanner.ranks(places, len(text))
    n = ranks.total
    if marked or not text or h[2] % 100 >= 100 - plain:
        return "plain", n, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = ranks.end_of(a), ranks.end_of(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h[3] % 100 < suffix_first:
        return "spm", n, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return "psm", n, a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(
    docs: DataFrame, units: str = "characters", *, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """``docs`` with fim_form (plain, psm or spm), fim_units, fim_prefix_chars, fim_middle_chars and fim_output."""
    if len(set(sentinels)) < 3 or any(a != b and a in b for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three different texts, none inside another")
    if any(a[-i:] == b[:i] for a in sentinels for b in sentinels for i in range(1, min(len(a), len(b)))):
        raise ValueError("no sentinel may begin as another one ends")
    common.ship(docs.sparkSession)
    placed, before = common.by_place(docs, "doc_id", "text")
    drawn = placed.withColumns({f"_h{i}": h for i, h in enumerate(draws(F.col("doc_id"), seed))})
    kinds = [T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*placed.schema, *(T.StructField(n, t) for n, t in zip(ADDED, kinds, strict=True))])
    arrow = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    passed, names = placed.columns, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = common.tenant(f"scanner {units} {sentinels}", lambda: Scanner(UNITS[units], sentinels))
        for batch in batches:
            for at in common.portions(batch.column("text"), PORTION):
                part = batch.slice(at.start, at.stop - at.start)
                h = zip(*(part.column(f"_h{i}").to_pylist() for i in range(4)), strict=True)
                rows = [_cut(scanner, text or "", own, plain, suffix_first, sentinels) for text, own in zip(part.column("text").to_pylist(), h, strict=True)]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *columns], names=names)

    return common.renamed(drawn.mapInArrow(run, schema), before, *ADDED)


def restore(form: Column, output: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which ``transform`` made an output of that form."""
    p, s, m = sentinels
    middle, rest = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    between = lambda head, tail: (F.substring_index(rest, tail, 1).substr(F.lit(len(head) + 1), F.length(rest)), F.substring_index(rest, tail, -1))
    prefix, suffix = between(p, s)
    after, before = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(before, middle, after)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("fim_form"), F.col("fim_output")), 256).alias("restored_sha256"),
    )


_PART = "CAST(('0x' || substr(d, {at}, 8)) AS BIGINT)"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, {_PART.format(at=1)} AS h1, {_PART.format(at=9)} AS h2, {_PART.format(at=17)} AS h3, {_PART.format(at=25)} AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
