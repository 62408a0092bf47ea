"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

The scripts of a word's letters narrow the candidate languages to those whose training words use
one of them.  A word's score for a language is the sum of the log-probabilities of its hashed character
n-grams, over the square root of their number.  Viterbi with a fixed cost of switching labels
spans of words; a document's language is the one whose spans hold most letters.

Counts are taken over all training rows.  The model has a fixed size for each language
(``BUCKETS`` floats); a column of more than ``MOST_LANGUAGES`` different values is refused with a ValueError, since
the model goes to every task.  A language is a candidate for a script only if at least ``MIN_SCRIPT_SHARE`` of its
training words use it.

Defined results: a text that is null or has no letter gives ``und`` and score 0; a text all of
whose words are of scripts not met in training gives the language that sorts first and score 0.  Rows with null text or language are never
learned from.  Every row is judged on its own, so repeated rows get equal answers.  Ties go to
the language that sorts first.  With no training rows every answer is ``und``.  Other columns pass through, but
for those called like an added one, in whatever case.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsift.llm import common

#: First and last code points of scripts (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
SWITCH_PENALTY = 6.0
#: A language is a candidate for a script that holds at least this share of its training words.
MIN_SCRIPT_SHARE = 0.01
#: Languages that a model may hold: half a megabyte each on the driver, a quarter in every task.
MOST_LANGUAGES = 200
UNDETERMINED = "und"
WORDS_KEPT = 200_000
_FNV, _PRIME = 0x811C9DC5, 0x01000193


@lru_cache(maxsize=65_536)
def script_of(letter: str) -> str:
    code = ord(letter)
    return next((name for name, low, high in SCRIPTS if low <= code <= high), "other")


def scripts_of(letters: str) -> tuple[str, ...]:
    """Scripts of a word's letters; most words have one."""
    if letters.isascii():
        return ("latin",) if letters else ()
    return tuple(sorted(set(map(script_of, letters))))


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def gram_ids(spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of every ``<letters>``, and whose they are."""
    framed = [f"<{letters}>" for letters in spelled]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    owner = np.repeat(np.arange(len(framed)), sizes)
    ends = np.cumsum(sizes)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[ends - sizes] = False
    ids, owners = [], []
    h = np.full(len(codes), _FNV, np.uint32)
    for n in range(1, GRAMS[-1] + 1):
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(_PRIME)
        ok = owner[: len(h)] == owner[n - 1 :]
        ok = ok & inner if n == 1 else ok
        ids.append(((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS))[ok])
        owners.append(owner[: len(h)][ok])
    return np.concatenate(ids), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x BUCKETS
    by_script: dict[str, np.ndarray]  # candidates of each script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("language counts", dict)
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words[lang].update(text.split())
        if sum(map(len, words.values())) > 2 * WORDS_KEPT:
            yield from _emit(words)
            words.clear()
    yield from _emit(words)


def _emit(words: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counted in words.items():
        grams, scripts = np.zeros(BUCKETS), Counter()
        spelled = [(letters, n) for word, n in counted.items() if (letters := letters_of(word))]
        for letters, n in spelled:
            for script in scripts_of(letters):
                scripts[script] += n
        for i in range(0, len(spelled), 20_000):
            part = spelled[i : i + 20_000]
            ids, owner = gram_ids([w for w, _ in part])
            grams += np.bincount(ids, np.array([n for _, n in part])[owner], BUCKETS)
        at = np.flatnonzero(grams)
        keys = [*map(str, at.tolist()), *(f"script:{s}" for s in scripts)]
        n = [*grams[at].astype(int).tolist(), *scripts.values()]
        if keys:
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "key": keys, "n": n})


def _gathered(counts: pa.Table) -> pa.Table:
    """The counts of one language: of all buckets, packed, and of its scripts."""
    keys, n = counts.column("key").to_pylist(), counts.column("n").to_pylist()
    grams, scripts = np.zeros(BUCKETS), {}
    for key, count in zip(keys, n, strict=True):
        if key.startswith("script:"):
            scripts[key.removeprefix("script:")] = count
        else:
            grams[int(key)] = count
    columns = [counts.column("lang")[:1].combine_chunks(), pa.array([grams.tobytes()]), pa.array([list(scripts)], pa.list_(pa.string())), pa.array([list(scripts.values())], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, ["lang", "grams", "scripts", "n"])


def train(docs: DataFrame) -> Model:
    """Count n-grams and scripts for each language over all rows of ``docs`` (text, lang).

    A language's counts become one row of half a megabyte; more than ``MOST_LANGUAGES`` are refused before any comes to the driver.
    """
    common.ship(docs.sparkSession)
    placed, _ = common.by_place(docs, "text", "lang")
    counts = placed.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, key string, n long")
    packed = counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(_gathered, "lang string, grams binary, scripts array<string>, n array<long>")
    packed = common.materialise(packed, "language-counts")
    if packed.count() > MOST_LANGUAGES:
        raise ValueError(f"the column lang holds more than {MOST_LANGUAGES} languages")
    rows = packed.orderBy("lang").collect()
    common.discard(packed)
    languages = [r["lang"] for r in rows]
    grams = np.full((len(languages), BUCKETS), 0.5)
    scripts: dict[str, np.ndarray] = {}
    for i, row in enumerate(rows):
        grams[i] += np.frombuffer(row["grams"])
        for script, n in zip(row["scripts"], row["n"], strict=True):
            if n >= MIN_SCRIPT_SHARE * sum(row["n"]):
                scripts.setdefault(script, np.zeros(len(languages), bool))[i] = True
    log_p = np.log(grams / grams.sum(axis=1, keepdims=True)) if languages else grams
    return Model(languages, log_p.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``scores`` holds the words of one text after the other.

    All texts advance together, the longest first, so a step costs one vector operation.
    """
    n_labels = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    out = np.zeros(len(scores), np.int32)
    if not len(scores):
        return out
    stays = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int32)
    active = int((sizes > 0).sum())
    value = scores[starts[:active]].astype(np.float64)
    finals = np.zeros(active, np.int32)
    for t in range(1, int(sizes[0])):
        live = int(np.searchsorted(-sizes[:active], -t, side="left"))
        if live < len(value):
            finals[live : len(value)] = value[live:].argmax(1)
            value = value[:live]
        top = value.argmax(1)
        switched = value[np.arange(live), top] - penalty
        at = starts[:live] + t
        stay = value >= switched[:, None]
        stays[at], came[at] = stay, top
        value = np.where(stay, value, switched[:, None]) + scores[at]
    finals[: len(value)] = value.argmax(1)
    label = finals.copy()
    for t in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes[:active], -t, side="left"))
        at = starts[:live] + t
        now = label[:live]
        out[at] = now
        label[:live] = np.where(stays[at, now] if n_labels else True, now, came[at])
    return out


class Labeller:
    """Scores of words under a model, with the words already met."""

    def __init__(self, model: Model) -> None:
        self.model, self.ids = model, {}
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        spelled = [letters_of(w) for w in words]
        n = len(self.model.languages)
        ids, owner = gram_ids(spelled)
        size = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        score = np.stack([np.bincount(owner, row[ids], len(words)) for row in self.model.log_p], 1) / np.sqrt(size)[:, None]
        scripts = [scripts_of(w) for w in spelled]
        allowed = {found: np.any([np.zeros(n, bool), *(self.model.by_script[s] for s in found if s in self.model.by_script)], axis=0) for found in set(scripts)}
        candidates = np.array([allowed[found] for found in scripts]).reshape(len(words), n)
        best = np.where(candidates, score, -np.inf).max(1, keepdims=True)
        known = candidates.any(1)
        score = np.where(candidates, score - np.where(known[:, None], best, 0), -2 * SWITCH_PENALTY)
        score[~known] = 0
        letters = np.where(known, np.fromiter(map(len, spelled), np.int64, len(words)), 0)
        self.ids.update(zip(words, range(len(self.letters), len(self.letters) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, score.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and letters of all words, and how many each text has."""
        if len(self.ids) > WORDS_KEPT:
            self.__init__(self.model)
        split = [(text or "").split() for text in texts]
        fresh = list(set().union(*split).difference(self.ids))
        if fresh:
            self._learn(fresh)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(self.ids.__getitem__, own), np.int64, len(own)) for own in split)])
        return self.scores[ids], self.letters[ids], np.fromiter(map(len, split), np.int64, len(split))

    def label(self, texts: list[str | None], penalty: float = SWITCH_PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters that the spans of each language hold, for each text; labels; words of each text."""
        scores, letters, lengths = self.words(texts)
        labels = viterbi(scores, lengths, penalty)
        n = len(self.model.languages)
        owner = np.repeat(np.arange(len(texts)), lengths)
        held = np.bincount(owner * n + labels, letters, len(texts) * n).reshape(len(texts), n)
        return held, labels, lengths


def _spans(words: list[str], labels: np.ndarray, languages: list[str]) -> list[dict]:
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)] if len(words) else []
    return [{"lang": languages[labels[a]], "first_word": a, "words": b - a} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def predict(docs: DataFrame, model: Model, *, spans: bool = False) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and, if asked for, labelled spans of words."""
    session = docs.sparkSession
    common.ship(session)
    held = session.sparkContext.broadcast(model)
    kept_as = f"labeller {uuid.uuid4().hex}"
    placed, before = common.by_place(docs, "text")
    added_names = ["lang_pred", "lang_score", *(["lang_spans"] if spans else [])]
    span = T.ArrayType(T.StructType().add("lang", "string").add("first_word", "integer").add("words", "integer"))
    schema = T.StructType([*placed.schema, *(T.StructField(n, t) for n, t in zip(added_names, [T.StringType(), T.DoubleType(), span], strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = common.tenant(kept_as, lambda: Labeller(held.value))
        languages = held.value.languages
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts = batch.column("text").to_pylist()
                if languages:
                    letters, labels, lengths = labeller.label(texts)
                    total, best = letters.sum(1), letters.argmax(1)
                    top = letters[np.arange(len(texts)), best]
                    names = [languages[b] if t > 0 or has_letter(text) else UNDETERMINED for b, t, text in zip(best, total, texts, strict=True)]
                    share = np.where(total > 0, top / np.maximum(total, 1), 0.0)
                else:
                    labels, lengths = np.zeros(0, np.int32), np.zeros(len(texts), int)
                    names, share = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                added = [pa.array(names, pa.string()), pa.array(share, pa.float64())]
                if spans:
                    ends = np.cumsum(lengths)
                    cut = [_spans((t or "").split(), labels[e - n : e], languages) if n else [] for t, n, e in zip(texts, lengths, ends, strict=True)]
                    added.append(pa.array(cut, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *added_names])

    return common.renamed(placed.mapInArrow(run, schema), before, *added_names)


def held_out(modulus: int = 4):
    return common.crc_mod(F.col("doc_id"), modulus) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
