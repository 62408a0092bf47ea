"""Toxicity: weighted finite-state transducers over clauses, and a logistic score.

Words are tagged (insult, threat, target, negation, reported speech, other).  Four transducers,
composed into one, rewrite the tags of a clause: reported speech marks later insults as quoted,
negation those within three words, a target those it stands before, and the last one weighs what
is left.  A document's features are the summed weights of each kind of match over its clauses;
logistic regression turns them into a score.

Insults are learned from labelled rows by sequential covering: again and again the whole word or
word beginning that explains most toxic documents not yet explained, and hardly any other, joins
the lexicon.  Copies of one document thus add nothing once it is explained.  A learned term is a
threat instead where it goes before its target: where at least half of the toxic documents that
hold it have a target within ``THREAT_REACH`` words after it in its clause ("crush you"), or where
it starts like one of the given threats (an inflection of it).

Bound: at most about ``SAMPLE`` labelled rows are learned from (drawn by a hash of doc_id), which
bounds the lexicon too.

Defined results: a null or empty text has no match and gets the score of no match; rows are
judged one by one, repeated ones alike; a doc_id with several labels counts as toxic if one of them
says so; of terms that explain equally much the longer one, then the one that sorts last, joins
first; rows without a label are never learned from; with no labels, or labels of one
kind only, the score is the share of toxic labels (0 without any); other columns pass through, but for
those called like an added one, in whatever case.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsift.llm import common
from gridsift.llm.language_id import letters_of

SAMPLE = 20_000
MIN_SUPPORT = 4
#: A document is explained once so many of its terms are in the lexicon.
COVERS = 3
MIN_PRECISION = 0.9
PREFIXES = range(4, 11)
THRESHOLD = 0.3
WORDS_KEPT = 200_000
#: Terms that a task counts before it hands them on.
TERMS_HELD = 250_000
NEGATION_REACH = 3
#: How many words after a threat its target may stand.
THREAT_REACH = 2

TAGS = ["other", "insult", "threat", "target", "negation", "report"]
MATCHES = ["plain", "aimed", "negated", "quoted", "threat"]
_SEEDS = {
    "threat": "kill murder destroy strangle stab shoot beat hurt töten umbringen ermorden erschießen verprügeln tuer assassiner étrangler frapper matar asesinar golpear estrangular",
    "target": "you your he she they him her them this that these those du ihr sie er dieser tu vous il elle ils ce usted ella ellos este",
    "negation": "not no never nobody nicht kein keine nie ne pas jamais nunca",
    "report": "said says say wrote quoted claimed called sagt sagte schrieb dit disait dijo dice",
}
_ENDINGS = re.compile(r"(en|er|ar|e)$")
#: Beginnings that the given threats share with their inflections.
_STEMS = tuple(sorted(stem for w in _SEEDS["threat"].split() if len(stem := _ENDINGS.sub("", w)) >= 4))
_CLAUSE_END = re.compile(r"[.!?;:,|]\W*$")


@dataclass(frozen=True)
class Transducer:
    """arcs[state, symbol] = (next state, output symbol, weight); other symbols pass unchanged."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: Transducer, symbols: Iterable[str]) -> Transducer:
        """This one first, then ``other`` on its output; weights multiply.  Reachable states only."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            a, b = state = todo.pop()
            for symbol in symbols:
                a2, middle, w = self.step(a, symbol)
                b2, out, v = other.step(b, middle)
                arcs[state, symbol] = ((a2, b2), out, w * v)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(arcs, start)


def grammar() -> Transducer:
    """Reported speech, negation, target and weights, composed."""
    reported = Transducer({(0, "report"): (1, "other", 1.0), (1, "insult"): (1, "quoted", 1.0), (1, "threat"): (1, "quoted", 1.0)})
    fading = {(left, s): (left - 1, s, 1.0) for left in range(1, NEGATION_REACH + 1) for s in ("other", "target", "quoted")}
    negated = Transducer(
        fading
        | {(left, "negation"): (NEGATION_REACH, "other", 1.0) for left in range(NEGATION_REACH + 1)}
        | {(left, s): (left - 1, "negated", 1.0) for left in range(1, NEGATION_REACH + 1) for s in ("insult", "threat")}
    )
    aimed = Transducer({(0, "target"): (1, "other", 1.0), (1, "target"): (1, "other", 1.0), (1, "insult"): (1, "aimed", 1.0), (0, "insult"): (0, "plain", 1.0)})
    weighed = Transducer({(0, "aimed"): (0, "aimed", 1.5), (0, "negated"): (0, "negated", 0.5), (0, "quoted"): (0, "quoted", 0.5)})
    whole = reported
    for part in (negated, aimed, weighed):
        whole = whole.compose(part, TAGS)
    return whole


@dataclass
class Model:
    words: set[str]
    prefixes: set[str]
    weights: np.ndarray  # of the features, the last one of the constant
    threats: set[str] = field(default_factory=set)  # of the words (marked) and prefixes


class Matcher:
    """Tags words under a lexicon and runs the grammar over clauses with a match."""

    def __init__(self, words: set[str], prefixes: set[str], threats: Iterable[str] = ()) -> None:
        self.words, self.prefixes, self.threats = words, prefixes, frozenset(threats)
        self.lengths = sorted({len(p) for p in prefixes})
        self.fixed = {w: TAGS.index(tag) for tag, ws in _SEEDS.items() for w in ws.split()}
        self.known: dict[str, int] = {}
        self.grammar = grammar()

    def _tag(self, word: str) -> int:
        bare = letters_of(word)
        term = self.term(bare)
        tag = (2 if term in self.threats else 1) if term else self.fixed.get(bare, 0)
        self.known[word] = tag
        return tag

    def term(self, bare: str) -> str | None:
        """The learned term that a word falls under: itself (marked), or its shortest learned beginning."""
        if bare in self.words:
            return f"={bare}"
        return next((bare[:n] for n in self.lengths if bare[:n] in self.prefixes), None)

    def before_targets(self, text: str | None) -> dict[str, bool]:
        """For each learned term of a text, whether a target ever follows it within reach in its clause."""
        words, out = (text or "").split(), {}
        for i, word in enumerate(words):
            if not (term := self.term(letters_of(word))):
                continue
            follows = False
            for j in range(i, min(i + THREAT_REACH, len(words) - 1)):
                if _CLAUSE_END.search(words[j]):
                    break
                follows |= self.fixed.get(letters_of(words[j + 1])) == 3
            out[term] = out.get(term, False) or follows
        return out

    def matches(self, text: str | None) -> tuple[list[tuple[int, int, str, float]], int]:
        """(first word, last word, kind, weight) of each match, and the number of words."""
        words = (text or "").split()
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        tags = list(map(self.known.get, words))
        if None in tags:
            tags = [self._tag(w) if t is None else t for w, t in zip(words, tags, strict=True)]
        coded = bytes(tags)
        found, upto = [], -1
        for hit in re.finditer(b"[\x01\x02]", coded):
            at = hit.start()
            if at <= upto:
                continue
            first = at
            while first > 0 and not _CLAUSE_END.search(words[first - 1]):
                first -= 1
            upto, state = first - 1, self.grammar.start
            for i in range(first, len(words)):
                state, out, weight = self.grammar.step(state, TAGS[coded[i]])
                upto = i
                if out in MATCHES:
                    found.append((first, i, out, weight))
                if _CLAUSE_END.search(words[i]):
                    break
        return found, len(words)

    def features(self, text: str | None) -> list[float]:
        found, n = self.matches(text)
        sums = dict.fromkeys(MATCHES, 0.0)
        for _, _, kind, weight in found:
            sums[kind] += weight
        total = sum(sums.values())
        clauses = len({first for first, *_ in found})
        return [*(math.log1p(v) for v in sums.values()), float(total > 0), math.log1p(clauses), total / (n + 20.0)]


N_FEATURES = len(MATCHES) + 3


def _candidates(text: str | None) -> set[str]:
    """Whole words (marked) and their beginnings."""
    out = set()
    for word in set((text or "").split()):
        bare = letters_of(word)
        if len(bare) >= 3:
            out.add(f"={bare}")
            out.update(bare[:n] for n in PREFIXES if n <= len(bare))
    return out


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.tenant("toxicity counts", dict)
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else other).update(_candidates(text))
        if len(toxic) + len(other) > TERMS_HELD:
            yield pa.RecordBatch.from_pydict({"term": list(toxic), "n_toxic": list(toxic.values()), "n_other": [other.pop(t, 0) for t in toxic]})
            yield pa.RecordBatch.from_pydict({"term": list(other), "n_toxic": [0] * len(other), "n_other": list(other.values())})
            toxic.clear()
            other.clear()
    yield pa.RecordBatch.from_pydict({"term": list(toxic), "n_toxic": list(toxic.values()), "n_other": [other.pop(t, 0) for t in toxic]}, schema=_TALLY)
    yield pa.RecordBatch.from_pydict({"term": list(other), "n_toxic": [0] * len(other), "n_other": list(other.values())}, schema=_TALLY)


_PLACES = pa.schema([("term", pa.string()), ("held", pa.int64()), ("after", pa.int64())])
_TALLY = pa.schema([("term", pa.string()), ("n_toxic", pa.int64()), ("n_other", pa.int64())])


def cover(terms_of: list[set[str]], allowed: dict[str, float]) -> list[str]:
    """Greedy covering of toxic documents, each given by its terms, with allowed terms.

    A whole word whose beginning is chosen adds nothing, so it is passed over.
    """
    holders = defaultdict(set)
    for i, terms in enumerate(terms_of):
        for t in terms:
            holders[t].add(i)
    count = {t: len(d) for t, d in holders.items()}
    chosen, taken, wanted = [], set(), [COVERS] * len(terms_of)
    while count:
        best = max(count, key=lambda t: (count[t] * allowed[t], len(t), t))
        if count[best] < MIN_SUPPORT:
            break
        bare = best.lstrip("=")
        if any(bare[:n] in taken for n in range(4, len(bare) + 1)):
            count.pop(best)
            continue
        taken.add(best)
        chosen.append(best)
        for i in holders[best]:
            wanted[i] -= 1
            if wanted[i] == 0:
                for t in terms_of[i]:
                    if (left := count.get(t)) is not None:
                        count[t] = left - 1
        count.pop(best)
        count = {t: n for t, n in count.items() if n >= MIN_SUPPORT}
    return chosen


def threats_among(chosen: Iterable[str], places: dict[str, tuple[int, int]]) -> set[str]:
    """The chosen terms that are threats; ``places`` has documents that hold a term, and those with a target after it."""
    out = {t for t in chosen if t.lstrip("=").startswith(_STEMS)}
    return out | {t for t in chosen if places.get(t, (0, 0))[1] >= max(MIN_SUPPORT, places.get(t, (0, 0))[0] / 2)}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method on the bounded sample; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text) and (doc_id, toxic); the caller leaves held-out rows out."""
    common.ship(docs.sparkSession)
    docs, labels = common.by_place(docs, "doc_id", "text")[0], common.by_place(labels, "doc_id", "toxic")[0]
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(total, 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(known.where(drawn)), "doc_id")  # about ``sample`` rows
    rows = common.materialise(rows, "toxicity-sample")
    tally = rows.mapInArrow(_tally, "term string, n_toxic long, n_other long").groupBy("term")
    tally = tally.agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o"))
    tally = tally.where((F.col("t") >= MIN_SUPPORT) & (F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("o"))))
    allowed = {r["term"]: (r["t"] + 0.5) / (r["t"] + r["o"] + 1.0) for r in tally.collect()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(_candidates(t) & allowed.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "terms"])

    toxic = rows.where("toxic = 1").mapInArrow(pick, "doc_id long, terms array<string>").orderBy("doc_id").collect()
    chosen = cover([set(r["terms"]) for r in toxic], allowed)
    words = {t[1:] for t in chosen if t[0] == "="}
    prefixes = {t for t in chosen if t[0] != "="}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words, prefixes)
        for batch in batches:
            held, after = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                seen = matcher.before_targets(text)
                held.update(seen.keys())
                after.update(t for t, follows in seen.items() if follows)
            yield pa.RecordBatch.from_pydict({"term": list(held), "held": list(held.values()), "after": [after[t] for t in held]}, schema=_PLACES)

    places = rows.where("toxic = 1").mapInArrow(place, "term string, held long, after long").groupBy("term").agg(F.sum("held"), F.sum("after"))
    threats = threats_among(chosen, {t: (held, after) for t, held, after in places.collect()})  # a row for each chosen term

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words, prefixes, threats)
        for batch in batches:
            own = [matcher.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    seen = rows.mapInArrow(featurise, "doc_id long, toxic int, x array<double>").orderBy("doc_id").toPandas()
    common.discard(rows)
    y = seen["toxic"].to_numpy(float)
    share = y.mean() if len(y) else 0.0
    if 0 < share < 1:
        weights = fit_logistic(np.array(seen["x"].tolist()), y)
    else:
        weights = np.r_[np.zeros(N_FEATURES), 40.0 * (2 * share - 1)]
    return Model(words, prefixes, weights, threats)


def score(docs: DataFrame, model: Model, *, spans: bool = False) -> DataFrame:
    """All columns of ``docs`` with tox_score, tox_predicted and, if asked for, the matches."""
    session = docs.sparkSession
    common.ship(session)
    held = session.sparkContext.broadcast(model)
    kept_as = f"matcher {uuid.uuid4().hex}"
    placed, before = common.by_place(docs, "text")
    added_names = ["tox_score", "tox_predicted", *(["tox_matches"] if spans else [])]
    match = T.ArrayType(T.StructType().add("first_word", "integer").add("last_word", "integer").add("kind", "string").add("weight", "double"))
    schema = T.StructType([*placed.schema, *(T.StructField(n, t) for n, t in zip(added_names, [T.DoubleType(), T.IntegerType(), match], strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        matcher = common.tenant(kept_as, lambda: Matcher(m.words, m.prefixes, m.threats))
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                texts = batch.column("text").to_pylist()
                x = np.array([matcher.features(t) for t in texts]).reshape(len(texts), N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -40, 40)))
                added = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]
                if spans:
                    found = [[{"first_word": a, "last_word": b, "kind": k, "weight": w} for a, b, k, w in matcher.matches(t)[0]] for t in texts]
                    shape = pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())])
                    added.append(pa.array(found, pa.list_(shape)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *added_names])

    return common.renamed(placed.mapInArrow(run, schema), before, *added_names)


def held_out():
    return common.crc_mod(F.col("doc_id"), 4) == 2


def train_on_folds(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the query and the pipeline: learned from labels outside the held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train_on_folds(spark, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted")
    )
