"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions only.

Documents fall into cells (source, language, topic).  Raking multiplies the cells' weights by
target / current for one margin after the other, which brings the margins of the weighted tokens
to their targets: ``SWEEPS`` times, then on until every margin is within ``TOLERANCE`` of its
target, at most ``MOST_SWEEPS`` times.  Targets may contradict each other; then a warning names the
error that is left, which ``margin_errors`` gives for each margin.  Probabilities are proportional
to the weights, at most 1, and calibrated so that the expected tokens are ``rate`` times all tokens;
each document is drawn by a hash of its id.

A document's topic is a hashed class of its dominant term: the most frequent one of its words of at
least ``LONG`` letters (of equally frequent ones, that which sorts first), dealt to ``TOPICS``
classes; documents that are about the same thing, and copies, thus share a topic in any language.
The caller may bring a column instead.

Only the table of cells is raked, in tasks of ``CELLS_PER_TASK`` rows; it has a row for each
combination that occurs.  Totals and calibration are aggregates over it.  It is broadcast to the
documents where it has at most ``BROADCAST_CELLS`` rows; beyond, documents are joined to it by
salted keys.

Targets are the shares of a level's tokens raised to a power below one, or tables (level, share)
of the caller; levels that a table does not name get nothing.

Defined results: null source, language or topic is the level ``(none)``, as is the topic of a text
without long words; a null text has no token and is drawn with its cell's probability; cells without
tokens have weight 1; rows that repeat a doc_id are drawn alike; an empty table gives an empty
result; columns of the caller named like the added ones are replaced.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm import common

RATE = 0.5
#: Power of a level's share of tokens that gives its target share.
TEMPER = {"mix_source": 0.5, "mix_lang": 0.7, "mix_topic": 0.7}
SWEEPS = 30
MOST_SWEEPS = 120
TOLERANCE = 1e-4
SEED = "mix-1"
TOPICS, LONG = 12, 9
CELLS_PER_TASK = 100_000
BROADCAST_CELLS = 200_000
SALTS = 64
#: Sweeps between two cuts of the lineage.
_SWEEPS_AT_ONCE = 6
_MARKS = ".,;:!?"
ADDED = ["n_tokens", "mix_source", "mix_lang", "mix_topic", "mix_weight", "mix_probability"]
_MIXED = [*ADDED, "mix_kept"]


def dominant_term(text: Column) -> Column:
    """The most frequent long word of a text, A-Z lower-cased and without marks around it; empty without one."""
    long = F.filter(F.split(text, common.SPACE), lambda w: F.length(w) >= LONG)
    words = F.sort_array(F.filter(F.transform(long, lambda w: F.btrim(common.lower_ascii(w), F.lit(_MARKS))), lambda w: F.length(w) >= LONG))
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("run"), F.lit("").alias("best"), F.lit(0).alias("most"))

    def take(state: Column, word: Column) -> Column:
        run = F.when(state["now"] == word, state["run"] + 1).otherwise(1)
        more = run > state["most"]
        return F.struct(
            word.alias("now"), run.alias("run"), F.when(more, word).otherwise(state["best"]).alias("best"), F.when(more, run).otherwise(state["most"]).alias("most")
        )

    return F.aggregate(words, start, take, lambda state: state["best"])


def topic_of(text: Column) -> Column:
    """Class of the dominant term of a text, by its md5."""
    term = dominant_term(text)
    number = F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % TOPICS
    return F.when(term != "", F.concat(F.lit("t"), number.cast("string")))


def n_tokens(text: Column) -> Column:
    """Words of a text."""
    parts = F.split(text, common.SPACE)
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    return F.coalesce(F.size(parts) - first - last, F.lit(0)).cast("long")


def with_levels(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with token counts and levels of the three margins."""
    docs = docs.drop(*ADDED)
    topic = topic_of(F.col("text")) if topic is None else topic
    named = {"mix_source": F.col("source"), "mix_lang": F.col("lang"), "mix_topic": topic}
    return docs.withColumns({"n_tokens": n_tokens(F.col("text"))} | {k: F.coalesce(c.cast("string"), F.lit("(none)")) for k, c in named.items()})


def _shares(cells: DataFrame, margin: str, all_tokens: int, targets: dict[str, DataFrame] | None) -> DataFrame:
    """(margin, its target share): a row for each level that occurs; shares sum to one."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("own"))
    if targets and margin in targets:
        given = targets[margin].select(F.col("level").alias(margin), F.col("share").cast("double").alias("wanted"))
        own = own.join(given, margin, "left").select(margin, F.coalesce("wanted", F.lit(0.0)).alias("wanted"))
    else:
        share = F.pow(F.col("own") / F.lit(float(max(all_tokens, 1))), F.lit(TEMPER[margin]))
        own = own.select(margin, F.when(F.col("own") > 0, share).otherwise(0.0).alias("wanted"))
    total = own.agg(F.sum("wanted").alias("total")).first()["total"] or 0.0
    return own.select(margin, (F.col("wanted") / F.lit(total) if total > 0 else F.lit(0.0)).alias(f"{margin}_share"))


def _with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    all_tokens = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    out = cells.withColumn("all_tokens", F.lit(all_tokens).cast("long"))
    for margin in TEMPER:
        out = out.join(_shares(cells, margin, all_tokens, targets), margin)
    return out


def _sweep(cells: DataFrame, times: int) -> DataFrame:
    for _ in range(times):
        for margin in TEMPER:
            now = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(margin))
            goal = F.col(f"{margin}_share") * F.col("all_tokens")
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * goal / now).otherwise(F.col("weight")))
    return cells


def rake(cells: DataFrame, sweeps: int = SWEEPS, tasks: int = 1, tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> DataFrame:
    """``cells`` (three margins, their shares, tokens, all_tokens) with the column ``weight``.

    Where one task is enough, its partition serves every margin and nothing is shuffled.
    """
    cells, done = cells.withColumn("weight", F.lit(1.0)), 0
    while done < sweeps:
        now = min(_SWEEPS_AT_ONCE, sweeps - done)
        before, cells, done = cells, common.materialise(_sweep(cells, now), "raked"), done + now
        common.discard(before)
        cells = _coalesced(cells, tasks)
    while (left := max((r["error"] for r in margin_errors(cells).collect()), default=0.0)) > tolerance and done < most:
        before, cells, done = cells, common.materialise(_sweep(cells, _SWEEPS_AT_ONCE), "raked"), done + _SWEEPS_AT_ONCE
        common.discard(before)
        cells = _coalesced(cells, tasks)
    if left > tolerance:
        warnings.warn(f"after {done} sweeps a margin misses its target by a share of {left:.3g} of the tokens", stacklevel=2)
    return cells


def _coalesced(cells: DataFrame, tasks: int) -> DataFrame:
    out = cells.coalesce(tasks)
    out.gridsift_path = cells.gridsift_path
    return out


def probabilities(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """min(1, k * weight) with the k for which expected tokens are ``rate`` times all tokens.

    k grows from aggregate to aggregate, as the cells that it makes certain stop taking part; each
    step needs one row.  Where all cells become certain, they stay so.
    """
    k = 0.0
    certain = F.lit(False)
    while True:
        row = cells.agg(
            F.sum(F.when(certain, F.col("tokens")).otherwise(0)).alias("sure"),
            F.sum(F.when(certain, F.lit(0.0)).otherwise(F.col("tokens") * F.col("weight"))).alias("rest"),
            F.max("all_tokens").alias("total"),
        ).first()
        if not row["rest"]:
            k = k or 1.0
            break
        following = (rate * row["total"] - row["sure"]) / row["rest"]
        if following <= k * (1 + 1e-12):
            break
        k = following
        certain = F.col("weight") * F.lit(k) >= 1
    return cells.withColumn("probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(k) * F.col("weight"))))


def cell_table(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, sweeps: int = SWEEPS, most: int = MOST_SWEEPS) -> DataFrame:
    """Raked cells of ``with_levels`` output: margins, docs, tokens, weight, probability."""
    counted = docs.groupBy("mix_source", "mix_lang", "mix_topic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    cells = common.materialise(counted, "cells")
    tasks = math.ceil(max(cells.count(), 1) / CELLS_PER_TASK)
    aimed = common.materialise(_with_targets(cells, targets), "aimed-cells")
    raked = rake(_coalesced(aimed, tasks), sweeps, tasks, most=max(sweeps, most))
    out = common.materialise(probabilities(raked, rate), "mixed-cells")
    common.discard(cells, raked)
    return out


def margin_errors(cells: DataFrame) -> DataFrame:
    """(margin, error) of ``cell_table`` output: the largest |share of weighted tokens - target share| of a level."""
    parts = []
    for margin in TEMPER:
        now = F.sum(F.col("tokens") * F.col("weight")) / F.first("all_tokens")
        off = cells.groupBy(margin).agg(F.abs(now - F.first(f"{margin}_share")).alias("off"))
        parts.append(off.agg(F.lit(margin).alias("margin"), F.coalesce(F.max("off"), F.lit(0.0)).alias("error")))
    return parts[0].union(parts[1]).union(parts[2])


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and id."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, topic: Column | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``docs`` with tokens, levels, raked weight, probability and ``mix_kept``.

    Levels are derived from the texts twice, for the cells and for the rows, so that texts need not
    be stored; ``mix_levels`` takes levels that are stored.
    """
    given = [] if topic is None else ["_topic"]
    placed, before = common.by_place(docs if topic is None else docs.withColumn("_topic", topic), "doc_id", "text", "lang", "source", *given)
    before.pop("_topic", None)
    mixed = mix_levels(with_levels(placed, None if topic is None else F.col("_topic")), targets, rate, sweeps)
    return common.renamed(mixed, before, *_MIXED)


def mix_levels(levels: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, sweeps: int = SWEEPS, most: int = MOST_SWEEPS) -> DataFrame:
    """``with_levels`` output with raked weight, probability and ``mix_kept``."""
    cells = cell_table(levels, targets, rate, sweeps, most)
    cells = cells.select("mix_source", "mix_lang", "mix_topic", F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    keys = ["mix_source", "mix_lang", "mix_topic"]
    if cells.count() <= BROADCAST_CELLS:
        joined = levels.join(F.broadcast(cells), keys)
    else:
        salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = levels.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")
    return joined.withColumn("mix_kept", draw(F.col("doc_id")) < F.col("mix_probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = mix_levels(common.materialise(with_levels(docs).drop("text", "lang", "source"), "levels"), most=SWEEPS)
    return mixed.select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"),
        "n_tokens",
        F.round("mix_weight", 6).alias("weight"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"),
    )


def _oracle() -> str:
    """The same by DuckDB: a sweep is three chained steps of a recursive query."""
    steps = "cells0 AS (SELECT *, CAST(1.0 AS DOUBLE) AS w FROM shares)"
    at = 0
    for _ in range(SWEEPS):
        for m in ("source", "lang", "topic"):
            steps += (
                f", cells{at + 1} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN sum(tokens * w) OVER (PARTITION BY {m}) > 0 "
                f"THEN w * ({m}_share * all_tokens) / sum(tokens * w) OVER (PARTITION BY {m}) ELSE w END AS w FROM cells{at})"
            )
            at += 1
    powers = {k.removeprefix("mix_"): v for k, v in TEMPER.items()}
    margins = ", ".join(
        f"m_{m} AS (SELECT {m}, p / sum(p) OVER () AS {m}_share FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(CAST(sum(tokens) AS DOUBLE) / max(all_tokens), {p}) ELSE 0 END AS p FROM cells GROUP BY {m}))"
        for m, p in powers.items()
    )
    return f"""
WITH terms AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, trim(translate(unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_MARKS}') AS word FROM documents)
  WHERE length(word) >= {LONG} GROUP BY ALL),
topics AS (
  SELECT doc_id, concat('t', CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {TOPICS}) AS topic FROM terms
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) = 1),
docs AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    coalesce(topics.topic, '(none)') AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents LEFT JOIN topics USING (doc_id)),
cells AS (
  SELECT *, sum(tokens) OVER () AS all_tokens FROM (
    SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)),
{margins},
shares AS (SELECT * FROM cells JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)),
{steps},
tried AS (
  SELECT *, ({RATE} * all_tokens - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(tokens * w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS k
  FROM cells{at} WINDOW o AS (ORDER BY w DESC, source, lang, topic)),
probs AS (
  SELECT source, lang, topic, w, least(1.0, greatest(0.0, w * coalesce((SELECT max(k) FROM tried WHERE k * w <= 1), 1.0))) AS p FROM tried)
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(p, 6) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 12) AS BIGINT) / CAST({1 << 48} AS DOUBLE) < p AS kept
FROM docs JOIN probs USING (source, lang, topic)
"""


ORACLE = _oracle()
