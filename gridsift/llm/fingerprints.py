"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are the words of a text after A-Z are lower-cased, weighted by their counts.  For each
sample k and term, r and c are Gamma(2, 1) and beta is uniform, all derived from hashes of the
term and k.  With weight w the term offers t = floor(ln(w) / r + beta) at the price
ln(a) = ln(c) - r * (t - beta + 1), and the cheapest (term, t) is the sample.  Two texts share
a sample with a probability equal to the generalised Jaccard similarity of their weights.

A sample is kept as 32 bits of its (term, t); the price is ordered in steps of 2**-22, below
which the smaller 32 bits win in both texts alike.

Defined results: a null text is empty; texts without words have the fingerprint ``EMPTY`` and
are alike only to each other; rows that repeat a doc_id count as one row, with its smallest
text; in an empty table there is nothing to return; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsift.llm import common

SAMPLES = 36
#: Samples computed in one pass over a term's row.
_TOGETHER = 4
EMPTY = "empty"
_STEPS = float(1 << 22)
_UNIT = 2.0**-32


def _uniform(hashed: Column, high: bool) -> Column:
    bits = F.shiftrightunsigned(hashed, 32) if high else hashed.bitwiseAND(F.lit(0xFFFFFFFF))
    return (bits.cast("double") + 0.5) * _UNIT


def _offer(draw: Column, weight: Column) -> Column:
    """Price and 32 bits of (term, t) in one long whose order is that of the price."""
    r, ln_c, beta = draw["r"], draw["ln_c"], draw["beta"]
    t = F.floor(F.log(weight) / r + beta)
    price = F.floor((ln_c - r * (t - beta + 1.0)) * _STEPS)
    low = F.xxhash64(draw["seed"], t).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(weight > 0, F.shiftleft(F.greatest(price, F.lit(-(1 << 30))).cast("long"), 32).bitwiseOR(low))


def _draws(term: Column, k: Column) -> Column:
    a, b, c = (F.xxhash64(term, k * 3 + i) for i in range(3))
    return F.struct(
        (-F.log(_uniform(a, True) * _uniform(a, False))).alias("r"),
        F.log(-F.log(_uniform(b, True) * _uniform(b, False))).alias("ln_c"),
        _uniform(c, True).alias("beta"),
        c.alias("seed"),
    )


def samples(weights: DataFrame, key: str, columns: list[str], n: int = SAMPLES) -> DataFrame:
    """One row for each key with, for each weight column, the array ``<column>_sig`` of n samples.

    ``weights`` has (key, term long, one weight for each column); it is aggregated where its
    partitioning by ``key`` already stands.
    """
    groups = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _TOGETHER))).alias("g")
    spread = weights.select(key, "term", *columns, groups)
    for j in range(_TOGETHER):
        spread = spread.withColumn(f"d{j}", _draws(F.col("term"), F.col("g") * _TOGETHER + j))
    best = spread.groupBy(key, "g").agg(
        *(F.min(_offer(F.col(f"d{j}"), F.col(c).cast("double"))).alias(f"{c}_{j}") for c in columns for j in range(_TOGETHER))
    )
    packed = best.groupBy(key).agg(
        *(F.sort_array(F.collect_list(F.struct("g", *(F.col(f"{c}_{j}").alias(f"s{j}") for j in range(_TOGETHER))))).alias(c) for c in columns)
    )

    def signature(c: str) -> Column:
        flat = F.flatten(F.transform(F.col(c), lambda x: F.array(*(x[f"s{j}"].bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(_TOGETHER)))))
        return F.when(F.col(c)[0]["s0"].isNotNull(), F.slice(flat, 1, n))

    return packed.select(key, *(signature(c).alias(f"{c}_sig") for c in columns))


def as_text(signature: Column) -> Column:
    hexed = F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0")))
    return F.when(signature.isNull(), EMPTY).otherwise(F.concat_ws("", hexed))


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples; two texts without words are alike, one without is not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(n)))


def _words(text: Column) -> Column:
    return F.split(common.lower_ascii(text), common.SPACE)


def term_weights(texts: DataFrame, key: str, segments: list[tuple[str, list[str]]]) -> DataFrame:
    """(key, term, weight columns): each segment column adds its words to the named weights."""
    parts = F.array(*(F.struct(F.lit(i).alias("segment"), F.col(c).alias("text")) for i, (c, _) in enumerate(segments)))
    rows = texts.select(key, F.explode(parts).alias("p")).select(key, "p.segment", F.explode(_words(F.col("p.text"))).alias("word"))
    rows = rows.where("word != ''").select(key, "segment", F.xxhash64("word").alias("term"))
    names = list(dict.fromkeys(w for _, ws in segments for w in ws))
    adds = {w: [i for i, (_, ws) in enumerate(segments) if w in ws] for w in names}
    return rows.groupBy(key, "term").agg(*(F.sum(F.col("segment").isin(adds[w]).cast("int")).alias(w) for w in names))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order, the first one following the last.

    Ids are range-partitioned, so only a row for each partition is ordered in one place.
    """
    parts = ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    parts = common.materialise(parts, "id-ranges")
    inside = parts.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = parts.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "part",
        F.coalesce(F.lead("first_id").over(Window.orderBy("part")), F.first("first_id").over(whole)).alias("after_id"),
    )
    return inside.join(after, "part").select("doc_id", F.coalesce("next_id", "after_id").alias("next_id"), "n_chars")


def fingerprint_edits(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    Texts are shuffled by doc_id once; the first quarters of the next documents follow.
    """
    texts = common.unique_by_id(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chain = common.materialise(successors(texts.select("doc_id", F.length("text").cast("long").alias("n_chars"))), "successors")
    heads = (
        chain.withColumnRenamed("doc_id", "prev_id")
        .join(texts, F.col("next_id") == F.col("doc_id"))
        .select(F.col("prev_id").alias("doc_id"), "n_chars", F.substr("text", F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("head"))
    )
    kept = F.substr("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int"))
    both = heads.join(texts, "doc_id").select("doc_id", "n_chars", "text", F.concat(kept, "head").alias("edited"), F.regexp_extract(kept, r"(?s)^.*[\x20\x09-\x0D]", 0).alias("common"))
    rest = F.length("common") + 1
    cut = both.select("doc_id", "common", F.substr("text", rest).alias("old"), F.substr("edited", rest).alias("new"))
    weights = term_weights(cut, "doc_id", [("common", ["own", "other"]), ("old", ["own"]), ("new", ["other"])])
    marks = samples(weights, "doc_id", ["own", "other"], n)
    facts = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    marks = common.materialise(facts.join(marks, "doc_id", "left"), "fingerprints")
    following = marks.select(F.col("doc_id").alias("next_id"), F.col("own_sig").alias("next_sig"))
    return (
        marks.join(chain.select("doc_id", "next_id"), "doc_id")
        .join(following, "next_id")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own_sig")).alias("fingerprint"),
            as_text(F.col("other_sig")).alias("edited_fingerprint"),
            likeness(F.col("own_sig"), F.col("other_sig"), n).alias("near_edited"),
            likeness(F.col("own_sig"), F.col("next_sig"), n).alias("near_next"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
