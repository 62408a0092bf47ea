"""From raw documents to sampled token ids: five stages over one table of documents.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
``docs``.  What a stage rejects is gone for the next one.

Defined results: an empty table stays empty; extra columns pass through as they are, whatever their
names; texts are used whole, however long; rows that
repeat a doc_id are judged one by one and alike, and near-duplicate removal keeps all rows of a
doc_id that stays.  Null and empty texts have no language and go in the first stage; the stages
after it would keep them.  Rows without doc_id go in near-duplicate removal, the first stage that
needs an id.  Null language or source are levels of their own in mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.llm import common, language_id, minhash_dedup, mixing, sampled_pieces, toxicity

#: A document goes if no language holds at least this share of its letters.
MIN_LANGUAGE_SHARE = 0.4
#: What stages read; all other columns travel under names of their own.
NEEDED = ("doc_id", "text", "lang", "source")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without a determined language; a missing lang gets the predicted one."""
    placed, before = common.by_place(docs, *NEEDED)
    model = language_id.train(placed.where(~F.coalesce(language_id.held_out(), F.lit(False))))
    judged = language_id.predict(placed, model)
    kept = judged.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= MIN_LANGUAGE_SHARE))
    return common.renamed(kept.withColumn("lang", F.coalesce("lang", "lang_pred")), before)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts that the model, learned from the labels outside its fold, calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    placed, before = common.by_place(docs, *NEEDED)
    return common.renamed(toxicity.score(placed, toxicity.train(placed, labels)).where("tox_predicted = 0"), before)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies, that with the smallest doc_id."""
    placed, before = common.by_place(docs, *NEEDED)
    kept = minhash_dedup.link(placed.select("doc_id", "text")).where("kept").select("doc_id")
    return common.renamed(placed.join(kept, "doc_id", "left_semi"), before)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by raked probabilities of source, language and topic."""
    placed, before = common.by_place(docs, *NEEDED)
    return common.renamed(mixing.mix(placed).where("mix_kept"), before)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, with their ids and scores."""
    placed, _ = common.by_place(docs, *NEEDED)
    return sampled_pieces.encode(placed.select("doc_id", "text"))


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("minhash_dedup", keep_one_of_near_copies),
    ("mixing", mix_to_targets),
    ("sentencepiece", encode_pieces),
]
#: Learned models and sampled segmentations are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
