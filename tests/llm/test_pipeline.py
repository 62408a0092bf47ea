import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gridsift.llm import common, minhash_dedup, registry, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, FOLDER), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_remove(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == before.columns and ids(after) <= ids(before) and after.count() == len(ids(after))


def test_language_stage_keeps_texts_with_letters(stages):
    gone = stages[0].join(stages[1], "doc_id", "left_anti")
    assert gone.count() < 0.05 * stages[0].count()
    assert stages[1].where("lang IS NULL").count() == 0


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    """300 labels, some of them wrong, teach part of the insults only; clean documents must stay."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic IS NOT NULL").join(stages[1].select("doc_id"), "doc_id")
    kept = stages[2].select("doc_id").withColumn("kept", F.lit(1))
    rates = {r["toxic"]: r["share"] for r in labels.join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert rates[0] > 0.97 and rates[1] < 0.5


def test_one_of_each_group_of_near_copies_stays(stages):
    from tests.llm.test_dedup import roots, text_links

    rows = [(r["doc_id"], r["text"]) for r in stages[2].select("doc_id", "text").collect()]
    sets, near = text_links(rows)
    assert ids(stages[3]) == {i for i, root in roots(sets, near).items() if i == root}


def test_mixing_draws_about_its_rate(stages):
    from gridsift.llm.mixing import RATE, n_tokens

    total = lambda df: df.agg(F.sum(n_tokens(F.col("text")))).first()[0]
    assert total(stages[4]) / total(stages[3]) == pytest.approx(RATE, abs=0.1)


def test_last_stage_encodes_all_that_is_left(stages):
    assert ids(stages[5]) == ids(stages[4])
    assert stages[5].where("NOT round_trip").count() == 0


def test_run_gives_what_the_stages_give(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).select("doc_id", "sample", "ids_crc32")
    assert got.exceptAll(stages[5].select("doc_id", "sample", "ids_crc32")).count() == 0
    assert got.count() == stages[5].count()


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing columns, no rows at all."""
    english = "the house and the garden of the people in the city with a long road"
    rows = [(i, f"{english} number{i} with words{i} like these{i} and those{i}", "en", f"s{i % 3}", 10, "x") for i in range(40)]
    rows += [(100, None, "en", "s0", 0, None), (101, "", None, None, 0, None), (None, english, "en", None, 3, None), (102, english, None, None, None, None), (102, english, None, None, None, None), (103, f"{english} " * 3_000, "en", "s1", 9, None)]
    extra = ["Lang_Score", "Tox_Score", "tox_predicted", "Mix_Kept", "n_tokens", "a.b", "c`d", "Kept", "component_id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, " + ", ".join("`" + e.replace("`", "``") + "` int" for e in extra)
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
        assert all(tuple(r)[6:] == tuple(range(len(extra))) for r in out.collect())
        kept = [r["doc_id"] for r in out.collect()]
        assert set(kept) <= {r[0] for r in rows}
        if name == "language_id":
            assert not {100, 101} & set(kept) and kept.count(102) == 2
        if name == "minhash_dedup":
            assert None not in kept and {100, 101} <= set(kept)
    last = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert last.where("NOT round_trip").count() == 0 and last.select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_operators_on_names_that_differ_in_case_or_hold_marks(spark):
    from gridsift.llm import language_id, mixing

    english = "the house and the garden of the people in the city"
    names = "doc_id long, text string, lang string, source string, TEXT string, `a.b` int, `c``d` int, Lang_Pred int, TOX_predicted int, Mix_Topic int"
    docs = spark.createDataFrame([(i, f"{english} {i}", "en", "s", "other", 1, 2, 3, 4, 5) for i in range(12)], names)
    judged = language_id.predict(docs, language_id.train(docs), spans=True)
    assert judged.columns == ["doc_id", "text", "lang", "source", "TEXT", "a.b", "c`d", "TOX_predicted", "Mix_Topic", "lang_pred", "lang_score", "lang_spans"]
    assert judged.first()[4:9] == ("other", 1, 2, 4, 5) and judged.first()["lang_pred"] == "en"
    labels = spark.createDataFrame([(i, i % 2, 1, 0) for i in range(12)], "doc_id long, toxic int, `x.y` int, Toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels), spans=True)
    assert "TOX_predicted" not in scored.columns and scored.first()[4:7] == ("other", 1, 2)
    mixed = mixing.mix(docs)
    assert "Mix_Topic" not in mixed.columns and mixed.count() == 12 and mixed.first()[4:7] == ("other", 1, 2)
    given = mixing.mix(spark.createDataFrame([(1, "some words", "en", "s", 3)], "doc_id long, text string, lang string, source string, Lang_Pred int"), topic=F.col("Lang_Pred").cast("string"))
    assert {r["mix_topic"] for r in given.collect()} == {"3"}
    assert minhash_dedup.link(docs).count() == 12


def test_too_many_languages_are_refused(spark, monkeypatch):
    from gridsift.llm import language_id

    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(docs)
    assert len(language_id.train(docs.where("doc_id < 3")).languages) == 3


def test_registry_names_each_operator_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert minhash_dedup.PERCENT == 75 and toxicity.THRESHOLD == 0.3
