import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.llm import common, fingerprints, mixing, sampled_pieces, tokens_orc

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "Hello, world!! it's 3.5%", "x" * 3000, "ÀÉ ß ΟΔΟΣ. Σ, ﬁ ① a\u0301b\u00a0c\u3000d\x85e\x1ff", "日本語 テスト 한국어", "🙂🙂 a🙂b", "<|endoftext|> and <|startoftext|>",
    "don't can't we'll 'tis", "a\u200bb \u202e", "tab\tline\nfeed\x0bvt\x0cff\rcr", "word. word, word; w:o|r!d?", "ǅ İstanbul ŉ", "... ,,, !!!", "1,000.50 a1b2 x_y-z", "́ combining first", "word " * 20_000,
]


def documents(spark):
    return spark.createDataFrame([(i * 3, t, "en") for i, t in enumerate(ODD)], "doc_id long, text string, start string")


def test_ids_equal_direct_encoding_and_survive_the_files(spark):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(tokens_orc.default_tokenizer())
    target = common.new_path(spark, "test-orc")
    tokens_orc.write_orc(documents(spark).repartition(5, "text"), target)
    rows = {r["doc_id"]: r["ids"] for r in tokens_orc.read_orc(spark, target).collect()}
    digest = {r["doc_id"]: r for r in tokens_orc.summarise(tokens_orc.read_orc(spark, target)).collect()}
    at = 0
    for i, text in enumerate(ODD):
        want = [*direct.encode(text or "", add_special_tokens=False).ids, 1]
        assert rows[i * 3] == want, text
        d = digest[i * 3]
        assert (d["start"], d["n_tokens"], d["ids_crc32"]) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


@pytest.mark.parametrize("plain_literals", [False, True])
def test_encoder_equals_the_library_on_mixed_characters(plain_literals):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(tokens_orc.default_tokenizer())
    direct.encode_special_tokens = plain_literals
    draw = random.Random(5)
    parts = "a B word Word, İ i ŉ ẖ H̱ ̱ ́ 's ' don't ß Σ ς <|endoftext|> <|STARTOFTEXT|> <|startoftext|> < | > . , ! ? ; : _ - *** &&& 1 23 ½ 日本 🙂 ﬁ ǅ K Å ≠ ̸ х Й é \u200d ı Ł ø Ǆ".split(" ")
    parts += [" ", "  ", "\u00a0", "\u3000", "\x85", "\x1c", "\t", "\n", "\x0b", "\0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    encoder = tokens_orc.Encoder(tokens_orc.default_tokenizer(), plain_literals)
    for some in (texts[:1500], texts[1000:], [None]):
        ids, lengths = encoder.ids(pa.array(some, pa.string()), 1)
        for text, own in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert own.tolist() == [*direct.encode(text or "", add_special_tokens=False).ids, 1], text


def test_encoder_forgets_and_learns_again(monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"common word{i}. number {i} x{i}y?" for i in range(300)])
    want = tokens_orc.Encoder(tokens_orc.default_tokenizer()).ids(texts, 1)
    monkeypatch.setattr(tokens_orc, "PIECES_KEPT", 50)
    small = tokens_orc.Encoder(tokens_orc.default_tokenizer())
    parts = [small.ids(texts[i : i + 20], 1) for i in range(0, 300, 20)]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), want[0]) and np.array_equal(np.concatenate([p[1] for p in parts]), want[1])
    assert len(small.place) < 300


def test_files_are_in_order_and_prunable(spark):
    import pyarrow.orc

    target = common.new_path(spark, "test-orc")
    tokens_orc.write_orc(spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(7), target)
    rows = tokens_orc.read_orc(spark, target).orderBy("part", "row").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert tokens_orc.read_orc(spark, target).where("doc_id = 7").count() == sum(r["doc_id"] == 7 for r in rows)
    import glob

    files = glob.glob(f"{target.removeprefix('file://')}/*.orc")
    assert files and sum(pyarrow.orc.ORCFile(f).nrows for f in files) == len(rows)
    assert tokens_orc.read_orc(spark, target).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]") == 1


def test_no_documents_and_repeated_ids(spark):
    target = common.new_path(spark, "test-orc")
    tokens_orc.write_orc(spark.createDataFrame([], "doc_id long, text string"), target)
    assert tokens_orc.summarise(tokens_orc.read_orc(spark, target)).count() == 0
    target = common.new_path(spark, "test-orc")
    tokens_orc.write_orc(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string"), target)
    assert sorted(r["start"] for r in tokens_orc.summarise(tokens_orc.read_orc(spark, target)).collect()) == [0, 2, 4]


def jaccard(a, b):
    x, y = (Counter(t.encode().lower().split()) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys) if keys else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    out = {r["doc_id"]: r for r in fingerprints.query(spark, FOLDER).collect()}
    errors, prints = [], {}
    for (i, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        r = out[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, following)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.09


def test_fingerprints_of_odd_texts(spark):
    rows = [(i, t, 9) for i, t in enumerate(ODD)]
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert len(out) == len(ODD) and out[0]["fingerprint"] == out[2]["fingerprint"] == fingerprints.EMPTY
    assert out[0]["n_chars"] == 0 and out[0]["near_next"] == 1.0 and out[2]["near_next"] == 0.0
    for i, text in enumerate(ODD):
        text, following = text or "", ODD[(i + 1) % len(ODD)] or ""
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_equals_sql(spark, duck):
    got = sorted(tuple(r) for r in mixing.query(spark, FOLDER).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept").collect())
    want = sorted(duck.execute(f"SELECT doc_id, source, lang, topic, n_tokens, weight, probability, kept FROM ({mixing.ORACLE})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == tuple(b[:5]) and a[7] == b[7] and a[5:7] == pytest.approx(tuple(b[5:7]), abs=2e-6)


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    cells = mixing.cell_table(mixing.with_levels(docs)).persist()
    total = cells.agg(F.sum("tokens")).first()[0]
    assert cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] == pytest.approx(mixing.RATE * total, rel=1e-6)
    for margin in mixing.TEMPER:
        for r in cells.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now"), F.first(f"{margin}_share").alias("share")).collect():
            assert r["now"] / total == pytest.approx(r["share"], abs=2e-3)


def test_margin_errors_show_sweeps_that_stop_short(spark):
    docs = mixing.with_levels(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    few, many = ({r["margin"]: r["error"] for r in mixing.margin_errors(mixing.cell_table(docs, sweeps=n, most=n)).collect()} for n in (1, mixing.SWEEPS))
    assert set(many) == set(mixing.TEMPER) and max(many.values()) < 2e-3 and max(many.values()) < max(few.values())


def test_mixing_of_nulls_and_nothing(spark):
    rows = [(1, None, None, None, 5.0), (2, "a b", "en", "web", 1.0), (3, "c " * 30_000, "en", None, 2.0), (3, "c", "en", "web", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_weight double")
    out = mixing.mix(docs).collect()
    assert len(out) == 4 and all(0 <= r["mix_probability"] <= 1 for r in out)
    assert {r["mix_source"] for r in out} == {"(none)", "web"}
    assert mixing.mix(docs.where("false")).count() == 0
    targets = {"mix_lang": spark.createDataFrame([("en", 1.0)], "level string, share double")}
    assert mixing.mix(docs, targets).count() == 4
    assert mixing.mix(docs, topic=F.col("source")).select("mix_topic").distinct().count() == 2


def test_dominant_terms(spark):
    cases = {"Government. government? parliament": "government", "zzzzzzzzzz aaaaaaaaaa": "aaaaaaaaaa", "short words only": "", "": "", None: None, "Überraschung, überraschung": "Überraschung"}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").select("text", mixing.dominant_term(F.col("text")).alias("term"), mixing.topic_of(F.col("text")).alias("topic")).collect()
    assert {r["text"]: r["term"] for r in rows} == cases
    assert all((r["topic"] is None) == (not r["term"]) for r in rows)


def test_cells_that_are_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "mix_probability", "mix_kept").collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(mixing, "CELLS_PER_TASK", 50)
    got = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "mix_probability", "mix_kept").collect())
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want] and [b for _, b, _ in got] == pytest.approx([b for _, b, _ in want])


def test_targets_that_contradict_are_reported(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s1"), (2, "c d", "de", "s2")], "doc_id long, text string, lang string, source string")
    targets = {"mix_lang": spark.createDataFrame([("en", 0.9), ("de", 0.1)], "level string, share double"), "mix_source": spark.createDataFrame([("s1", 0.1), ("s2", 0.9)], "level string, share double")}
    with pytest.warns(UserWarning, match="misses its target"):
        mixing.cell_table(mixing.with_levels(docs), targets, most=36)


def test_samples_are_distinct_and_decode(spark):
    texts = [t for t in ODD if t is None or len(t) < 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sampled_pieces.encode(docs, 3).collect()
    own = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(tuple(r["ids"]))
        assert r["round_trip"] and r["log_inclusion"] <= 0 and r["n_pieces"] == len(r["ids"])
    assert all(len(set(v)) == len(v) for v in own.values()) and len(own[0]) == 1
    decoded = {(r["doc_id"], r["sample"]): r["text"] for r in sampled_pieces.decode(spark.createDataFrame(rows)).collect()}
    assert all(decoded[r["doc_id"], r["sample"]] == (texts[r["doc_id"]] or "").replace("▁", " ") for r in rows)
    again = sampled_pieces.encode(docs.repartition(3), 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_all_segmentations_of_a_short_text(spark):
    """More samples than segmentations: each comes once and probabilities sum to one."""
    rows = sampled_pieces.encode(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), 500).collect()
    assert np.exp([r["log_prob"] for r in rows]).sum() == pytest.approx(1.0, rel=1e-4)
    assert all(r["log_inclusion"] == 0 for r in rows[-1:])
    perturbed = [r["perturbed"] for r in sorted(rows, key=lambda r: r["sample"])]
    assert perturbed == sorted(perturbed, reverse=True)


def segmentations(text):
    """All (ids, weight) of a text, piece by piece, from the library's own table of pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sampled_pieces.default_model())
    size = own.get_piece_size()
    pieces = {own.id_to_piece(i): i for i in range(size) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))}
    first = min(pieces.values())
    spaced = "▁" + text.replace(" ", "▁")

    def rest(at):
        if at == len(spaced):
            return [((), 1.0)]
        out = []
        for end in range(at + 1, len(spaced) + 1):
            if (i := pieces.get(spaced[at:end])) is not None:
                out += [((i, *ids), w / (i - first + 10.0)) for ids, w in rest(end)]
        if spaced[at] not in pieces:
            coded = tuple(own.piece_to_id(f"<0x{b:02X}>") for b in spaced[at].encode())
            out += [((*coded, *ids), w * (size * np.e**2) ** -len(coded)) for ids, w in rest(at + 1)]
        return out

    return rest(0)


@pytest.mark.parametrize("text", ["abc", "a bc", "héé", "x🙂y", "the cat"])
def test_segmentations_equal_enumeration(spark, text):
    rows = sampled_pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), 3000).collect()
    want = {}
    for ids, w in segmentations(text):
        want[ids] = want.get(ids, 0.0) + w
    total = sum(want.values())
    assert {tuple(r["ids"]) for r in rows} == set(want)
    for r in rows:
        assert np.exp(r["log_prob"]) == pytest.approx(want[tuple(r["ids"])] / total, rel=1e-4)


def test_inclusion_scores(spark):
    """The threshold of k samples is the score of the next one."""
    docs = spark.createDataFrame([(i, "some words to cut") for i in range(20)], "doc_id long, text string")
    of = lambda k: {(r["doc_id"], r["sample"]): r for r in sampled_pieces.encode(docs, k).collect()}
    five, six = of(5), of(6)
    for (doc, i), r in five.items():
        assert r["ids"] == six[doc, i]["ids"]
        x = r["log_prob"] - six[doc, 5]["perturbed"]
        assert r["log_inclusion"] == pytest.approx(np.log(-np.expm1(-np.exp(x))), rel=1e-6, abs=1e-9)


def test_samples_of_repeats_clashing_columns_long_texts_and_nothing(spark):
    long = "lorem ipsum  dolor\n" * 4_000
    docs = spark.createDataFrame([(1, long, 1), (1, long, 2), (None, "x", 3), (2, "y" * 6_000, 4)], "doc_id long, text string, ids int")
    rows = sampled_pieces.encode(docs).collect()
    assert all(r["round_trip"] for r in rows) and len(rows) == 8
    assert len({(r["sample"], r["ids_crc32"]) for r in rows if r["doc_id"] == 1}) == 2
    assert sampled_pieces.encode(docs.where("false")).count() == 0
    assert [r["text"] for r in sampled_pieces.decode(spark.createDataFrame([(1, 0, None), (1, 1, [])], "doc_id long, sample int, ids array<int>")).collect()] == [None, ""]


def test_few_lattices_are_kept(spark, monkeypatch):
    lattices = sampled_pieces.Lattices(sampled_pieces.default_model(), 1.0)
    texts = [f"word{i} of common{i % 7} kind" for i in range(300)]
    want = sampled_pieces._rows(lattices, list(range(300)), texts, 2, 1)
    monkeypatch.setattr(sampled_pieces, "UNITS_KEPT", 60)
    small = sampled_pieces.Lattices(sampled_pieces.default_model(), 1.0)
    for i in range(0, 300, 20):
        got = sampled_pieces._rows(small, list(range(i, i + 20)), texts[i : i + 20], 2, 1)
        for name in ("ids", "perturbed", "log_prob", "log_inclusion"):
            assert got[name].to_pylist() == want[name].slice(2 * i, 40).to_pylist()
    assert len(small.types) < 200


def test_first_samples_follow_the_probabilities(spark):
    one = {tuple(r["ids"]): np.exp(r["log_prob"]) for r in sampled_pieces.encode(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), 500).collect()}
    rows = sampled_pieces.encode(spark.range(4000).selectExpr("id AS doc_id", "'abc' AS text"), 1).groupBy("ids").count().collect()
    for r in rows:
        p = one[tuple(r["ids"])]
        assert abs(r["count"] / 4000 - p) < 5 * np.sqrt(p * (1 - p) / 4000) + 1e-3
