import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.llm import katz, language_id, toxicity, url_filter

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("https://A.Example.org/es/1?q=/x#f", "a.example.org", "/es/1"),
        ("http://net?x", "net", ""),
        ("ftp://x#y/z", "x", ""),
        ("no scheme/path", "", ""),
        ("://h/p://q", "h", "/p://q"),
        ("x://É.com/É", "É.com", "/É"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_host_and_path(spark, url, host, path):
    h, p = url_filter.host_and_path(F.col("u"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(h, p).first()) == (host, path)


@pytest.mark.parametrize(
    ("host", "path", "rule", "action"),
    [
        ("org", "/", "org/", "allow"),
        ("a.org", "/x", "org/", "allow"),
        ("aorg", "/x", None, None),
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("www.example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/de/", "com/de/", "block"),
        ("x.com", "/fr", None, None),
        ("", "", None, None),
    ],
)
def test_rules(spark, host, path, rule, action):
    r, a = url_filter.rule_for(F.col("h"), F.col("p"))
    assert tuple(spark.createDataFrame([(host, path)], "h string, p string").select(r, a).first()) == (rule, action)


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.labelled_table(spark))


def test_urls_are_judged_by_what_they_say(spark, url_model):
    pages = spark.createDataFrame([(1, "http://shop.casino-pills.biz/en/4", "x"), (2, "http://city-library.info/en/4", "y"), (3, None, None), (4, "h://" + "a" * 5000, None), (2, "http://city-library.info/en/4", "y")], "page_id long, url string, host string")
    rows = url_filter.judge(pages, url_model).collect()
    out = {r["page_id"]: r for r in rows}
    assert out[1]["verdict"] == "block" and out[2]["verdict"] == "allow" and out[1]["rule"] is None and len(rows) == 5
    assert out[3]["host"] == "" and out[4]["host"] == "a" * 5000 and len({tuple(r) for r in rows if r["page_id"] == 2}) == 1
    assert url_filter.judge(pages.where("false"), url_model).count() == 0


def test_held_out_urls(spark, url_model):
    """Shapes, neighbours and zones that the labelled table has not."""
    bad = "porn casino poker viagra pills warez keygen malware payday escort xxx betting".split()
    good = "library museum weather garden recipe history school council chess hiking archive orchestra".split()
    urls = [(f"https://{a}{mid}{b}.{zone}/{path}", label) for label, stems in ((1, bad), (0, good)) for stem in stems for a, mid, b, zone, path in ((stem, "", "life", "org.uk", "a/b"), ("top-", stem, "", "biz", "x?y=1"), ("", stem, "4u", "eu", f"start/{stem}"))]
    urls += [(f"https://{name}.at/{i}", 0) for i, name in enumerate("ththnd anthor m.ththth lesdor quielan erande ondit verste unddas losque".split())]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in url_filter.judge(pages, url_model, []).collect()}
    hits = sum(got[i] and label for i, (_, label) in enumerate(urls))
    assert hits / sum(got.values()) > 0.9 and hits / sum(label for _, label in urls) > 0.8


def test_url_scores_equal_brute_force(spark, url_model):
    from pyspark.ml.feature import HashingTF

    hashing = HashingTF(numFeatures=url_filter.HASHED)
    urls = ["https://a.b/c", "http://Wiki-casino.net/é/日本?x", "x://🙂.com/", "nothing", "h:///"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    weights, constant = url_model.coefficients.toArray(), url_model.intercept
    for r in url_filter.judge(pages, url_model).collect():
        grams = [f"{mark}{framed[i : i + n]}" for mark, framed in (("h:", f"^{r['host']}$"), ("p:", f"^{r['path']}$")) for n in url_filter.SIZES for i in range(len(framed) - n + 1)]
        z = constant + sum(weights[hashing.indexOf(g)] for g in grams)
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-6)


def test_very_long_urls_take_linear_time(spark, url_model):
    import time

    began = time.time()
    assert url_filter.judge(spark.createDataFrame([(1, "h://x/" + "ab" * 200_000)], "page_id long, url string"), url_model).count() == 1
    url_filter.judge(spark.createDataFrame([(1, "h://x/" + "ab" * 200_000)], "page_id long, url string"), url_model).collect()
    assert time.time() - began < 60


def test_rules_of_equal_length(spark):
    r, a = url_filter.rule_for(F.col("h"), F.col("p"), [("allow", "b.c", "/"), ("block", "c", "/x/"), ("block", "c", "/y/")])
    df = spark.createDataFrame([("b.c", "/x/"), ("c", "/y/")], "h string, p string")
    assert [tuple(x) for x in df.select(r, a).collect()] == [("b.c/", "allow"), ("c/y/", "block")]


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_languages_of_held_out_documents(spark):
    rows = language_id.query(spark, FOLDER).where("held_out").join(documents(spark).select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows)
    assert len(rows) > 100 and right > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_texts_without_language_and_mixed_ones(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat with the hat", "en"), ("der hund und die katze sind nicht da", "de"), ("привет как дела мой друг", "ru")] * 5)]
    model = language_id.train(spark.createDataFrame([*rows, (90, None, "en"), (91, "text", None)], "doc_id long, text string, lang string"))
    cases = [(1, None), (2, "12 34 !?"), (3, ""), (4, "the cat and the hat " * 5 + "der hund und die katze " * 5), (5, "мой друг"), (6, "ελλάδα"), (7, "the " * 40_000)]
    out = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame([(i, t, "x") for i, t in cases], "doc_id long, text string, lang_pred string"), model, spans=True).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["lang_score"] == 0
    assert (out[6]["lang_pred"], out[6]["lang_score"]) == ("de", 0)
    assert [s["lang"] for s in out[4]["lang_spans"]] == ["en", "de"] and sum(s["words"] for s in out[4]["lang_spans"]) == 50
    assert out[5]["lang_pred"] == "ru" and out[7]["lang_pred"] == "en"
    nothing = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language_id.predict(spark.createDataFrame([(1, "word")], "doc_id long, text string"), nothing).first()["lang_pred"] == "und"


def test_viterbi_matches_every_path():
    rng = np.random.default_rng(7)
    lengths = np.array([5, 0, 1, 4])
    scores = rng.normal(0, 2, (10, 3))
    got = language_id.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        own = scores[at : at + n]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        if n:
            best = max(np.ndindex(*[3] * n), key=value)
            assert value(tuple(got[at : at + n])) == pytest.approx(value(best))
        at += n


def test_more_languages_than_a_byte_counts(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(i, f"{letters[i % 20]}{letters[i // 20]}{letters[i % 7]} " * 8, f"l{i:03d}") for i in range(200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 200
    out = language_id.predict(spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 0.95 * len(out) and len(out) == 203


def test_ties_go_to_the_first_language_and_words_may_mix_scripts(spark):
    model = language_id.train(spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a"), (3, "привет мир", "ru")], "doc_id long, text string, lang string"))
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame([(1, "same words"), (2, "приветмирx"), (3, "xпривет мир")], "doc_id long, text string"), model).collect()}
    assert out == {1: "a", 2: "ru", 3: "ru"}
    assert language_id.scripts_of("abcяß日") == ("cyrillic", "han", "latin") and language_id.scripts_of("") == ()


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("you are a fool", ["aimed"]),
        ("a fool is here", ["plain"]),
        ("you are not a fool", ["negated"]),
        ("she said the fool left", ["quoted"]),
        ("i will kill it", ["threat"]),
        ("nothing here. a fine day", []),
        ("she said so. a fool", ["plain"]),
        (None, []),
        ("", []),
    ],
)
def test_clauses(text, kinds):
    assert [k for *_, k, _ in toxicity.Matcher({"fool"}, set()).matches(text)[0]] == kinds


def test_composition_equals_one_after_the_other():
    a = toxicity.Transducer({(0, "x"): (1, "y", 2.0)})
    b = toxicity.Transducer({(0, "y"): (0, "z", 3.0)})
    whole, state, out = a.compose(b, ["x", "y"]), (0, 0), []
    for s in "xxy":
        state, o, w = whole.step(state, s)
        out.append((o, w))
    assert out == [("z", 6.0), ("x", 1.0), ("z", 3.0)]


def test_cover_equals_the_plain_greedy_choice():
    draw = np.random.default_rng(8)
    names = [f"={w}" for w in ("alpha", "beta", "gamma", "delta", "epsil")] + ["alph", "epsi", "gamm", "zeta", "etaa"]
    for _ in range(20):
        terms = [set(draw.choice(names, draw.integers(0, 6), replace=False).tolist()) for _ in range(30)]
        allowed = {t: float(draw.choice([0.9, 0.95, 0.99])) for t in names}
        wanted, chosen = [toxicity.COVERS] * len(terms), []
        while True:
            left = {t: sum(t in own and w > 0 for own, w in zip(terms, wanted, strict=True)) for t in names if t not in chosen}
            left = {t: n for t, n in left.items() if n >= toxicity.MIN_SUPPORT and not any(c != t and t.lstrip("=").startswith(c) and c[0] != "=" for c in chosen)}
            if not left:
                break
            best = max(left, key=lambda t: (left[t] * allowed[t], len(t), t))
            chosen.append(best)
            wanted = [w - (best in own) for own, w in zip(terms, wanted, strict=True)]
        assert toxicity.cover(terms, allowed) == chosen


def test_logistic_fit_is_a_minimum():
    draw = np.random.default_rng(9)
    x = draw.normal(0, 1, (400, 3))
    y = (draw.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0] + 0.5)))).astype(float)
    w = toxicity.fit_logistic(x, y)

    def loss(v):
        z = x @ v[:3] + v[3]
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (v[:3] @ v[:3]) + 0.5e-6 * v[3] ** 2

    assert all(loss(w) <= loss(w + step) for step in 1e-3 * np.r_[np.eye(4), -np.eye(4)]) and abs(w[0] - 1) < 0.5 and abs(w[1] + 2) < 0.5


def test_labels_of_another_type_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"you blorgish fool{i}" if i % 2 else f"a calm day {i}") for i in range(40)] + [(1, "you blorgish fool1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1)], "doc_id long, toxic long")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 41 and all(r["tox_predicted"] == r["doc_id"] % 2 for r in out)
    assert len({r["tox_score"] for r in out if r["doc_id"] == 1}) == 1


def test_toxic_held_out_documents(spark):
    """At the largest scale: the smaller ones have a few toxic labels only, some of them wrong."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.query(spark, folder).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    positive = [r["score"] for r in rows if r["toxic"] == 1]
    negative = [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(p > n) + (p == n) / 2 for p in positive for n in negative])
    assert auc > 0.9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_threats_and_their_inflections_are_learned_from_labels(spark):
    said = ["i crush you", "we crush the them", "crushing her now", "i was crushed he said", "you fool", "that fool. you see", "the fool we know", "a fool too", "he was killing it", "killing time"]
    said += ["killing", "killing all"]
    calm = ["rain and wind", "you and me", "a tree", "he said so"]
    rows = [(i, t, 1) for i, t in enumerate(said * 2)] + [(100 + i, t, 0) for i, t in enumerate(calm * 10)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    matcher = toxicity.Matcher(model.words, model.prefixes, model.threats)
    kinds = {text: [k for *_, k, _ in matcher.matches(text)[0]] for text in ("i crush you", "fool", "you fool", "killing", "no crush", "he said crush", "rain")}
    assert kinds == {"i crush you": ["threat"], "fool": ["plain"], "you fool": ["aimed"], "killing": ["threat"], "no crush": ["negated"], "he said crush": ["quoted"], "rain": []}
    assert matcher.before_targets("fool. you fool") == {matcher.term("fool"): False} and matcher.before_targets(None) == {}


def test_toxicity_without_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "old"), (2, None, "old"), (3, "x " * 50_000, "old")], "doc_id long, text string, tox_score string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(docs, model, spans=True).collect()
    assert len(out) == 3 and all(r["tox_predicted"] == 0 and r["tox_matches"] == [] for r in out)
    assert toxicity.score(docs.where("false"), model).count() == 0


def brute_katz(rows, order=2):
    """Probabilities by the definitions, one n-gram at a time, for any order."""
    words = lambda t: (t or "").encode().lower().split()
    grams = {n: {} for n in range(1, order + 1)}
    documents = 0
    for _, text, keep in rows:
        if keep:
            documents += 1
            tokens = ["<s>"] * (order - 1) + [*words(text), "</s>"]
            for i in range(order - 1, len(tokens)):
                for n in grams:
                    gram = tuple(tokens[i - n + 1 : i + 1])
                    grams[n][gram] = grams[n].get(gram, 0) + 1
    uni = grams[1]
    total, types = sum(uni.values()), len(uni)
    factors = {n: katz.good_turing(np.array([sum(1 for v in table.values() if v == r) for r in range(katz.GOOD_TURING_MAX + 2)])) for n, table in grams.items()}
    cut = lambda c: min(c, katz.GOOD_TURING_MAX + 1)
    kept = sum(c * factors[1][cut(c)] for c in uni.values()) / total
    unknown = max(1 - kept, 1 / (total + 1))
    scale = (1 - unknown) / kept

    def context_count(h):
        return documents if set(h) == {"<s>"} else grams[len(h)].get(h, 0)

    held = {n: {} for n in range(2, order + 1)}
    for n in held:
        for gram, c in grams[n].items():
            held[n].setdefault(gram[:-1], {})[gram[-1]] = c * factors[n][cut(c)] / context_count(gram[:-1])

    def p(w, h):
        if not h:
            return scale * uni[w,] * factors[1][cut(uni[w,])] / total if (w,) in uni else unknown
        own = held[len(h) + 1].get(h, {})
        s, weight = katz.backoff(np.array([sum(own.values())]), np.array([sum(p(x, h[1:]) for x in own)]), np.array([max(context_count(h), 1)]))
        return float(own[w] * s[0]) if w in own else float(weight[0] * p(w, h[1:]))

    out = {}
    for i, text, _ in rows:
        tokens = ["<s>"] * (order - 1) + [*words(text), "</s>"]
        own = range(order - 1, len(tokens))
        score = sum(math.log10(p(tokens[k], tuple(tokens[k - order + 1 : k]))) for k in own)
        base = sum(math.log10((uni.get((tokens[k],), 0) + 1) / (total + types + 1)) for k in own)
        out[i] = (len(own), sum((tokens[k],) in uni for k in own), total, base, score)
    vocabulary = [*(w for (w,) in uni), "never seen"]
    sums = [sum(p(w, h) for w in vocabulary) for h in [*list(held[order])[:20], ("nowhere",) * (order - 1)]]
    return out, sums


@pytest.mark.parametrize("order", [2, 3])
def test_katz_matches_brute_force(spark, order):
    rng = np.random.default_rng(0)
    words = [f"v{int(x)}" for x in rng.zipf(1.4, 3000) if x < 200]
    rows = [(i, " ".join(words[20 * i : 20 * i + 1 + i % 25]), i % 7 != 2) for i in range(60)] + [(900, None, True), (901, "", False), (902, "brand new", False), (903, "V1 v2\tv1", True)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    keep = F.col("doc_id").isin([i for i, _, k in rows if k])
    want, sums = brute_katz(rows, order)
    assert sums == pytest.approx([1.0] * len(sums))
    got = katz.score(df, keep, order).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert (r["base_score"], r["score"]) == pytest.approx((base, score))


def test_katz_of_repeats_rows_without_id_and_long_texts(spark):
    """Each row counts and scores; rows without id are not learned from, whatever their number."""
    rows = [(1, "a b a"), (1, "a b a"), (1, "a b c"), (2, "b " * 60_000)] + [(None, f"a b x{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = katz.score(df, F.col("doc_id").isNotNull()).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {4 * 3 + 60_001}
    assert [r["n_tokens"] for r in got if r["doc_id"] == 2] == [60_001] and sum(r["doc_id"] is None for r in got) == 50
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 2


def test_packed_numbers():
    numbers = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64, endpoint=False))
    assert np.array_equal(katz.unpacked(katz.packed(numbers)), numbers) and len(katz.unpacked(katz.packed(numbers[:0]))) == 0


def test_katz_without_rows_or_training(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(none, F.lit(True)).count() == 0
    out = katz.score(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in out} == {(1, 2, 0, 0.0), (2, 1, 0, 0.0)}


def test_katz_beats_the_base_on_held_out_documents(spark):
    r = katz.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_katz_keeps_bigrams_seen_once(spark):
    """The words of both held-out texts occur equally often; only the first one's bigram was seen, once."""
    rows = [(1, "x y", True), (2, "z w", True), (3, "y x", True), (4, "w z", True), (5, "x y", False), (6, "x w", False)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in katz.score(df, F.col("doc_id") <= 4).collect()}
    assert out[5] > out[6] + 0.1


def test_katz_of_one_text_repeated_very_often(spark, monkeypatch):
    """With an id and without one; blocks stay small, and every row is counted and scored."""
    monkeypatch.setattr(katz, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(1)
    rows = [(7, "hot words again and again", True)] * 20_000 + [(8, "hot words", False)] * 9_000
    rows += [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 30, 8)), True) for i in range(100, 200)] + [(300 + i, "long " * 900 + str(i), False) for i in range(12)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "hot words")] * 9_000, "doc_id long, text string").repartition(4)
    keep = (F.col("doc_id") == 7) | F.col("doc_id").between(100, 199)
    docs, blocks, documents, repeated = katz.with_blocks(df.withColumn("_train", F.coalesce(keep, F.lit(False))), F.col("_train"))
    assert repeated and documents == 20_100 and docs.agg(F.sum("copies")).first()[0] == len(rows) + 9_000
    assert docs.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] < 2 * katz.BLOCK_BYTES
    assert docs.agg(F.max("block")).first()[0] < blocks
    want, _ = brute_katz([*rows, (-1, "hot words", False)])
    got = katz.score(df, keep).groupBy("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 9).alias("b"), F.round("score", 9).alias("s")).count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {7: 20_000, 8: 9_000, None: 9_000, **{i: 1 for i, _, _ in rows if i >= 100}}
    for r in got:
        n, known, total, base, score = want[-1 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert (r["b"], r["s"]) == pytest.approx((base, score), abs=1e-7)
