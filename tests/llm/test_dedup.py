import numpy as np
import pytest

from gridsift.llm import common, embedding_dedup, minhash_dedup
from gridsift.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def text_links(rows):
    """All pairs at the threshold, by full sets of word tuples."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, near


def check_texts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = {r["doc_id"]: r for r in minhash_dedup.link(df).collect()}
    sets, near = text_links([(i, t) for i, t, _ in rows])
    want = roots(sets, near)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == want[i]) for i, r in out.items())
    return out


def test_texts_match_brute_force_on_documents(spark):
    docs = [(r["doc_id"], r["text"], None) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_texts(spark, docs)


def test_edited_copies_of_one_original(spark, monkeypatch):
    """Copies that are near the original but not near each other, in lists of more than one block."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base), None)]
    for i in range(1, 60):
        words = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words), None))
    check_texts(spark, rows)


def test_sets_that_fit_in_their_keys_and_partners_that_do_not(spark):
    """Pairs (smaller, larger set) at or just above the threshold, the smaller one inside the larger."""
    rows = []
    for pair, (few, many) in enumerate([(36, 48), (37, 49), (44, 58), (45, 60), (46, 61), (47, 62), (48, 60), (48, 63), (48, 64), (49, 65)] * 12):
        words = [f"p{pair}_{i}" for i in range(many + 4)]
        rows += [(2 * pair, " ".join(words[: few + 4]), None), (2 * pair + 1, " ".join(words), None)]
    out = check_texts(spark, rows)
    assert sum(not r["kept"] for r in out.values()) == len(rows) // 2


def test_texts_without_and_with_few_words(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "One two", "b"), (5, "one  TWO ", "b"), (6, "one", "b"), (7, long, "c"), (8, long + " end", "c"), (9, "É one", "d"), (10, "é one", "d")]
    out = check_texts(spark, rows)
    assert out[5]["component_id"] == 4 and out[8]["component_id"] == 7 and out[2]["component_id"] == 2 and out[10]["component_id"] == 10
    assert minhash_dedup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "b b b b b b"), (1, "a a a a a a"), (None, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in minhash_dedup.link(twice).collect()] == [1]


def test_estimate_is_exact_where_sets_fit(spark):
    sets = [np.sort(np.random.default_rng(i).choice(1000, 60, replace=False)) for i in range(12)]
    sketch = minhash_dedup._matrix(__import__("pyarrow").array([s.tolist() for s in sets]), minhash_dedup.SKETCH, -1)
    i, j = np.triu_indices(12, 1)
    got = minhash_dedup.near_pairs(np.full(12, 60), sketch, i, j)
    want = [100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 460)]
    out = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert out == roots(ids, [e for e in edges if e[0] != e[1]])


def vector_links(rows):
    good = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v, label in rows if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(good)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= embedding_dedup.MIN_COSINE]


def test_vectors_match_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    out = {r["vec_id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    near = vector_links(rows)
    assert len(out) == len(rows)
    want = dict.fromkeys(out, 0)
    for a, b in near:
        want[a] += 1
        want[b] += 1
    assert all(out[i]["n_links"] <= n for i, n in want.items())
    assert sum(r["n_links"] for r in out.values()) >= 0.97 * 2 * len(near)


def test_vectors_that_cannot_be_compared_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 16)
    rows = [(i, [float(x) for x in base + rng.normal(0, 0.05, 16)], 1) for i in range(30)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [None] + [1.0] * 15, 1), (104, rows[0][1], None), (105, rows[0][1], 2), (106, [], 1), (107, [1.0], 1)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1)]
    out = {r["vec_id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = roots(out, vector_links(rows))
    assert {i: r["component_id"] for i, r in out.items()} == want
    count = {i: sum(i in e for e in vector_links(rows)) for i in out}
    assert {i: r["n_links"] for i, r in out.items()} == count
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(0, 1, (5, 64))
    assert np.linalg.norm(embedding_dedup.hadamard(x), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))


def test_repeated_ids_keep_the_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in common.unique_by_id(df, "doc_id", "text").collect()} == {(1, "a"), (2, None)}
