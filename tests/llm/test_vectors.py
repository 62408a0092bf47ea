"""Centroid clustering and top-k search against full scans, and the SQL of both."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsift.llm import block_topk, centroid_clusters, registry

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op13_block_topk"])
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cursor.fetchall())


def lloyd(rows, k, rounds, width, scale, seed):
    """Plain Lloyd rounds in Python's integers."""
    kept = [(i, [int(np.floor(scale * e)) for e in x]) for i, x in rows if x is not None and len(x) == width and all(e is not None and np.isfinite(e) for e in x)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centers = [x for _, _, x in sorted((digest(i), x, x) for i, x in kept if i is not None)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centers)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted((str(i), *near(x)[::-1]) for i, x in kept), centers


@pytest.mark.parametrize("size", [1.0, 3e4])
def test_clusters_equal_plain_rounds(spark, size):
    """With ties, repeated vectors and ids, vectors that do not count, and components beyond exact doubles."""
    rng = np.random.default_rng(3)
    rows = [(i, (size * rng.choice([0.0, 0.25, 0.5], 8) if i % 3 else size * rng.normal(0, 1, 8)).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (7, [0.5] * 8), (None, [0.25] * 8), (500, None), (501, [1.0] * 7), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [None] * 8)]
    found, centers = centroid_clusters.cluster(table(spark, rows), k=12, rounds=4, width=8, scale=64, seed=5)
    want, want_centers = lloyd(rows, 12, 4, 8, 64, 5)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    assert centers.tolist() == want_centers


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (10 * (i % 6) + rng.normal(0, 0.1, 4)).tolist()) for i in range(600)]
    found, _ = centroid_clusters.cluster(table(spark, rows), k=6, rounds=5, width=4, scale=16)
    scans = found.agg(F.sum("scans")).first()[0]
    assert scans < 0.6 * 6 * 600


def test_bounds_hold_after_moves():
    rng = np.random.default_rng(5)
    x, old = rng.integers(-500, 500, (300, 6)), rng.integers(-500, 500, (9, 6))
    none = np.full(300, -1)
    cluster, upper, lower, scanned = centroid_clusters.Step(old, None).assign(x, none, np.zeros(300), np.zeros(300))
    assert scanned.all()
    for _ in range(4):
        new = old + rng.integers(-20, 21, old.shape)
        cluster, upper, lower, scanned = centroid_clusters.Step(new, old).assign(x, cluster, upper, lower)
        far = np.sqrt(((x[:, None] - new[None]) ** 2).sum(2))
        assert (cluster == far.argmin(1)).all()
        own = far[np.arange(300), cluster]
        far[np.arange(300), cluster] = np.inf
        assert (upper >= own).all() and (lower <= far.min(1)).all()
        old = new


def test_clusters_of_odd_tables(spark):
    nothing = table(spark, [])
    found, centers = centroid_clusters.cluster(nothing)
    assert found.count() == 0 and len(centers) == 0
    few, centers = centroid_clusters.cluster(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])]), k=5, width=2)
    assert len(centers) == 2 and sorted(r["distance"] for r in few.collect()) == [0, 0]
    clash = spark.createDataFrame([(1, [0.5] * 3, 9, 8, "y")], "vec_id int, embedding array<float>, cluster int, X int, `a.b` string")
    found, _ = centroid_clusters.cluster(clash, width=3)
    assert [tuple(r) for r in found.collect()] == [(1, 0, 0, 1)]
    without, centers = centroid_clusters.cluster(table(spark, [(None, [1.0]), (None, [3.0])]), k=2, width=1, scale=1)
    assert sorted(r["distance"] for r in without.collect()) == [1, 1] and centers.tolist() == [[2]]


def best(rows, asks, k, scale):
    """Every query against every row, in Python's integers."""
    kept = {}
    for i, x in rows:
        if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x):
            x = [int(np.floor(scale * e)) for e in x]
            kept[i] = min(x, kept.get(i, x))
    out = []
    for q in sorted(i for i in kept if asks(i)):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], x, strict=False)), i) for i, x in kept.items() if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("sizes", [(16, 64, 3, 2), (4, 8, 1, 1), (128, 65_536, 16_384, 1_024)])
@pytest.mark.parametrize("size", [1.0, 6e4])
def test_topk_equals_every_pair(spark, monkeypatch, sizes, size):
    """A third of the rows share one vector, so scores tie; ids repeat; lengths differ; some take no part."""
    for name, value in zip(("BLOCK", "SHARD", "GROUP", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(block_topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(int(i), ([0.5, -0.5, 0.25, 0.0] if i % 3 == 0 else (size * rng.normal(0, 1, 4)).tolist())) for i in rng.permutation(300)]
    rows += [(5, [9.0] * 4), (None, [1.0] * 4), (400, None), (402, [float("nan")] * 4), (404, [None, 1.0]), (406, [1.0, 2.0]), (408, []), (410, [0.0] * 4)]
    found = block_topk.search(table(spark, rows), F.col("vec_id") % 10 == 0, k=7, scale=32)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())
    assert got == best(rows, lambda i: i % 10 == 0, 7, 32)


def test_blocks_are_pruned():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-5, 6, (64, 8)) + 100 * np.eye(8, dtype=int)[c] for c in range(8)]).astype(np.int32)
    blocks = [x[i : i + 16] for i in range(0, len(x), 16)]
    packed = pa.table({"ids": [np.arange(16 * b, 16 * b + 16).tobytes() for b in range(len(blocks))], "x": [b.tobytes() for b in blocks], "top": [b.max(0).tobytes() for b in blocks], "low": [b.min(0).tobytes() for b in blocks]})
    shard = block_topk.Shard(packed, 8)
    asked = np.arange(0, len(x), 8)
    limit = np.full(len(asked), block_topk._LEAST), np.full(len(asked), block_topk._NO_ID)
    found = shard.search(asked, x[asked], *limit, 5)
    scores = x[asked].astype(int) @ x.T.astype(int)
    scores[np.arange(len(asked)), asked] = -(10**9)
    want = [sorted(zip(-s, range(len(x)), strict=True))[:5] for s in scores]
    got = [sorted(zip((-found.score[found.query == q]).tolist(), found.id[found.query == q].tolist(), strict=True)) for q in range(len(asked))]
    assert got == want
    assert shard.scored < 0.3 * len(asked) * len(blocks)


def test_topk_of_odd_tables(spark):
    asks = F.col("vec_id") % 2 == 0
    assert block_topk.search(table(spark, []), asks).count() == 0
    assert block_topk.search(table(spark, [(1, [1.0])]), asks).count() == 0
    assert block_topk.search(table(spark, [(2, [1.0])]), asks).count() == 0
    clash = spark.createDataFrame([(2, [1.0], 5, 6, "z"), (3, [2.0], 5, 6, "z")], "vec_id long, embedding array<float>, Score int, x int, `a.b` string")
    assert [tuple(r) for r in block_topk.search(clash, asks, scale=1).collect()] == [(2, 1, 3, 2)]
