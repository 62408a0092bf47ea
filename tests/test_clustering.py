import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from gridsift.operators import clustering, kmeans, metrics, scaling

#: K, silhouette, Calinski-Harabasz, Davies-Bouldin, inertia; K 2 and 3 get two votes each.
SWEEP = [(2, 0.11, 16.6, 3.29, 5890.0), (3, 0.05, 12.9, 3.36, 5640.0), (4, 0.04, 11.5, 3.3, 5430.0), (5, 0.045, 10.3, 3.2, 5270.0), (6, 0.03, 9.9, 2.9, 5090.0), (7, 0.02, 9.0, 2.8, 4990.0), (8, 0.01, 8.2, 2.7, 4900.0)]
K_TABLE = "k int, silhouette double, ch double, db double, inertia double"


def cloud(spark, n=90, k=3, d=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, i % k, [float(v) for v in rng.normal(3.0 * (i % k), 1, d)]) for i in range(n)]
    rows += [(n, k, [50.0] * d)]  # alone in its cluster
    return spark.createDataFrame(rows, "id long, cluster int, x array<double>")


def brute(rows):
    x = np.array([r["x"] for r in rows])
    c = np.array([r["cluster"] for r in rows])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sil = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            sil.append(0.0)
            continue
        a = far[i][own].mean()
        b = min(far[i][c == o].mean() for o in set(c) - {c[i]})
        sil.append((b - a) / max(a, b))
    cents = {o: x[c == o].mean(0) for o in set(c)}
    inertia = sum(((x[c == o] - m) ** 2).sum() for o, m in cents.items())
    between = sum((c == o).sum() * ((m - x.mean(0)) ** 2).sum() for o, m in cents.items())
    ch = between / (len(cents) - 1) / (inertia / (len(x) - len(cents)))
    s = {o: np.sqrt(((x[c == o] - m) ** 2).sum(1)).mean() for o, m in cents.items()}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in cents if j != i) for i in cents])
    return inertia, np.array(sil), ch, db


@pytest.mark.parametrize("block", [7, 2048])
def test_metrics_match_brute_force(spark, block):
    pts = cloud(spark)
    inertia, sil, ch, db = brute(pts.orderBy("id").collect())
    got = metrics.silhouettes(pts, block).orderBy("id").collect()
    assert [r["silhouette"] for r in got] == pytest.approx(sil.tolist())
    assert metrics.inertia(pts).first()["inertia"] == pytest.approx(inertia)
    found = metrics.all_metrics(pts)
    assert (found["ch"], found["db"], found["silhouette"]) == pytest.approx((ch, db, sil.mean()))


def test_metrics_of_one_cluster_and_none(spark):
    one = cloud(spark).selectExpr("id", "0 AS cluster", "x")
    assert metrics.calinski_harabasz(one) is None and metrics.davies_bouldin(one) is None
    assert metrics.silhouette(one) == 0.0
    assert metrics.silhouettes(one.where("false")).count() == 0


def test_equal_points_have_distance_zero(spark):
    pts = spark.createDataFrame([(i, i // 2, [1e6 + i // 2, 1e6]) for i in range(4)], "id long, cluster int, x array<double>")
    assert metrics.silhouette(pts) == pytest.approx(1.0)


def ari(a, b):
    n = len(a)
    pairs = list(itertools.combinations(range(n), 2))
    same = lambda v: np.array([v[i] == v[j] for i, j in pairs])
    sa, sb = same(a), same(b)
    expected = sa.sum() * sb.sum() / len(pairs)
    most = (sa.sum() + sb.sum()) / 2
    return 1.0 if most == expected else ((sa & sb).sum() - expected) / (most - expected)


def test_rand_index(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 40).tolist(), rng.integers(0, 4, 40).tolist()
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert metrics.rand_table(df, "a", "b").first()["ari"] == pytest.approx(ari(a, b))
    assert metrics.rand_table(df, "a", "a").first()["ari"] == 1.0
    assert metrics.rand_table(df.selectExpr("1 AS a", "2 AS b"), "a", "b").first()["ari"] == 1.0


def test_vote_keeps_insertion_order_on_ties(spark):
    sweep = spark.createDataFrame(SWEEP, K_TABLE)
    votes = {r["k"]: r["votes"] for r in clustering.votes(sweep).collect()}
    assert votes[2] == votes[3] == 2 and clustering.choose_k(sweep) == 2
    falling = [(k, s, c, d, i) for k, s, c, d, i in ((2, 0.5, 200, 0.5, 100), (3, 0.3, 100, 1.0, 90), (4, 0.2, 80, 1.2, 80), (5, 0.15, 60, 1.5, 70), (6, 0.1, 40, 1.8, 60))]
    assert clustering.choose_k(spark.createDataFrame([tuple(map(float, r)) for r in falling], "k double, silhouette double, ch double, db double, inertia double")) == 2


def test_kmeans_finds_separate_clouds_and_is_stable(spark):
    pts = cloud(spark).where("cluster < 3").selectExpr("id AS consumer_id", "x AS pc", "cluster AS truth")
    points = pts.persist()
    sweep, models = clustering.sweep(points, range(2, 4), restarts=2)
    assert [r["k"] for r in sweep.orderBy("k").collect()] == [2, 3]
    labels = clustering.label(points, models[3])
    assert labels.select("cluster").distinct().count() == 3
    assert metrics.rand_table(labels, "cluster", "truth").first()["ari"] > 0.9
    result = clustering.stability_summary(*clustering.stability(points, 3, runs=3, restarts=2), 3)
    assert result["n_runs"] == 3 and result["mean_ari"] > 0.9


def test_lloyd_step_ties_take_the_first(spark):
    pts = spark.createDataFrame([(1, [0.0]), (2, [10.0]), (3, [5.0])], "id long, x array<double>")
    out = {r["id"]: r["cluster"] for r in clustering.lloyd_step(pts, [[0.0], [10.0]]).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


def test_scaling_and_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (60, 2))
    x = np.c_[base, base @ rng.normal(0, 1, (2, 2)) + 0.01 * rng.normal(0, 1, (60, 2)), np.full(60, 7.0)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "consumer_id long, a double, b double, c double, d double, e double")
    scaler = scaling.fit_scaler(df)
    assert "consumer_id" not in scaler.columns
    scaled = np.array([[r[c] for c in scaler.columns] for r in scaler.transform(df).collect()])
    assert scaled.mean(0) == pytest.approx(np.zeros(5), abs=1e-9) and scaled.std(0)[:4] == pytest.approx(np.ones(4))
    found = scaling.fit_components(df, 0.95, ["a", "b", "c", "d"])
    rows = found.explained(spark).orderBy("component").collect()
    assert rows[-1]["cumulative"] == pytest.approx(1.0) and found.n == 2
    scores = np.array([r["pc"] for r in found.scores(df).orderBy("consumer_id").collect()])
    values = np.linalg.eigvalsh(np.cov(scaled[:, :4].T))[::-1]
    assert scores.var(axis=0, ddof=1) == pytest.approx(values[:2])
    with pytest.raises(ValueError):
        scaling.fit_scaler(df.select("consumer_id"))


def test_components_needed():
    assert scaling.components_needed([0.6, 0.3, 0.1], 0.95) == 3
    assert scaling.components_needed([0.6, 0.3, 0.1], 0.6) == 1
    assert scaling.components_needed([0.5, 0.1], 0.95) == 2


def test_balance(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "cluster int")
    assert math.isclose(clustering.balance(df).first()["balance"], 0.5)


def test_registered_queries_do_the_whole_job(spark, monkeypatch):
    """K 2 to 10, ten starts, ten runs, stability on."""
    from inspect import signature
    from unittest.mock import MagicMock

    from gridsift.queries import clusters

    calls = {}
    for name in ("panel", "rounded", "_scores"):
        monkeypatch.setattr(clusters, name, MagicMock())
    for module, name in ((clusters, "analyse"), (clusters, "ablate"), (clusters.clustering, "sweep"), (clusters.clustering, "stability"), (clusters.clustering, "fit_kmeans")):
        own = signature(getattr(module, name))

        def record(*args, own=own, name=name, **named):
            bound = own.bind(*args, **named)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return MagicMock(), MagicMock()

        monkeypatch.setattr(module, name, MagicMock(side_effect=record))
    for name in ("stability_summary", "label"):
        monkeypatch.setattr(clusters.clustering, name, MagicMock())
    clusters.analyse.side_effect = lambda *a: calls.update(analyse={"settings": a[1]}) or MagicMock()
    for query in (clusters.analysis, clusters.ablation, clusters.k_sweep, clusters.stability_runs, clusters.kmeans_labels):
        query(MagicMock(), "folder")
    for name in ("analyse", "ablate"):
        s = calls[name]["settings"]
        assert (s.ks, s.restarts, s.test_stability) == ((2, 11), 10, True)
    assert calls["sweep"]["ks"] == range(2, 11) and calls["sweep"]["restarts"] == calls["fit_kmeans"]["restarts"] == 10
    assert (calls["stability"]["runs"], calls["stability"]["restarts"]) == (10, 10)


def test_models_that_advance_together_equal_models_alone(spark):
    """From the same starts, by plain Lloyd passes; a model that rests early leaves."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0.0, 4.0, 9.0)])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "consumer_id long, pc array<double>").repartition(3)
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 5, 5)] + [np.array([[0.0] * 3, [1e6] * 3])]
    for start, (centers, cost, passes) in zip(starts, kmeans.lloyd(points, starts, "pc"), strict=True):
        want, n = start.copy(), 0
        while True:
            own = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(want)])
            moved, want, n = ((new - want) ** 2).sum(1).max(), new, n + 1
            if moved <= kmeans.TOLERANCE**2:
                break
        assert centers == pytest.approx(want) and passes == n
        assert cost == pytest.approx(((x[:, None] - want[None]) ** 2).sum(2).min(1).sum())


def test_rows_of_many_tasks_are_added_by_spark(spark, monkeypatch):
    pts = cloud(spark).selectExpr("id AS consumer_id", "x AS pc")
    want = clustering.fit_all(pts, [(3, 1), (4, 2)])
    monkeypatch.setattr(kmeans, "FEW", 0)
    monkeypatch.setattr(kmeans, "SHARE", 50)
    for a, b in zip(want, clustering.fit_all(pts.repartition(4), [(3, 1), (4, 2)]), strict=True):
        assert a.inertia == pytest.approx(b.inertia) and a.centers == pytest.approx(b.centers)


def test_starts_do_not_depend_on_partitions_and_few_points_suffice(spark):
    pts = cloud(spark).selectExpr("id AS consumer_id", "x AS pc")
    one = kmeans.starts(pts.coalesce(1), [(3, 5), (6, 9)], "consumer_id", "pc")
    two = kmeans.starts(pts.repartition(3), [(3, 5), (6, 9)], "consumer_id", "pc")
    assert [len(s) for s in one] == [3, 6] and all(a == pytest.approx(b) for a, b in zip(one, two, strict=True))
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "consumer_id long, pc array<double>")
    model = clustering.fit_kmeans(same, 4, restarts=2)
    assert len(model.centers) == 2 and model.inertia == pytest.approx(0.0)
    with pytest.raises(ValueError):
        clustering.fit_kmeans(same.where("false"), 2)


def test_equal_points_are_one_row_of_a_pass(spark, monkeypatch):
    """455 points, 91 different ones: passes read 91 rows, and draws, centres and costs are those of all points."""
    read, real = [], kmeans._gathered
    monkeypatch.setattr(kmeans, "_gathered", lambda points, n: read.append(points.count()) or real(points, n))
    once = cloud(spark).selectExpr("id AS consumer_id", "x AS pc")
    pts = once.selectExpr("explode(sequence(0, 4)) AS copy", "*").selectExpr("consumer_id + 1000 * copy AS consumer_id", "pc").persist()
    models = clustering.fit_all(pts, [(3, 1), (4, 2)])
    assert read == [91, 91]
    x = np.array([r["pc"] for r in pts.collect()])
    for m in models:
        assert m.inertia == pytest.approx(((x[:, None] - m.centers[None]) ** 2).sum(2).min(1).sum())
    starts = [np.array(x[:3]), np.array(x[10:14])]
    weighed = once.selectExpr("pc", "IF(consumer_id % 2 = 0, 5D, 1D) AS n")
    long = once.selectExpr("explode(sequence(1, IF(consumer_id % 2 = 0, 5, 1)))", "pc")
    for (a, cost, n), (b, want, m) in zip(kmeans.lloyd(weighed, starts, "pc", number="n"), kmeans.lloyd(long, starts, "pc"), strict=True):
        assert a == pytest.approx(b) and cost == pytest.approx(want) and n == m


def test_stability_pairs_what_is_labelled_alike(spark, monkeypatch):
    """The table that pairs of runs are made from has a row for each different array of labels, not for each point."""
    rows, real = [], metrics.rand_table
    monkeypatch.setattr(metrics, "rand_table", lambda df, *names, **more: rows.append(df.count()) or real(df, *names, **more))
    points = cloud(spark).selectExpr("id AS consumer_id", "x AS pc").persist()
    ari, _ = clustering.stability(points, 3, runs=3, restarts=2)
    assert rows[0] <= 3 * 27
    models = [clustering._best(clustering.fit_all(points, [(3, 42 + i), (3, 1042 + i)])) for i in range(3)]
    wide = clustering.labelings(points, models)
    for r in ari.collect():
        assert r["ari"] == pytest.approx(real(wide.selectExpr(f"clusters[{r['a']}] AS x", f"clusters[{r['b']}] AS y"), "x", "y").first()["ari"])


def test_nearest_centres_of_stacks_of_any_sizes():
    """Models of equal and unequal numbers of centres, some centres equal: the first of the nearest."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (50, 2)).astype(float)
    centers = [rng.integers(0, 4, (k, 2)).astype(float) for k in (1, 3, 3, 2, 5, 5, 1)]
    stack = kmeans.Stack(centers)
    (_, at, least), = stack.nearest(x)
    for m, own in enumerate(centers):
        far = ((x[:, None] - own[None]) ** 2).sum(2)
        assert least[:, m] == pytest.approx(far.min(1), abs=1e-9)
        assert far[np.arange(50), at[:, m] - stack.first[m]] == pytest.approx(far.min(1), abs=1e-9)


def test_correlations_of_gaps_constants_and_nothing(spark):
    from gridsift.operators import exploration

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (50, 3)) + [1e6, 0, 5]
    rows = [(i, *(None if rng.random() < 0.2 else float(v) for v in r), 7.0, None, float("nan") if i == 3 else float(i)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "consumer_id long, a double, `b.c` double, d double, e double, f double, g double").repartition(3)
    table = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    names = ["a", "b.c", "d", "e", "f", "g"]
    got = {(r["a"], r["b"]): r["r"] for r in exploration.correlations(df).collect()}
    assert len(got) == 15
    for i, j in itertools.combinations(range(6), 2):
        both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
        if {i, j} & {3, 4}:
            assert got[names[i], names[j]] is None
        else:
            assert got[names[i], names[j]] == pytest.approx(np.corrcoef(table[both, i], table[both, j])[0, 1], abs=1e-9)
    assert all(r["r"] is None for r in exploration.correlations(df.where("false")).collect())


def test_components_of_dependent_columns(spark):
    """Shares that sum to one have a last component of zero; the spectrum is that of the covariances."""
    rng = np.random.default_rng(9)
    share = rng.dirichlet(np.ones(6), 80)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(share)], "consumer_id long, " + ", ".join(f"s{j} double" for j in range(6))).repartition(5)
    found = scaling.fit_components(df)
    z = (share - share.mean(0)) / share.std(0)
    values = np.linalg.eigvalsh(np.corrcoef(z.T))[::-1]
    assert np.array(found.ratios) * 6 == pytest.approx(np.maximum(values, 0), abs=1e-9)
    assert found.matrix.T @ found.matrix == pytest.approx(np.eye(6), abs=1e-12)
    few = scaling.fit_components(df.limit(2))
    assert sum(few.ratios) == pytest.approx(1.0) and len(few.ratios) == 6


def test_silhouettes_by_coreset(spark):
    """Whole clusters below its size, drawn ones above; mean distances stay within the stated error."""
    pts = cloud(spark, n=600).persist()
    _, sil, _, _ = brute(pts.orderBy("id").collect())
    whole = metrics.silhouettes_by_coreset(pts).orderBy("id").collect()
    assert [r["silhouette"] for r in whole] == pytest.approx(sil.tolist())
    error = 0.8
    size = metrics.coreset_size(error)
    assert size < 200
    x, weight, cluster, sizes = metrics.coresets(pts, size)
    assert len(x) < 601 and sizes == {0: 200, 1: 200, 2: 200, 3: 1}
    rows = pts.collect()
    for c in (0, 1, 2):
        own = np.array([r["x"] for r in rows if r["cluster"] == c])
        for r in rows:
            exact = np.linalg.norm(own - r["x"], axis=1).mean()
            near = (np.linalg.norm(x[cluster == c] - r["x"], axis=1) * weight[cluster == c]).sum()
            assert abs(near - exact) <= error * exact
    again = metrics.coresets(pts.repartition(5), size)
    assert (again[0] == x).all() and again[1] == pytest.approx(weight)
    assert abs(metrics.silhouette(pts, error=error) - sil.mean()) < 0.2
    one = pts.selectExpr("id", "0 AS cluster", "x")
    assert metrics.silhouette(one, error=error) == 0.0 and metrics.silhouettes_by_coreset(one.where("false"), error).count() == 0


def test_many_points_take_the_coreset(spark, monkeypatch):
    monkeypatch.setattr(metrics, "EXACT_UPTO", 10)
    calls = []
    real = metrics.silhouettes_by_coreset
    monkeypatch.setattr(metrics, "silhouettes_by_coreset", lambda *a: calls.append(a[1]) or real(*a))
    pts = cloud(spark)
    metrics.silhouette(pts)
    metrics.metrics_of_labelings(pts.selectExpr("id", "array(cluster, cluster % 2) AS clusters", "x"), 2)
    assert calls == [metrics.ERROR] * 3


def test_equal_points_count_once_toward_the_exact_limit(spark, monkeypatch):
    """455 points, 91 different ones: exact silhouettes of all, where a limit of 100 sent them to the coreset."""
    monkeypatch.setattr(metrics, "EXACT_UPTO", 100)
    monkeypatch.setattr(metrics, "silhouettes_by_coreset", None)
    once = cloud(spark)
    pts = once.selectExpr("explode(sequence(0, 4)) AS copy", "*").selectExpr("id + 1000 * copy AS id", "cluster", "x")
    _, sil, _, _ = brute(pts.collect())
    assert metrics.silhouette(pts) == pytest.approx(sil.mean(), abs=1e-12)
    both = metrics.metrics_of_labelings(pts.selectExpr("id", "array(cluster, cluster % 2) AS clusters", "x"), 2)
    _, halves, _, _ = brute(pts.selectExpr("id", "cluster % 2 AS cluster", "x").collect())
    assert [m["silhouette"] for m in both] == pytest.approx([sil.mean(), halves.mean()], abs=1e-12)


def test_points_are_sent_to_a_bounded_number_of_tasks(spark):
    """Small blocks are joined, so that a point is not copied once for each 256 others."""
    assert [metrics._blocks(n, 256) for n in (0, 500, 102_564, 615_384)] == [1, 2, 24, 24]
    assert metrics._blocks(3_276_800, 256) == 100
    pts = cloud(spark, n=120)
    _, sil, _, _ = brute(pts.orderBy("id").collect())
    assert [r["silhouette"] for r in metrics.silhouettes(pts, 1).orderBy("id").collect()] == pytest.approx(sil.tolist())


def test_distances_of_near_points_far_from_the_rest():
    rng = np.random.default_rng(4)
    for d in (2, 20):
        for n in (3, 40):  # few and many near pairs
            a, b = rng.normal(0, 1, (50, d)), rng.normal(0, 1, (60, d)) + 1e3
            a[:n] = b[:n] + rng.normal(0, 1e-4, (n, d))
            b[n : 2 * n] = b[:1] if n == 40 else b[n : 2 * n]
            want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
            assert metrics._distances(a, b) == pytest.approx(want, rel=1e-9, abs=0)


def test_clusters_that_cannot_be_the_nearest_are_passed_over(spark):
    """Far, near and nested clusters by whole coresets equal brute force."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, s, (30, 2)) for m, s in ((0, 1), (0.5, 4), (6, 1), (300, 1), (302, 9))])
    pts = spark.createDataFrame([(i, i // 30, r.tolist()) for i, r in enumerate(x)], "id long, cluster int, x array<double>")
    _, sil, _, _ = brute(pts.orderBy("id").collect())
    assert [r["silhouette"] for r in metrics.silhouettes_by_coreset(pts).orderBy("id").collect()] == pytest.approx(sil.tolist())


def test_features_are_kept_for_scaler_components_and_scores(spark):
    from gridsift.queries import clusters

    rows, _ = clusters._components(spark, "/root/testdata/sf0.001")
    assert "InMemoryTableScan" in rows._jdf.queryExecution().executedPlan().toString()


def test_more_than_100000_different_points_are_exact(spark):
    """On a line, sums of distances come from running sums; no point is drawn, however many there are."""
    n = 100_003
    pts = spark.range(n).selectExpr("id", "CAST(id % 3 = 0 OR id > 70000 AS int) AS cluster", "array(sqrt(id)) AS x")
    x, at = np.sqrt(np.arange(n)), np.arange(n)
    c = ((at % 3 == 0) | (at > 70000)).astype(int)
    means = []
    for k in (0, 1):
        number, total = np.cumsum(c == k), np.cumsum(x * (c == k))
        sums = x * number - total + (total[-1] - total) - x * (number[-1] - number)
        means.append(sums / np.where(c == k, number[-1] - 1, number[-1]))
    a, b = np.where(c == 0, means, means[::-1])
    want = ((b - a) / np.maximum(a, b)).mean()
    assert metrics.metrics_of_labelings(pts.selectExpr("id", "array(cluster) AS clusters", "x"), 1)[0]["silhouette"] == pytest.approx(want, abs=1e-10)


def test_sums_by_stretches_of_labels_and_by_one_product():
    """Few and many stretches of equal labels in a tile give the same sums, with weights."""
    rng = np.random.default_rng(6)
    n, width = 200, 5
    names = [np.arange(2, dtype=np.int32), np.arange(3, dtype=np.int32)]
    labels = [rng.integers(0, 2, n), rng.integers(0, 3, n)]
    far, w = rng.random((7, n)), rng.integers(1, 4, n).astype(float)
    table = pa.table({"id": np.arange(n), "w": w, "x": pa.array(rng.random((n, 2)).tolist()), "clusters": pa.array(np.stack(labels, 1).tolist(), pa.list_(pa.int32()))})
    for stretches in (0, 64):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(metrics, "STRETCHES", stretches)
            block, out = metrics._Block(table, names), np.zeros((7, width))
            block.add(out, far[:, block.ids], slice(0, n))
        want = [(far * w)[:, labels[i] == k].sum(1) for i, k in ((0, 0), (0, 1), (1, 0), (1, 1), (1, 2))]
        assert out == pytest.approx(np.stack(want, 1))


def test_a_pass_makes_no_plan_of_its_own(spark, monkeypatch):
    """However many passes models take, the points are handed to Python's tasks by one plan."""
    pts = cloud(spark).selectExpr("x AS pc")
    plans, real = [], type(pts).mapInArrow
    monkeypatch.setattr(type(pts), "mapInArrow", lambda self, *a, **more: plans.append(1) or real(self, *a, **more))
    x, kept = np.array([r["pc"] for r in pts.collect()]), len(spark.sparkContext._jsc.getPersistentRDDs())
    found = kmeans.lloyd(pts, [x[:2], x[:5]], "pc")
    assert max(n for _, _, n in found) > 1 and len(plans) == 1
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == kept


def test_feature_sets_are_analysed_side_by_side(spark, monkeypatch):
    """No sweep of an ablation waits for the end of another; rows stay in the order of the feature sets."""
    from threading import Barrier

    from gridsift.operators import features
    from gridsift.plans.analysis import Settings, ablate

    begun, real = Barrier(len(features.FEATURE_SETS), timeout=100), clustering.sweep
    monkeypatch.setattr(clustering, "sweep", lambda *a, **more: begun.wait() >= 0 and real(*a, **more))
    table = ablate(spark, Settings(n_consumers=12, n_days=3, ks=(2, 4), restarts=1))
    assert [r["feature_set"] for r in table.collect()] == list(features.FEATURE_SETS)
