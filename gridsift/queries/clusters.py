"""Queries on scaling, components, clusterings, profiles and rules, and SQL that checks them.

Where a query needs a given clustering, it is the label of an embedding or the remainder of an id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import clustering, features, kmeans, metrics, profiling, scaling
from gridsift.plans.analysis import Settings, ablate, analyse
from gridsift.queries.common import PANEL, panel, raw_features_sql, rounded, rounded_sql, table
from gridsift.schema import BEHAVIORAL, KEY, PERIOD_USAGE, VALUE#: (K, seed) of models with given starts, and their passes.
_STARTS = [(2, 1), (3, 1), (5, 1), (5, 2), (8, 3)]
_PASSES = 6


def _behavior(spark: SparkSession, d: str) -> DataFrame:
    return features.raw_features(panel(spark, d), "behavioral").na.fill(0.0)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.points(table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL"), "vec_id", "label", "embedding")


def standardize_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _behavior(spark, d)
    return rounded(scaling.fit_scaler(rows).transform(rows), 5)


def covariance_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scaling.covariances(_behavior(spark, d)))


def _components(spark: SparkSession, d: str) -> tuple[DataFrame, scaling.Components]:
    raw = features.raw_features(panel(spark, d), "behavioral").persist()  # a row for each consumer, read again by the scaler, the components and the scores
    rows = raw.select(KEY, *features.varying_columns(raw)).na.fill(0.0)
    return rows, scaling.fit_components(rows)


def pca_explained(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_components(spark, d)[1].explained(spark))


def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_components(spark, d)[1].loadings(spark))


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _components(spark, d)
    return found.scores(rows).select(KEY, F.round(F.get("pc", F.lit(0)), 6).alias("pc1"), F.round(F.get("pc", F.lit(1)), 6).alias("pc2"))


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _components(spark, d)
    return rounded(scaling.projection(found.scores(rows)))


def pca_rebuilt_correlations(spark: SparkSession, d: str) -> DataFrame:
    """What all ratios and loadings multiply out to: the correlations of all features."""
    return rounded(_components(spark, d)[1].rebuilt(spark))


def pca_score_products(spark: SparkSession, d: str) -> DataFrame:
    """Inner products of the scores on all components, which are those of the scaled features."""
    rows, found = _components(spark, d)
    scores = found.scores(rows, n=len(found.ratios))
    first = scores.orderBy(KEY).limit(1).select(F.col("pc").alias("first"))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rounded(scores.crossJoin(F.broadcast(first)).select(KEY, product(F.col("pc"), F.col("pc")).alias("own"), product(F.col("pc"), F.col("first")).alias("with_first")), 5)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows, found = _components(spark, d)
    return found.scores(rows).persist()


def kmeans_labels(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d)
    return clustering.label(scores, clustering.fit_kmeans(scores, 3)).select(KEY, "cluster")


def kmeans_fixed_starts(spark: SparkSession, d: str) -> DataFrame:
    """Lloyd passes of several models together, each from the points whose ids have the smallest digests of its own."""
    points = _points(spark, d).persist()
    digest = lambda seed: F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    starts = [np.array([r["x"] for r in points.orderBy(digest(seed)).limit(k).collect()]) for k, seed in _STARTS]  # k rows
    found = kmeans.lloyd(points, starts, "x", _PASSES, 0.0)
    models = [kmeans.Clusters(k, seed, centers, cost, n) for (k, seed), (centers, cost, n) in zip(_STARTS, found, strict=True)]
    labels = clustering.labelings(points.select("x"), models, "x").select(F.posexplode("clusters").alias("model", "cluster"))
    sizes = labels.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("size"))
    costs = spark.createDataFrame([(i, m.k, m.inertia) for i, m in enumerate(models)], "model int, k int, inertia double")
    return rounded(sizes.join(F.broadcast(costs), "model"), 5)


def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.sweep(_scores(spark, d), range(*Settings.ks))[0])


def stability_runs(spark: SparkSession, d: str) -> DataFrame:
    ari, inertia = clustering.stability(_scores(spark, d), 2, restarts=clustering.RESTARTS)
    return rounded(spark.createDataFrame([clustering.stability_summary(ari, inertia, 2)]))


def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d).select("id", "x")
    centers = [r["x"] for r in points.orderBy("id").limit(4).collect()]
    return clustering.lloyd_step(points, centers).select("id", "cluster")


def inertia_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.inertia(_points(spark, d)), 4)


def silhouette_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.silhouettes(_points(spark, d), block=256))


def _number(name: str, f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(spark.createDataFrame([(f(_points(spark, d)),)], f"{name} double"), 5)

    return run


def ari_two_labelings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("label IS NOT NULL").select("label", (F.col("label") % 3 + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)).alias("other"))
    return rounded(metrics.rand_table(rows, "label", "other"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = features.raw_features(panel(spark, d).withColumn(VALUE, F.col(VALUE) * (1 + F.col(KEY) % 3) / 60), "combined").na.fill(0.0)
    return profiling.cluster_profiles(rows, rows.select(KEY, (F.col(KEY) % 3).cast("int").alias("cluster")))


def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_profiles(spark, d))


def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    return profiling.named_profiles(_profiles(spark, d)).select("cluster", "cluster_name")


def cluster_insights(spark: SparkSession, d: str) -> DataFrame:
    return profiling.cluster_insights(_profiles(spark, d))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return profiling.recommendations(profiling.named_profiles(_profiles(spark, d)))


def cluster_balance(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("cluster"))
    return rounded(clustering.balance(labels))


def analysis(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of the panel: its named profiles."""
    return rounded(analyse(spark, Settings(), panel(spark, d).drop("hour", "day_of_week", "is_weekend", "month"), ["timestamp", "event_id"]).profiles)


def ablation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ablate(spark, Settings(), panel(spark, d).drop("hour", "day_of_week", "is_weekend", "month"), ["timestamp", "event_id"])).withColumn("sizes", F.concat_ws(",", F.col("sizes").cast("array<string>")))


QUERIES = {
    "standardize_features": standardize_features,
    "covariance_long": covariance_long,
    "pca_explained": pca_explained,
    "pca_loadings": pca_loadings,
    "pca_scores": pca_scores,
    "pca_rebuilt_correlations": pca_rebuilt_correlations,
    "pca_score_products": pca_score_products,
    "pca_projection": pca_projection,
    "kmeans_labels": kmeans_labels,
    "kmeans_fixed_starts": kmeans_fixed_starts,
    "k_sweep": k_sweep,
    "stability_runs": stability_runs,
    "lloyd_step": lloyd_step,
    "inertia_by_label": inertia_by_label,
    "silhouette_by_label": silhouette_by_label,
    "calinski_harabasz": _number("ch", metrics.calinski_harabasz),
    "davies_bouldin": _number("db", metrics.davies_bouldin),
    "ari_two_labelings": ari_two_labelings,
    "cluster_profile": cluster_profile,
    "cluster_names": cluster_names,
    "cluster_insights": cluster_insights,
    "recommendations": recommendations,
    "cluster_balance": cluster_balance,
    "analysis": analysis,
    "ablation": ablation,
}

_F = f"f AS ({raw_features_sql(fill=True, scale=False)})"
_X = "p AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
_DIMS = "e AS (SELECT id, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p), c AS (SELECT cluster, i, avg(v) AS m FROM e GROUP BY ALL)"
_DIST = "t AS (SELECT id, cluster, sum((v - m) * (v - m)) AS d2 FROM e JOIN c USING (cluster, i) GROUP BY ALL)"
_MEANS = {
    "avg_consumption": f"{VALUE}_mean", "peak_consumption": f"{VALUE}_max", "min_consumption": f"{VALUE}_min", "consumption_std": f"{VALUE}_std",
    "avg_cv": "coefficient_of_variation", "avg_peak_to_avg": "peak_to_avg_ratio", **{p: p for p in PERIOD_USAGE}, "weekend_ratio": "weekend_ratio",
}
_PROFILES = f"""{PANEL}, scaled AS (SELECT * REPLACE ({VALUE} * (1 + consumer_id % 3) / 60 AS {VALUE}) FROM panel), f AS ({raw_features_sql("scaled", fill=True)}),
    pr AS (SELECT CAST(consumer_id % 3 AS INTEGER) AS cluster, count(*) AS size, 100.0 * count(*) / sum(count(*)) OVER () AS size_percentage,
      {", ".join(f"avg({f}) AS {n}" for n, f in _MEANS.items())} FROM f GROUP BY consumer_id % 3)"""
_NAME = """concat_ws(' ',
    CASE WHEN avg_consumption < 0.85 * pop THEN 'Lower-Scale' WHEN avg_consumption > 1.15 * pop THEN 'Higher-Scale' END,
    CASE WHEN weekend_ratio >= 1.15 THEN 'Weekend-Oriented' WHEN weekend_ratio <= 0.85 AND weekend_ratio != 0 THEN 'Weekday-Oriented'
      WHEN evening_usage >= greatest(morning_usage, afternoon_usage, night_usage) AND evening_usage > 0 THEN 'Evening-Peak'
      WHEN morning_usage >= greatest(afternoon_usage, night_usage) AND morning_usage > 0 THEN 'Morning-Peak'
      WHEN afternoon_usage >= night_usage AND afternoon_usage > 0 THEN 'Afternoon-Peak' WHEN night_usage > 0 THEN 'Night-Peak' ELSE 'Balanced-Timing' END,
    CASE WHEN avg_peak_to_avg >= 9 OR avg_cv >= 1.2 THEN 'Spiky-Variable' WHEN avg_peak_to_avg <= 5 AND avg_cv <= 0.8 THEN 'Flat-Stable'
      WHEN avg_cv >= 1.0 THEN 'High-Variability' ELSE 'Moderate-Variability' END)"""
_NAMED = f"n AS (SELECT *, {_NAME} AS cluster_name FROM (SELECT *, (SELECT quantile_cont(avg_consumption, 0.5) FROM pr) AS pop FROM pr))"
_INSIGHTS = """SELECT cluster, concat_ws(' ',
    CASE WHEN avg_consumption < 1 THEN 'Low consumption consumers' WHEN avg_consumption < 1.5 THEN 'Moderate consumption consumers' ELSE 'High consumption consumers' END,
    CASE WHEN avg_cv < 0.3 THEN 'with stable usage patterns' WHEN avg_cv < 0.5 THEN 'with moderate variability' ELSE 'with highly variable usage' END,
    CASE WHEN avg_peak_to_avg > 2 THEN 'and significant peak loads' END,
    CASE WHEN morning_usage > greatest(evening_usage, night_usage) THEN 'with morning-heavy usage' WHEN evening_usage > greatest(morning_usage, night_usage) THEN 'with evening-heavy usage'
      WHEN night_usage > greatest(morning_usage, evening_usage) THEN 'with night-heavy usage' END,
    CASE WHEN weekend_ratio > 1.15 THEN 'and weekend-oriented energy intensity' WHEN weekend_ratio < 0.85 THEN 'and weekday-oriented energy intensity' END) AS interpretation,
  concat_ws('; ',
    CASE WHEN avg_consumption > 2 THEN 'Consider energy efficiency audits to identify reduction opportunities; Evaluate equipment upgrades for more efficient alternatives' END,
    CASE WHEN avg_cv > 0.6 THEN 'Implement load monitoring to understand usage patterns; Consider energy storage to smooth demand fluctuations' END,
    CASE WHEN avg_peak_to_avg > 2.5 THEN 'Implement peak-load shifting strategies; Consider demand-response programs to reduce peak charges; Schedule high-energy tasks during off-peak hours' END,
    CASE WHEN evening_usage > morning_usage * 1.5 AND evening_usage > 0.5 THEN 'Consider shifting evening loads to earlier hours; Implement smart scheduling for appliances' END,
    CASE WHEN weekend_ratio > 1.2 THEN 'Weekend-dominant usage: Consider time-of-use optimization' WHEN weekend_ratio < 0.8 THEN 'Weekday-dominant usage: Consider weekend load shifting' END) AS recommendations
  FROM pr"""
_RULES = [
    ("avg_consumption > 2.0", "Conduct energy efficiency audit", "format('Average consumption {:.2f} kWh exceeds 2.0 kWh threshold', round(avg_consumption, 2))", "high", "consumption", 1),
    ("avg_peak_to_avg > 2.5", "Implement peak-load shifting and demand-response programs", "format('Peak-to-average ratio {:.2f} indicates significant peak loads', round(avg_peak_to_avg, 2))", "high", "peak_management", 2),
    ("avg_cv > 0.6", "Implement load monitoring and energy storage", "format('Coefficient of variation {:.2f} indicates high usage volatility', round(avg_cv, 2))", "high", "variability", 3),
    (
        "evening_usage > 1.5 * morning_usage AND evening_usage > 0.5",
        "Shift evening loads to off-peak hours",
        "format('Evening usage ({:.3f}) is {:.1f}x higher than morning usage', round(evening_usage, 3), round(evening_usage / nullif(morning_usage, 0), 1))",
        "medium",
        "temporal",
        4,
    ),
    ("weekend_ratio > 1.2", "Optimize time-of-use scheduling for weekend patterns", "format('Weekend-to-weekday ratio {:.2f} indicates weekend-dominant usage', round(weekend_ratio, 2))", "medium", "temporal", 5),
]
_CH = f"""WITH {_X}, {_DIMS}, {_DIST}, n AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster), g AS (SELECT i, avg(v) AS g FROM e GROUP BY i),
    w AS (SELECT sum(d2) AS w FROM t), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM c JOIN n USING (cluster) JOIN g USING (i))
    SELECT round(b * ((SELECT count(*) FROM p) - (SELECT count(*) FROM n)) / (w * ((SELECT count(*) FROM n) - 1)), 5) + 0.0 AS ch FROM w, b"""
_DB = f"""WITH {_X}, {_DIMS}, {_DIST}, s AS (SELECT cluster, avg(sqrt(d2)) AS s FROM t GROUP BY cluster),
    m AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.i = b.i AND a.cluster != b.cluster GROUP BY ALL),
    r AS (SELECT a, max((x.s + y.s) / d) AS r FROM m JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY a) SELECT round(avg(r), 5) + 0.0 AS db FROM r"""
_SILHOUETTE = f"""WITH {_X}, n AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster),
    d AS (SELECT a.id, a.cluster, b.cluster AS other, sum(list_distance(a.x, b.x)) AS d FROM p a, p b GROUP BY ALL),
    k AS (SELECT id, d.cluster, max(CASE WHEN other = d.cluster THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN other != d.cluster THEN d / n END) AS b FROM d JOIN n ON n.cluster = other GROUP BY ALL)
    SELECT id, cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM k"""
_ARI = """WITH l AS (SELECT label AS a, label % 3 + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS b FROM embeddings WHERE label IS NOT NULL),
    c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), sab AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM c), sa AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)),
    sb AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT count(*) * (count(*) - 1) / 2.0 AS v FROM l)
    SELECT round((sab.v - sa.v * sb.v / t.v) / ((sa.v + sb.v) / 2 - sa.v * sb.v / t.v), 6) + 0.0 AS ari FROM sab, sa, sb, t"""


def _pairs_sql(function: str, name: str, digits: int) -> str:
    """A row for each two features, in one pass."""
    pairs = ((a, b) for i, a in enumerate(BEHAVIORAL) for b in BEHAVIORAL[i:])
    return f"SELECT p.a AS a, p.b AS b, p.v AS {name} FROM (SELECT unnest([" + ", ".join(f"{{'a': '{a}', 'b': '{b}', 'v': round({function}({a}, {b}), {digits}) + 0.0}}" for a, b in pairs) + "]) AS p FROM f)"


ORACLES = {
    "standardize_features": f"WITH {PANEL}, {_F} SELECT consumer_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 5) + 0.0 AS {c}" for c in BEHAVIORAL) + " FROM f",
    "covariance_long": f"WITH {PANEL}, {_F} {_pairs_sql('covar_samp', 'covariance', 6)}",
    "pca_rebuilt_correlations": f"WITH {PANEL}, {_F} {_pairs_sql('corr', 'r', 6)}",
    "pca_score_products": f"""WITH {PANEL}, {_F}, z AS (SELECT consumer_id, [{", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)" for c in BEHAVIORAL)}] AS z FROM f)
        SELECT consumer_id, round(list_inner_product(z, z), 5) + 0.0 AS own, round(list_inner_product(z, (SELECT z FROM z ORDER BY consumer_id LIMIT 1)), 5) + 0.0 AS with_first FROM z""",
    "kmeans_fixed_starts": f"""WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
        w(model, k, seed) AS (VALUES {", ".join(f"({i}, {k}, {seed})" for i, (k, seed) in enumerate(_STARTS))}),
        s AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY md5(seed || ':' || id)) - 1 AS cluster, x AS m, k FROM p, w QUALIFY row_number() OVER (PARTITION BY model ORDER BY md5(seed || ':' || id)) <= k),
        c(turn, model, cluster, m) AS (
          SELECT 0, model, cluster, m FROM s UNION ALL
          SELECT turn + 1, model, cluster, list(v ORDER BY i) FROM (
            SELECT turn, model, cluster, i, avg(v) AS v FROM (
              SELECT turn, model, cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM (
                SELECT turn, model, id, arg_min(cluster, list_distance(x, m)) AS cluster, any_value(x) AS x FROM c, p WHERE turn < {_PASSES} GROUP BY turn, model, id))
            GROUP BY turn, model, cluster, i) GROUP BY turn, model, cluster),
        l AS (SELECT model, id, min(list_distance(x, m)) AS far, arg_min(cluster, list_distance(x, m)) AS cluster FROM c, p WHERE turn = {_PASSES} GROUP BY model, id)
        SELECT CAST(model AS INTEGER) AS model, CAST(cluster AS INTEGER) AS cluster, count(*) AS size, CAST(k AS INTEGER) AS k, round(sum(sum(far * far)) OVER (PARTITION BY model), 5) + 0.0 AS inertia
        FROM l JOIN w USING (model) GROUP BY model, cluster, k""",
    "lloyd_step": """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
        c AS (SELECT x AS m, row_number() OVER (ORDER BY id) - 1 AS cluster FROM (SELECT * FROM p ORDER BY id LIMIT 4))
        SELECT id, CAST(arg_min(cluster, list_distance(x, m)) AS INTEGER) AS cluster FROM p, c GROUP BY id""",
    "inertia_by_label": f"WITH {_X}, {_DIMS}, {_DIST} SELECT round(sum(d2), 4) + 0.0 AS inertia FROM t",
    "silhouette_by_label": _SILHOUETTE,
    "calinski_harabasz": _CH,
    "davies_bouldin": _DB,
    "ari_two_labelings": _ARI,
    "cluster_profile": f"WITH {_PROFILES} " + rounded_sql("SELECT * FROM pr", ["size_percentage", *_MEANS]),
    "cluster_names": f"WITH {_PROFILES}, {_NAMED} SELECT cluster, cluster_name FROM n",
    "cluster_insights": f"WITH {_PROFILES} {_INSIGHTS}",
    "recommendations": f"WITH {_PROFILES}, {_NAMED}, r AS ("
    + " UNION ALL ".join(f"SELECT cluster, cluster_name, '{text}' AS recommendation, {evidence} AS evidence, '{p}' AS priority, '{c}' AS category, {o} AS o FROM n WHERE {rule}" for rule, text, evidence, p, c, o in _RULES)
    + ") SELECT cluster, cluster_name, recommendation, evidence, priority, category, CAST(row_number() OVER (PARTITION BY cluster ORDER BY o) AS INTEGER) AS rank FROM r",
    "cluster_balance": "SELECT round(min(n) / max(n), 6) + 0.0 AS balance FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)",
}
