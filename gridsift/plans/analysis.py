"""The whole analysis: panel, cleaning, features, components, clusters, profiles, recommendations."""

from __future__ import annotations

import hashlib
import json
import os
import platform
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyspark
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsift.operators import clustering, exploration, features, profiling
from gridsift.operators.cleaning import clean
from gridsift.operators.kmeans import Clusters
from gridsift.operators.scaling import Components, Scaler, fit_components
from gridsift.plans import cache, reports
from gridsift.schema import ARCHETYPE, KEY, TIME
from gridsift.sources.generator import synthetic_panel
from gridsift.sources.tables import write_csv


@dataclass(frozen=True)
class Settings:
    """What an analysis does; ``fingerprint`` identifies everything that changes its results."""

    n_consumers: int = 200
    n_days: int = 30
    hourly: bool = True
    seed: int = 42
    feature_set: str = "behavioral"
    variance: float = 0.95
    ks: tuple[int, int] = (2, 11)
    test_stability: bool = True
    remove_outliers: bool = False
    name: str = "behavioral_primary"
    kmeans_seed: int = 42
    restarts: int = clustering.RESTARTS
    output: str | None = None

    def fingerprint(self) -> str:
        relevant = {k: v for k, v in asdict(self).items() if k not in ("test_stability", "output")}
        return hashlib.sha256(json.dumps(relevant, sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Analysis:
    settings: Settings
    panel: DataFrame
    cleaned: DataFrame
    features: DataFrame
    components: Components
    scores: DataFrame
    metrics: DataFrame
    k: int
    model: Clusters
    labels: DataFrame
    profiles: DataFrame
    insights: DataFrame
    recommendations: DataFrame
    stability: dict | None
    source: str = "synthetic panel"
    metric_of: dict[int, dict] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    @property
    def feature_names(self) -> list[str]:
        return [c for c in self.features.columns if c != KEY]

    def silhouette_for(self, k: int) -> float:
        """By K, never by position; KeyError for a K that was not tried."""
        return self.metric_of[k]["silhouette"]

    def summary(self) -> dict:
        sizes = {r["cluster"]: r["size"] for r in clustering.sizes(self.labels).collect()}
        return {
            "feature_set": self.settings.feature_set,
            "n_features": len(self.feature_names),
            "components": self.components.n,
            "k": self.k,
            "silhouette": self.silhouette_for(self.k),
            "cluster_sizes": [sizes[c] for c in sorted(sizes)],
            "n_recommendations": self.recommendations.count(),
            "fingerprint": self.settings.fingerprint(),
        }

    def metadata(self) -> dict:
        summary = self.summary()
        return summary | {
            "features": self.feature_names,
            "variance": self.settings.variance,
            "seed": self.settings.seed,
            "name": self.settings.name,
            "data_source": self.source,
            "n_consumers": sum(summary["cluster_sizes"]),
            "n_days": self.cleaned.agg(F.count_distinct(F.to_date(TIME))).first()[0] if TIME in self.cleaned.columns else None,
            "versions": versions(self.panel.sparkSession),
            "written_at": datetime.now(UTC).isoformat(),
        }

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def analyse(spark: SparkSession, settings: Settings = Settings(), panel: DataFrame | None = None, order: list[str] | None = None) -> Analysis:
    """Run on ``panel``, or on a synthetic one.

    The feature table (a row for each consumer) and the scores are persisted: the sweep over K
    reads them again and again.
    """
    raw = panel if panel is not None else synthetic_panel(spark, settings.n_consumers, settings.n_days, settings.hourly, settings.seed)
    cleaned = clean(raw.drop(ARCHETYPE), remove_outliers=settings.remove_outliers, order=order)
    everything = features.raw_features(cleaned, "combined").persist()
    varying = features.varying_columns(everything)
    combined = everything.select(KEY, *varying).na.fill(0.0)
    own = features.select_features(combined, settings.feature_set)
    components = fit_components(own, settings.variance)
    scores = components.scores(own).persist()
    table, models = clustering.sweep(scores, range(*settings.ks), seed=settings.kmeans_seed, restarts=settings.restarts)
    k = clustering.choose_k(table)
    labels = clustering.label(scores, models[k]).select(KEY, "cluster")
    stable = None
    if settings.test_stability:
        stable = clustering.stability_summary(*clustering.stability(scores, k, seed=settings.kmeans_seed, restarts=settings.restarts), k)
    profiles = profiling.named_profiles(profiling.cluster_profiles(combined, labels))
    found = {r["k"]: r.asDict() for r in table.collect()}
    out = Analysis(
        settings, raw, cleaned, own, components, scores, table, k, models[k], labels, profiles,
        profiling.cluster_insights(profiles), profiling.recommendations(profiles), stable,
        "given panel" if panel is not None else "synthetic panel", found, [everything, scores],
    )
    if settings.output:
        save(spark, out, settings.output)
    return out


def save(spark: SparkSession, a: Analysis, folder: str) -> None:
    """Tables as CSV and Parquet by Spark, models by Spark ML; reports beside them if the folder is local."""
    write_csv(a.components.explained(spark), f"{folder}/metrics/explained_variance")
    write_csv(a.metrics, f"{folder}/metrics/clustering")
    write_csv(evaluation(a), f"{folder}/metrics/evaluation")
    write_csv(exploration.describe(a.cleaned), f"{folder}/reports/statistical_summary")
    if ARCHETYPE in a.panel.columns:
        checked = exploration.validate(a.panel)
        write_csv(checked["statistics"], f"{folder}/metrics/archetype_statistics")
    write_csv(a.profiles, f"{folder}/reports/cluster_profiles")
    write_csv(a.insights, f"{folder}/reports/cluster_insights")
    write_csv(a.recommendations, f"{folder}/reports/recommendations")
    if a.stability:
        write_csv(spark.createDataFrame([a.stability]), f"{folder}/metrics/stability")
    a.labels.write.mode("overwrite").parquet(f"{folder}/models/labels")
    a.model.save(spark, f"{folder}/models/kmeans")
    loadings = [(i + 1, r, a.components.matrix[:, i].tolist()) for i, r in enumerate(a.components.ratios)]
    spark.createDataFrame(loadings, "component int, ratio double, loadings array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/models/pca")
    spark.createDataFrame(a.components.scaler.to_rows(), "feature string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/models/scaler")
    spark.createDataFrame([(a.components.n,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/models/components")
    spark.createDataFrame([(json.dumps(a.metadata(), indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/models/metadata")
    if "://" not in folder:
        os.makedirs(f"{folder}/reports", exist_ok=True)
        texts = {"recommendations.md": reports.recommendation_report(a.recommendations), "summary.md": reports.summary_report(a.summary(), a.profiles)}
        if ARCHETYPE in a.panel.columns:
            texts["validation.md"] = reports.validation_report(checked["overview"], checked["statistics"], checked["consumers"])
        for name, text in texts.items():
            with open(f"{folder}/reports/{name}", "w", encoding="utf-8") as f:
                f.write(text)


def load_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/models/labels")


def load_kmeans(spark: SparkSession, folder: str) -> Clusters:
    return Clusters.load(spark, f"{folder}/models/kmeans")


def load_scaler(spark: SparkSession, folder: str) -> Scaler:
    rows = spark.read.parquet(f"{folder}/models/scaler").collect()  # a row for each feature
    return Scaler([r["feature"] for r in rows], [r["mean"] for r in rows], [r["std"] for r in rows])


def load_components(spark: SparkSession, folder: str) -> Components:
    rows = spark.read.parquet(f"{folder}/models/pca").orderBy("component").collect()  # a row for each component
    n = spark.read.parquet(f"{folder}/models/components").first()["n"]
    return Components(load_scaler(spark, folder), [r["ratio"] for r in rows], np.array([r["loadings"] for r in rows]).T, n)


def load_metadata(spark: SparkSession, folder: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{folder}/models/metadata").collect()))


def versions(spark: SparkSession) -> dict[str, str]:
    """What a result depends on besides its settings."""
    java = spark._jvm.java.lang.System.getProperty("java.version")
    return {"pyspark": pyspark.__version__, "spark": spark.version, "java": java, "python": platform.python_version()}


def evaluation(a: Analysis) -> DataFrame:
    """One row: inertia, silhouette, ch and db of the labels that were chosen."""
    found = a.metric_of[a.k]
    return a.panel.sparkSession.createDataFrame([(a.k, *(float(found[c]) for c in ("inertia", "silhouette", "ch", "db")))], "k int, inertia double, silhouette double, ch double, db double")


def cached(spark: SparkSession, settings: Settings, folder: str, panel: DataFrame | None = None, order: list[str] | None = None) -> tuple[dict[str, DataFrame], bool]:
    """The tables of ``views``, and whether they were made now.

    They are kept below ``folder`` under the settings and the content of the panel (``cache``): another panel, or one of
    whose rows any has changed, is analysed anew.
    """

    def make() -> tuple[dict[str, DataFrame], Callable[[], None]]:
        a = analyse(spark, settings, panel, order)
        return views(a), a.release

    return cache.kept(spark, folder, [settings.fingerprint(), order, cache.content_fingerprint(panel) if panel is not None else None], make)


def views(a: Analysis) -> dict[str, DataFrame]:
    """The tables behind each page of a dashboard."""
    spark = a.panel.sparkSession
    return {
        "overview": exploration.overview(a.cleaned),
        "hourly": exploration.hourly_profile(a.cleaned),
        "weekend": exploration.weekend_profile(a.cleaned),
        "correlations": exploration.correlations(a.features, a.feature_names),
        "explained_variance": a.components.explained(spark),
        "loadings": a.components.loadings(spark),
        "projection": a.scores.join(a.labels, KEY).select(KEY, "cluster", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2")),
        "metrics": a.metrics,
        "profiles": a.profiles,
        "insights": a.insights,
        "recommendations": a.recommendations,
    }


def save_ablation(table: DataFrame, folder: str) -> None:
    """The comparison of feature sets as CSV, and its report beside it if the folder is local."""
    write_csv(table.withColumn("sizes", F.concat_ws(",", F.col("sizes").cast("array<string>"))), f"{folder}/reports/ablation_results")
    if "://" not in folder:
        os.makedirs(f"{folder}/reports", exist_ok=True)
        with open(f"{folder}/reports/ablation.md", "w", encoding="utf-8") as f:
            f.write(reports.ablation_report(table))


def ablate(spark: SparkSession, settings: Settings = Settings(), panel: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """A row for each feature set: size, components, chosen K and its quality, stability, balance.

    The panel is cleaned and aggregated once; feature sets are columns of that table.  They are analysed side by side,
    since the passes of one are short jobs that leave most cores idle.
    """
    raw = panel if panel is not None else synthetic_panel(spark, settings.n_consumers, settings.n_days, settings.hourly, settings.seed)
    everything = features.raw_features(clean(raw.drop(ARCHETYPE), order=order), "combined").persist()
    combined = everything.select(KEY, *features.varying_columns(everything)).na.fill(0.0)

    def compared(name: str) -> tuple:
        own = features.select_features(combined, name)
        components = fit_components(own, settings.variance)
        scores = components.scores(own).persist()
        table, models = clustering.sweep(scores, range(*settings.ks), seed=settings.kmeans_seed, restarts=settings.restarts)
        k = clustering.choose_k(table)
        best = table.where(F.col("k") == k).first()
        sizes = sorted((r["cluster"], r["size"]) for r in clustering.sizes(clustering.label(scores, models[k])).collect())
        stable = clustering.stability_summary(*clustering.stability(scores, k, seed=settings.kmeans_seed, restarts=settings.restarts), k)
        scores.unpersist()
        counts = [n for _, n in sizes]
        return name, len(own.columns) - 1, components.n, k, best["silhouette"], best["ch"], best["db"], stable["mean_ari"], stable["std_ari"], counts, min(counts) / max(counts)

    with ThreadPoolExecutor(len(features.FEATURE_SETS)) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(compared), features.FEATURE_SETS))
    everything.unpersist()
    return spark.createDataFrame(
        rows,
        "feature_set string, n_features int, components int, k int, silhouette double, ch double, db double, mean_ari double, std_ari double, sizes array<long>, balance double",
    )
