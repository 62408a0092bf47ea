"""The analysis as stages of Spark ML: fitted on one panel, saved as one ``PipelineModel``, applied to others.

``PanelFeatures`` turns a cleaned panel into a row for each consumer and keeps the columns that vary in the
panel it was fitted on; ``ScaledComponents`` scales and projects them by the means, deviations and loadings of that panel;
``Segments`` gives each consumer the nearest centre.  Every fitted stage is its parameters alone, so Spark ML's writers and readers
for parameters save and load it.  A new panel may lack values that the old one had: features it cannot give are 0, as in fitting.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.functions.calendar import with_calendar
from gridsift.operators import clustering, features
from gridsift.operators.kmeans import Clusters
from gridsift.operators.scaling import THRESHOLD, Components, Scaler, fit_components, projected
from gridsift.schema import KEY
from gridsift.shipping import ship


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose whole state is its parameters."""

    def with_values(self, **values):
        return self._set(**values)


class _FeatureParams(_Stage):
    featureSet = Param(Params._dummy(), "featureSet", "behavioral, scale or combined", TypeConverters.toString)


class PanelFeatures(Estimator, _FeatureParams):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featureSet="behavioral")

    def _fit(self, dataset: DataFrame) -> PanelFeaturesModel:
        name = self.getOrDefault(self.featureSet)
        rows = features.consumer_features(_dated(dataset), name)
        return PanelFeaturesModel().with_values(featureSet=name, columns=[c for c in rows.columns if c != KEY])


class PanelFeaturesModel(Model, _FeatureParams):
    columns = Param(Params._dummy(), "columns", "features that varied when fitted", TypeConverters.toListString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = features.raw_features(_dated(dataset), self.getOrDefault(self.featureSet))
        wanted = self.getOrDefault(self.columns)
        return rows.select(KEY, *(F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in wanted)).na.fill(0.0)


class ScaledComponents(Estimator, _Stage):
    threshold = Param(Params._dummy(), "threshold", "share of the variance that the kept components reach", TypeConverters.toFloat)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(threshold=THRESHOLD)

    def _fit(self, dataset: DataFrame) -> ScaledComponentsModel:
        rows = dataset.persist()
        found = fit_components(rows, self.getOrDefault(self.threshold))
        rows.unpersist()
        return ScaledComponentsModel().with_values(
            columns=found.scaler.columns, means=found.scaler.means, deviations=found.scaler.stds, ratios=found.ratios, loadings=found.matrix.ravel().tolist(), kept=found.n
        )


class ScaledComponentsModel(Model, _Stage):
    columns = Param(Params._dummy(), "columns", "features", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "of the features", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "of the features", TypeConverters.toListFloat)
    ratios = Param(Params._dummy(), "ratios", "shares of the variance", TypeConverters.toListFloat)
    loadings = Param(Params._dummy(), "loadings", "a row for each feature", TypeConverters.toListFloat)
    kept = Param(Params._dummy(), "kept", "number of components", TypeConverters.toInt)

    def components(self) -> Components:
        names = self.getOrDefault(self.columns)
        scaler = Scaler(names, self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return Components(scaler, self.getOrDefault(self.ratios), np.array(self.getOrDefault(self.loadings)).reshape(len(names), -1), self.getOrDefault(self.kept))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        own = self.components()
        scaled = F.array(*((F.col(c) - m) / (s or 1.0) for c, m, s in own.scaler.to_rows()))
        return dataset.withColumn("pc", projected(scaled, own.matrix[:, : own.n]))


class Segments(Estimator, _Stage):
    """K by the vote over ``smallest`` to ``largest``; one K where both are equal."""

    smallest = Param(Params._dummy(), "smallest", "K to try", TypeConverters.toInt)
    largest = Param(Params._dummy(), "largest", "K to try", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the starts", TypeConverters.toInt)
    restarts = Param(Params._dummy(), "restarts", "starts of each K", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(smallest=2, largest=10, seed=clustering.SEED, restarts=clustering.RESTARTS)

    def _fit(self, dataset: DataFrame) -> SegmentsModel:
        low, high, seed, restarts = (self.getOrDefault(p) for p in (self.smallest, self.largest, self.seed, self.restarts))
        points = dataset.select(KEY, "pc").persist()
        if low == high:
            model = clustering.fit_kmeans(points, low, seed, restarts)
        else:
            table, models = clustering.sweep(points, range(low, high + 1), seed=seed, restarts=restarts)
            model = models[clustering.choose_k(table)]
        points.unpersist()
        return SegmentsModel().with_values(k=model.k, seed=model.seed, inertia=model.inertia, centers=model.centers.ravel().tolist(), width=model.centers.shape[1])


class SegmentsModel(Model, _Stage):
    k = Param(Params._dummy(), "k", "wanted centres", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the starts", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "components of a centre", TypeConverters.toInt)
    inertia = Param(Params._dummy(), "inertia", "of the points it was fitted on", TypeConverters.toFloat)
    centers = Param(Params._dummy(), "centers", "one after the other", TypeConverters.toListFloat)

    def clusters(self) -> Clusters:
        centers = np.array(self.getOrDefault(self.centers)).reshape(-1, self.getOrDefault(self.width))
        return Clusters(self.getOrDefault(self.k), self.getOrDefault(self.seed), centers, self.getOrDefault(self.inertia))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clustering.label(dataset, self.clusters())


def _dated(panel: DataFrame) -> DataFrame:
    return panel if {"hour", "is_weekend"} <= set(panel.columns) else with_calendar(panel)


def segmentation(feature_set: str = "behavioral", threshold: float = THRESHOLD, ks: tuple[int, int] = (2, 10), seed: int = clustering.SEED, restarts: int = clustering.RESTARTS) -> Pipeline:
    """From a cleaned panel to (consumer_id, features, pc, cluster)."""
    return Pipeline(
        stages=[
            PanelFeatures().with_values(featureSet=feature_set),
            ScaledComponents().with_values(threshold=threshold),
            Segments().with_values(smallest=ks[0], largest=ks[1], seed=seed, restarts=restarts),
        ]
    )
