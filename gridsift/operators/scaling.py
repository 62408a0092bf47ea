"""Standardisation and principal components of a feature table.

Components come from a QR factorisation of the scaled rows, reduced over tasks, and the singular values of its
small factor.  The covariances are never formed, so components of nearly dependent columns (shares of a day sum to
one) are as exact as the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsift.operators import matrices
from gridsift.schema import KEY, numeric_columns
from gridsift.shipping import ship

THRESHOLD = 0.95


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation of each column; a constant column is only centred."""

    columns: list[str]
    means: list[float]
    stds: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (F.col(c) - m) / (s or 1.0) for c, m, s in zip(self.columns, self.means, self.stds, strict=True)}
        return df.withColumns(scaled)

    def to_rows(self) -> list[tuple[str, float, float]]:
        return list(zip(self.columns, self.means, self.stds, strict=True))


def fit_scaler(df: DataFrame, columns: list[str] | None = None) -> Scaler:
    columns = columns or numeric_columns(df)
    if not columns:
        raise ValueError("no numeric columns to scale")
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    pick = lambda k: [row[f"{k}{i}"] or 0.0 for i in range(len(columns))]
    return Scaler(columns, pick("m"), pick("s"))


def covariances(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, covariance) for a <= b by position; null under two rows where both are known."""
    columns = columns or numeric_columns(df)
    return pair_table(df, columns, matrices.pairwise(df, columns)[0], "covariance", 0)


def pair_table(df: DataFrame, columns: list[str], values: np.ndarray, name: str, apart: int) -> DataFrame:
    """(a, b, value) for columns that are at least ``apart`` places apart; NaN is null."""
    rows = [(a, columns[j], None if np.isnan(values[i, j]) else float(values[i, j])) for i, a in enumerate(columns) for j in range(i + apart, len(columns))]
    return df.sparkSession.createDataFrame(rows, f"a string, b string, {name} double")


def projected(x: Column, matrix: np.ndarray) -> Column:
    """The product of a row x (array<double>) with a matrix, as array<double>."""

    @F.arrow_udf("array<double>")
    def product(rows: pa.Array) -> pa.Array:
        out = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), matrix.shape[0]) @ matrix
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(out.ravel()))

    return product(x)


@dataclass(frozen=True)
class Components:
    """Principal components of scaled features: shares of the variance, and a column of loadings for each, whose largest one is positive."""

    scaler: Scaler
    ratios: list[float]
    matrix: np.ndarray
    n: int

    def explained(self, spark) -> DataFrame:
        """(component, ratio, cumulative, chosen) of the whole spectrum."""
        rows = [(i + 1, float(r), float(c), i < self.n) for i, (r, c) in enumerate(zip(self.ratios, np.cumsum(self.ratios), strict=True))]
        return spark.createDataFrame(rows, "component int, ratio double, cumulative double, chosen boolean")

    def loadings(self, spark, first: int = 3) -> DataFrame:
        """(component, feature, loading) of the first components."""
        rows = [(j + 1, c, float(self.matrix[i, j])) for j in range(min(first, self.matrix.shape[1])) for i, c in enumerate(self.scaler.columns)]
        return spark.createDataFrame(rows, "component int, feature string, loading double")

    def scores(self, features: DataFrame, key: str = KEY, n: int | None = None) -> DataFrame:
        """(key, pc array<double>): projections on the chosen, or the first n, components."""
        ship(features.sparkSession)
        scaled = self.scaler.transform(features).select(key, F.array(*map(F.col, self.scaler.columns)).alias("scaled"))
        return scaled.select(key, projected(F.col("scaled"), self.matrix[:, : n or self.n]).alias("pc"))

    def rebuilt(self, spark) -> DataFrame:
        """(a, b, r) for a <= b: the correlations that all ratios and loadings stand for."""
        values = (self.matrix * (np.array(self.ratios) * len(self.scaler.columns))) @ self.matrix.T
        return pair_table(spark.range(0), self.scaler.columns, values, "r", 0)


def components_needed(ratios: list[float], threshold: float = THRESHOLD) -> int:
    """Smallest number of components that reaches the threshold; all where none does."""
    total = 0.0
    for i, r in enumerate(ratios, 1):
        total += r
        if total >= threshold:
            return i
    return len(ratios)


def fit_components(features: DataFrame, threshold: float = THRESHOLD, columns: list[str] | None = None) -> Components:
    """Scale, fit the whole spectrum once, and choose how many components to keep."""
    scaler = fit_scaler(features, columns)
    size = len(scaler.columns)
    _, values, rows = np.linalg.svd(matrices.triangle(scaler.transform(features), scaler.columns))
    variances = np.zeros(size)
    variances[: len(values)] = values**2
    total = variances.sum()
    ratios = (variances / total if total > 0 else np.full(size, 1.0 / size)).tolist()
    matrix = rows.T
    matrix = matrix * np.where(matrix[np.abs(matrix).argmax(0), np.arange(size)] >= 0, 1.0, -1.0)
    return Components(scaler, ratios, matrix, components_needed(ratios, threshold))


def projection(scores: DataFrame, first: int = 2) -> DataFrame:
    """(component, population variance) of the first scores."""
    wide = scores.agg(*(F.var_pop(F.get("pc", F.lit(i))).alias(f"v{i}") for i in range(first)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col(f"v{i}").alias("variance")) for i in range(first)))))
