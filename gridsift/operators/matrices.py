"""Small matrices of all rows of a table: sums of products, and the triangular factor of a tall matrix.

A task folds its rows, batch by batch, into one small matrix; Spark merges the matrices of groups of tasks, and the
driver those of the groups.  What is shuffled or collected grows with the square of the number of columns
and never with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsift.shipping import ship

#: Tasks whose matrices are merged together.
FAN = 64
Step = Callable[[np.ndarray | None, np.ndarray], np.ndarray]


def fold(df: DataFrame, columns: list[str], step: Step, merge: Step) -> np.ndarray | None:
    """``step`` takes what a task has so far and a batch of rows (missing values are NaN), ``merge`` two results; None without rows."""
    ship(df.sparkSession)
    width = len(columns)

    def packed(state: np.ndarray | None, slot: int) -> pa.RecordBatch:
        rows = [] if state is None else [state]
        return pa.RecordBatch.from_arrays(
            [pa.array([slot] * len(rows), pa.int32()), pa.array([list(r.shape) for r in rows], pa.list_(pa.int32())), pa.array([r.ravel() for r in rows], pa.list_(pa.float64()))],
            names=["slot", "shape", "state"],
        )

    def unpacked(shapes: pa.Array, states: pa.Array) -> np.ndarray | None:
        out = None
        for shape, state in zip(shapes.to_pylist(), states.to_pylist(), strict=True):
            own = np.array(state).reshape(shape)
            out = own if out is None else merge(out, own)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(state, batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        yield packed(state, TaskContext.get().partitionId() // FAN)

    def join(table: pa.Table) -> pa.Table:
        own = table.combine_chunks()
        return pa.Table.from_batches([packed(unpacked(own.column("shape"), own.column("state")), own.column("slot")[0].as_py())])

    schema = "slot int, shape array<int>, state array<double>"
    rows = df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    found = rows.mapInArrow(run, schema).groupBy("slot").applyInArrow(join, schema).collect()  # a row for each group of tasks
    return unpacked(pa.array([r["shape"] for r in found]), pa.array([r["state"] for r in found])) if found else None


def pairwise_sums(df: DataFrame, columns: list[str], origin: np.ndarray) -> np.ndarray:
    """Four matrices for columns a, b over the rows where both are known: rows, sums of a, of a * a, of a * b, each a measured from ``origin``."""

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        m, z = known.astype(float), np.where(known, x - origin, 0.0)
        own = np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        return own if state is None else state + own

    found = fold(df, columns, step, lambda a, b: a + b)
    return np.zeros((4, len(columns), len(columns))) if found is None else found


def pairwise(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sample covariances and Pearson's r for each two columns, NaN where they are not defined.

    r is not defined where a column is constant, or has fewer than two values, over the rows where both are known.
    """
    row = df.agg(*(F.avg(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(columns))).first()
    n, s, q, p = pairwise_sums(df, [f"`{c}`" for c in columns], np.array([m or 0.0 for m in row]))
    with np.errstate(divide="ignore", invalid="ignore"):
        both = p - s * s.T / n
        own = q - s * s / n
        own = np.where(own > 1e-13 * q, own, np.nan)
        return np.where(n > 1, both / (n - 1), np.nan), np.clip(both / np.sqrt(own * own.T), -1, 1)


def triangle(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of the QR factorisation of the rows: R'R is X'X, without ever forming it."""

    def step(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x if state is None else np.concatenate([state, x]), mode="r")

    found = fold(df, columns, step, step)
    return np.zeros((1, len(columns))) if found is None else found
