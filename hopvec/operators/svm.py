"""Linear SVM by deterministic full-batch subgradient descent.

Hinge loss, no intercept, squared-L2 step: in round ``t`` the step is ``step / sqrt(t)`` and
``w <- w (1 - step_t reg) - step_t / n * gradient``. Every round reads all rows, so neither a sample nor the
partitioning decides the weights. A round is one job: each task adds up the gradient of its Arrow batches, and
``d`` sums come back. Training stops after ``iterations`` rounds, or when a round moves the weights by less
than ``tol * max(|w|, 1)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vec_dot

PART_BYTES = 32 << 20     # numbers that a task of a round reads at least, if the table has as many


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _gradient(points: DataFrame, w: np.ndarray) -> np.ndarray:
    """Sum of ``-s x`` over the rows whose margin ``s (x . w)`` is under 1 (``s``: label as -1 or 1)."""
    d = len(w)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(d)
        for b in batches:
            x, s = _matrix(b, d), 2.0 * b["label"].to_numpy(zero_copy_only=False) - 1.0
            inside = s * (x @ w) < 1.0
            g -= s[inside] @ x[inside]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(g)], ["pos", "g"])

    out = np.zeros(d)
    for r in points.mapInArrow(part, "pos bigint, g double").groupBy("pos").agg(F.sum("g").alias("g")).collect():     # d rows
        out[r["pos"]] = r["g"]
    return out


def fit_svm(points: DataFrame, iterations: int = 400, step: float = 1.0, reg: float = 0.01, tol: float = 0.001) -> list[float]:
    """Weights from ``points (x array<double>, label double)``, labels 0 or 1; ``points`` is read once a round,
    so it should be stored. Rows with a null vector or label are left out; without rows the weights are empty.
    """
    points = points.select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label")).where("x is not null and label is not null")
    size = points.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size["n"] == 0:
        return []
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of {size['least']} to {size['most']} numbers")
    w = np.zeros(size["most"])
    points = points.coalesce(max(1, -(-size["n"] * len(w) * 8 // PART_BYTES)))      # small tables: one task, no exchange
    for t in range(1, iterations + 1):
        rate = step / t ** 0.5
        before, w = w, w * (1.0 - rate * reg) - rate / size["n"] * _gradient(points, w)
        if np.linalg.norm(w - before) < tol * max(np.linalg.norm(w), 1.0):
            break
    return w.tolist()


def svm_margin(x: Column | str, weights: list[float]) -> Column:
    """``x . w``: above 0 is class 1. Without weights 0."""
    return vec_dot(x, F.array(*[F.lit(float(v)) for v in weights])) if weights else F.lit(0.0)
