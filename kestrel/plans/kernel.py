"""Support vector regression with a Gaussian kernel, on landmarks.

The kernel is expanded in its values at ``landmarks`` rows (Nystroem's approximation; exact where
all rows are landmarks), so the model is linear in that many derived inputs:
0.5 |w|^2 + C sum(max(0, |y - w z - b| - epsilon)).  The corner of the loss is rounded over a
width that shrinks stage by stage; each Newton step is one pass in which tasks add up loss,
gradient and curvature of their rows - sums that Spark combines entry by entry - and one that
compares step lengths.  The driver holds the landmarks (a parameter bounds them) and these sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.plans.forest import as_array
from kestrel.storage import materialize

#: Widths of the rounded corner, as shares of epsilon plus the labels' deviation; Newton steps at each; step lengths compared.
WIDTHS, STEPS, LENGTHS = tuple(10.0 ** (-k / 2) for k in range(9)), 12, tuple(0.5**k for k in range(12))


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)
    return np.exp(-gamma * np.maximum(square, 0.0))


@dataclass
class KernelModel:
    """y = kernel(x, landmarks) @ weights + intercept."""

    landmarks: np.ndarray
    gamma: float
    weights: np.ndarray
    intercept: float
    features: str = "features"

    def predict(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.landmarks, self.gamma) @ self.weights + self.intercept

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(rows):
            import pandas as pd

            return pd.Series(model.predict(np.stack(rows.to_numpy())) if len(rows) else [], dtype="float64")

        return df.withColumn("prediction", score(as_array(self.features)))


def _rounded(r: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of residuals: zero up to epsilon, a parabola over ``width``, then linear."""
    over = np.maximum(np.abs(r) - epsilon, 0.0)
    near = over < width
    loss = np.where(near, over * over / (2 * width), over - width / 2)
    return loss, np.sign(r) * np.where(near, over / width, 1.0), np.where(near & (over > 0), 1 / width, 0.0)


def _summed(rows: DataFrame, of_batch: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Sum over all rows (x, y) of the ``n`` numbers that ``of_batch`` gives for some of them, entry by entry on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(np.stack(batch.column(0).to_numpy(zero_copy_only=False)), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total)], names=["at", "v"])

    found = rows.select("x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # n rows
    out = np.zeros(n)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


@dataclass
class KernelSVR:
    """Estimator of :class:`KernelModel`; ``gamma`` None is one over the inputs' number and variance."""

    c: float = 1.0
    epsilon: float = 0.1
    gamma: float | None = None
    landmarks: int = 256
    features: str = "features"
    label: str = "label"

    def fit(self, df: DataFrame) -> KernelModel:
        told = df.where(F.col(self.label).isNotNull()).select(as_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        rows, _ = materialize(told, "learning")
        n, d, mean, spread = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("y"), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no row to learn from")
        gamma = self.gamma
        if gamma is None:
            variance = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1 / (d * variance) if variance else 1.0
        # The rows of the smallest hashes, whatever the partitions; inputs may have been scaled with noise in the last digits.
        some = rows.select("x").distinct().orderBy(F.xxhash64(F.transform("x", lambda v: F.round(v, 6))), "x").limit(self.landmarks).collect()
        marks = np.array([r["x"] for r in some])
        values, vectors = np.linalg.eigh(gaussian(marks, marks, gamma))
        held = values > 1e-10 * values[-1]
        basis = vectors[:, held] / np.sqrt(values[held])
        m = int(held.sum())
        size = m + 1

        def derived(x: np.ndarray) -> np.ndarray:
            return np.column_stack([gaussian(x, marks, gamma) @ basis, np.ones(len(x))])

        upper = np.triu_indices(size)
        w = np.append(np.zeros(m), mean)
        keep = np.append(np.ones(m), 0.0)  # the intercept is free
        for width in (self.epsilon + spread) * np.array(WIDTHS):

            def parts(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, width: float = width) -> np.ndarray:
                z = derived(x)
                loss, slope, curve = _rounded(z @ w - y, self.epsilon, width)
                return np.concatenate(([loss.sum()], slope @ z, ((z * curve[:, None]).T @ z)[upper]))

            for _ in range(STEPS):
                sums = self.c * _summed(rows, lambda x, y, w=w, width=width: parts(x, y, w, width), 1 + size + len(upper[0]))
                loss, gradient = sums[0] + 0.5 * (keep * w) @ w, sums[1 : 1 + size] + keep * w
                curve = np.zeros((size, size))
                curve[upper] = sums[1 + size :]
                curve = curve + np.triu(curve, 1).T + np.diag(keep) + 1e-9 * np.eye(size)
                step = -np.linalg.solve(curve, gradient)
                if -gradient @ step < 1e-9 * (1 + abs(loss)):
                    break

                def along(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, step: np.ndarray = step, width: float = width) -> np.ndarray:
                    z = derived(x)
                    base, move = z @ w - y, z @ step
                    return np.array([_rounded(base + t * move, self.epsilon, width)[0].sum() for t in LENGTHS])

                losses = self.c * _summed(rows, along, len(LENGTHS)) + [0.5 * (keep * (w + t * step)) @ (w + t * step) for t in LENGTHS]
                best = int(np.argmin(losses))
                if losses[best] >= loss:
                    break
                w = w + LENGTHS[best] * step
        return KernelModel(marks, float(gamma), basis @ w[:m], float(w[m]), self.features)
