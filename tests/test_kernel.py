"""Kernel support vector regression against the exact dual solution."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from kestrel.plans.kernel import KernelSVR, gaussian


def dual(k, y, c, epsilon, steps=40_000):
    """Coefficients and intercept by exact steps along the most violating pair of coefficients."""
    b = np.zeros(len(y))
    f = np.zeros(len(y))  # k @ b
    for _ in range(steps):
        up = f - y + epsilon * np.where(b >= 0, 1, -1)  # slope when a coefficient grows
        down = f - y + epsilon * np.where(b > 0, 1, -1)  # and when it falls
        i = int(np.argmin(np.where(b < c, up, np.inf)))
        j = int(np.argmax(np.where(b > -c, down, -np.inf)))
        if down[j] - up[i] < 1e-9:
            break
        curve = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min((down[j] - up[i]) / curve, c - b[i], b[j] + c)
        if b[i] < 0:
            t = min(t, -b[i])
        if b[j] > 0:
            t = min(t, b[j])
        b[i] += t
        b[j] -= t
        f += t * (k[:, i] - k[:, j])
    free = (np.abs(b) > 1e-9) & (np.abs(b) < c - 1e-9)
    return b, float(np.mean((y - f - epsilon * np.sign(b))[free]))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + 0.1 * rng.normal(size=200)
    y[:5] += 6  # far rows, whose loss is linear
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, label double").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), x, y


def test_all_rows_as_landmarks_give_the_exact_solution(data):
    df, x, y = data
    model = KernelSVR(c=2.0, epsilon=0.2, gamma=0.5, landmarks=200).fit(df)
    b, intercept = dual(gaussian(x, x, 0.5), y, 2.0, 0.2)
    want = gaussian(x, x, 0.5) @ b + intercept
    got = {r.id: r.prediction for r in model.transform(df).select("id", "prediction").collect()}
    assert np.abs(np.array([got[i] for i in range(200)]) - want).max() < 0.01
    assert 0.1 < np.std(want)


def test_few_landmarks_come_near(data):
    df, x, y = data
    b, intercept = dual(gaussian(x, x, 1 / (3 * x.var())), y, 1.0, 0.1)
    want = gaussian(x, x, 1 / (3 * x.var())) @ b + intercept
    got = KernelSVR(landmarks=60).fit(df.unionByName(df.limit(3).selectExpr("id", "a", "b", "c", "CAST(NULL AS DOUBLE) AS label", "features"))).predict(x)
    assert np.sqrt(np.mean((got - want) ** 2)) < 0.15 * np.std(want)
    assert np.mean(np.abs(got - y)) < 0.5 * np.mean(np.abs(y - y.mean()))
