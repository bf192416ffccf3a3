"""Hyper-parameter search by tree-structured Parzen estimators, and more regressors.

The search itself is a few numbers on the driver; each trial fits and scores one
learner on the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.plans.kernel import KernelSVR
from kestrel.plans.modelling import SEED
from kestrel.storage import materialize


@dataclass(frozen=True)
class Range:
    """A numeric parameter between two ends, by logarithm or in whole numbers if asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inside(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outside(self, u: float) -> float | int:
        x = min(max(math.exp(u) if self.log else u, self.low), self.high)
        return int(round(x)) if self.whole else x


Space = Mapping[str, Range | Sequence]


def _density(u: np.ndarray, seen: np.ndarray, low: float, high: float) -> np.ndarray:
    """Mixture of normals at the values seen and one wide one over the whole range, as logarithms."""
    centres = np.append(seen, (low + high) / 2)
    width = np.append(np.full(len(seen), max((high - low) / max(4.0, len(seen)), 1e-12)), max(high - low, 1e-12))
    z = (u[:, None] - centres) / width
    return np.log((np.exp(-0.5 * z * z) / width).mean(axis=1) + 1e-300)


def search(
    objective: Callable[[dict], float], space: Space, trials: int = 75, first: int = 10, candidates: int = 24,
    best_share: float = 0.25, seed: int = SEED,
) -> tuple[dict, float, list[tuple[dict, float]]]:
    """(best parameters, their loss, all trials): minimises ``objective``.

    The ``first`` trials are random.  After that the trials so far are split into the best ones and
    the rest; of ``candidates`` drawn near the best, the one with the highest ratio of the two
    densities is tried.  Losses that are not finite count as the worst.
    """
    if trials < 1:
        raise ValueError("trials must be positive")
    rng = np.random.default_rng(seed)
    done: list[tuple[dict, float]] = []
    for t in range(trials):
        ranked = sorted(done, key=lambda d: d[1])
        cut = max(1, math.ceil(best_share * len(ranked)))
        good, rest = ranked[:cut], ranked[cut:]
        given: dict = {}
        for name, kind in space.items():
            if isinstance(kind, Range):
                low, high = kind.inside(kind.low), kind.inside(kind.high)
                if t < first or not rest:
                    given[name] = kind.outside(rng.uniform(low, high))
                    continue
                a = np.array([kind.inside(p[name]) for p, _ in good])
                b = np.array([kind.inside(p[name]) for p, _ in rest])
                near = rng.choice(np.append(a, rng.uniform(low, high)), candidates)
                u = np.clip(near + rng.normal(size=candidates) * (high - low) / max(4.0, len(a)), low, high)
                given[name] = kind.outside(float(u[np.argmax(_density(u, a, low, high) - _density(u, b, low, high))]))
            else:
                options = list(kind)
                if t < first or not rest:
                    given[name] = options[rng.integers(len(options))]
                    continue
                odds = [
                    (1 + sum(p[name] == o for p, _ in good)) / (len(options) + len(good))
                    / ((1 + sum(p[name] == o for p, _ in rest)) / (len(options) + len(rest)))
                    for o in options
                ]
                given[name] = options[int(np.argmax(np.array(odds) * rng.uniform(0.9, 1.1, len(odds))))]
        loss = float(objective(given))
        done.append((given, loss if math.isfinite(loss) else math.inf))
    best = min(done, key=lambda d: d[1])
    return best[0], best[1], done


def tune(
    make: Callable[[dict], Estimator], space: Space, train: DataFrame, valid: DataFrame, trials: int = 75, seed: int = SEED
) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Parameters of ``make(parameters)`` with the least RMSE of the label on ``valid``; both tables come from ``prepare``.

    Both are written once, so that no trial reads their sources again.
    """
    kept = [n for n in ("features", "label", "weight") if n in train.columns and n in valid.columns]
    train, valid = (materialize(df.select(*kept), label)[0] for df, label in ((train, "train"), (valid, "valid")))

    def loss(given: dict) -> float:
        done = make(given).fit(train).transform(valid)
        return done.agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0] or 0.0

    return search(loss, space, trials, seed=seed)


def scaled(learner: Estimator) -> Pipeline:
    """The learner on standardised inputs; it must read ``scaled``."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), learner])


def robust_linear(epsilon: float = 1.35, reg: float = 0.01) -> Pipeline:
    """Linear regression on standardised inputs whose loss is linear in large errors."""
    return scaled(LinearRegression(featuresCol="scaled", labelCol="label", loss="huber", epsilon=epsilon, regParam=reg))


@dataclass
class Chain:
    """Transformers one after another, as one model."""

    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


@dataclass
class KernelOnScaled:
    """Support vector regression with a Gaussian kernel on standardised inputs."""

    svr: KernelSVR

    def fit(self, df: DataFrame) -> Chain:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(df)
        return Chain([scaler, self.svr.fit(scaler.transform(df))])


def kernel_svr(c: float = 1.0, epsilon: float = 0.1, gamma: float | None = None, landmarks: int = 256) -> KernelOnScaled:
    return KernelOnScaled(KernelSVR(c, epsilon, gamma, landmarks, features="scaled"))
