"""Regression forests as arrays: scoring, import of MLlib's trees, and exact SHAP values along their paths.

A forest is model state: its nodes are bounded by its parameters, live on the driver and
go to the executors in a closure.  Rows are scored and explained in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.columns import c


@dataclass
class Tree:
    """Nodes as arrays; the root is node 0, ``feature`` is -1 at a leaf; a row goes left if its value is at most ``threshold``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    #: Weight of the training rows that pass a node.
    cover: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            at = self.feature[node]
            inner = at >= 0
            if not inner.any():
                return node
            goes_left = x[rows, np.maximum(at, 0)] <= self.threshold[node]
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)

    def paths(self) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(leaf, [(node, child on the way)]) for every leaf."""
        stack: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        while stack:
            node, way = stack.pop()
            if self.feature[node] < 0:
                yield node, way
            else:
                stack += [(int(child), [*way, (node, int(child))]) for child in (self.left[node], self.right[node])]

    def as_lists(self) -> dict[str, list]:
        return {name: getattr(self, name).tolist() for name in ("feature", "threshold", "left", "right", "value", "cover")}

    @classmethod
    def of_lists(cls, given: dict[str, list]) -> Tree:
        ints = ("feature", "left", "right")
        return cls(**{k: np.array(v, dtype=np.int64 if k in ints else np.float64) for k, v in given.items()})


@dataclass
class Forest:
    """base + the sum of scale * tree; MLlib's and this package's tree models in one form."""

    trees: list[Tree] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    base: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for scale, tree in zip(self.scales, self.trees, strict=True):
            out += scale * tree.value[tree.leaves(x)]
        return out

    def expected(self) -> float:
        """Mean prediction over the training rows, along the covers."""
        out = self.base
        for scale, tree in zip(self.scales, self.trees, strict=True):
            leaf = tree.feature < 0
            out += scale * float(tree.value[leaf] @ tree.cover[leaf] / tree.cover[0])
        return out

    def params(self) -> dict:
        return {"base": self.base, "scales": self.scales, "trees": [t.as_lists() for t in self.trees]}

    @classmethod
    def of_params(cls, given: dict) -> Forest:
        return cls([Tree.of_lists(t) for t in given["trees"]], given["scales"], given["base"])

    def scored(self, df: DataFrame, features: Column, out: str = "prediction") -> DataFrame:
        """``df`` with the forest's prediction for the array ``features``."""
        forest = self

        @F.arrow_udf("double")
        def score(rows: pa.Array) -> pa.Array:
            if not len(rows):
                return pa.array([], pa.float64())
            sizes = np.diff(rows.offsets.to_numpy())
            if (sizes != sizes[0]).any():
                raise ValueError("rows of different numbers of inputs")
            return pa.array(forest.predict(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)))

        return df.withColumn(out, score(features))


def of_mllib(model: Model) -> Forest:
    """The trees of a fitted MLlib tree, random forest or boosted regressor, read through its nodes."""
    if hasattr(model, "trees"):
        weights = [float(w) for w in model.treeWeights]
        averaged = "GBT" not in type(model).__name__
        scales = [w / sum(weights) for w in weights] if averaged else weights
        return Forest([_tree(t._java_obj.rootNode()) for t in model.trees], scales)
    return Forest([_tree(model._java_obj.rootNode())], [1.0])


def _tree(root) -> Tree:
    feature, threshold, left, right, value, cover = [], [], [], [], [], []
    stack = [(root, None)]
    while stack:
        node, from_left_of = stack.pop()
        at = len(feature)
        if from_left_of is not None:
            parent, side = from_left_of
            (left if side else right)[parent] = at
        value.append(float(node.prediction()))
        cover.append(float(node.impurityStats().count()))
        if node.subtreeDepth() == 0:
            feature.append(-1), threshold.append(0.0)
        else:
            split = node.split()
            if not hasattr(split, "threshold") or split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("splits by category have no threshold")
            feature.append(int(split.featureIndex())), threshold.append(float(split.threshold()))
            stack += [(node.rightChild(), (at, False)), (node.leftChild(), (at, True))]
        left.append(-1), right.append(-1)
    ints, floats = (np.array(v, dtype=np.int64) for v in (feature, left, right)), (np.array(v) for v in (threshold, value, cover))
    (f, lo, hi), (t, v, n) = ints, floats
    return Tree(f, t, lo, hi, v, n)


def path_shap(tree: Tree, x: np.ndarray) -> np.ndarray:
    r"""SHAP values of one tree for each row of ``x``: inputs left out follow both children by their covers.

    For a leaf of value v let o_i be 1 if the row passes all its splits on input i, and z_i the share
    of covers that do.  The leaf adds v * prod(o_i or z_i) to a subset's expectation, so input i gets
    v * (o_i - z_i) times the Shapley-weighted sum, over subsets of the path's other inputs, of those
    products.  The weight k! (d - 1 - k)! / d! is the integral of t^k (1 - t)^(d - 1 - k) over [0, 1],
    so the sum is the integral of prod((1 - t) z_j + t o_j): a polynomial of degree d - 1, which
    Gauss-Legendre quadrature with d / 2 points integrates exactly.
    """
    out = np.zeros(x.shape)
    for leaf, way in tree.paths():
        if not way:
            continue
        inputs = sorted({int(tree.feature[n]) for n, _ in way})
        d, place = len(inputs), {f: k for k, f in enumerate(inputs)}
        passes, share = np.ones((len(x), d), dtype=bool), np.ones(d)
        for node, child in way:
            k = place[int(tree.feature[node])]
            goes_left = x[:, tree.feature[node]] <= tree.threshold[node]
            passes[:, k] &= goes_left if child == tree.left[node] else ~goes_left
            share[k] *= tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
        points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        t, weights = (points + 1) / 2, weights / 2
        factors = (1 - t) * share[None, :, None] + t * passes[:, :, None]
        # Products of all factors but one, without a division.
        before, after = np.ones((len(x), d, len(t))), np.ones((len(x), d, len(t)))
        for k in range(1, d):
            before[:, k] = before[:, k - 1] * factors[:, k - 1]
            after[:, d - 1 - k] = after[:, d - k] * factors[:, d - k]
        out[:, inputs] += tree.value[leaf] * (passes - share) * ((before * after) @ weights)
    return out


def tree_shap(forest: Forest, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, feature, shap): exact SHAP values of ``forest``, whose inputs are ``features`` in this order.

    A row's values add up to its prediction less :meth:`Forest.expected`.  Missing inputs count as 0,
    as in training.  The work is rows x leaves x depth^2; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns[1:]]) if batch.num_rows else np.empty((0, len(features)))
            values = np.zeros(x.shape)
            for scale, tree in zip(forest.scales, forest.trees, strict=True):
                values += scale * path_shap(tree, x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["__key", "__shap"])

    given = df.select(c(key).alias("__key"), *(F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f"__x{k}") for k, f in enumerate(features)))
    kind = given.schema["__key"].dataType.simpleString()
    long = given.mapInArrow(run, f"__key {kind}, __shap array<double>").select("__key", F.posexplode("__shap").alias("__at", "shap"))
    return long.select(F.col("__key").alias(key), F.lit(list(features))[F.col("__at")].alias("feature"), "shap")


def as_array(features: str = "features") -> Column:
    return vector_to_array(F.col(features))
