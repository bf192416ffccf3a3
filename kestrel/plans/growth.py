"""Growing regression trees level by level on histograms: three boosters and extremely random trees.

Inputs are cut into at most ``BINS`` bins at exact quantiles, a byte each; where a tree sees every row,
learning rows of a batch that fall in the same bins are one row of their mean label and whole weight.  A level of all trees
that grow is one Spark job: tasks route their rows through the trees so far (a closure) and add
up weight, gradient and hessian per node, input and bin, which are combined before the shuffle;
each (node, input) then finds its best cut, and only the best cut of each node - model state -
reaches the driver.  Nothing depends on how the rows are partitioned, but for rounding in the
last digits, against which gains are compared at ten digits.

* :class:`DepthwiseTrees`: second-order gain with L2 and a least gain, all nodes of a level.
* :class:`LeafwiseTrees`: the same gain, but only the splits of highest gain, up to so many leaves.
* :class:`SymmetricTrees`: one cut for a whole level; categories by ordered target statistics.
* :class:`ExtraTrees`: all trees at once; a random cut for each of some random inputs of a node.

Boosters stop early where a validation column says on which rows to watch the error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.operators.ranks import quantiles
from kestrel.operators.runs import running_sum
from kestrel.plans.forest import Forest, Tree, as_array
from kestrel.sources.files import read_params, write_params
from kestrel.storage import materialize

#: Bins of an input; histograms of so many cells are kept by a task, larger ones leave it with each batch.
BINS, DENSE = 64, 1 << 21
#: Rounds after which a booster's predictions are written beside the rows, so that a pass routes through no more trees.
SAVED = 16
SEED = 1308


def bin_edges(df: DataFrame, n: int, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each of the ``n`` entries of ``x``: exact quantiles, all inputs placed together."""
    long = df.select(F.posexplode("x").alias("at", "v"))
    found = {r["at"]: r["__q"] for r in quantiles(long, ["at"], "v", [k / bins for k in range(1, bins)]).collect()}  # one row an input
    return [np.unique(np.array(found.get(k) or [0.0])) for k in range(n)]


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """The arrays of ``n`` numbers of a column as rows."""
    if len(column) and (np.diff(column.offsets.to_numpy()) != n).any():
        raise ValueError(f"not every row has {n} inputs")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def binned(df: DataFrame, edges: Sequence[np.ndarray], merged: bool = False) -> DataFrame:
    """rid (a hash of the row), bins (a byte an input), y, w and valid; bin b holds values above edge b - 1 up to edge b.

    With ``merged`` the rows to learn from that a batch holds in the same bins are one, and its rid is one of theirs.
    """
    n = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), n)
            codes = np.ascontiguousarray(np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]).astype(np.uint8))
            rid, y, w, valid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            if merged and len(codes):
                whole = np.flatnonzero(~valid.astype(bool) & (w > 0))
                _, first, at = np.unique(codes[whole].view(f"V{n}").ravel(), return_index=True, return_inverse=True)
                weight = np.bincount(at, w[whole], len(first))
                mean = np.bincount(at, w[whole] * y[whole], len(first)) / weight
                rest = np.setdiff1d(np.arange(len(codes)), whole)
                order = np.concatenate([whole[first], rest])
                codes, rid, valid = codes[order], rid[order], valid[order]
                y, w = np.concatenate([mean, y[rest]]), np.concatenate([weight, w[rest]])
            bins = pa.Array.from_buffers(pa.binary(n), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rid), bins, pa.array(y), pa.array(w), pa.array(valid.astype(bool))], names=["rid", "bins", "y", "w", "valid"])

    return df.select("rid", "x", "y", "w", "valid").mapInArrow(run, "rid long, bins binary, y double, w double, valid boolean")


def learning_rows(df: DataFrame, valid: str | None = None, more: Sequence[str] = ()) -> DataFrame:
    """rid, x, y, w, valid and the columns ``more`` of the rows with a label."""
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    watched = F.coalesce(c(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)
    x = as_array()
    told = df.where("label IS NOT NULL").select(
        x.alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w"), watched.alias("valid"), *(c(m) for m in more)
    )
    return told.withColumn("rid", F.xxhash64("x", "y", *(c(m) for m in more)))


def _draw(*parts: np.ndarray | int) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on ``parts`` alone."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, dtype=np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class _Growing:
    """A tree in bins while it grows."""

    def __init__(self, weight: float = 0.0, value: float = 0.0):
        self.feature, self.cut, self.left, self.right = [-1], [0], [-1], [-1]
        self.gain, self.value, self.cover = [0.0], [value], [weight]

    def split(self, node: int, feature: int, cut: int, gain: float, sides: Sequence[tuple[float, float]]) -> tuple[int, int]:
        """Children of ``node`` with their (cover, value)."""
        at = len(self.feature)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.right[node] = feature, cut, gain, at, at + 1
        for cover, value in sides:
            for name, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("gain", 0.0), ("value", value), ("cover", cover)):
                getattr(self, name).append(v)
        return at, at + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.feature, self.cut, self.left, self.right, self.value))

    def tree(self, edges: Sequence[np.ndarray]) -> Tree:
        threshold = [float(edges[f][k]) if f >= 0 else 0.0 for f, k in zip(self.feature, self.cut, strict=True)]
        return Tree(np.array(self.feature), np.array(threshold), np.array(self.left), np.array(self.right), np.array(self.value, dtype=float), np.array(self.cover, dtype=float))


def _nodes(arrays: tuple[np.ndarray, ...], codes: np.ndarray) -> np.ndarray:
    """The node of a tree in bins that each row has reached."""
    feature, cut, left, right, _ = arrays
    node, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while (inner := feature[node] >= 0).any():
        goes_left = codes[rows, np.maximum(feature[node], 0)] <= cut[node]
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
    return node


def _advance(f: np.ndarray, codes: np.ndarray, margin: Sequence[tuple]) -> np.ndarray:
    """``f`` and what the trees (scale, arrays) of ``margin`` add to it."""
    for scale, a in margin:
        f = f + scale * a[4][_nodes(a, codes)]
    return f


def advanced(rows: DataFrame, n: int, margin: Sequence[tuple]) -> DataFrame:
    """``rows`` with the trees of ``margin`` added to ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _advance(batch.column(5).to_numpy(zero_copy_only=False), _codes(batch.column(1), n), margin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(f)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _codes(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, n)


@dataclass
class Settings:
    """What the trees of one model have in common."""

    l2: float = 0.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    #: Share of the inputs that a node may choose from, and of the rows that a tree sees.
    inputs: float = 1.0
    sample: float = 1.0
    random_cut: bool = False
    symmetric: bool = False
    bins: int = BINS
    seed: int = SEED


def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return np.where(h + l2 > 0, g * g / np.where(h + l2 > 0, h + l2, 1.0), 0.0)


def cuts(at: Sequence[int], g: Sequence[float], h: Sequence[float], s: Settings, slot: int, feature: int) -> tuple[np.ndarray, ...]:
    """(bin, gain, left gradient, left hessian) of the cuts allowed by a node's histogram of one input.

    A cut after bin b sends bins up to b left.  Cuts after an empty bin say the same as the one before it and are left out.
    """
    order = np.argsort(at)
    at, g, h = np.asarray(at)[order], np.asarray(g)[order], np.asarray(h)[order]
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = _score(left_g, left_h, s.l2) + _score(all_g - left_g, all_h - left_h, s.l2) - _score(all_g, all_h, s.l2)
    fine = (left_h >= s.least_weight) & (all_h - left_h >= s.least_weight)
    if s.random_cut and len(at) > 1:
        # One place between the lowest and the highest bin held, whatever the rows between.
        place = at[0] + int(_draw(s.seed, slot, feature) * (at[-1] - at[0]))
        fine &= np.arange(len(at) - 1) == np.searchsorted(at, place, side="right") - 1
    return at[:-1][fine], gain[fine], left_g[fine], left_h[fine]


def best_splits(
    rows: DataFrame, n: int, grown: Sequence[_Growing], slots: Sequence[tuple[int, int]], s: Settings, margin: Sequence[tuple] = (), round_: int = 0
) -> dict[int, tuple]:
    """{slot: (feature, bin, gain, left g, left h, g, h)} of the slots that gain by a split, from one pass.

    ``slots`` are the (tree, node) that may split; ``margin`` holds (scale, arrays) of trees to be added to the rows' ``f``.
    """
    arrays = [t.arrays() for t in grown]
    slot_of = np.full((len(arrays), max(len(a[0]) for a in arrays)), -1, dtype=np.int64)
    for k, (tree, node) in enumerate(slots):
        slot_of[tree, node] = k
    names = np.array([(tree << 32) + node for tree, node in slots], dtype=np.int64)
    offered = max(1, round(s.inputs * n))
    some = np.ones((len(slots), n), dtype=bool)
    if offered < n:
        order = np.argsort(_draw(s.seed, round_, names[:, None], np.arange(n)[None, :]), axis=1)
        some = np.zeros((len(slots), n), dtype=bool)
        np.put_along_axis(some, order[:, :offered], True, axis=1)
    cells = len(slots) * n * s.bins
    dense = cells <= DENSE

    def cell_rows(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        slot, rest = np.divmod(keys, n * s.bins)
        f, b = np.divmod(rest, s.bins)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (slot, f.astype(np.int32), b.astype(np.int32), g, h)], names=["slot", "f", "b", "g", "h"])

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, cells)) if dense else None
        for batch in batches:
            rid, y, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            codes = _codes(batch.column(1), n)
            f = _advance(batch.column(4).to_numpy(zero_copy_only=False), codes, margin)
            for tree, a in enumerate(arrays):
                slot = slot_of[tree][_nodes(a, codes)]
                use = slot >= 0
                if s.sample < 1:
                    use &= _draw(s.seed, round_, rid, tree) < s.sample
                if not use.any():
                    continue
                pick = some[slot[use]].ravel()
                keys = ((slot[use][:, None] * n + np.arange(n)) * s.bins + codes[use]).ravel()[pick]
                g, h = (np.repeat(v[use], n)[pick] for v in (w * (f - y), w))
                if dense:
                    held += (np.bincount(keys, g, cells), np.bincount(keys, h, cells))
                else:
                    keys, at = np.unique(keys, return_inverse=True)
                    yield cell_rows(keys, np.bincount(at, g), np.bincount(at, h))
        if dense:
            keys = np.flatnonzero(held[1])
            yield cell_rows(keys, *held[:, keys])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slot, f, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at, g, h = (np.array([x[k] for x in held]) for k in ("b", "g", "h"))
                found = cuts(at, g, h, s, int(names[slot]), f)
                told = [(slot, f, *(float(v[k]) for v in found), float(g.sum()), float(h.sum())) for k in range(len(found[0]))]
                told = [(*r[:3], float(f"{r[3]:.9e}"), *r[4:]) for r in told]
                out += told if s.symmetric or not told else [max(told, key=lambda r: (r[3], -r[2]))]
            kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 6]
            names_ = ["slot", "f", "b", "gain", "g", "h", "all_g", "all_h"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names_)

    hist = rows.where("NOT valid").select("rid", "bins", "y", "w", "f").mapInArrow(histograms, "slot long, f int, b int, g double, h double")
    hist = hist.groupBy("slot", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    # A (node, input) has as many cells as an input has bins.
    lists = hist.groupBy("slot", "f").agg(F.collect_list(F.struct("b", "g", "h")).alias("cells"))
    found = lists.mapInArrow(choose, "slot long, f int, b double, gain double, g double, h double, all_g double, all_h double")
    node = F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "g", "h", "all_g", "all_h")
    if s.symmetric:
        # The cut of most gain over all nodes of the level; a node for which it is not allowed gains nothing by it.
        level = found.groupBy("f", "b").agg(F.format_string("%.8e", F.sum("gain")).cast("double").alias("total"), F.collect_list(F.struct("slot", node.alias("m"))).alias("nodes"))
        one = level.where(F.col("total") > s.least_gain).agg(F.max_by("nodes", F.struct("total", -F.col("f"), -F.col("b"))).alias("nodes")).first()["nodes"]
        best = one or []
    else:
        best = found.where(F.col("gain") > s.least_gain).groupBy("slot").agg(F.max(node).alias("m")).collect()  # one row a node
    return {r.slot: (-r.m.f, int(-r.m.b), r.m.gain, r.m.g, r.m.h, r.m.all_g, r.m.all_h) for r in best}


def grow(rows: DataFrame, n: int, trees: Sequence[_Growing], depth: int, s: Settings, margin: Sequence[tuple] = (), round_: int = 0) -> None:
    """Grow all ``trees`` together, level by level."""

    def end(g: float, h: float) -> tuple[float, float]:
        """(cover, value) of a node."""
        return h, float(-g / (h + s.l2)) if h + s.l2 > 0 else 0.0

    open_ = [(t, 0) for t in range(len(trees))]
    for _ in range(depth):
        found = best_splits(rows, n, trees, open_, s, margin, round_) if open_ else {}
        after = []
        for k, (t, node) in enumerate(open_):
            if k not in found:
                continue
            f, b, gain, left_g, left_h, g, h = found[k]
            if node == 0:
                trees[t].cover[0], trees[t].value[0] = end(g, h)
            after += [(t, child) for child in trees[t].split(node, f, b, gain, [end(left_g, left_h), end(g - left_g, h - left_h)])]
        open_ = after


def best_leaves(tree: _Growing, leaves: int) -> _Growing:
    """The tree that splits its leaf of highest gain again and again, until it has so many leaves.

    A node's splits do not depend on others, so it is cut out of the tree with every split.
    """
    out, open_ = _Growing(tree.cover[0], tree.value[0]), [(0, 0)]
    while len(open_) < leaves:
        splits = [(-tree.gain[node], node, at) for at, node in open_ if tree.feature[node] >= 0]
        if not splits:
            break
        _, node, at = min(splits)
        ends = [(tree.cover[k], tree.value[k]) for k in (tree.left[node], tree.right[node])]
        children = out.split(at, tree.feature[node], tree.cut[node], tree.gain[node], ends)
        open_.remove((at, node))
        open_ += list(zip(children, (tree.left[node], tree.right[node]), strict=True))
    return out


def _statistic(k: int) -> str:
    return f"__statistic{k}"


def ordered_statistics(rows: DataFrame, categories: Sequence[str], prior: float, strength: float) -> DataFrame:
    """``rows(rid, y, w, valid, categories)`` with a column for each category: the mean label of its rows before, in an
    order by hash, drawn to ``prior`` with the weight ``strength``.  So no row's own label enters its inputs."""
    for k, name in enumerate(categories):
        told = running_sum(rows, [name], [f"__h{k}", "rid"], {"__y": F.col("w") * F.col("y"), "__w": "w"})
        rows = told.withColumn(_statistic(k), (F.col("__y") + strength * prior) / (F.col("__w") + strength)).drop("__y", "__w")
    return rows


def whole_statistics(rows: DataFrame, name: str, prior: float, strength: float) -> DataFrame:
    """(__category, __mean): the statistic of each value of a category over all learning rows, for rows to be scored."""
    sums = rows.groupBy(c(name).alias("__category")).agg(F.sum(F.col("w") * F.col("y")).alias("__y"), F.sum("w").alias("__w"))
    return sums.select("__category", ((F.col("__y") + strength * prior) / (F.col("__w") + strength)).alias("__mean"))


def with_statistics(df: DataFrame, statistics: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """``df`` with the statistic of each category; values that were not learned take the prior."""
    for k, (name, (table, prior)) in enumerate(statistics.items()):
        known = table.withColumnsRenamed({"__category": f"__c{k}", "__mean": f"__m{k}"})
        df = df.join(known, c(name).eqNullSafe(F.col(f"__c{k}")), "left").withColumn(_statistic(k), F.coalesce(f"__m{k}", F.lit(prior))).drop(f"__c{k}", f"__m{k}")
    return df


@dataclass
class ForestModel:
    """A fitted forest over the vector ``features``, then the statistics of categories, as a transformer."""

    forest: Forest
    #: RMSE on the watched rows with 0, 1, 2, ... trees.
    errors: list[float] = field(default_factory=list)
    statistics: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        names = [_statistic(k) for k in range(len(self.statistics))]
        ready = with_statistics(df, self.statistics)
        return self.forest.scored(ready, F.concat(as_array(), F.array(*names)) if names else as_array()).drop(*names)

    def save(self, spark: SparkSession, path: str) -> None:
        """The forest as JSON, the categories' statistics as Parquet."""
        told = {"errors": self.errors, "categories": list(self.statistics), "priors": [prior for _, prior in self.statistics.values()]}
        write_params(spark, self.forest.params() | told, f"{path}/forest")
        for k, (table, _) in enumerate(self.statistics.values()):
            table.write.mode("overwrite").parquet(f"{path}/statistics{k}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        p = read_params(spark, f"{path}/forest")
        tables = {n: (spark.read.parquet(f"{path}/statistics{k}"), p["priors"][k]) for k, n in enumerate(p["categories"])}
        return cls(Forest.of_params(p), p["errors"], tables)


@dataclass
class Laid:
    """Learning rows in bins, how many inputs they have, their mean label, the bins' edges and the categories' statistics."""

    rows: DataFrame
    n: int
    start: float
    edges: list[np.ndarray]
    statistics: dict[str, tuple[DataFrame, float]]


def fit_together(learners: dict[str, DepthwiseTrees], df: DataFrame) -> dict[str, ForestModel]:
    """Boosters fitted to the same rows, which are laid out once for those that need them alike."""
    laid: dict[tuple, Laid] = {}
    out = {}
    for name, learner in learners.items():
        s = learner.settings()
        key = (learner.valid, s.bins, s.sample >= 1, *getattr(learner, "categories", ()))
        if getattr(learner, "categories", ()):
            key = (*key, learner.strength, learner.seed)
        if key not in laid:
            laid[key] = learner.laid_out(df)
        out[name] = learner.grown(laid[key])
    return out


@dataclass
class DepthwiseTrees:
    """Boosted least squares: trees of ``depth`` levels that split wherever the regularised gain is above ``least_gain``."""

    rounds: int = 30
    depth: int = 6
    rate: float = 0.1
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    #: Share of the inputs that a node may choose from, and of the rows that a tree sees.
    inputs: float = 1.0
    sample: float = 1.0
    #: Boolean column of the rows on which the error is watched; rounds without a lower one before the end.
    valid: str | None = None
    patience: int = 10
    seed: int = SEED

    def settings(self) -> Settings:
        return Settings(self.l2, self.least_gain, self.least_weight, self.inputs, self.sample, seed=self.seed)

    def finished(self, tree: _Growing) -> _Growing:
        return tree

    def prepared(self, df: DataFrame) -> tuple[DataFrame, dict[str, tuple[DataFrame, float]]]:
        """Learning rows, and the statistics that scoring needs."""
        return materialize(learning_rows(df, self.valid), "learning")[0], {}

    def fit(self, df: DataFrame) -> ForestModel:
        return self.grown(self.laid_out(df))

    def laid_out(self, df: DataFrame) -> Laid:
        """The learning rows in bins, with what is needed beside them."""
        s = self.settings()
        told, statistics = self.prepared(df)
        n, start = _inputs_and_mean(told)
        edges = bin_edges(told.where("NOT valid"), n, s.bins)
        rows, _ = materialize(binned(told, edges, s.sample >= 1).withColumn("f", F.lit(start)), "binned")
        return Laid(rows, n, start, edges, statistics)

    def grown(self, laid: Laid) -> ForestModel:
        s, rows, n, start, edges, statistics = self.settings(), laid.rows, laid.n, laid.start, laid.edges, laid.statistics
        grown: list[_Growing] = []
        errors, since = [], 0
        for k in range(self.rounds + 1):
            margin = [(self.rate, t.arrays()) for t in grown[since:]]
            if self.valid is not None:
                watched = advanced(rows.where("valid"), n, margin)
                w, error = watched.agg(F.sum("w"), F.sum(F.col("w") * (F.col("y") - F.col("f")) ** 2)).first()
                if w:
                    errors.append(float(np.sqrt(error / w)))
                    if len(errors) - 1 - int(np.argmin(errors)) >= self.patience:
                        break
            if k == self.rounds:
                break
            if len(margin) >= SAVED:
                rows, _ = materialize(advanced(rows, n, margin), "margins")
                margin, since = [], len(grown)
            tree = _Growing()
            grow(rows, n, [tree], self.depth, s, margin, k)
            tree = self.finished(tree)
            if tree.feature[0] < 0:
                break
            grown.append(tree)
        if errors:
            grown = grown[: int(np.argmin(errors))]
        return ForestModel(Forest([t.tree(edges) for t in grown], [self.rate] * len(grown), start), errors, statistics)


@dataclass
class LeafwiseTrees(DepthwiseTrees):
    """The same, but each tree keeps the splits of highest gain alone, up to ``leaves`` leaves within ``depth`` levels."""

    leaves: int = 31
    depth: int = 8

    def finished(self, tree: _Growing) -> _Growing:
        return best_leaves(tree, self.leaves)


@dataclass
class SymmetricTrees(DepthwiseTrees):
    """Boosted least squares along trees with one cut a level; ``categories`` enter by ordered target statistics.

    Where the cut is not allowed in a node of the level, that node is a leaf.
    """

    categories: Sequence[str] = ()
    #: Weight of the mean label in a category's statistic.
    strength: float = 10.0

    def settings(self) -> Settings:
        return replace(super().settings(), symmetric=True)

    def prepared(self, df: DataFrame) -> tuple[DataFrame, dict[str, tuple[DataFrame, float]]]:
        told, _ = materialize(learning_rows(df, self.valid, self.categories), "learning")
        if not self.categories:
            return told, {}
        _, prior = _inputs_and_mean(told)
        learned = told.where("NOT valid").withColumns({f"__h{k}": F.xxhash64("rid", F.lit(k), F.lit(self.seed)) for k in range(len(self.categories))})
        statistics = {}
        for name in self.categories:
            table, _ = materialize(whole_statistics(learned, name, prior, self.strength), "statistics")
            statistics[name] = (table, prior)
        ordered = ordered_statistics(learned, self.categories, prior, self.strength)
        watched = with_statistics(told.where("valid"), statistics)
        names = [_statistic(k) for k in range(len(self.categories))]
        whole = ordered.select("rid", "x", "y", "w", "valid", *names).unionByName(watched.select("rid", "x", "y", "w", "valid", *names))
        return materialize(whole.withColumn("x", F.concat("x", F.array(*names))).drop(*names), "learning")[0], statistics


@dataclass
class ExtraTrees:
    """The mean of trees, all grown at once, on all rows: each node takes the best of one random cut for each of some random inputs."""

    trees: int = 30
    depth: int = 10
    inputs: float = 1.0
    least_weight: float = 1.0
    seed: int = SEED

    def fit(self, df: DataFrame) -> ForestModel:
        s = Settings(least_weight=self.least_weight, inputs=self.inputs, random_cut=True, seed=self.seed)
        told, _ = materialize(learning_rows(df), "learning")
        n, start = _inputs_and_mean(told)
        edges = bin_edges(told, n, s.bins)
        rows, _ = materialize(binned(told, edges, True).withColumn("f", F.lit(start)), "binned")
        grown = [_Growing() for _ in range(self.trees)]
        grow(rows, n, grown, self.depth, s)
        return ForestModel(Forest([t.tree(edges) for t in grown], [1 / self.trees] * self.trees, start))


def _inputs_and_mean(told: DataFrame) -> tuple[int, float]:
    """How many inputs the learning rows have, and their weighted mean label."""
    row = told.where("NOT valid").agg(F.max(F.size("x")).alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m")).first()
    if row["m"] is None:
        raise ValueError("no row to learn from")
    return row["n"], float(row["m"])
