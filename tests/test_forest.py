"""Exact SHAP values against the definition over all subsets; boosted and extremely random trees against plain Python."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from kestrel.plans import forest as f
from kestrel.plans import growth
from kestrel.plans import modelling as m

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    y = np.expm1(0.3 * x[:, 0] + 0.2 * x[:, 1] * (x[:, 2] > 2) + 0.05 * rng.normal(size=300))
    df = spark.createDataFrame([(i, *map(float, row), float(v)) for i, (row, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")
    return df, x, y


def expectation(tree, row, known, node=0):
    """Mean of the tree where only the inputs ``known`` are followed."""
    at = tree.feature[node]
    if at < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if at in known:
        return expectation(tree, row, known, left if row[at] <= tree.threshold[node] else right)
    return (tree.cover[left] * expectation(tree, row, known, left) + tree.cover[right] * expectation(tree, row, known, right)) / tree.cover[node]


def by_subsets(forest, row):
    n = len(row)
    out = np.zeros(n)
    for scale, tree in zip(forest.scales, forest.trees, strict=True):
        for i in range(n):
            rest = [j for j in range(n) if j != i]
            for k in range(n):
                for s in combinations(rest, k):
                    weight = factorial(k) * factorial(n - 1 - k) / factorial(n)
                    out[i] += scale * weight * (expectation(tree, row, {*s, i}) - expectation(tree, row, {*s}))
    return out


TREES = {
    "tree": lambda: DecisionTreeRegressor(maxDepth=4),
    "forest": lambda: RandomForestRegressor(numTrees=3, maxDepth=4, seed=1),
    "boosted": lambda: GBTRegressor(maxIter=3, maxDepth=3, seed=1),
}


@pytest.mark.parametrize("name", TREES)
def test_path_shap_equals_the_definition(data, name):
    df, x, _ = data
    model = TREES[name]().fit(m.prepare(df, "y", NAMES))
    forest = f.of_mllib(model)
    ready = m.prepare(df.where("id < 25"), "y", NAMES)
    predicted = {r.id: r.prediction for r in model.transform(ready).collect()}
    assert [forest.predict(x[i : i + 1])[0] for i in range(25)] == pytest.approx([predicted[i] for i in range(25)])
    values = {}
    for r in f.tree_shap(forest, df.where("id < 25"), "id", NAMES).collect():
        values.setdefault(r.id, {})[r.feature] = r.shap
    for i in range(25):
        got = [values[i][n] for n in NAMES]
        assert got == pytest.approx(by_subsets(forest, x[i]), abs=1e-9)
        assert sum(got) == pytest.approx(predicted[i] - forest.expected())
    assert any(abs(v["a"]) > 0.05 for v in values.values())


def test_deep_paths_and_missing_inputs(spark):
    """A chain of splits on 24 inputs, beyond what subsets can be listed for, adds up; a null counts as 0."""
    n = 24
    feature = [k for j in range(n) for k in (j, -1)] + [-1]
    left, right = [-1] * len(feature), [-1] * len(feature)
    for j in range(n):
        left[2 * j], right[2 * j] = 2 * j + 1, 2 * j + 2
    cover = [float(2 ** (n - k // 2)) if k % 2 == 0 else float(2 ** (n - 1 - k // 2)) for k in range(len(feature))]
    tree = f.Tree.of_lists({"feature": feature, "threshold": [0.0] * len(feature), "left": left, "right": right, "value": [float(k * k % 17) for k in range(len(feature))], "cover": cover})
    forest = f.Forest([tree], [0.5], 2.0)
    again = f.Forest.of_params(forest.params())
    x = np.random.default_rng(1).choice([-1.0, 1.0], (40, n), p=[0.1, 0.9])
    x[0] = 1.0
    names = [f"x{k}" for k in range(n)]
    df = spark.createDataFrame([(i, *(None if v < 0 and i % 2 else float(v) for v in row)) for i, row in enumerate(x)], ", ".join(["id long", *(f"{k} double" for k in names)]))
    sums = {r.id: r.s for r in f.tree_shap(again, df, "id", names).groupBy("id").agg({"shap": "sum"}).withColumnRenamed("sum(shap)", "s").collect()}
    assert [sums[i] for i in range(40)] == pytest.approx(forest.predict(x) - forest.expected())
    assert f.tree_shap(forest, df.limit(0), "id", names).count() == 0
    leaf = f.Forest([f.Tree.of_lists({"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [3.0], "cover": [9.0]})], [1.0])
    assert {r.shap for r in f.tree_shap(leaf, df, "id", names).collect()} == {0.0} and leaf.expected() == 3.0


# Boosters and extremely random trees


def score(g, h, l2):
    return g * g / (h + l2) if h + l2 > 0 else 0.0


def best_cut(x, g, h, features, l2, least, choose=None):
    """(gain, feature, threshold) by trying every value of every input; ``choose`` narrows an input's thresholds."""
    best = None
    for k in features:
        values = np.unique(x[:, k])[:-1]
        for t in values if choose is None else choose(k, values):
            left = x[:, k] <= t
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = score(g[left].sum(), h[left].sum(), l2) + score(g[~left].sum(), h[~left].sum(), l2) - score(g.sum(), h.sum(), l2)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-8 * abs(gain)):
                best = (gain, k, t)
    return best


def plain(x, g, h, depth, l2, least):
    """A tree as nested tuples, split greedily."""
    found = best_cut(x, g, h, range(x.shape[1]), l2, least) if depth else None
    if found is None:
        return float(-g.sum() / (h.sum() + l2))
    gain, k, t = found
    left = x[:, k] <= t
    return (k, float(t), gain, plain(x[left], g[left], h[left], depth - 1, l2, least), plain(x[~left], g[~left], h[~left], depth - 1, l2, least))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return float(tree.value[node])
    return (int(tree.feature[node]), float(tree.threshold[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def without_gain(t):
    return t if isinstance(t, float) else (t[0], t[1], without_gain(t[3]), without_gain(t[4]))


def flat(t):
    return [t] if isinstance(t, float) else [t[0], t[1], *flat(t[2]), *flat(t[3])]


def learning(data):
    df, x, _ = data
    ready = m.prepare(df, "y", NAMES)
    rows = {r.id: (r.label, r.weight) for r in ready.collect()}
    y, w = (np.array([rows[i][k] for i in range(len(x))]) for k in (0, 1))
    return ready, x, y, w


def test_depthwise_splits_against_brute_force(data):
    ready, x, y, w = learning(data)
    model = growth.DepthwiseTrees(rounds=2, depth=3, rate=0.3, l2=0.7, least_weight=5.0).fit(ready)
    f_ = np.full(len(x), (w * y).sum() / w.sum())
    assert model.forest.base == pytest.approx(f_[0])
    for tree in model.forest.trees:
        want = without_gain(plain(x, w * (f_ - y), w, 3, 0.7, 5.0))
        assert flat(nested(tree)) == pytest.approx(flat(want))
        assert tree.cover[0] == pytest.approx(w.sum())
        f_ = f_ + 0.3 * tree.value[tree.leaves(x)]
    got = {r.id: r.prediction for r in model.transform(ready).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(list(f_))


def test_leafwise_takes_the_best_leaves_first(data):
    ready, x, y, w = learning(data)
    model = growth.LeafwiseTrees(rounds=1, leaves=5, depth=6, rate=1.0, l2=1.0, least_weight=3.0).fit(ready)
    g = w * ((w * y).sum() / w.sum() - y)
    leaves = [np.ones(len(x), dtype=bool)]
    while len(leaves) < 5:
        found = [(best_cut(x[s], g[s], w[s], range(4), 1.0, 3.0), k) for k, s in enumerate(leaves)]
        (_, f_, t), k = max(found, key=lambda r: r[0][0] if r[0] else -1)
        s = leaves.pop(k)
        leaves += [s & (x[:, f_] <= t), s & (x[:, f_] > t)]
    reached = model.forest.trees[0].leaves(x)
    assert {frozenset(np.flatnonzero(s)) for s in leaves} == {frozenset(np.flatnonzero(reached == n)) for n in set(reached)}
    depths = [len(way) for _, way in model.forest.trees[0].paths()]
    assert len(depths) == 5 and max(depths) > 2  # deeper than three balanced levels ask for


def test_symmetric_trees_cut_a_level_at_once(data):
    ready, x, y, w = learning(data)
    tree = growth.SymmetricTrees(rounds=1, depth=2, rate=1.0, l2=1.0, least_weight=1.0).fit(ready).forest.trees[0]
    g = w * ((w * y).sum() / w.sum() - y)
    parts = [np.ones(len(x), dtype=bool)]
    cuts = []
    for _ in range(2):
        best = None
        for k in range(4):
            for t in np.unique(x[:, k])[:-1]:
                gain = 0.0
                for s in parts:
                    left = s & (x[:, k] <= t)
                    right = s & ~left
                    if w[left].sum() >= 1 and w[right].sum() >= 1:
                        gain += score(g[left].sum(), w[left].sum(), 1) + score(g[right].sum(), w[right].sum(), 1) - score(g[s].sum(), w[s].sum(), 1)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, k, t)
        cuts.append(best[1:])
        parts = [s & side for s in parts for side in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2])]
    for _, way in tree.paths():
        assert [(int(tree.feature[n]), float(tree.threshold[n])) for n, _ in way] == [(k, float(t)) for k, t in cuts[: len(way)]]


def test_extra_trees_against_plain_python(data):
    ready, x, y, w = learning(data)
    est = growth.ExtraTrees(trees=3, depth=4, inputs=0.5, least_weight=2.0, seed=5)
    model = est.fit(ready)
    start = (w * y).sum() / w.sum()
    edges = growth.bin_edges(growth.learning_rows(ready), 4)
    g = w * (start - y)
    for number, tree in enumerate(model.forest.trees):
        # Nodes are numbered level by level, left children first, as they are split.
        queue, parts, want = [0], {0: np.ones(len(x), dtype=bool)}, {}
        n, level = 1, 0
        while queue and level < 4:
            after = []
            for node in queue:
                s, name = parts[node], (number << 32) + node
                offered = np.argsort(growth._draw(5, 0, np.array([name])[:, None], np.arange(4)[None, :]), axis=1)[0][:2]

                def one(k, values, s=s, name=name):
                    at = np.searchsorted(edges[k], np.unique(x[s, k]), side="left")
                    if len(at) < 2:
                        return []
                    place = at[0] + int(growth._draw(5, name, int(k)) * (at[-1] - at[0]))
                    return [values[max(i for i, b in enumerate(at) if b <= place)]]

                found = best_cut(x[s], g[s], w[s], sorted(offered), 0.0, 2.0, one)
                if found is None:
                    continue
                _, k, t = found
                want[node] = (int(k), float(edges[k][np.searchsorted(edges[k], t)]))
                parts[n], parts[n + 1] = s & (x[:, k] <= t), s & (x[:, k] > t)
                after += [n, n + 1]
                n += 2
            queue, level = after, level + 1
        got = {k: (int(tree.feature[k]), float(tree.threshold[k])) for k in range(len(tree.feature)) if tree.feature[k] >= 0}
        assert got == want and len(got) > 5
        for k in range(len(tree.feature)):
            if tree.feature[k] < 0:
                s = parts[k]
                assert tree.value[k] == pytest.approx((w[s] * (y[s] - start)).sum() / w[s].sum())
    again = est.fit(ready.repartition(7))
    assert [nested(t) for t in again.forest.trees] != [] and [flat(nested(t)) for t in again.forest.trees] == [pytest.approx(flat(nested(t))) for t in model.forest.trees]


def test_histograms_leave_large_tasks_with_each_batch(data, monkeypatch):
    ready, *_ = learning(data)
    est = growth.ExtraTrees(trees=2, depth=3, seed=1)
    one = est.fit(ready)
    monkeypatch.setattr(growth, "DENSE", 10)
    assert [flat(nested(t)) for t in est.fit(ready).forest.trees] == [pytest.approx(flat(nested(t))) for t in one.forest.trees]


def test_early_stopping_and_other_models_than_mllibs(spark, data, monkeypatch):
    monkeypatch.setattr(growth, "SAVED", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = np.exp(x[:, 0]) + (x[:, 1] > 0) + 0.7 * rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r), float(v) + 20, bool(i % 4 == 0)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double, watch boolean")
    ready = m.prepare(df, "y", NAMES).cache()
    told = ready.where("watch").collect()
    label = np.array([r.label for r in told])
    weight = np.array([r.weight for r in told])
    rmse = lambda p: float(np.sqrt((weight * (p - label) ** 2).sum() / weight.sum()))
    predicted = {}
    for est, more in ((growth.DepthwiseTrees, {}), (growth.LeafwiseTrees, {"leaves": 6, "depth": 4}), (growth.SymmetricTrees, {})):
        model = est(**({"rounds": 12, "depth": 3, "rate": 0.9, "valid": "watch", "patience": 1} | more)).fit(ready)
        best = int(np.argmin(model.errors))
        assert len(model.forest.trees) == best < 12 and len(model.errors) - 1 - best <= 1
        by_id = {r.id: r.prediction for r in model.transform(ready).collect()}
        p = np.array([by_id[r.id] for r in told])
        assert rmse(p) == pytest.approx(min(model.errors)) and model.errors[0] == pytest.approx(rmse(np.full(len(p), model.forest.base)))
        assert min(model.errors) < 0.8 * model.errors[0]
        predicted[est.__name__] = p
    gbt = GBTRegressor(maxIter=5, maxDepth=3, stepSize=0.6, weightCol="weight").fit(ready.where("NOT watch")).transform(ready)
    by_id = {r.id: r.prediction for r in gbt.collect()}
    predicted["gbt"] = np.array([by_id[r.id] for r in told])
    names = sorted(predicted)
    assert all(np.abs(predicted[a] - predicted[b]).max() > 0.01 for a in names for b in names if a < b)


def test_categories_by_ordered_statistics(spark, tmp_path):
    rng = np.random.default_rng(6)
    towns = [f"t{k}" for k in range(8)] + [None]
    effect = {t: float(k % 4) for k, t in enumerate(towns)}
    rows = [(i, (t := towns[int(rng.integers(9))] if i % 2 else "t0"), float(rng.normal()), effect[t] + 0.1 * float(rng.normal()) + 20) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, town string, a double, y double").repartition(4)
    ready = m.prepare(df, "y", ["a"])
    told = growth.learning_rows(ready, None, ["town"]).withColumn("__h0", F.xxhash64("rid", F.lit(0)))
    got = growth.ordered_statistics(told, ["town"], 3.0, 10.0).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["__h0"], r.rid)):
        s, n = seen.get(r.town, (0.0, 0.0))
        assert r["__statistic0"] == pytest.approx((s + 30.0) / (n + 10.0))
        seen[r.town] = (s + r.w * r.y, n + r.w)
    model = growth.SymmetricTrees(rounds=5, depth=3, rate=0.8, l2=0.0, categories=["town"]).fit(ready)
    score_of = lambda model: {r.id: r.prediction for r in model.transform(ready).collect()}
    p, label = score_of(model), {r.id: r.label for r in ready.collect()}
    base = growth.SymmetricTrees(rounds=5, depth=3, rate=0.8, l2=0.0).fit(ready)
    error = lambda p: np.mean([(p[i] - label[i]) ** 2 for i in p])
    assert error(p) < 0.2 * error(score_of(base))
    model.save(spark, f"{tmp_path}/model")
    assert score_of(growth.ForestModel.load(spark, f"{tmp_path}/model")) == pytest.approx(p)
    new = m.prepare(spark.createDataFrame([(1, "elsewhere", 0.0, 22.0)], "id long, town string, a double, y double"), "y", ["a"])
    assert model.transform(new).columns == [*new.columns, "prediction"] and model.transform(new).count() == 1


def test_rows_of_the_same_bins_are_one(spark):
    """Rows to learn from are merged where trees see them all, watched ones are not; sums stay, and the boosters share them."""
    rows = [([float(k % 3), float(k % 2)], float(k), 1.0 + k % 4, k >= 90) for k in range(100)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rid long, x array<double>, y double, w double, valid boolean").coalesce(1)
    edges = [np.array([0.0, 1.0]), np.array([0.0])]
    one, all_ = (growth.binned(df, edges, merged).collect() for merged in (True, False))
    sums = lambda rs: {b: (sum(r.w for r in rs if r.bins == b), sum(r.w * r.y for r in rs if r.bins == b)) for b in {r.bins for r in rs}}
    assert len(all_) == 100 and len(one) == 6 + 10 and sum(r.valid for r in one) == 10
    for b, (w, y) in sums(all_).items():
        assert sums(one)[b] == (pytest.approx(w), pytest.approx(y))


def test_boosters_fitted_together(spark, monkeypatch):
    """The same trees as one by one, with the rows laid out once."""
    from pyspark.ml.linalg import Vectors

    ready = spark.createDataFrame([(Vectors.dense(k % 7, k % 5), float(k % 7 + 2 * (k % 5 > 2))) for k in range(200)], ["features", "label"])
    learners = {"a": growth.DepthwiseTrees(rounds=2, depth=2), "b": growth.LeafwiseTrees(rounds=2, depth=3, leaves=4), "c": growth.SymmetricTrees(rounds=2, depth=2)}
    alone = {name: learner.fit(ready) for name, learner in learners.items()}
    calls, edges = [], growth.bin_edges
    monkeypatch.setattr(growth, "bin_edges", lambda *a: calls.append(1) or edges(*a))
    together = growth.fit_together(learners, ready)
    assert len(calls) == 1
    for name, model in together.items():
        for a, b in zip(model.forest.trees, alone[name].forest.trees, strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.threshold.tolist() == b.threshold.tolist()
            assert a.value.tolist() == pytest.approx(b.value.tolist()) and a.cover.tolist() == pytest.approx(b.cover.tolist())
