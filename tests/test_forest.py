"""Trees with several outputs, against searches by hand and over any partitioning."""

import random

import numpy as np
import pytest

from airspan.models.forest import ForestModel, Growth, _mixed, _seeded, child_keys, fit_bins, pack, times_drawn
from pyspark.sql import functions as F

FEATURES, OUTPUTS = ["a", "b", "c"], ["u", "v"]
SCHEMA = "k long, a double, b int, c double, name string, u double, v double"


def rows_of(n, seed=1):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        a, b, c = draw.randrange(12) / 4, draw.randrange(7), float(draw.randrange(40))
        name = draw.choice("ABCDE")
        out.append((k, a, b, c, name, a * b + (c > 17) * 3 + (name == "C") * 5 + draw.random(), 100 * (b == 2) - c + draw.random()))
    return out


def best_by_hand(x, y, leaf=1):
    """(feature, cut, left rows): the split of least squared error over all features and values."""
    best = None
    for f in range(x.shape[1]):
        for value in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= value
            if min(left.sum(), (~left).sum()) < leaf:
                continue
            error = sum(((y[side] - y[side].mean(axis=0)) ** 2).sum() for side in (left, ~left))
            if best is None or error < best[0] - 1e-9:
                best = (error, f, left)
    return best[1:]


def predicted_by_hand(x, y, depth):
    if depth == 0 or (y == y[0]).all() or (x == x[0]).all():
        return np.tile(y.mean(axis=0), (len(y), 1))
    _, left = best_by_hand(x, y)
    out = np.empty_like(y)
    out[left], out[~left] = predicted_by_hand(x[left], y[left], depth - 1), predicted_by_hand(x[~left], y[~left], depth - 1)
    return out


def answers(model, df, key="k"):
    return {r[key]: list(r["predictions"]) for r in model.transform(df).select(key, "predictions").collect()}


@pytest.mark.parametrize("node_rows", [10**6, 40])
def test_two_levels_equal_a_search_by_hand(spark, node_rows):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = ForestModel.fit(df, FEATURES, OUTPUTS, ["k"], Growth(depth=2), node_rows=node_rows)
    x, y = np.array([r[1:4] for r in rows], float), np.array([r[5:7] for r in rows])
    want = predicted_by_hand(x, y, 2)
    got = answers(model, df)
    assert np.allclose([got[k] for k in range(200)], want, atol=1e-5)


def test_all_levels_equal_a_search_by_hand_and_give_the_means_of_points(spark):
    rows = rows_of(300, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(ForestModel.fit(df, FEATURES, OUTPUTS, ["k"], Growth(trees=50)), df)
    points = {}
    for r in rows:
        points.setdefault(r[1:4], []).append(r[5:7])
    assert np.allclose([got[r[0]] for r in rows], [np.mean(points[r[1:4]], axis=0) for r in rows], atol=1e-5)


@pytest.mark.parametrize("growth", [
    Growth(trees=4, bootstrap=True, features=2), Growth(trees=3, random_cuts=True, leaf_rows=3), Growth(trees=2, bootstrap=True, depth=4, split_rows=10)])
def test_same_trees_level_by_level_and_over_any_partitioning(spark, growth):
    rows = rows_of(500, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    named = {"name": list("ABCDE")}
    fitted = [answers(ForestModel.fit(part, FEATURES, OUTPUTS, ["k"], growth, named, node_rows=n, task_rows=t), df)
              for part, n, t in ((df.coalesce(1), 10**6, 10**6), (df.repartition(7), 10**6, 50), (df.repartition(3), 60, 100), (df.repartition(2, "b"), 1, 100))]
    assert fitted[0] == fitted[1] == fitted[2] == fitted[3]


def tree_by_hand(x, y, w, key, growth, largest):
    """One tree, node by node: draws as a node's key tells, all else looked at one by one."""
    mean = (y * w[:, None]).sum(axis=0) / w.sum()
    varies = [f for f in range(x.shape[1]) if len(np.unique(x[:, f])) > 1]
    if (y == y[0]).all() or w.sum() < growth.split_rows or not varies:
        return mean
    draw = lambda seed: int(_mixed(np.array([seed], np.uint64))[0])
    if growth.features:
        varies = sorted(varies, key=lambda f: draw((key + 0x9E3779B97F4A7C15 * (f + 1)) % 2**64))[: growth.features]
    best = None
    for f in sorted(varies):
        values = np.unique(x[:, f])
        cuts = values[:-1]
        if growth.random_cuts:
            share = draw(key ^ draw(f + 77)) / 2.0**64
            low, high = largest[f][values[0]], largest[f][values[-1]]
            point = low + share * (high - low)
            cuts = [max((v for v in values if largest[f][v] <= point), default=values[0])]
            cuts = [min(cuts[0], values[-2])]
        for cut in cuts:
            left = x[:, f] <= cut
            n = [w[left].sum(), w[~left].sum()]
            if min(n) < growth.leaf_rows:
                continue
            sums = [(y[s] * w[s, None]).sum(axis=0) for s in (left, ~left)]
            gain = sum((s**2).sum() / m for s, m in zip(sums, n))
            if best is None or gain > best[0] * (1 + 1e-12):
                best = (gain, f, cut, left)
    if best is None:
        return mean
    _, f, cut, left = best
    keys = [int(child_keys(np.array([key], np.uint64), side)[0]) for side in (0, 1)]
    return f, cut, tree_by_hand(x[left], y[left], w[left], keys[0], growth, largest), tree_by_hand(x[~left], y[~left], w[~left], keys[1], growth, largest)


def ask(tree, at):
    while isinstance(tree, tuple):
        tree = tree[2] if at[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("growth", [Growth(trees=3, random_cuts=True, seed=5), Growth(trees=3, random_cuts=True, leaf_rows=4, split_rows=10),
                                    Growth(trees=3, bootstrap=True, features=1)])
def test_drawn_cuts_features_and_rows_equal_a_twin(spark, growth):
    rows = rows_of(250, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = answers(ForestModel.fit(df, FEATURES, OUTPUTS, ["k"], growth, node_rows=70), df)
    hashes = {r[0]: r[1] for r in df.select("k", F.xxhash64("k")).collect()}
    raw, y = np.array([r[1:4] for r in rows], float), np.array([r[5:7] for r in rows])
    kinds = [np.unique(raw[:, f]) for f in range(3)]
    x = np.stack([np.searchsorted(kinds[f], raw[:, f]) for f in range(3)], axis=1)
    total = np.zeros_like(y)
    for t in range(3):
        key = np.array([hashes[k] for k in range(len(rows))], np.int64).view(np.uint64)
        w = times_drawn(key, growth.seed, t) if growth.bootstrap else np.ones(len(rows))
        in_ = w > 0
        tree = tree_by_hand(x[in_], y[in_], w[in_], int(_seeded(growth.seed + 1, t)[0]), growth, [dict(enumerate(k)) for k in kinds])
        total += [ask(tree, at) for at in x]
    assert np.allclose([got[k] for k in range(len(rows))], total / 3, atol=1e-5)


def test_a_forest_for_each_output(spark):
    df = spark.createDataFrame(rows_of(150, 6), SCHEMA)
    growth = Growth(trees=3, bootstrap=True)
    both = answers(ForestModel.fit(df, FEATURES, OUTPUTS, ["k"], growth, together=False, node_rows=30), df)
    for i, output in enumerate(OUTPUTS):
        one = answers(ForestModel.fit(df, FEATURES, [output], ["k"], growth), df)
        assert {k: v[i] for k, v in both.items()} == {k: v[0] for k, v in one.items()}


def test_names_are_flags_and_models_are_saved(spark, tmp_path):
    rows = [(k, 1.0, 1, 1.0, name, float(name == "C"), 0.0) for k, name in enumerate("ABCDEABCDE")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = ForestModel.fit(df, ["a"], ["u"], ["k"], Growth(depth=1), {"name": list("ABCDE")})
    asked = spark.createDataFrame([(0, None, "C"), (1, 9.0, "A"), (2, 1.0, "nowhere"), (3, 1.0, None)], "k long, a double, name string")
    assert answers(model, asked) == {0: [1.0], 1: [0.0], 2: [0.0], 3: [0.0]}
    model.save(str(tmp_path / "m"))
    assert answers(ForestModel.load(spark, str(tmp_path / "m")), asked) == answers(model, asked)


def test_many_values_get_bins_of_equal_counts(spark):
    df = spark.range(5000).select("id", (F.col("id") * 1.0).alias("a"), (F.col("id") % 3).alias("y"))
    bins = fit_bins(df, ["a"], bins=100)
    packed = pack(df, bins, ["y"], ["id"])
    counts = np.bincount(np.concatenate([np.frombuffer(r["x"], np.int16) for r in packed.blocks.collect()]))
    assert len(counts) == 100 and counts.min() > 35 and counts.max() < 65


def test_nothing_to_train_on(spark):
    with pytest.raises(ValueError):
        ForestModel.fit(spark.createDataFrame([], SCHEMA), FEATURES, OUTPUTS, ["k"], Growth())
