"""Bins from exact counts, and trees by tables and in the order of bins against those by sorted cells."""

import numpy as np
import pytest

from airspan.models import boosting, forest
from airspan.models.forest import Bins, Columns, Growth
from pyspark.sql import functions as F


def test_bins_end_at_exact_ranks_and_few_values_have_a_bin_each(spark, monkeypatch):
    monkeypatch.setattr(forest, "COUNTED_ROWS", 300, raising=False)
    df = spark.range(5000).repartition(5).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(3000)).cast("double").alias("a"), (F.col("id") % 7).alias("b"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 2).alias("c"), F.lit(None).cast("double").alias("d"))
    rows = df.collect()
    bins = forest.fit_bins(df, ["a", "b", "c", "d"], bins=64)
    assert bins.ordered["b"] == [i + 0.5 for i in range(6)] and bins.ordered["d"] == []
    for c in "ac":
        values = sorted(r[c] for r in rows if r[c] is not None)
        ends = sorted({values[-(-len(values) * i // 64) - 1] for i in range(1, 65)})
        assert bins.largest[c] == ends and bins.ordered[c] == ends[:-1]


def data(n, k, seed):
    draw = np.random.default_rng(seed)
    sizes = [300, 24, 1, 700, 40]
    x = np.stack([draw.integers(0, s, n) for s in sizes], axis=1).astype(np.int16)
    y = draw.integers(-1 << 20, 1 << 20, (n, k)).astype(np.float64) + (x[:, :1] > 100) * (1 << 22) + (x[:, 4:] == 7) * (1 << 21)
    ordered = {c: [i + 0.5 for i in range(s - 1)] for c, s in zip("abcd", sizes)}
    bins = Bins(ordered, {c: [float(i) for i in range(s)] for c, s in zip("abcd", sizes)}, {"e": [str(i) for i in range(40)]})
    return x, y, draw.integers(0, 5, n).astype(float), bins


def written(grown, leaves=None):
    tree = grown.tree(leaves)
    return [tree.feature.tolist(), np.where(tree.left < 0, 0, tree.cut).tolist(), tree.left.tolist(), tree.value.tolist()]


@pytest.mark.parametrize("growth", [Growth(), Growth(leaf_rows=3, depth=7), Growth(features=2), Growth(random_cuts=True), Growth(penalty=1.0, columns=0.7)])
@pytest.mark.parametrize("k", [1, 3])
def test_tables_and_orders_give_the_trees_of_sorted_cells(monkeypatch, growth, k):
    x, y, w, bins = data(6000, k, 3)
    in_ = np.flatnonzero(w)
    root = np.sort(np.random.default_rng(1).integers(0, 2, len(in_)))
    args = (root, x[in_], y[in_], w[in_], np.array([3, 9], np.uint64), np.array([0, 1]), growth, bins, np.full(k, 2.0**-10))
    found = []
    for small, few in ((10**9, 10**9), (10**9, 20), (30, 20), (200, 10**9)):
        monkeypatch.setattr(forest, "SMALL_ROWS", small)
        monkeypatch.setattr(forest, "FEW_ROWS", few)
        monkeypatch.setattr(forest, "TABLE_SHARE", 10**9)
        monkeypatch.setattr(forest, "SORTED_ROWS", 700)
        monkeypatch.setattr(forest, "TABLE_ROWS", 512)
        found.append([written(g) for g in forest.grow(*args)])
    assert found[0] == found[1] == found[2] == found[3]
    assert len(found[0][0][0]) > 20


def test_rounds_that_draw_other_features_use_the_same_counts():
    x, y, _, bins = data(800, 1, 4)
    key = np.random.default_rng(2).integers(0, 1 << 60, 800).astype(np.uint64)
    setting = boosting.Boosting(rounds=12, columns=0.5, depth=3)
    made = boosting.boost(Columns([x[:, f] for f in range(5)], 4), y[:, 0].astype(np.int64), key, setting, bins, 2.0**-10)
    rest = y[:, 0].astype(np.int64) - made.start
    for round_, tree in enumerate(made.trees):
        growth = setting.growth(round_)
        by_cells = forest._together(np.zeros(800, np.int64), x, rest[:, None].astype(float), np.ones(800), boosting.Plan(growth, ((0,),)).key(0),
                                    np.zeros(1, np.int64), growth, bins, np.array([2.0**-10]))[0].tree()
        assert tree.feature.tolist() == by_cells.feature.tolist() and tree.left.tolist() == by_cells.left.tolist()
        assert tree.value.tolist() == setting.steps(by_cells, 2.0**-10).tolist()
        rest = rest - tree.value[tree.leaf_of(x, 4)]


def test_a_task_boosts_as_many_rows_as_the_driver_has():
    assert boosting.TASK_CELLS // 29 > 4_300_000


def test_blocks_are_held_by_feature():
    names = [str(i) for i in range(40_000)]
    bins = Bins({"a": [0.5, 1.5]}, {"a": [0.0, 1.0, 2.0]}, {"n": names})
    x = np.array([[0, 39_999], [2, 5], [1, 70]], np.int32)
    blocks = [(bins.by_feature(x[a:b]), np.arange(a, b, dtype=np.int32).tobytes(), np.arange(a, b, dtype=np.uint64).tobytes()) for a, b in ((0, 2), (2, 3))]
    columns, y, key = bins.held(blocks)
    assert isinstance(columns, Columns) and [c.dtype for c in columns.columns] == [np.int16, np.int32]
    assert np.stack(columns.columns, axis=1).tolist() == x.tolist() and y.tolist() == [0, 1, 2] == key.tolist()


@pytest.mark.parametrize("growth", [Growth(trees=4, bootstrap=True), Growth(trees=3, random_cuts=True, leaf_rows=3), Growth(trees=3, bootstrap=True, features=1, depth=4)])
def test_rows_of_a_point_are_added_up_before_trees_grow(spark, monkeypatch, growth):
    rows = spark.range(900).repartition(4).select(
        "id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double").alias(c) for i, (c, m) in enumerate(zip("abuv", (9, 11, 30, 50)))])
    found, dealt = [], []
    plain = forest._fit_points
    monkeypatch.setattr(forest, "_fit_points", lambda *args: dealt.append(args[2]) or plain(*args))
    monkeypatch.setattr(forest, "POINT_ROWS", 200)
    for points in (None, 10**9):
        if points:
            monkeypatch.setattr(forest.Packed, "points", lambda self: points)
        model = forest.ForestModel.fit(rows, ["a", "b"], ["u", "v"], ["id"], growth)
        found.append({r["id"]: r["predictions"] for r in model.transform(rows).collect()})
    assert len(dealt) == 1 and found[0] == found[1]
