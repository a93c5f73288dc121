"""Boosted trees against rounds by hand, in one task and level by level."""

import numpy as np
import pytest

from airspan.models.boosting import Booster, BoostedModel, Boosting, Patience
from airspan.models.forest import Grown, share_of
from pyspark.sql import functions as F
from test_forest import FEATURES, OUTPUTS, SCHEMA, answers, rows_of


def leaf_by_hand(x, y, depth, penalty):
    """The values that one tree gives its training rows: gradients are residuals, second derivatives one."""
    whole = y.sum() / (len(y) + penalty)
    if depth == 0:
        return np.full(len(y), whole)
    best = None
    for f in range(x.shape[1]):
        for value in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= value
            gain = sum(y[s].sum() ** 2 / (s.sum() + penalty) for s in (left, ~left)) - y.sum() ** 2 / (len(y) + penalty)
            if best is None or gain > best[0] * (1 + 1e-9):
                best = (gain, left)
    if best is None or best[0] <= 0 or (y == y[0]).all():
        return np.full(len(y), whole)
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = leaf_by_hand(x[side], y[side], depth - 1, penalty)
    return out


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_rounds_equal_those_by_hand(spark, penalty):
    rows = rows_of(200, 11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    setting = Boosting(rounds=4, rate=0.3, depth=2, penalty=penalty)
    got = answers(BoostedModel.fit(df, FEATURES, OUTPUTS, ["k"], setting), df)
    x, y = np.array([r[1:4] for r in rows], float), np.array([r[5:7] for r in rows])
    for i in range(2):
        total = np.full(len(y), y[:, i].mean())
        for _ in range(4):
            total += 0.3 * leaf_by_hand(x, y[:, i] - total, 2, penalty)
        assert np.allclose([got[k][i] for k in range(len(rows))], total, atol=1e-4)


@pytest.mark.parametrize("setting", [
    Boosting(rounds=3, rows=0.7, columns=0.6), Boosting(rounds=2, depth=6, leaves=5, leaf_rows=4), Boosting(rounds=12, rate=0.5, patience=2, tolerance=0.5)])
def test_same_trees_in_one_task_and_level_by_level(spark, setting):
    df = spark.createDataFrame(rows_of(300, 12), SCHEMA)
    named = {"name": list("ABCDE")}
    fitted = [BoostedModel.fit(part, FEATURES, OUTPUTS, ["k"], setting, named, node_cells=n)
              for part, n in ((df.coalesce(1), 10**9), (df.repartition(5), 10**9), (df.repartition(3), 1))]
    found = [answers(m, df) for m in fitted]
    assert found[0] == found[1] == found[2]
    assert len({len(b.trees) for m in fitted for b in m.boosters[:1]}) == 1


def best_first_by_hand(grown, leaves):
    """Splits the leaf whose split gains most, one at a time, looking at all leaves each time."""
    ends, split = [0], set()
    while len(ends) < leaves:
        able = [n for n in ends if grown.left[n] >= 0]
        if not able:
            break
        node = max(able, key=lambda n: (grown.gain[n], -n))
        split.add(node)
        ends.remove(node)
        ends += [int(grown.left[node]), int(grown.left[node]) + 1]
    return sorted(float(grown.means[n, 0]) for n in ends)


def test_leaves_are_those_of_a_search_for_the_best_split():
    rng = np.random.default_rng(3)
    for _ in range(50):
        left, n = [], 1
        for node in range(41):
            more = n < 41 and (node == 0 or rng.random() < 0.6)
            left.append(n if more else -1)
            n += 2 * more
            if len(left) == n:
                break
        left = np.array(left + [-1] * (n - len(left)))
        grown = Grown(np.where(left >= 0, 0, -1), np.zeros(n, np.int16), left, rng.random((n, 1)), rng.random(n))
        for leaves in (1, 2, 5, 100):
            assert sorted(grown.tree(leaves).value[:, 0].tolist()) == best_first_by_hand(grown, leaves)


def test_rounds_end_as_in_a_replay(spark):
    """Errors on the held-out rows, round by round from the model itself, tell where the rounds must end."""
    rows = rows_of(400, 13)
    df = spark.createDataFrame(rows, SCHEMA)
    ending = Boosting(rounds=60, rate=0.4, patience=3, tolerance=0.02)
    model = BoostedModel.fit(df, FEATURES, ["u"], ["k"], ending)
    n = len(model.boosters[0].trees)
    assert 3 < n < 60
    keys = {r[0]: r[1] for r in df.select("k", F.xxhash64("k")).collect()}
    aside = share_of(np.array([keys[r[0]] for r in rows], np.int64).view(np.uint64), ending.seed, 7) < ending.held
    assert 15 < aside.sum() < 80
    y = np.array([r[5] for r in rows])
    errors = []
    for k in range(1, n + 1):
        part = BoostedModel([Booster(model.boosters[0].start, model.boosters[0].trees[:k])], model.units, model.bins, ["u"])
        got = answers(part, df)
        errors.append(float(((y - np.array([got[r[0]][0] for r in rows]))[aside] ** 2).mean()))
    replay = Patience(ending)
    assert [replay.ends(i, e) for i, e in enumerate(errors)] == [False] * (n - 1) + [True]
    last = [float("inf")] * 3
    for i, e in enumerate(errors[:-1]):
        assert any(e + 0.02 < old for old in last)
        last[i % 3] = e
    assert not any(errors[-1] + 0.02 < old for old in last)


def test_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame(rows_of(120, 14), SCHEMA)
    model = BoostedModel.fit(df, FEATURES, OUTPUTS, ["k"], Boosting(rounds=3))
    model.save(str(tmp_path / "m"))
    assert answers(BoostedModel.load(spark, str(tmp_path / "m")), df) == answers(model, df)
