"""Trees and boosting at sizes that tasks take on their own."""

import numpy as np
from airspan.models import boosting, forest


def test_cells_of_a_level_are_held_for_a_few_nodes_at_a_time(monkeypatch):
    draw = np.random.default_rng(1)
    n, most, held = 60_000, 20_000, []
    monkeypatch.setattr(forest, "LEVEL_CELLS", most, raising=False)
    plain = forest.best_splits
    monkeypatch.setattr(forest, "best_splits", lambda cells, *more: held.append(len(cells.n)) or plain(cells, *more))
    x = draw.integers(0, 500, (n, 4)).astype(np.int16)
    bins = forest.Bins({c: [i + 0.5 for i in range(499)] for c in "abcd"}, {c: [float(i) for i in range(500)] for c in "abcd"}, {})
    trees = forest.grow(np.zeros(n, np.int64), x, draw.integers(0, 1000, (n, 2)).astype(float), np.ones(n), np.array([3], np.uint64),
                        np.zeros(1, np.int64), forest.Growth(), bins, np.ones(2))
    assert len(trees[0].left) > 60_000
    assert max(held) <= most


def test_a_task_boosts_rows_of_several_million_cells(monkeypatch):
    taken = []
    bins = forest.Bins({f"f{i}": [0.5] for i in range(30)}, {}, {})
    monkeypatch.setattr(boosting, "fit_bins", lambda *_: bins)
    monkeypatch.setattr(boosting, "_in_tasks", lambda packed, _: taken.append(("task", packed.n_rows)))
    monkeypatch.setattr(boosting, "_in_rounds", lambda packed, _: taken.append(("rounds", packed.n_rows)))
    for n in (1_000_000, 10_000_000):
        monkeypatch.setattr(boosting, "pack", lambda *_, n=n: forest.Packed(None, bins, ("y",), np.ones(1), n))
        boosting.BoostedModel.fit(None, [], ["y"], [], boosting.Boosting())
    assert taken == [("task", 1_000_000), ("rounds", 10_000_000)]
