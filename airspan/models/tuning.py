"""Grid search over expanding folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import functions as F

from airspan.models.composed import OneTarget
from airspan.models.forest import Packed
from airspan.models.learners import FEATURES, GRIDS, PREDICTION, Task, side_by_side
from airspan.plans.features import expanding_folds


def settings_of(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def grid_scores(
    task: Task, make: Callable, settings: Sequence[dict], packed: Packed, bounds: Sequence[tuple[int, int]], at_once: int = 2
) -> list[tuple[dict, float]]:
    """Mean absolute error of each setting over the folds: part i of the packed rows is tested on by the parts before it.
    Fits of different settings share the cluster, ``at_once`` at a time."""
    sizes, row, rows = packed.parts(), F.col("row_no"), task.train.drop(FEATURES)

    def score(setting: dict) -> float:
        errors = []
        for i, (start, end) in enumerate(bounds):
            model = OneTarget(make(task, packed.only(sizes, range(i + 1)), **setting), PREDICTION)
            held = model.transform(rows.filter((row >= start) & (row < end)))
            errors.append(held.agg(F.avg(F.abs(F.col(task.target) - F.col(PREDICTION)))).first()[0])
        return sum(errors) / len(errors)

    return list(zip(settings, side_by_side(score, settings, at_once)))


def fit_tuned(
    name: str, task: Task, settings: Sequence[dict] | None = None, output: str = PREDICTION, folds: int = 3
) -> tuple[OneTarget, dict]:
    """The model with the smallest error, trained on all rows, and its setting. The first one
    wins a tie; without folds the first setting is taken."""
    make, grid = GRIDS[name]
    settings = list(settings or settings_of(grid))
    bounds = expanding_folds(task.train.count(), folds)
    packed = task.packed(sum(((F.col("row_no") >= start).cast("int") for start, _ in bounds), F.lit(0)))
    scores = grid_scores(task, make, settings, packed, bounds) if bounds else []
    best = min(scores, key=lambda s: s[1])[0] if scores else settings[0]
    return OneTarget(make(task, packed, **best), output), best
