"""The regression models and their settings. Those of one target are trees over binned rows, in which the stations are one named
feature, as they are for the models of all targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from airspan.models.adaboost import Ada, AdaModel
from airspan.models.boosting import BoostedModel, Boosting, MeanModel
from airspan.models.composed import Member, OneTarget, StackModel, member_columns, members_asked
from airspan.models.forest import ForestModel, Growth, Packed, fit_bins, pack
from airspan.plans.features import contiguous_folds, feature_columns, station_names
from airspan.schemas import name_col
from airspan.session import durable

FEATURES = "features"
PREDICTION = "prediction"
DEEPEST = 30
SEED = 42


@dataclass(frozen=True)
class Task:
    """One fit: training rows with their features, the target, and how large the model may be.

    ``names`` are the stations, those of the rows if none are given. ``most`` bounds trees and rounds and
    ``deepest`` their depth; both are only lowered for quick runs.
    """

    train: DataFrame
    target: str
    names: tuple[str, ...] = ()
    most: int = 10_000
    deepest: int = DEEPEST
    seed: int = SEED
    station: str = "Estacion"

    def trees(self, n: int) -> int:
        return min(n, self.most)

    def depth(self, n: int | None = None) -> int | None:
        """The bound on the depth, or None without one."""
        least = min(n or DEEPEST, self.deepest)
        return least if n or least < DEEPEST else None

    def packed(self, part: Column | None = None, targets: Sequence[str] = ()) -> Packed:
        """The training rows with the targets, the task's if none are given, binned once for all fits, in blocks of one
        ``part`` each."""
        ordered = [c for c in feature_columns(self.train) if c not in (FEATURES, "is_test", self.station)]
        named = {}
        if self.station in self.train.columns:
            named = {self.station: self.names or tuple(station_names(self.train, self.station))}
        return pack(self.train, fit_bins(self.train, ordered, named), targets or [self.target], ["row_no"], part)


def quick(task: Task, most: int = 3, deepest: int = 4) -> Task:
    return replace(task, most=most, deepest=deepest)


def side_by_side(work: Callable, items: Sequence, at_once: int = 4) -> list:
    """Runs independent fits as concurrent Spark jobs, so small ones do not leave the cluster idle."""
    with ThreadPool(at_once) as pool:
        return pool.map(work, items)


# Single models


def fit_forest(task: Task, packed: Packed, growth: Growth) -> ForestModel:
    growth = replace(growth, trees=task.trees(growth.trees), depth=task.depth(growth.depth), seed=task.seed)
    return ForestModel.fit(None, [], packed.outputs, [], growth, together=False, packed=packed)


def fit_boosted(task: Task, packed: Packed, setting: Boosting) -> BoostedModel:
    setting = replace(setting, rounds=task.trees(setting.rounds), depth=task.depth(setting.depth), seed=task.seed)
    return BoostedModel.fit(None, [], packed.outputs, [], setting, packed=packed)


def fit_adaboost(task: Task, packed: Packed, setting: Ada) -> AdaModel:
    return AdaModel.fit(packed, replace(setting, rounds=task.trees(setting.rounds), depth=task.depth(setting.depth), seed=task.seed))


def fit_member(name: str, task: Task, packed: Packed) -> Member:
    if name in NEXT_HOUR_FORESTS:
        return fit_forest(task, packed, NEXT_HOUR_FORESTS[name])
    if name in NEXT_HOUR_BOOSTED:
        return fit_boosted(task, packed, NEXT_HOUR_BOOSTED[name])
    return fit_adaboost(task, packed, ADABOOST[name])


# Combinations


def fit_stacking(task: Task, members: Sequence[str], blend: Callable, targets: Sequence[str] = (), folds: int = 5) -> StackModel:
    """Members predict rows they were not trained on, in contiguous folds of the row number; the blender of each target, the
    task's if none are given, learns from those predictions. Then the members are trained on all rows."""
    targets = list(targets) or [task.target]
    row, bounds = F.col("row_no"), contiguous_folds(task.train.count(), folds)
    fold = sum(((row >= start).cast("int") for start, _ in bounds[1:]), F.lit(0))
    packed = task.packed(fold, targets)
    sizes = packed.parts()
    rest = [packed.only(sizes, [f for f in range(folds) if f != i]) for i in range(folds)]
    jobs = [(m, p) for p in [*(p for p in rest if p.n_rows), packed] for m in members]
    fitted = side_by_side(lambda job: fit_member(job[0], task, job[1]), jobs)
    *by_fold, models = [fitted[i:i + len(members)] for i in range(0, len(fitted), len(members))]
    whole = task.train.drop(FEATURES).dropna(subset=[name_col(t) for t in targets]).withColumn("_fold", fold)
    columns = [member_columns(len(members), k) for k in range(len(targets))]
    parts = [members_asked(asked, whole.filter(F.col("_fold") == i)).select(
        "row_no", *[F.col(name_col(t)) for t in targets], *[c for own in columns for c in own])
        for i, asked in zip([i for i, p in enumerate(rest) if p.n_rows], by_fold)]
    rows = durable(reduce(DataFrame.unionByName, parts))
    return StackModel(models, side_by_side(lambda job: blend(replace(task, target=job[0]), rows, job[1]), list(zip(targets, columns))))


def blend_linear(task: Task, rows: DataFrame, columns: Sequence[str]) -> list[float]:
    """The intercept and a factor for each member."""
    found = LinearRegression(featuresCol="_in", labelCol=task.target).fit(
        VectorAssembler(inputCols=list(columns), outputCol="_in").transform(rows))
    return [float(found.intercept), *(float(c) for c in found.coefficients)]


def blend_forest(task: Task, rows: DataFrame, columns: Sequence[str]) -> ForestModel:
    growth = Growth(trees=task.trees(200), bootstrap=True, depth=task.depth(), leaf_rows=2, seed=task.seed)
    return ForestModel.fit(rows, columns, [task.target], ["row_no"], growth)


def weighted_median_sql(columns: Sequence[str], votes: Sequence[float]) -> str:
    """The smallest prediction at which half of the votes is reached."""
    ballots = ", ".join(f"struct({c} AS p, {v!r}D AS v)" for c, v in zip(columns, votes))
    half = repr(sum(votes) / 2)
    return (
        f"aggregate(array_sort(array({ballots})), struct(0D AS sum, CAST(NULL AS DOUBLE) AS p),"
        f" (s, x) -> struct(s.sum + x.v AS sum, IF(s.p IS NULL AND s.sum + x.v >= {half}D, x.p, s.p) AS p),"
        f" s -> s.p)")


# The models and their settings. Those with several outputs are forests of trees that predict all
# of them, and so is the next-hour forest, with trees of its own for each output.
MULTI_OUTPUT: dict[str, Growth] = {
    "1. Decision Tree": Growth(),
    "2. Bagging (Trees)": Growth(trees=50, bootstrap=True),
    "3. Pasting (Trees)": Growth(trees=50),
    "5. RF Estandar": Growth(trees=100, bootstrap=True),
    "6. RF Profundo": Growth(trees=200, bootstrap=True),
    "7. RF Regularizado": Growth(trees=100, bootstrap=True, depth=10),
    "8. Extra-Trees": Growth(trees=100, random_cuts=True),
    "9. ET Optimizado": Growth(trees=200, random_cuts=True, leaf_rows=3),
    "10. RF FeatureSel": Growth(trees=100, bootstrap=True, features=2),
}
KNN_MODEL = "4. Bagging (KNN)"
NEXT_HOUR_FORESTS: dict[str, Growth] = {"rf": Growth(trees=300, bootstrap=True, leaf_rows=2)}
NEXT_HOUR_BOOSTED: dict[str, Boosting] = {
    "gbr": Boosting(rounds=300, rate=0.05),
    "xgb": Boosting(rounds=300, rate=0.05, depth=4, penalty=1.0, rows=0.9, columns=0.9),
    "gbr_estandar": Boosting(),
    "gbr_shrinkage": Boosting(rounds=500, rate=0.05),
    "gbr_early": Boosting(rounds=400, rate=0.05, patience=5),
    "gbr_stochastic": Boosting(rounds=400, rate=0.05, rows=0.7),
    "hist_gbrt": Boosting(rounds=100, rate=0.05, depth=8, leaves=31, leaf_rows=20),
}
VOTING = {"voting_simple": ("gbr_estandar", "gbr_shrinkage", "hist_gbrt")}
ADABOOST: dict[str, Ada] = {"ada_stumps": Ada(400, 0.1, 1), "ada_profundo": Ada(300, 0.05, 3)}
STACKS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "stacking_nivel1": (("ada_stumps", "gbr_estandar", "hist_gbrt"), blend_linear),
    "stacking_nivel2": (("gbr_shrinkage", "gbr_early", "gbr_stochastic"), blend_forest),
    "stack": (("rf", "gbr", "xgb"), blend_linear),
}
NEXT_HOUR = (
    "rf", "gbr", "xgb", "ada_stumps", "ada_profundo", "gbr_estandar", "gbr_shrinkage", "gbr_early", "gbr_stochastic", "hist_gbrt",
    "voting_simple", "stacking_nivel1", "stacking_nivel2", "stack")


def tuned_forest(task: Task, packed: Packed, trees: int = 100, depth: int | None = None, minInstancesPerNode: int = 1) -> ForestModel:
    return fit_forest(task, packed, Growth(trees=trees, bootstrap=True, depth=depth, leaf_rows=minInstancesPerNode))


def _tuned_boosting(penalty: float) -> Callable:
    def fit(task: Task, packed: Packed, rounds: int = 100, rate: float = 0.1, depth: int = 3, subsamplingRate: float = 1.0,
            featureSubsetStrategy: str = "all") -> BoostedModel:
        share = 1.0 if featureSubsetStrategy == "all" else float(featureSubsetStrategy)
        return fit_boosted(task, packed, Boosting(
            rounds=rounds, rate=rate, depth=depth, rows=subsamplingRate, columns=share, penalty=penalty))
    return fit


GRIDS: dict[str, tuple[Callable, dict[str, list]]] = {
    "rf": (tuned_forest, {
        "trees": [200, 300], "depth": [None, 10], "minInstancesPerNode": [1, 2]}),
    "gbr": (_tuned_boosting(0.0), {
        "rounds": [200, 300], "rate": [0.05, 0.1], "depth": [2, 3], "subsamplingRate": [0.8, 1.0]}),
    "xgb": (_tuned_boosting(1.0), {
        "rounds": [200, 300], "rate": [0.05, 0.1], "depth": [3, 4], "subsamplingRate": [0.8, 1.0],
        "featureSubsetStrategy": ["0.8", "all"]}),
}


def fit_model(name: str, task: Task, output: str = PREDICTION) -> OneTarget:
    """A model for one target; those with several outputs are in modules of their own."""
    if name not in NEXT_HOUR:
        raise ValueError(f"unknown model: {name}")
    if name in STACKS:
        return OneTarget(fit_stacking(task, *STACKS[name]), output)
    packed = task.packed()
    if name in VOTING:
        return OneTarget(MeanModel(side_by_side(lambda part: fit_member(part, task, packed), VOTING[name])), output)
    return OneTarget(fit_member(name, task, packed), output)
