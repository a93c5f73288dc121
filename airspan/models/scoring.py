"""Training runs, scenarios and real against predicted."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from airspan.functions.texts import target_label
from airspan.models.adaboost import AdaModel
from airspan.models.boosting import BoostedModel, MeanModel
from airspan.models.composed import OneTarget, StackModel
from airspan.models.forest import ForestModel
from airspan.models.knn import NearestModel
from airspan.models.learners import (
    ADABOOST, FEATURES, KNN_MODEL, MULTI_OUTPUT, NEXT_HOUR, NEXT_HOUR_BOOSTED, NEXT_HOUR_FORESTS, PREDICTION, STACKS, VOTING, Task, fit_member,
    fit_model, fit_stacking, quick, side_by_side,
)
from airspan.operators.metrics import multi_output_metrics, regression_metrics
from airspan.operators.order import first_complete_rows
from airspan.plans.features import (
    MULTI_FEATURES, MULTI_TARGETS, TIME_FEATURES, feature_columns, median_vector, one_hot,
    random_split, sequential_split,
)
from airspan.schemas import RAW_KEY, name_col
from airspan.session import durable

FLAGS = "station_flags"


def assemble(frame: DataFrame, columns: Sequence[str], station: str, names: Sequence[str]) -> DataFrame:
    """Adds the feature vector: the columns, then a flag per station but the first."""
    flagged = one_hot(frame, station, names, FLAGS)
    inputs = [*columns, FLAGS] if FLAGS in flagged.columns else list(columns)
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(flagged).drop(FLAGS)


def next_hour_split(
    frame: DataFrame, names: Sequence[str], station: str = "Estacion", ts: str = "datetime"
) -> DataFrame:
    """Assembled rows with ``row_no`` and ``is_test``, saved once for all fits."""
    columns = feature_columns(frame)
    split = sequential_split(frame, [station, ts])
    return durable(assemble(split, columns, station, names))


def train_next_hour(
    split: DataFrame, targets: Sequence[str], models: Iterable[str], small: bool = False,
    names: Sequence[str] = (), station: str = "Estacion",
) -> tuple[dict[str, dict[str, OneTarget | ForestModel]], DataFrame]:
    """algorithm -> target -> model, and their metrics on the held-out rows. ``names`` are the stations, which
    trees take by name. ``small`` is for trials: AdaBoost and stacks of few trees and rounds, a fit for each target."""
    train, test = split.filter("not is_test"), split.filter("is_test")
    fitted: dict = {}
    scored = []
    for name in models:
        if name in TOGETHER or name in NEXT_HOUR and not small:
            model = fit_next_hour(name, train, targets, names, station)
            fitted[name] = {t: model for t in targets}
            scored.append(long_scored(model, name, test, targets))
            continue
        for target in targets:
            model = fit_model(name, quick(Task(train, target, tuple(names), station=station)))
            fitted.setdefault(name, {})[target] = model
            scored.append(_scored(model.transform(test.drop(FEATURES)), target, name, F.col(PREDICTION)))
    return fitted, regression_metrics(reduce(DataFrame.unionByName, scored))


# Next-hour models that have no small ones for trials.
TOGETHER = (*NEXT_HOUR_FORESTS, *NEXT_HOUR_BOOSTED, *VOTING)


def fit_next_hour(
    name: str, train: DataFrame, targets: Sequence[str], names: Sequence[str], station: str = "Estacion",
) -> ForestModel | BoostedModel | MeanModel | AdaModel | StackModel:
    """One of ``NEXT_HOUR``: trees of their own for each target, all on the same binned rows."""
    if name not in NEXT_HOUR:
        raise ValueError(f"unknown model: {name}")
    if name in VOTING:
        return MeanModel(side_by_side(lambda part: fit_next_hour(part, train, targets, names, station), VOTING[name]))
    task = Task(train, targets[0], tuple(names), station=station)
    if name in STACKS:
        return fit_stacking(task, *STACKS[name], targets)
    if name in ADABOOST:
        return fit_member(name, task, task.packed(targets=targets))
    ordered = [c for c in feature_columns(train) if c not in (FEATURES, "is_test")]
    if name in NEXT_HOUR_FORESTS:
        return ForestModel.fit(train, ordered, targets, ["row_no"], NEXT_HOUR_FORESTS[name], {station: names}, together=False)
    return BoostedModel.fit(train, ordered, targets, ["row_no"], NEXT_HOUR_BOOSTED[name], {station: names})


def long_scored(model: ForestModel | BoostedModel | MeanModel | AdaModel | StackModel, name: str, rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, model, y, pred) of a model that answers for several targets."""
    answered = model.transform(rows.select(*model.bins.columns(), *[F.col(name_col(t)).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)]))
    at = {t: i for i, t in enumerate(model.outputs)}
    return answered.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(name).alias("model"), F.col(f"_y{i}").alias("y"), F.col("predictions")[at[t]].alias("pred"))
        for i, t in enumerate(targets)])))


def _scored(rows: DataFrame, target: str, model: str, pred) -> DataFrame:
    return rows.select(
        F.lit(target).alias("target"), F.lit(model).alias("model"),
        F.col(name_col(target)).alias("y"), pred.alias("pred"))


def multi_split(frame: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with ``is_test``. The targets get names without dots."""
    return durable(random_split(frame, RAW_KEY, test_share, seed).withColumnsRenamed(ML_NAMES))


ML_NAMES = {t: t.replace("PM 2.5", "PM2_5").replace("PM 10", "PM10") for t in MULTI_TARGETS}
ML_TARGETS = list(ML_NAMES.values())


def fit_multi(name: str, train: DataFrame, targets: Sequence[str] = tuple(ML_TARGETS)) -> NearestModel | ForestModel:
    """A model that answers for all targets at once."""
    if name == KNN_MODEL:
        return NearestModel.fit(train, MULTI_FEATURES, targets, RAW_KEY)
    if name not in MULTI_OUTPUT:
        raise ValueError(f"unknown model: {name}")
    return ForestModel.fit(train, MULTI_FEATURES, targets, RAW_KEY, MULTI_OUTPUT[name])


def predict_multi(model, rows: DataFrame, targets: Sequence[str] = tuple(ML_TARGETS)) -> DataFrame:
    """Adds ``pred_<target>`` for every target."""
    answered = model.transform(rows.drop(FEATURES) if isinstance(model, ForestModel) else rows, "_all")
    return answered.select("*", *[
        F.col("_all")[i].alias(f"pred_{t}") for i, t in enumerate(targets)]).drop("_all")


def multi_scored(model, name: str, rows: DataFrame, targets: Sequence[str] = tuple(ML_TARGETS)) -> DataFrame:
    """(target, model, y, pred) of rows that hold the truth."""
    predicted = predict_multi(model, rows, targets)
    entries = [F.struct(F.lit(t).alias("target"), F.lit(name).alias("model"),
                        F.col(t).alias("y"), F.col(f"pred_{t}").alias("pred")) for t in targets]
    return predicted.select(F.inline(F.array(*entries)))


def train_multi(split: DataFrame, models: Iterable[str]) -> tuple[dict, DataFrame]:
    """Models by name, and (model, r2, rmse) over all targets on the held-out rows."""
    train, test = split.filter("not is_test"), split.filter("is_test")
    fitted = {name: fit_multi(name, train) for name in models}
    scored = [multi_scored(model, name, test) for name, model in fitted.items()]
    return fitted, multi_output_metrics(regression_metrics(reduce(DataFrame.unionByName, scored)))


def scenario_rows(scenarios: DataFrame, frame: DataFrame, station: str = "Estacion") -> DataFrame:
    """Scenarios (hour, month, dayofweek, station) on top of the median of every other feature."""
    columns = feature_columns(frame)
    others = [c for c in columns if c not in TIME_FEATURES]
    medians = median_vector(frame, others)
    packed = medians.agg(F.struct(*[F.max(c).alias(c) for c in others])).scalar()
    weekend = (F.col("dayofweek") >= 5).cast("int")
    kept = [c for c in scenarios.columns if c not in ("is_weekend", *others)]
    return scenarios.withColumn("_medians", packed).select(
        *kept, weekend.alias("is_weekend"), *[F.col(f"_medians.{c}").alias(c) for c in others])


def score_scenarios(
    models: Mapping[str, PipelineModel | BoostedModel], scenarios: DataFrame, frame: DataFrame, names: Sequence[str],
    station: str = "Estacion",
) -> DataFrame:
    """Long result: a row per scenario and target. Models of all targets are asked once."""
    rows = scenario_rows(scenarios, frame, station)
    keep = [c for c in scenarios.columns]
    parts = []
    for model in dict.fromkeys(models.values()):
        own = [t for t in models if models[t] is model]
        if isinstance(model, PipelineModel):
            answered = model.transform(assemble(rows, feature_columns(frame), station, names))
            entries = [F.struct(F.lit(t).alias("target"), F.col(PREDICTION).alias("prediction")) for t in own]
        else:
            answered = (model.model if isinstance(model, OneTarget) else model).transform(rows, "_all")
            entries = [F.struct(F.lit(t).alias("target"), F.col("_all")[model.outputs.index(t)].alias("prediction")) for t in own]
        parts.append(answered.select(*keep, F.inline(F.array(*entries))).select(
            *keep, "target", target_label(F.col("target")).alias("label"), "prediction"))
    return reduce(DataFrame.unionByName, parts)


def score_multi(model, scenarios: DataFrame, targets: Sequence[str] = tuple(ML_TARGETS)) -> DataFrame:
    """Hour, month, weekday and station code with a prediction per target."""
    return predict_multi(model, scenarios, targets)


def real_against_predicted(predicted: DataFrame, target: str, pred: str = PREDICTION) -> DataFrame:
    real, guess = F.col(target), F.col(pred)
    return predicted.select(
        real.alias("real"), guess.alias("predicted"), (real - guess).alias("residual"))


def first_real_against_predicted(
    model: PipelineModel | BoostedModel, split: DataFrame, target: str, order: Sequence[str], n: int = 400
) -> DataFrame:
    """The first complete rows of the frame, real against predicted."""
    rows = first_complete_rows(split, [FEATURES, target], order, n)
    if isinstance(model, PipelineModel):
        return real_against_predicted(model.transform(rows), target)
    answered = (model.model if isinstance(model, OneTarget) else model).transform(rows.drop(FEATURES), "_all")
    return real_against_predicted(answered.withColumn(PREDICTION, F.col("_all")[model.outputs.index(target)]), target)
