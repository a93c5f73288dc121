"""Queries that train and apply models, at their own settings but for grids, which are cut to few trees and rounds. Predictions have no SQL twin, but for those that must be means of rows."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from airspan.catalog.features import frame, multi_frame
from airspan.catalog.registry import ORACLE, query
from airspan.models.learners import FEATURES, KNN_MODEL, MULTI_OUTPUT, NEXT_HOUR, Task, quick
from airspan.models.registry import ALL_TARGETS, load_models, save_model
from airspan.models.scoring import (
    ML_NAMES, ML_TARGETS, fit_multi, fit_next_hour, first_real_against_predicted, multi_split, next_hour_split, predict_multi,
    real_against_predicted, score_multi, score_scenarios, train_multi, train_next_hour,
)
from airspan.models.tuning import fit_tuned
from airspan.plans.features import MULTI_FEATURES, station_names, target_columns
from airspan.session import checkpoint_root
from airspan.sources import sample

TARGET = "PM2_5_next_hour"


def _stations(spark, sf_dir):
    return station_names(sample.named_measurements(spark, sf_dir), "Estacion")


def next_hour(spark, sf_dir):
    return next_hour_split(frame(spark, sf_dir), _stations(spark, sf_dir))


def multi(spark, sf_dir):
    return multi_split(multi_frame(spark, sf_dir))


def _slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"^\d+\. ", "", name).lower()).strip("_")


def _train_multi(name: str):
    return lambda spark, sf_dir: train_multi(multi(spark, sf_dir), [name])[1]


def _train_next(name: str):
    def run(spark, sf_dir):
        split = next_hour(spark, sf_dir)
        return train_next_hour(split, target_columns(split), [name], names=_stations(spark, sf_dir))[1]
    return run


def _tune(name: str, settings: list[dict]):
    def run(spark, sf_dir):
        split = next_hour(spark, sf_dir)
        task = quick(Task(split.filter("not is_test"), TARGET, tuple(_stations(spark, sf_dir))))
        model, best = fit_tuned(name, task, settings)
        rows = model.transform(split.filter("is_test").drop(FEATURES))
        chosen = ", ".join(f"{k}={v}" for k, v in sorted(best.items()))
        return rows.agg(F.avg(F.abs(F.col(TARGET) - F.col("prediction"))).alias("mae")).withColumn(
            "setting", F.lit(chosen))
    return run


for _name in [*MULTI_OUTPUT, KNN_MODEL]:
    query(f"train_multi_{_slug(_name)}")(_train_multi(_name))
for _name in NEXT_HOUR:
    query(f"train_next_{_name}")(_train_next(_name))

query("tune_rf")(_tune("rf", [{"trees": 3, "minInstancesPerNode": 1}, {"trees": 3, "minInstancesPerNode": 2}]))
query("tune_gbr")(_tune("gbr", [{"rounds": 3, "rate": 0.05}, {"rounds": 3, "rate": 0.1}]))
query("tune_xgb")(_tune("xgb", [{"rounds": 3, "subsamplingRate": 0.8}, {"rounds": 3, "subsamplingRate": 1.0}]))


def _multi_tree(rows):
    return fit_multi("1. Decision Tree", rows.filter("not is_test"))


def _next_models(split, names):
    targets = target_columns(split)
    return dict.fromkeys(targets, fit_next_hour("gbr_estandar", split.filter("not is_test"), targets, names))


@query("score_scenarios")
def score_scenarios_(spark, sf_dir):
    """A scenario per order: its customer's station at the weekday and month it was placed."""
    scenarios = sample.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("int").alias("Estacion"),
        F.pmod("o_orderkey", F.lit(24)).cast("int").alias("hour"),
        F.weekday("o_orderdate").alias("dayofweek"), F.month("o_orderdate").alias("month"))
    return score_scenarios(
        _next_models(next_hour(spark, sf_dir), _stations(spark, sf_dir)), scenarios, frame(spark, sf_dir), _stations(spark, sf_dir))


@query("score_multi")
def score_multi_(spark, sf_dir):
    scenarios = sample.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.pmod("o_orderkey", F.lit(24)).cast("int").alias("Hora_Num"),
        F.month("o_orderdate").alias("Mes"), F.weekday("o_orderdate").alias("Dia_Semana"),
        F.col("o_custkey").cast("int").alias("Estacion_Code"))
    return score_multi(_multi_tree(multi(spark, sf_dir)), scenarios)


@query("real_vs_pred_multi")
def real_vs_pred_multi(spark, sf_dir):
    """Every target of every held-out row."""
    rows = multi(spark, sf_dir)
    predicted = predict_multi(_multi_tree(rows), rows.filter("is_test"))
    parts = [real_against_predicted(predicted, t, f"pred_{t}").withColumn("target", F.lit(t)) for t in ML_TARGETS]
    return reduce(DataFrame.unionByName, parts)


@query("tree_on_training_rows", f"""
SELECT "Hora_Num", "Mes", "Dia_Semana", "Estacion_Code", count(*) AS n, {", ".join(
    f'round(avg("{name}"), 4) AS "{ML_NAMES[name]}"' for name in ML_NAMES)}
FROM ({ORACLE["multi_output_frame"]})
WHERE ('0x' || substr(md5('42|' || "Estacion" || '|' || "Fecha" || '|' || "Hora"), 1, 8))::BIGINT
      >= (0.2 * 4294967296)::BIGINT
GROUP BY 1, 2, 3, 4""")
def tree_on_training_rows(spark, sf_dir):
    """A tree without a bound on its depth gives each point that it was trained on the mean of its rows."""
    train = multi(spark, sf_dir).filter("not is_test")
    points = train.groupBy(*MULTI_FEATURES).agg(F.count(F.lit(1)).alias("n"))
    answered = predict_multi(fit_multi("1. Decision Tree", train), points)
    return answered.select(*MULTI_FEATURES, "n", *[F.round(f"pred_{t}", 4).alias(t) for t in ML_TARGETS])


@query("real_vs_pred_next_hour")
def real_vs_pred_next_hour(spark, sf_dir):
    """The first rows with all columns, every target."""
    split = next_hour(spark, sf_dir)
    parts = [first_real_against_predicted(model, split, t, ["Estacion", "datetime"]).withColumn("target", F.lit(t))
             for t, model in _next_models(split, _stations(spark, sf_dir)).items()]
    return reduce(DataFrame.unionByName, parts)


def _saved_and_loaded(spark, model):
    root = f"{checkpoint_root(spark)}/models-{uuid.uuid4().hex}"
    save_model(spark, root, "tree", ALL_TARGETS, model)
    return load_models(spark, root)["tree"][ALL_TARGETS]


@query("saved_models")
def saved_models(spark, sf_dir):
    """Saves the model, loads it, and scores with the loaded one."""
    rows = multi(spark, sf_dir)
    return predict_multi(_saved_and_loaded(spark, _multi_tree(rows)), rows.filter("is_test")).select(
        "Estacion", "Fecha", "Hora", *[f"pred_{t}" for t in ML_TARGETS])


@query("saved_models_agree", f"""
SELECT "Estacion", "Fecha", "Hora", TRUE AS same FROM ({ORACLE["multi_output_frame"]})
WHERE ('0x' || substr(md5('42|' || "Estacion" || '|' || "Fecha" || '|' || "Hora"), 1, 8))::BIGINT
      < (0.2 * 4294967296)::BIGINT""")
def saved_models_agree(spark, sf_dir):
    """Whether the loaded model answers as the one that was saved, for every held-out row."""
    rows = multi(spark, sf_dir)
    model, rows = _multi_tree(rows), rows.filter("is_test")
    names = [f"pred_{t}" for t in ML_TARGETS]
    before = predict_multi(model, rows).select("Estacion", "Fecha", "Hora", *names)
    after = predict_multi(_saved_and_loaded(spark, model), rows).select(
        "Estacion", "Fecha", "Hora", *[F.col(n).alias(f"loaded_{n}") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"loaded_{n}"))
    return before.join(after, ["Estacion", "Fecha", "Hora"]).select("Estacion", "Fecha", "Hora", same.alias("same"))
