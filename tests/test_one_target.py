"""Models of one target over binned rows, in which all stations are one feature."""

import random
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airspan.models.adaboost import Ada, AdaModel, weighted_medians
from airspan.models.composed import OneTarget, StackModel
from airspan.models.forest import Bins, ForestModel, Growth
from airspan.models.learners import Task, fit_model, quick
from airspan.models.registry import load_models, save_model
from airspan.models.tuning import fit_tuned
from test_forest import FEATURES, SCHEMA, answers, rows_of


def frame(spark, n=400):
    """Rows without a feature vector: nothing may need a flag per station."""
    draw = random.Random(5)
    rows = [(i, draw.randrange(40), draw.randrange(24), draw.random() * 5) for i in range(n)]
    return spark.createDataFrame(
        [(i, f"s{s}", h, v, h + 10.0 * (s == 7) + v + draw.random()) for i, s, h, v in rows],
        "row_no long, Estacion string, hour int, CO double, CO_next_hour double")


def stump_by_hand(x, y, w):
    best = None
    for f in range(x.shape[1]):
        for value in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= value
            gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or gain > best[0] * (1 + 1e-12):
                best = (gain, left)
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = (w[side] * y[side]).sum() / w[side].sum()
    return out


@pytest.mark.parametrize("node_cells", [10**9, 1])
def test_adaboost_equals_rounds_by_hand(spark, node_cells):
    rows = rows_of(150, 21)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = answers(AdaModel.fit_rows(df, FEATURES, "u", ["k"], Ada(3, 0.5, 1), node_cells=node_cells), df)
    x, y, w, asked, votes = np.array([r[1:4] for r in rows], float), np.array([r[5] for r in rows]), np.ones(150), [], []
    for _ in range(3):
        pred = stump_by_hand(x, y, w)
        miss = np.abs(y - pred)
        loss = (w * miss).sum() / w.sum() / miss.max()
        assert loss < 0.5
        beta = loss / (1 - loss)
        asked, votes, w = [*asked, pred], [*votes, 0.5 * log(1 / beta)], w * beta ** ((1 - miss / miss.max()) * 0.5)
    want = weighted_medians(np.stack(asked, axis=1), np.array(votes))
    assert np.allclose([got[k][0] for k in range(150)], want, atol=1e-5)


def test_more_stations_than_small_numbers_count_to(spark):
    names = [f"s{i}" for i in range(40_000)]
    bins = Bins({}, {}, {"s": names})
    asked = pa.RecordBatch.from_pydict({"s": ["s0", "s39999", "s33000", "unknown"]})
    assert bins.place(asked)[:, 0].tolist() == [0, 39999, 33000, 0]
    rows = spark.range(120).select(
        "id", F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 39_999).otherwise(7)).alias("s"), F.lit(1).alias("a"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(1.0).alias("y"))
    for node_rows in (10**6, 10):
        model = ForestModel.fit(rows, ["a"], ["y"], ["id"], Growth(depth=2), {"s": names}, node_rows=node_rows)
        assert {(r["s"], round(r["predictions"][0], 4)) for r in model.transform(rows).collect()} == {("s39999", 5.0), ("s7", 1.0)}


def test_stacks_blend_predictions_of_rows_not_trained_on(spark, tmp_path):
    rows = frame(spark)
    for name in ("stacking_nivel1", "stacking_nivel2"):
        model = fit_model(name, quick(Task(rows, "CO_next_hour"), 30, 3))
        assert isinstance(model.model, StackModel) and len(model.model.members) == 3
        answered = model.transform(rows)
        error = answered.agg(F.avg(F.abs(F.col("prediction") - F.col("CO_next_hour")))).first()[0]
        plain = rows.agg((F.sqrt(F.var_pop("CO_next_hour")))).first()[0]
        assert error < plain / 2 and answered.count() == rows.count()
        save_model(spark, str(tmp_path), name, "CO", model)
        loaded = load_models(spark, str(tmp_path))[name]["CO"]
        assert isinstance(loaded, OneTarget)
        assert loaded.transform(rows).select("row_no", "prediction").exceptAll(answered.select("row_no", "prediction")).isEmpty()


def test_grids_take_forests_and_boosted_trees_by_station(spark):
    task = quick(Task(frame(spark), "CO_next_hour"), 20, 6)
    model, best = fit_tuned("rf", task, [{"trees": 1, "depth": 1}, {"trees": 20, "minInstancesPerNode": 2}])
    assert best == {"trees": 20, "minInstancesPerNode": 2} and isinstance(model.model, ForestModel)
    _, best = fit_tuned("xgb", task, [{"rounds": 1}, {"rounds": 20, "rate": 0.3, "featureSubsetStrategy": "0.8"}])
    assert best["rounds"] == 20
