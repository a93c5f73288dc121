"""Models on small frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from airspan.models.boosting import BoostedModel, Boosting, MeanModel
from airspan.models.forest import ForestModel
from airspan.models.knn import NearestModel, _times_drawn
from airspan.models.learners import MULTI_OUTPUT, Task, fit_model, quick, weighted_median_sql
from airspan.models.registry import load_models, save_model
from airspan.models.scoring import (
    assemble, next_hour_split, score_scenarios, train_next_hour,
)
from airspan.models.tuning import fit_tuned, settings_of
from airspan.operators.metrics import best_models, one_row_per_model, regression_metrics
from airspan.plans.features import (
    contiguous_folds, expanding_folds, feature_columns, next_hour_frame, random_split, sequential_split,
    station_names, target_columns,
)

TARGET = "CO_next_hour"


@pytest.fixture(scope="module")
def split(spark):
    draw, start, rows = random.Random(3), datetime(2024, 1, 1), []
    for s in ("A", "B", "C", "D"):
        for h in range(60):
            rows.append((s, start + timedelta(hours=h), 10 + h % 24 + draw.random(), None if h % 7 else 2.0, None))
    df = spark.createDataFrame(rows, "Estacion string, datetime timestamp, CO double, O3 double, NO2 double")
    frame = next_hour_frame(df.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")))
    assert "NO2" not in frame.columns and frame.count() == 4 * 56
    return frame, next_hour_split(frame, station_names(frame, "Estacion"))


def test_metrics_equal_the_evaluator(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([("t", "m", draw.random(), draw.random()) for _ in range(200)], "target string, model string, y double, pred double")
    got = regression_metrics(df).first()
    for name in ("mae", "rmse", "r2"):
        judge = RegressionEvaluator(labelCol="y", predictionCol="pred", metricName=name)
        assert abs(got[name] - judge.evaluate(df)) < 1e-9


def test_ranking(spark):
    df = spark.createDataFrame(
        [("t", "a", 2.0, 0.5), ("t", "b", 1.0, 0.9), ("t", "b", 3.0, 0.1), ("u", "a", 1.0, 0.2)],
        "target string, model string, rmse double, r2 double")
    assert sorted((r["target"], r["model"]) for r in best_models(df).collect()) == [("t", "b"), ("u", "a")]
    assert sorted((r["target"], r["model"], r["r2"]) for r in one_row_per_model(df).collect()) == [
        ("t", "a", 0.5), ("t", "b", 0.1), ("u", "a", 0.2)]


def test_folds():
    assert expanding_folds(10) == [(4, 6), (6, 8), (8, 10)]
    assert expanding_folds(11) == [(5, 7), (7, 9), (9, 11)]
    assert expanding_folds(3) == [(1, 2), (2, 3)] and expanding_folds(2) == []
    assert contiguous_folds(11) == [(0, 3), (3, 5), (5, 7), (7, 9), (9, 11)]


def test_splits(spark):
    df = spark.range(11).withColumn("k", F.col("id"))
    rows = sequential_split(df, ["id"]).orderBy("row_no").collect()
    assert [r["is_test"] for r in rows] == [False] * 8 + [True] * 3
    many = spark.range(20000).withColumn("k", F.col("id"))
    share = random_split(many, ["k"]).filter("is_test").count() / 20000
    assert 0.18 < share < 0.22
    assert random_split(many.repartition(7), ["k"]).filter("is_test").select("k").exceptAll(
        random_split(many, ["k"]).filter("is_test").select("k")).count() == 0


def test_unknown_and_first_station_have_no_flag(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0), ("Z", 1.0)], "s string, x double")
    got = {r["s"]: list(r["features"].toArray()) for r in assemble(df, ["x"], "s", ["A", "B", "C"]).collect()}
    assert got == {"A": [1, 0, 0], "B": [1, 1, 0], "C": [1, 0, 1], "Z": [1, 0, 0]}


def test_weighted_median(spark):
    draw = random.Random(9)
    for _ in range(5):
        preds, votes = [draw.random() for _ in range(7)], [draw.random() for _ in range(7)]
        pairs, run, want = sorted(zip(preds, votes)), 0.0, None
        for p, v in pairs:
            run += v
            if run >= sum(votes) / 2:
                want = p
                break
        df = spark.createDataFrame([tuple(preds)], ", ".join(f"p{i} double" for i in range(7)))
        assert df.selectExpr(weighted_median_sql([f"p{i}" for i in range(7)], votes)).first()[0] == want


def test_voting_is_the_mean_of_its_parts(spark, split):
    train = split[1].filter("not is_test")
    task = quick(Task(train, TARGET))
    parts = [fit_model(n, task, f"p{i}").transform(train).select("row_no", f"p{i}")
             for i, n in enumerate(["gbr_estandar", "gbr_shrinkage", "hist_gbrt"])]
    joined = fit_model("voting_simple", task).transform(train).select("row_no", "prediction")
    for p in parts:
        joined = joined.join(p, "row_no")
    assert joined.filter("abs(prediction - (p0 + p1 + p2) / 3) > 1e-9").isEmpty()


def test_pasting_equals_the_single_tree(spark, split):
    train = split[1].filter("not is_test").drop("features")
    fit = lambda name: ForestModel.fit(train, ["hour", "CO_lag1"], [TARGET], ["row_no"], MULTI_OUTPUT[name])
    both = fit("3. Pasting (Trees)").transform(fit("1. Decision Tree").transform(train, "a"), "b")
    assert both.filter("abs(a[0] - b[0]) > 1e-9").isEmpty() and both.count() == train.count()


def test_means_of_models_are_saved_and_answer_for_scenarios(spark, split, tmp_path):
    frame, rows = split
    targets, names = target_columns(rows), ["A", "B", "C", "D"]
    parts = [BoostedModel.fit(rows, ["hour", "CO_lag1"], targets, ["row_no"], Boosting(rounds=n)) for n in (2, 5)]
    save_model(spark, str(tmp_path), "voting", "all", MeanModel(parts))
    mean = load_models(spark, str(tmp_path))["voting"]["all"]
    asked = mean.transform(parts[1].transform(parts[0].transform(rows.drop("features"), "a"), "b"), "m")
    assert asked.filter("abs(m[0] - (a[0] + b[0]) / 2) > 1e-12 or abs(m[1] - (a[1] + b[1]) / 2) > 1e-12").isEmpty()
    scenarios = spark.createDataFrame([(8, 1, 6, "B"), (8, 1, 0, "nowhere")], "hour int, month int, dayofweek int, Estacion string")
    got = score_scenarios(dict.fromkeys(targets, mean), scenarios, frame, names).collect()
    assert len(got) == 4 and {r["label"] for r in got} == {"CO", "O3"}


def test_next_hour_trees_answer_for_all_targets(spark, split):
    rows = split[1]
    targets = target_columns(rows)
    fitted, metrics = train_next_hour(rows, targets, ["rf", "hist_gbrt"], names=["A", "B", "C", "D"])
    assert sorted(r["target"] for r in metrics.collect()) == sorted(targets * 2) and len(targets) == 2
    assert all(r["r2"] > 0.8 for r in metrics.collect() if r["target"] == "CO_next_hour")
    with pytest.raises(ValueError):
        fit_model("nothing", Task(rows, TARGET))


def test_every_combination_fits_saves_and_loads(spark, split, tmp_path):
    frame, rows = split
    fitted, metrics = train_next_hour(rows, [TARGET], ["ada_profundo", "gbr_early"], small=True)
    assert metrics.count() == 2
    for name, models in fitted.items():
        save_model(spark, str(tmp_path), name, TARGET, models[TARGET])
    loaded = load_models(spark, str(tmp_path))
    test = rows.filter("is_test")
    for name in fitted:
        column = "prediction" if name == "ada_profundo" else "predictions"
        a = fitted[name][TARGET].transform(test).select("row_no", column)
        b = loaded[name][TARGET].transform(test).select("row_no", column)
        assert a.exceptAll(b).isEmpty() and a.count() == test.count()
    scenarios = spark.createDataFrame([(8, 1, 6, "B"), (8, 1, 0, "nowhere")], "hour int, month int, dayofweek int, Estacion string")
    got = score_scenarios({TARGET: loaded["gbr_early"][TARGET]}, scenarios, frame, ["A", "B", "C", "D"])
    assert got.count() == 2 and got.first()["label"] == "CO"


def test_tuning_takes_the_smallest_error(spark, split):
    train = split[1].filter("not is_test")
    _, best = fit_tuned("gbr", quick(Task(train, TARGET)), [{"rounds": 1, "depth": 1}, {"rounds": 3, "depth": 4}])
    assert best == {"rounds": 3, "depth": 4}
    assert len(settings_of({"a": [1, 2], "b": [3, 4]})) == 4


def test_nearest_model_against_brute_force(spark):
    draw = random.Random(11)
    rows = [(i, draw.randrange(24), draw.randrange(3), draw.randrange(0, 60), draw.random()) for i in range(150)]
    train = spark.createDataFrame(rows, "k int, a int, b int, c int, y double")
    model = NearestModel.fit(train, ["a", "b", "c"], ["y"], ["k"], bags=2, k=5)
    weights = train.select("k", *[_times_drawn(42, b, ["k"]).alias(f"w{b}") for b in range(2)]).collect()
    asked = [(draw.randrange(24), draw.randrange(3), draw.randrange(0, 90)) for _ in range(40)] + [(0, 0, 500)]
    got = {(r["a"], r["b"], r["c"]): r["predictions"][0] for r in model.transform(
        spark.createDataFrame(asked, "a int, b int, c int")).collect()}
    for q in asked:
        means = []
        for b in range(2):
            points = {}
            for (k, *at, y), w in zip(rows, weights):
                if w[f"w{b}"]:
                    n, s = points.get(tuple(at), (0.0, 0.0))
                    points[tuple(at)] = (n + w[f"w{b}"], s + w[f"w{b}"] * y)
            left, total = 5.0, 0.0
            for at in sorted(points, key=lambda p: (sum((x - z) ** 2 for x, z in zip(p, q)), p)):
                n, s = points[at]
                take = min(n, left)
                total, left = total + take * s / n, left - take
                if left <= 0:
                    break
            means.append(total / 5)
        assert abs(got[q] - sum(means) / 2) < 1e-9
