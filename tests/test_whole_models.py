"""The catalog's next-hour models run at their own settings and for all targets."""

import pytest
from pyspark.sql import functions as F

from airspan.catalog import QUERIES, models
from airspan.models import learners, scoring
from airspan.models.adaboost import Ada
from airspan.models.boosting import Boosting
from airspan.models.composed import StackModel
from airspan.models.forest import Growth
from airspan.plans.features import target_columns
from airspan.models.registry import load_models, save_model

TARGETS = ["CO_next_hour", "O3_next_hour"]


def rows(spark, n=300):
    """Two targets that differ, so that none can stand for the other."""
    draw = lambda i, m: F.pmod(F.xxhash64("row_no", F.lit(i)), F.lit(m)).cast("int")
    return spark.range(n).withColumnRenamed("id", "row_no").select(
        "row_no", F.concat(F.lit("s"), draw(1, 9)).alias("Estacion"), draw(2, 24).alias("hour"), (draw(3, 50) / 10.0).alias("CO"),
    ).withColumns({"CO_next_hour": F.col("CO") + F.col("hour"), "O3_next_hour": 500.0 - 3 * F.col("hour") + F.col("CO"),
                   "is_test": F.col("row_no") >= int(n * 0.8)})


@pytest.mark.parametrize("name", ["ada_stumps", "ada_profundo", "stack", "stacking_nivel1", "stacking_nivel2"])
def test_no_parameter_cuts_trees_rounds_depth_or_targets(spark, monkeypatch, name):
    made = []
    split = rows(spark)
    monkeypatch.setattr(models, "next_hour", lambda *_: split)
    monkeypatch.setattr(models, "_stations", lambda *_: [f"s{i}" for i in range(9)])

    def kept(of, setting_at):
        plain = of.fit

        def fit(cls, *args, **more):
            packed = more.get("packed") or args[0]
            setting = more.get("setting") or args[setting_at]
            made.append((tuple(packed.outputs), setting))
            small = {"rounds": 2} if not isinstance(setting, Growth) else {"trees": 2}
            args = [*args[:setting_at], learners.replace(setting, **small), *args[setting_at + 1:]]
            return plain.__func__(cls, *args, **more)
        monkeypatch.setattr(of, "fit", classmethod(fit))

    kept(learners.AdaModel, 1)
    kept(learners.BoostedModel, 4)
    monkeypatch.setattr(learners, "fit_forest", lambda task, packed, growth: made.append((tuple(packed.outputs), growth)) or _few(packed))
    monkeypatch.setattr(learners, "blend_forest", learners.blend_linear)
    monkeypatch.setitem(learners.STACKS, "stacking_nivel2", (learners.STACKS["stacking_nivel2"][0], learners.blend_linear))
    answered = QUERIES[f"train_next_{name}"](spark, "").collect()
    assert sorted(r["target"] for r in answered) == sorted(target_columns(split)) == TARGETS
    members = learners.STACKS[name][0] if name in learners.STACKS else [name]
    asked = {m: {**learners.ADABOOST, **learners.NEXT_HOUR_BOOSTED, **learners.NEXT_HOUR_FORESTS}[m] for m in members}
    assert {o for o, _ in made} == {tuple(TARGETS)}
    assert len(made) == len(members) * (6 if name in learners.STACKS else 1)
    for setting in asked.values():
        assert setting in [s if isinstance(s, Growth) else s for _, s in made]
    assert all(isinstance(s, (Ada, Boosting, Growth)) for _, s in made)


def _few(packed):
    return learners.ForestModel.fit(None, [], packed.outputs, [], Growth(trees=2, bootstrap=True), together=False, packed=packed)


def test_stacks_and_adaboost_of_several_targets_answer_for_each_and_are_saved(spark, monkeypatch, tmp_path):
    split = rows(spark)
    train = split.filter("not is_test")
    monkeypatch.setitem(learners.ADABOOST, "ada_stumps", Ada(5, 0.5, 3))
    monkeypatch.setitem(learners.NEXT_HOUR_BOOSTED, "gbr_estandar", Boosting(rounds=20, rate=0.3))
    monkeypatch.setitem(learners.NEXT_HOUR_BOOSTED, "hist_gbrt", Boosting(rounds=20, rate=0.3))
    for name, blend in zip("ab", (learners.blend_linear, lambda task, rows, columns: learners.blend_forest(learners.quick(task, 20, 8), rows, columns))):
        monkeypatch.setitem(learners.STACKS, "stacking_nivel1", (learners.STACKS["stacking_nivel1"][0], blend))
        model = scoring.fit_next_hour("stacking_nivel1", train, TARGETS, [f"s{i}" for i in range(9)])
        assert isinstance(model, StackModel) and model.outputs == TARGETS
        answered = model.transform(split).select("row_no", *TARGETS, "predictions").collect()
        for k, target in enumerate(TARGETS):
            misses = [abs(r["predictions"][k] - r[target]) for r in answered]
            assert sum(misses) / len(misses) < 6
        save_model(spark, str(tmp_path), name, "all", model)
        again = load_models(spark, str(tmp_path))[name]["all"]
        assert again.transform(split).select("row_no", "predictions").exceptAll(
            model.transform(split).select("row_no", "predictions")).isEmpty()


def test_adaboost_of_several_targets_is_that_of_each(spark):
    split = rows(spark)
    names = [f"s{i}" for i in range(9)]
    task = learners.Task(split, TARGETS[0], tuple(names))
    setting = Ada(4, 0.5, 2)
    both = learners.AdaModel.fit(task.packed(targets=TARGETS), setting)
    answers = {r["row_no"]: r["predictions"] for r in both.transform(split).collect()}
    for k, target in enumerate(TARGETS):
        for cells in (10**9, 1):
            one = learners.AdaModel.fit(learners.replace(task, target=target).packed(), setting, cells)
            for r in one.transform(split).collect():
                assert abs(r["predictions"][0] - answers[r["row_no"]][k]) < 1e-6
