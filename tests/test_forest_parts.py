"""Predictions of more trees than a task or the driver should hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspan.models import forest
from airspan.models.forest import ForestModel, Growth


@pytest.mark.parametrize("together", [True, False])
def test_trees_in_parts_answer_as_all_at_once_and_no_part_is_sent_to_the_driver(spark, monkeypatch, together):
    rows = spark.range(400).select(
        "id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(30)).cast("double").alias(c) for i, c in enumerate("abuv")])
    model = ForestModel.fit(rows, ["a", "b"], ["u", "v"], ["id"], Growth(trees=7, bootstrap=True), together=together, node_rows=100)
    known = {r["id"]: r["predictions"] for r in model.transform(rows).collect()}
    monkeypatch.setattr(forest, "TREE_BYTES", 20_000)
    monkeypatch.setattr(forest, "ROUND_BYTES", 45_000, raising=False)
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)
    found = model.transform(rows.repartition(3)).collect()
    assert len(found) == 400 and set(found[0].asDict()) == {*rows.columns, "predictions"}
    assert np.allclose([r["predictions"] for r in found], [known[r["id"]] for r in found], rtol=1e-12)


def test_trees_dealt_a_few_at_a_time_are_the_same(spark, monkeypatch):
    rows = spark.range(300).select(
        "id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(30)).cast("double").alias(c) for i, c in enumerate("abuv")])
    growth, dealt, answers = Growth(trees=5, bootstrap=True), [], []
    plain = forest._tasks
    monkeypatch.setattr(forest, "_tasks", lambda packed, trees, *more: dealt.append(trees) or plain(packed, trees, *more))
    for most in (1 << 31, 300 * 13 * 2):
        monkeypatch.setattr(forest, "DEAL_BYTES", most, raising=False)
        model = ForestModel.fit(rows, ["a", "b"], ["u", "v"], ["id"], growth, node_rows=100)
        answers.append({r["id"]: r["predictions"] for r in model.transform(rows).collect()})
    assert answers[0] == answers[1]
    assert dealt == [5, 2, 2, 1]
