"""Nearest neighbours among many points, which meet in blocks."""

import random

import numpy as np
import pytest

from airspan.models import knn
from airspan.models.knn import NearestModel, _times_drawn


@pytest.mark.parametrize("block_points", [5_000, 100])
def test_no_pairs_are_joined_where_neighbours_are_near(spark, monkeypatch, block_points):
    draw = random.Random(4)
    rows = [(i, draw.randrange(12), draw.randrange(7), draw.randrange(-30, 90), float(draw.randrange(100)), draw.random()) for i in range(6000)]
    train = spark.createDataFrame(rows, "k int, a int, b int, c int, y double, z double").repartition(3)
    monkeypatch.setattr(knn, "BLOCK_POINTS", block_points, raising=False)
    model = NearestModel.fit(train, ["a", "b", "c"], ["y", "z"], ["k"], bags=3)
    monkeypatch.setattr(NearestModel, "_within", lambda *_: pytest.fail("pairs were joined"))
    asked = sorted({(draw.randrange(-1, 13), draw.randrange(7), draw.randrange(-31, 91)) for _ in range(60)})
    got = {(r["a"], r["b"], r["c"]): r["predictions"] for r in model.transform(
        spark.createDataFrame(asked, "a int, b int, c int")).collect()}
    drawn = train.select("k", *[_times_drawn(42, b, ["k"]).alias(f"w{b}") for b in range(3)]).collect()
    weights = {r["k"]: [r[f"w{b}"] for b in range(3)] for r in drawn}
    for q in asked:
        want = np.zeros(2)
        for bag in range(3):
            points = {}
            for key, *at, y, z in rows:
                if weights[key][bag]:
                    n, s = points.get(tuple(at), (0.0, np.zeros(2)))
                    points[tuple(at)] = (n + weights[key][bag], s + weights[key][bag] * np.array([y, z]))
            left = 5.0
            for at in sorted(points, key=lambda p: (sum((x - v) ** 2 for x, v in zip(p, q)), p)):
                n, s = points[at]
                take = min(n, left)
                want, left = want + take * s / n / 15, left - take
                if left <= 0:
                    break
        assert np.allclose(got[q], want, atol=1e-9)
