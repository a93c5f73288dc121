"""Hard negatives against all pairs, and the product of matrices against numpy's."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspan.llm import negatives
from airspan.llm.negatives import hard_negatives, strassen

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchor):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
            and all(x is not None and math.isfinite(x) for x in r[2])]
    rows = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows]
    rows = list({r[0]: r for r in sorted(rows, reverse=True)}.values())
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a, lab, v in rows:
        if not anchor(a):
            continue
        scores = sorted((-dot(v, w), i, other) for i, other, w in rows if i != a)
        for p, i, _ in [s for s in scores if s[2] == lab][:5]:
            kept = [s for s in scores if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, i, k, s[1], -p, -s[0]) for k, s in enumerate(kept, 1)]
    return sorted(out)


def found(spark, rows, anchor, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("group", F.lit(1)).withColumn("q", F.lit("x")).repartition(5)
    got = hard_negatives(df, anchor, **more)
    return sorted(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 100), (64, 65, 66), (130, 131, 257), (256, 64, 1000)])
def test_product(shape):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-2**20, 2**20, shape[:2]), rng.integers(-2**20, 2**20, shape[1:])
    assert (strassen(x, y) == x @ y).all()


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, size in {"ANCHORS": 7, "CANDIDATES": 30, "TILE_ANCHORS": 5, "TILE_CANDIDATES": 11, "LEAF": 2}.items():
            monkeypatch.setattr(negatives, name, size)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        # One label holds a third of all rows; few different vectors, so that many scores tie.
        label = 0 if i % 3 == 0 else int(rng.integers(1, 6))
        rows.append((i, label, [float(x) for x in rng.integers(-3, 9, 6) / 8]))
    rows += [(1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [float("nan")] + [0.0] * 5), (1030, 1, [None] + [1.0] * 5),
             (1040, 2, [float("inf")] * 6), (None, 1, [1.0] * 6), (1050, 7, [1.0] * 6), (20, 3, [0.5] * 6), (20, 3, [0.5] * 6),
             (1060, 2, []), (1070, 2, [1.0]), (1080, 2, [0.001] * 6), (1090, 3, [-1.0] * 6)]
    anchor = lambda i: i % 10 == 0
    want = brute(rows, anchor)
    assert want and found(spark, rows, F.col("vec_id") % 10 == 0) == want


def test_nothing_to_find(spark):
    assert found(spark, [], F.lit(True)) == []
    assert found(spark, [(1, 1, [1.0])], F.lit(True)) == []
    assert found(spark, [(1, 1, [1.0]), (2, 2, [1.0])], F.lit(True)) == []


def test_too_large(spark):
    with pytest.raises(ArithmeticError):
        found(spark, [(1, 1, [1e30]), (2, 1, [1e30])], F.lit(True))
