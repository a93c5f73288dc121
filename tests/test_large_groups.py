"""The plans for groups of any size give the same rows as the plain ones."""

import random

from pyspark.sql import functions as F

from airspan.operators.lags import add_lags
from airspan.operators.median import bracketed_median, group_median, ranked_median
from airspan.operators.order import page, with_row_number
from airspan.plans.features import fill_medians


def skewed(spark, n=3000):
    """Half of all rows in one station."""
    draw = random.Random(5)
    rows, used = [], set()
    for i in range(n):
        station = 0 if draw.random() < 0.5 else draw.randrange(1, 40)
        t = draw.randrange(10**6)
        if (station, t) not in used:
            used.add((station, t))
            rows.append((station, t, draw.choice([None, round(draw.gauss(20, 9), 1)]),
                         None if station == 3 else draw.random(), None))
    return spark.createDataFrame(rows, "s int, t int, a double, b double, c double")


def same(left, right):
    return sorted(map(repr, left.collect())) == sorted(map(repr, right.select(left.columns).collect()))


def test_ranked_median(spark):
    df = skewed(spark)
    assert same(group_median(df, ["s"], ["a", "b", "c"]), group_median(df, ["s"], ["a", "b", "c"], 0))
    assert same(group_median(df, [], ["a", "b", "c"]), group_median(df, [], ["a", "b", "c"], 0))


def test_bracketed_median_in_rounds(spark):
    """Groups of very different sizes, many equal values, NaN, and brackets that miss the middle."""
    rows = spark.range(60000).select(
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 5).alias("s"),
        F.rand(3).alias("a"), F.floor(F.rand(4) * 3).alias("b"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.rand(5)).alias("c"))
    df = spark.createDataFrame(rows.collect(), rows.schema)
    plain = group_median(df, ["s"], ["a", "b", "c"])
    for width in (0.01, 0.2, 0.0):
        assert same(plain, bracketed_median(df, ["s"], ["a", "b", "c"], 1000, width))
    assert same(group_median(df, [], ["a", "c"]), bracketed_median(df, [], ["a", "c"], 1000))
    assert same(plain, ranked_median(df, ["s"], ["a", "b", "c"]))


def test_median_with_null_key(spark):
    df = skewed(spark).withColumn("s", F.when(F.col("s") > 5, F.col("s")))
    assert same(group_median(df, ["s"], ["a"]), group_median(df, ["s"], ["a"], 0))


def test_lags_in_blocks(spark):
    df = skewed(spark).select("s", "t", "a")
    plain = add_lags(df, "s", ["t"], ["a"])
    for rows in (3, 7, 100):
        assert same(plain, add_lags(df, "s", ["t"], ["a"], group_rows=0, block_rows=rows))


def test_row_number_is_the_sort_position(spark):
    df = skewed(spark).select("s", "t")
    got = [(r["s"], r["t"]) for r in with_row_number(df, ["s", "t"]).orderBy("row_no").collect()]
    assert got == sorted(got)
    assert [r[0] for r in with_row_number(df, ["s", "t"]).select("row_no").orderBy("row_no").collect()] == list(range(len(got)))


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    df = skewed(spark).select("s", "t")
    order = [F.desc("t"), F.asc("s")]
    shallow = page(df, order, 50, 700).collect()
    monkeypatch.setattr("airspan.operators.order.SHALLOW_OFFSET", 10)
    assert page(df, order, 50, 700).collect() == shallow


def test_fill_medians_global_comes_after_station(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (1, None), (1, 5.0), (2, None), (2, None), (3, 9.0)], "s int, a double")
    for limit in (10**6, 0):
        got = sorted((r["s"], r["a"]) for r in fill_medians(df, "s", ["a"], limit).collect())
        # station 1 -> 3.0; then the median of 1, 3, 5, 9 is 4.0
        assert got == [(1, 1.0), (1, 3.0), (1, 5.0), (2, 4.0), (2, 4.0), (3, 9.0)]
