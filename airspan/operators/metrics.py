"""Regression metrics and model ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def regression_metrics(scored: DataFrame) -> DataFrame:
    """(target, model, y, pred) rows -> mae, rmse, r2 per target and model, in one aggregate.

    The spread of ``y`` comes from the built-in population variance, which merges partial
    results without cancellation. R2 of a constant truth is 1 for a perfect model, else 0.
    """
    miss = F.col("y") - F.col("pred")
    sums = scored.groupBy("target", "model").agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.avg(miss * miss).alias("mse"),
        F.var_pop("y").alias("spread"),
    )
    r2 = (
        F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread"))
        .when(F.col("mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select("target", "model", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def multi_output_metrics(per_target: DataFrame) -> DataFrame:
    """Plain mean of R2 over the targets, and the root of the mean squared error over them."""
    return per_target.groupBy("model").agg(
        F.avg("r2").alias("r2"), F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"))


def rank_models(metrics: DataFrame, by: str = "r2") -> DataFrame:
    """Place of each model per target: highest R2, or lowest RMSE, first.

    A target has one row per model, so the window holds as many rows as there are models.
    """
    best = F.desc_nulls_last("r2") if by == "r2" else F.asc_nulls_last(by)
    return metrics.withColumn(
        "place", F.row_number().over(W.partitionBy("target").orderBy(best, F.asc("model"))))


def metrics_of(metrics: DataFrame, target: str) -> DataFrame:
    """Metrics of one target, best model first."""
    return metrics.filter(F.col("target") == target).orderBy(F.desc_nulls_last("r2"), F.asc("model"))


def best_models(metrics: DataFrame, by: str = "r2") -> DataFrame:
    return rank_models(metrics, by).filter("place = 1").drop("place")


def one_row_per_model(metrics: DataFrame) -> DataFrame:
    """Of repeated runs of a model the last in descending R2 stays, so the lowest one."""
    row = F.struct(*[c for c in metrics.columns if c not in ("target", "model")])
    picked = metrics.groupBy("target", "model").agg(F.min_by(row, F.col("r2")).alias("_row"))
    return picked.select("target", "model", "_row.*")
