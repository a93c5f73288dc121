"""Saved models, one folder per algorithm and target."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, functions as F

from airspan.models.adaboost import AdaModel
from airspan.models.boosting import BoostedModel, MeanModel
from airspan.models.composed import OneTarget, StackModel
from airspan.models.forest import ForestModel
from airspan.models.knn import NearestModel
from airspan.sinks.writers import stored_or_none

ALL_TARGETS = "all"
# Models with files of their own.
KINDS = {"nearest": NearestModel, "forest": ForestModel, "boosted": BoostedModel, "mean": MeanModel, "one": OneTarget, "ada": AdaModel,
         "stack": StackModel}


def _folder(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", text).strip("_")


def save_model(
    spark: SparkSession, root: str, algorithm: str, target: str,
    model: PipelineModel | NearestModel | ForestModel | BoostedModel | MeanModel | OneTarget | AdaModel | StackModel,
) -> str:
    """Saves the model and notes it in the index, where the last note of a name counts."""
    path = f"{root}/algorithm={_folder(algorithm)}/target={_folder(target)}"
    kind = next((k for k, of in KINDS.items() if isinstance(model, of)), "pipeline")
    model.write().overwrite().save(path) if kind == "pipeline" else model.save(path)
    spark.createDataFrame(
        [(algorithm, target, path, kind)],
        "algorithm string, target string, path string, kind string",
    ).withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/index")
    return path


def load_models(spark: SparkSession, root: str) -> dict[str, dict[str, object]]:
    """algorithm -> target -> model. One that cannot be read is left out."""
    index = stored_or_none(spark, f"{root}/index")
    if index is None:
        return {}
    latest = index.groupBy("algorithm", "target").agg(
        F.max_by(F.struct("path", "kind"), "saved_at").alias("at")).select("algorithm", "target", "at.*")
    models: dict = {}
    for row in latest.orderBy("algorithm", "target").collect():  # one small row per saved model
        try:
            loaded = (KINDS[row["kind"]].load(spark, row["path"]) if row["kind"] in KINDS
                      else PipelineModel.load(row["path"]))
        except Exception:
            continue
        models.setdefault(row["algorithm"], {})[row["target"]] = loaded
    return models
