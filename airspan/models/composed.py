"""Models made of others: stacks, and the scalar answer of a model of one target."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.models.adaboost import AdaModel
from airspan.models.boosting import BoostedModel, MeanModel
from airspan.models.forest import ForestModel

Member = ForestModel | BoostedModel | MeanModel | AdaModel


class StackModel:
    """Members whose predictions of an output its blender takes: a forest over them, or an intercept and a factor for each."""

    def __init__(self, members: Sequence[Member], blenders: Sequence[ForestModel | list[float]]):
        self.members, self.blenders = list(members), list(blenders)
        self.bins, self.outputs = members[0].bins, members[0].outputs

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """Adds an array with a prediction per output."""
        rows, answers, added = members_asked(self.members, df), [], []
        for k, blender in enumerate(self.blenders):
            names = member_columns(len(self.members), k)
            added += names
            if isinstance(blender, list):
                first, *factors = blender
                answers.append(sum((F.lit(f) * F.col(n) for f, n in zip(factors, names)), F.lit(first)))
            else:
                rows = blender.transform(rows, f"_b{k}")
                added.append(f"_b{k}")
                answers.append(F.col(f"_b{k}")[0])
        return rows.withColumn(output, F.array(*answers)).drop(*added)

    def save(self, path: str) -> None:
        for i, member in enumerate(self.members):
            member.save(f"{path}/member={i}")
        for k, blender in enumerate(self.blenders):
            if isinstance(blender, ForestModel):
                blender.save(f"{path}/blender={k}")
        _note(path, {"kinds": [_kind(m) for m in self.members], "blenders": [b if isinstance(b, list) else None for b in self.blenders]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "StackModel":
        about = _noted(spark, path)
        members = [KINDS[kind].load(spark, f"{path}/member={i}") for i, kind in enumerate(about["kinds"])]
        if "blender" in about:  # saved when stacks had one output
            return cls(members, [about["blender"] or ForestModel.load(spark, f"{path}/blender")])
        return cls(members, [b or ForestModel.load(spark, f"{path}/blender={k}") for k, b in enumerate(about["blenders"])])


def member_columns(members: int, output: int) -> list[str]:
    """The columns with what each member predicts for an output."""
    return [f"_s{i}" if output == 0 else f"_s{i}_{output}" for i in range(members)]


def members_asked(members: Sequence[Member], df: DataFrame) -> DataFrame:
    """Adds the predictions of each member, as ``member_columns`` names them."""
    for i, member in enumerate(members):
        df = member.transform(df, "_asked").withColumns({
            member_columns(len(members), k)[i]: F.col("_asked")[k] for k in range(len(member.outputs))}).drop("_asked")
    return df


class OneTarget:
    """The prediction of a model of one target, as a column of numbers."""

    def __init__(self, model: Member | StackModel, column: str):
        self.model, self.column, self.outputs, self.bins = model, column, model.outputs, model.bins

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df, "_all").withColumn(self.column, F.col("_all")[0]).drop("_all")

    def save(self, path: str) -> None:
        self.model.save(f"{path}/model")
        _note(path, {"kind": _kind(self.model), "column": self.column})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "OneTarget":
        about = _noted(spark, path)
        return cls(KINDS[about["kind"]].load(spark, f"{path}/model"), about["column"])


KINDS = {"forest": ForestModel, "boosted": BoostedModel, "mean": MeanModel, "ada": AdaModel, "stack": StackModel}


def _kind(model: object) -> str:
    return next(k for k, of in KINDS.items() if isinstance(model, of))


def _note(path: str, about: dict) -> None:
    SparkSession.getActiveSession().createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/kinds")


def _noted(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/kinds").first()["value"])
