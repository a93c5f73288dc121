"""AdaBoost.R2 (Drucker, 1997) with linear loss, on the cells of ``forest``.

Rows stay binned, and stations are one named feature instead of a flag each, so a row is as wide as it has features. While the
training rows fit a task, all rounds run in one; beyond that, each level of a round is one aggregate of cells, one more gives the
misses, and each row's weight stands in its block.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from airspan.models.boosting import TASK_CELLS, _by_levels, by_output
from airspan.models.forest import Bins, Columns, Growth, Packed, Plan, TableGrowth, Tree, _joined, _unpacked, fit_bins, pack
from airspan.session import durable, let_go

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rounds between two saves of the weights.
ROUNDS_PER_SAVE = 10


@dataclass(frozen=True)
class Ada:
    rounds: int
    rate: float
    depth: int
    seed: int = 42

    def plan(self, round_: int) -> Plan:
        return Plan(Growth(depth=self.depth, seed=self.seed + round_), ((0,),))


class Votes:
    """The trees so far and what each one's vote counts."""

    def __init__(self, setting: Ada):
        self.setting, self.trees, self.votes = setting, [], []

    def count(self, tree: Tree, largest: float, weighted: float, total: float) -> float | None:
        """Takes a tree by its largest miss, its weighted misses and the total weight: gives beta, or None at the end."""
        if largest == 0:
            self.trees, self.votes = [*self.trees, tree], [*self.votes, 1.0]
            return None
        loss = weighted / largest / total
        if loss >= 0.5:
            if not self.trees:
                self.trees, self.votes = [tree], [1.0]
            return None
        beta = loss / (1 - loss)
        self.trees.append(tree)
        self.votes.append(self.setting.rate * log(1 / beta))
        return beta


def _grown(weights: np.ndarray, miss: np.ndarray, largest: float, beta: float, rate: float) -> np.ndarray:
    # Divided by the smallest possible factor, so that no weight ever vanishes.
    return weights * beta ** ((1 - miss / largest) * rate) / beta ** rate


def weighted_medians(predictions: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """The smallest prediction of each row at which half of the votes is reached."""
    order = np.argsort(predictions, axis=1, kind="stable")
    reached = np.cumsum(votes[order], axis=1) >= votes.sum() / 2
    # Sums in another order may stay a bit below the half of all.
    reached[:, -1] = True
    return np.take_along_axis(predictions, np.take_along_axis(order, reached.argmax(axis=1)[:, None], 1), 1)[:, 0]


def ada(columns: Columns, y: np.ndarray, setting: Ada, bins: Bins, unit: float) -> Votes:
    """All rounds over rows that are held in memory."""
    units, made, weights, outputs = np.array([unit]), Votes(setting), np.ones(len(y)), [y.astype(np.float64)]
    for round_ in range(setting.rounds):
        plan = setting.plan(round_)
        tree = TableGrowth(columns, plan.growth, bins, units, 0).grow(None, outputs, weights, int(plan.key(0)[0])).tree()
        miss = np.empty(len(y))
        for leaf, rows in columns.leaves(tree):
            rows = slice(None) if rows is None else rows
            miss[rows] = np.abs(outputs[0][rows] * unit - tree.value[leaf, 0])
        largest = float(miss.max())
        beta = made.count(tree, largest, float((weights * miss).sum()), float(weights.sum()))
        if beta is None:
            break
        weights = _grown(weights, miss, largest, beta, setting.rate)
    return made


def _in_tasks(packed: Packed, setting: Ada) -> list[tuple[list[Tree], list[float]]]:
    """A task for each output, with all rows and all rounds."""
    bins, units = packed.bins, packed.units

    def run(i: int, columns: Columns, y: np.ndarray, key: np.ndarray) -> dict:
        order = np.argsort(key, kind="stable")  # so that sums do not depend on how blocks arrive
        made = ada(Columns([c[order] for c in columns.columns], columns.first_named), y[order], setting, bins, float(units[i]))
        return _written(made.trees, made.votes)

    return [_read(made) for made in by_output(packed, run)]


def _in_rounds(packed: Packed, setting: Ada) -> tuple[list[Tree], list[float]]:
    """The rounds of one output over rows that no task holds."""
    bins, units, first_named, rate = packed.bins, packed.units, len(packed.bins.ordered), setting.rate
    spark, made = packed.blocks.sparkSession, Votes(setting)
    blocks = packed.blocks.select("x", "y", "key", F.lit(None).cast("binary").alias("w"))

    def misses(blocks: DataFrame, tree: Tree):
        sent = spark.sparkContext.broadcast(tree)

        def run(batches):
            for x, y, _, w in _joined(batches, bins, 1, True):
                miss = np.abs(y[:, 0] * units[0] - sent.value.value[sent.value.leaf_of(x, first_named), 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(v)]) for v in (miss.max(initial=0), (w * miss).sum(), w.sum())], ["largest", "missed", "total"])
        return blocks.mapInArrow(run, "largest double, missed double, total double").agg(
            F.max("largest"), F.sum("missed"), F.sum("total")).first()

    def weighed(blocks: DataFrame, tree: Tree, largest: float, beta: float) -> DataFrame:
        sent = spark.sparkContext.broadcast(tree)

        def run(batches):
            for batch in batches:
                for (x, y, key), w in zip(_unpacked([batch], bins, 1), batch.column("w").to_pylist()):
                    miss = np.abs(y[:, 0] * units[0] - sent.value.value[sent.value.leaf_of(x, first_named), 0])
                    w = _grown(np.ones(len(x)) if w is None else np.frombuffer(w, np.float64), miss, largest, beta, rate)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.tobytes()], pa.binary()) for part in (x, y, key, w)], ["x", "y", "key", "w"])
        return blocks.mapInArrow(run, "x binary, y binary, key binary, w binary")

    for round_ in range(setting.rounds):
        here = Packed(blocks, bins, packed.outputs, units, packed.n_rows, True)
        tree = _by_levels(here, setting.plan(round_))[0].tree()
        largest, missed, total = misses(blocks, tree)
        beta = made.count(tree, largest, missed, total)
        if beta is None:
            break
        if round_ + 1 < setting.rounds:
            blocks = weighed(blocks, tree, largest, beta)
            if (round_ + 1) % ROUNDS_PER_SAVE == 0:
                blocks = durable(blocks)
                let_go(spark)
    return made.trees, made.votes


def _written(trees: Sequence[Tree], votes: Sequence[float]) -> dict:
    return {"votes": list(votes), "trees": [[t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.value[:, 0].tolist()] for t in trees]}


def _read(about: dict) -> tuple[list[Tree], list[float]]:
    return [Tree(np.array(f, np.int16), np.array(c, np.int32), np.array(left, np.int32), np.array(v, np.float64)[:, None])
            for f, c, left, v in about["trees"]], about["votes"]


class AdaModel:
    """Trees that vote, for each of several outputs; their number and depth are bounded by the setting, so every task holds them."""

    def __init__(self, made: Sequence[tuple[list[Tree], list[float]]], bins: Bins, outputs: Sequence[str]):
        self.made, self.bins, self.outputs = list(made), bins, list(outputs)

    @classmethod
    def fit(cls, packed: Packed, setting: Ada, node_cells: int = TASK_CELLS) -> "AdaModel":
        if not packed.n_rows:
            raise ValueError("no rows to train on")
        if packed.n_rows <= packed.rows_of(node_cells):
            return cls(_in_tasks(packed, setting), packed.bins, packed.outputs)
        return cls([_in_rounds(packed.one(i), setting) for i in range(len(packed.outputs))], packed.bins, packed.outputs)

    @classmethod
    def fit_rows(cls, rows: DataFrame, ordered: Sequence[str], output: str, key: Sequence[str], setting: Ada,
                 named: dict[str, Sequence[str]] | None = None, node_cells: int = TASK_CELLS) -> "AdaModel":
        return cls.fit(pack(rows, fit_bins(rows, ordered, named), [output], key), setting, node_cells)

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """Adds an array with a prediction per output."""
        sent, bins = df.sparkSession.sparkContext.broadcast(self.made), self.bins

        def run(batches):
            for batch in batches:
                x = bins.place(batch)
                answers = []
                for trees, votes in sent.value:
                    asked = np.stack([t.value[t.leaf_of(x, len(bins.ordered)), 0] for t in trees], axis=1)
                    answers.append(weighted_medians(asked, np.array(votes)))
                answers = np.stack(answers, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, answers.size + 1, answers.shape[1], dtype=np.int32), answers.reshape(-1))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, output])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))]))

    def save(self, path: str) -> None:
        about = json.dumps({"made": [_written(*made) for made in self.made], "bins": asdict(self.bins), "outputs": self.outputs})
        SparkSession.getActiveSession().createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AdaModel":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        # Models that were saved before have one output.
        made = about["made"] if isinstance(about["made"], list) else [about["made"]]
        return cls([_read(m) for m in made], Bins(**about["bins"]), about["outputs"])
