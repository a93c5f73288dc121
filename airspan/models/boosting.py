"""Gradient boosting on the cells of ``forest``: a model for each output, all outputs side by side.

Rows stay binned and predictions are whole numbers of the outputs' scale, so residuals and all sums of them are exact,
and the trees are the same however rows are partitioned. While the training rows fit a task, the rounds of
an output run in one task and the outputs in as many; beyond that, each level of each round is one
aggregate of cells for all outputs, and the residuals are saved every few rounds.

With squared errors the second derivative of every row is one, so a penalty on the leaves is added to their weight.
Trees can be bounded by leaves, of which the best split is made next, by drawn rows and features, and by rounds
without gain on rows that are held out.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from airspan.models.forest import (
    Bins, Columns, Growth, Grown, Packed, Plan, TableGrowth, Top, Tree, _level, _unpacked, child_keys, fit_bins, pack, share_of,
)
from airspan.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows times features that a task boosts on its own, which takes some four bytes each.
TASK_CELLS = 160_000_000
# Rounds between two saves of the residuals.
ROUNDS_PER_SAVE = 10


@dataclass(frozen=True)
class Boosting:
    """``penalty``, ``columns``, ``rows`` and ``leaf_rows`` are as in ``Growth``. With ``patience``, a share ``held`` of the
    rows is not trained on, and the rounds end when their error is not below any of the last so many by ``tolerance``."""

    rounds: int = 100
    rate: float = 0.1
    depth: int | None = 3
    leaf_rows: int = 1
    leaves: int | None = None
    penalty: float = 0.0
    columns: float = 1.0
    rows: float = 1.0
    patience: int | None = None
    held: float = 0.1
    tolerance: float = 1e-3
    seed: int = 42

    def growth(self, round_: int) -> Growth:
        return Growth(depth=self.depth, leaf_rows=self.leaf_rows, penalty=self.penalty, columns=self.columns, rows=self.rows,
                      seed=self.seed * 1000003 + round_, held=self.held if self.patience else 0.0, held_seed=self.seed)

    def steps(self, tree: Tree, unit: float) -> np.ndarray:
        """What each leaf adds to a prediction, as whole numbers of the output's scale."""
        return np.rint(tree.value[:, 0] / unit * self.rate).astype(np.int64)


class Patience:
    """Whether the error on held-out rows still falls: below one of the last few rounds' by the tolerance."""

    def __init__(self, setting: Boosting):
        self.setting, self.last = setting, [float("inf")] * (setting.patience or 0)

    def ends(self, round_: int, error: float) -> bool:
        if not self.last or all(error + self.setting.tolerance >= old for old in self.last):
            return bool(self.last)
        self.last[round_ % len(self.last)] = error
        return False


@dataclass
class Booster:
    """The rounds of one output: trees whose leaves hold whole numbers, added to the mean."""

    start: int
    trees: list[Tree]

    def predict(self, x: np.ndarray, first_named: int) -> np.ndarray:
        total = np.full(len(x), self.start, np.int64)
        for tree in self.trees:
            total += tree.value[tree.leaf_of(x, first_named)]
        return total


def boost(columns: Columns, y: np.ndarray, keys: np.ndarray, setting: Boosting, bins: Bins, unit: float) -> Booster:
    """All rounds of one output over rows that are held in memory."""
    units = np.array([unit])
    aside = share_of(keys, setting.seed, 7) < setting.held if setting.patience else np.zeros(len(y), bool)
    start = int(np.rint(y[~aside].sum() / max(1, (~aside).sum())))
    out, rest, patience = Booster(start, []), (y - start).astype(np.float64), Patience(setting)
    in_, counts = None if setting.rows < 1 else np.flatnonzero(~aside) if aside.any() else None, None
    for round_ in range(setting.rounds):
        growth = setting.growth(round_)
        if setting.rows < 1:
            in_ = np.flatnonzero(growth.weights(keys, 0) > 0)
        elif counts is None:  # the same rows in all rounds
            counts = {f: n[:columns.sizes[f]] for own in columns.tables(range(len(columns.columns))) for f, n in zip(own, columns.counted(in_, own))}
        if in_ is not None and not len(in_):
            break
        grown = TableGrowth(columns, growth, bins, units, 0).grow(in_, [rest], None, int(Plan(growth, ((0,),)).key(0)[0]), leaves=setting.leaves, counts=counts)
        tree = grown.tree()
        tree.value = setting.steps(tree, unit)
        for leaf, rows in columns.leaves(tree):
            rest[slice(None) if rows is None else rows] -= tree.value[leaf]
        out.trees.append(tree)
        if aside.any() and patience.ends(round_, float(((rest[aside] * unit) ** 2).mean())):
            break
    return out


def by_output(packed: Packed, work: Callable[[int, Columns, np.ndarray, np.ndarray], dict]) -> list[dict]:
    """A task for each output, with all rows: what ``work`` makes of the output's number and the rows' bins, output and keys."""
    n_out, bins = len(packed.outputs), packed.bins

    def deal(batches):
        for x, y, key in _unpacked(batches, bins, n_out):
            yield pa.RecordBatch.from_arrays([
                pa.array(range(n_out), pa.int32()), pa.array([bins.by_feature(x)] * n_out, pa.binary()),
                pa.array([np.ascontiguousarray(y[:, i]).tobytes() for i in range(n_out)], pa.binary()),
                pa.array([key.tobytes()] * n_out, pa.binary())], ["output", "x", "y", "key"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, *parts in zip(*(batch.column(c).to_pylist() for c in ("output", "x", "y", "key"))):
                held.setdefault(i, []).append(parts)
        for i in list(held):
            columns, y, key = bins.held(held.pop(i))
            made = work(i, columns, y.astype(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([json.dumps(made)])], ["output", "made"])

    # A partition for each output, so that none waits for another.
    dealt = packed.blocks.mapInArrow(deal, "output int, x binary, y binary, key binary")
    rows = dealt.repartitionByRange(n_out, "output").mapInArrow(run, "output int, made string").collect()
    made = {r["output"]: json.loads(r["made"]) for r in rows}
    return [made[i] for i in range(n_out)]


def _in_tasks(packed: Packed, setting: Boosting) -> list[Booster]:
    bins, units = packed.bins, packed.units
    return [_read(made) for made in by_output(packed, lambda i, x, y, key: _written(boost(x, y, key, setting, bins, float(units[i]))))]


def _by_levels(packed: Packed, plan: Plan) -> list[Grown]:
    """A tree for each output, one aggregate of cells a level."""
    blank = lambda: {"feature": [-1], "cut": [0], "left": [-1], "means": [[0.0]], "gain": [0.0]}
    trees = {t: blank() for t in plan.trees()}
    keys = {(t, 0): int(plan.key(t)[0]) for t in plan.trees()}
    open_, depth = set(keys), 0
    while open_:
        asked = {}
        for t, tree in trees.items():
            ends = [i for i, left in enumerate(tree["left"]) if left < 0]
            code = {node: -1 - i for i, node in enumerate(ends)}
            if any((t, node) in open_ for node in ends):
                asked[t] = Top(tree["feature"], tree["cut"], [code.get(i, left) for i, left in enumerate(tree["left"])],
                               [(node if (t, node) in open_ else None, []) for node in ends])
        ends = plan.growth.depth is not None and depth >= plan.growth.depth
        rows, open_ = _level(packed, plan, asked, {k: keys[k] for k in open_}, ends), set()
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
            t, node, tree = r["tree"], r["node"], trees[r["tree"]]
            tree["means"][node], tree["gain"][node] = r["mean"], r["gain"]
            if r["feature"] < 0 or ends:
                continue
            tree["feature"][node], tree["cut"][node], tree["left"][node] = r["feature"], r["cut"], len(tree["left"])
            for side in (0, 1):
                child = len(tree["left"])
                for name, value in blank().items():
                    tree[name] += value
                keys[(t, child)] = int(child_keys(np.array([keys[(t, node)]], np.uint64), side)[0])
                open_.add((t, child))
        depth += 1
    return [Grown(np.array(tree["feature"], np.int16), np.array(tree["cut"], np.int32), np.array(tree["left"], np.int32),
                  np.array(tree["means"]), np.array(tree["gain"])) for _, tree in sorted(trees.items())]


def _in_rounds(packed: Packed, setting: Boosting) -> list[Booster]:
    """The rounds of all outputs over rows that no task holds: residuals stand in the place of outputs."""
    bins, n_out, first_named, units = packed.bins, len(packed.outputs), len(packed.bins.ordered), packed.units
    spark = packed.blocks.sparkSession

    def moved(blocks: DataFrame, by: list[Tree | int | None]) -> DataFrame:
        """The residuals less what the trees, or a number, add to the predictions."""
        sent = spark.sparkContext.broadcast(by)

        def run(batches):
            for x, y, key in _unpacked(batches, bins, n_out):
                y = y.astype(np.int64)
                for i, tree in enumerate(sent.value):
                    if tree is not None:
                        y[:, i] -= tree if isinstance(tree, int) else tree.value[tree.leaf_of(x, first_named)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(y)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([key.tobytes()], pa.binary())], ["n", "x", "y", "key"])
        return blocks.mapInArrow(run, "n int, x binary, y binary, key binary")

    def sums(blocks: DataFrame, aside: bool) -> list[tuple[int, int, float]]:
        """(rows, sum, sum of squares) of each output over the rows held out, or all others."""
        def run(batches):
            for x, y, key in _unpacked(batches, bins, n_out):
                held = share_of(key, setting.seed, 7) < setting.held if setting.patience else np.zeros(len(y), bool)
                part = y[held == aside].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(n_out), pa.int32()), pa.array([len(part)] * n_out, pa.int64()), pa.array(part.sum(axis=0)),
                    pa.array(((part * units) ** 2).sum(axis=0))], ["output", "n", "s", "q"])
        found = blocks.mapInArrow(run, "output int, n long, s long, q double").groupBy("output").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
        return [(r["n"], r["s"], r["q"]) for r in sorted(found, key=lambda r: r["output"])]

    start = [int(np.rint(s / max(1, n))) for n, s, _ in sums(packed.blocks, False)]
    blocks = durable(moved(packed.blocks, start))
    made, patience, open_ = [Booster(s, []) for s in start], [Patience(setting) for _ in start], set(range(n_out))
    for round_ in range(setting.rounds):
        plan = Plan(setting.growth(round_), tuple((i,) for i in range(n_out)))
        trees: list[Tree | None] = []
        for i, grown in enumerate(_by_levels(Packed(blocks, packed.bins, packed.outputs, units, packed.n_rows), plan)):
            tree = grown.tree(setting.leaves)
            tree.value = setting.steps(tree, float(units[i]))
            trees.append(tree if i in open_ else None)
            if i in open_:
                made[i].trees.append(tree)
        blocks = moved(blocks, trees)
        if (round_ + 1) % ROUNDS_PER_SAVE == 0:
            blocks = durable(blocks)
        if setting.patience:
            for i, (n, _, q) in enumerate(sums(blocks, True)):
                if i in open_ and n and patience[i].ends(round_, q / n):
                    open_.discard(i)
            if not open_:
                break
    return made


def _written(booster: Booster) -> dict:
    return {"start": booster.start, "trees": [[t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.value.tolist()] for t in booster.trees]}


def _read(about: dict) -> Booster:
    return Booster(about["start"], [Tree(np.array(f, np.int16), np.array(c, np.int32), np.array(left, np.int32), np.array(v, np.int64))
                                    for f, c, left, v in about["trees"]])


class BoostedModel:
    """Boosted trees for each of several outputs. They are bounded by their settings, so every task holds them."""

    def __init__(self, boosters: list[Booster], units: Sequence[float], bins: Bins, outputs: Sequence[str]):
        self.boosters, self.units, self.bins, self.outputs = boosters, [float(u) for u in units], bins, list(outputs)

    @classmethod
    def fit(cls, rows: DataFrame, ordered: Sequence[str], outputs: Sequence[str], key: Sequence[str], setting: Boosting,
            named: dict[str, Sequence[str]] | None = None, node_cells: int = TASK_CELLS, packed: Packed | None = None) -> "BoostedModel":
        packed = packed or pack(rows, fit_bins(rows, ordered, named), outputs, key)
        if not packed.n_rows:
            raise ValueError("no rows to train on")
        boosters = (_in_tasks if packed.n_rows <= packed.rows_of(node_cells) else _in_rounds)(packed, setting)
        return cls(boosters, packed.units, packed.bins, outputs)

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """Adds an array with a prediction per output."""
        sent, bins, units = df.sparkSession.sparkContext.broadcast(self.boosters), self.bins, np.array(self.units)

        def run(batches):
            for batch in batches:
                x = bins.place(batch)
                total = np.stack([b.predict(x, len(bins.ordered)) for b in sent.value], axis=1) * units
                lists = pa.ListArray.from_arrays(np.arange(0, total.size + 1, len(units), dtype=np.int32), total.reshape(-1))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, output])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))]))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        about = json.dumps({"boosters": [_written(b) for b in self.boosters], "units": self.units, "bins": asdict(self.bins),
                            "outputs": self.outputs})
        spark.createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return cls([_read(b) for b in about["boosters"]], about["units"], Bins(**about["bins"]), about["outputs"])


class MeanModel:
    """The mean of what several models predict for the same outputs."""

    def __init__(self, models: list[BoostedModel]):
        self.models, self.bins, self.outputs = models, models[0].bins, models[0].outputs

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        for i, model in enumerate(self.models):
            df = model.transform(df, f"{output}_{i}")
        parts = [F.col(f"{output}_{i}") for i in range(len(self.models))]
        mean = F.array(*[sum((p[k] for p in parts[1:]), parts[0][k]) / len(parts) for k in range(len(self.outputs))])
        return df.withColumn(output, mean).drop(*[f"{output}_{i}" for i in range(len(parts))])

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.save(f"{path}/part={i}")
        SparkSession.getActiveSession().createDataFrame([(str(len(self.models)),)], "value string").write.mode("overwrite").text(f"{path}/parts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MeanModel":
        n = int(spark.read.text(f"{path}/parts").first()["value"])
        return cls([BoostedModel.load(spark, f"{path}/part={i}") for i in range(n)])
