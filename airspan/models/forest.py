"""Histogram trees with several outputs, many trees grown at once.

Rows are binned once. A cell (tree, node, feature, bin) holds a weight and, for each output, a sum, and the best
split of a node follows from its cells alone. Growth goes in two phases:

1. Nodes with more rows than a task should hold are split level by level, all trees together: each task adds up the
   cells of its rows, one aggregate adds up the tasks' cells, and what a level gives back is one split per node.
2. The rows of every smaller node are brought together, a node of a tree to one task, which grows the rest of that
   tree below it by the same cells and splits.

Outputs are whole numbers of a fixed scale and row weights are drawn by a hash of the row's key, so sums are exact and the
trees are the same however the rows are partitioned, and after an executor is lost.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, fields, replace
from functools import partial, reduce
from heapq import heappop, heappush
from math import e, factorial, frexp, prod

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airspan.schemas import name_col
from airspan.session import durable, let_go

# Executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Distinct values of a feature that get a bin each; features with more get so many bins of equal counts.
BINS = 4096
# Rows whose values a task counts at a time.
COUNTED_ROWS = 1 << 20
# Rows of a node that one task grows on its own, and of all nodes that it takes on together: some 250 bytes each.
NODE_ROWS, TASK_ROWS = 1_000_000, 500_000
# Rows for each task that brings rows of one point together.
POINT_ROWS = 1 << 20
# Bytes of rows that are dealt to trees before the files of that are let go.
DEAL_BYTES = 1 << 31
# Bits of an output as a whole number, so that sums over millions of rows are exact in floating point.
BITS = 30
# Rows of a packed block, cells that a task holds, and bytes of trees that a task of a prediction holds.
BLOCK, CELLS, TREE_BYTES = 1 << 16, 1 << 20, 64 << 20
# Rows times features of the nodes of a level whose cells are held at a time.
LEVEL_CELLS = 1 << 18
# Rows whose bins a task counts at a time, and how many places of tables a row of a node makes up for.
TABLE_ROWS, TABLE_SHARE = 1 << 16, 3
# Nodes with less rows are not split by tables. Rows that are put in the order of each feature at a time, and those that are too few.
SMALL_ROWS, SORTED_ROWS, FEW_ROWS = 1 << 10, 1 << 15, 1 << 9
# Rows times features, and twice the outputs, of the blocks whose cells a task adds up at a time.
JOINED_CELLS = 1 << 24
# Bytes of trees that are sent to tasks before the files of that are let go.
ROUND_BYTES = 1 << 30
# A node whose outputs vary less than this share of their squares is pure.
PURE = 1e-9


@dataclass(frozen=True)
class Growth:
    """How trees grow: ``features`` are tried at a node (all if None), at every cut or at one drawn at random."""

    trees: int = 1
    bootstrap: bool = False
    depth: int | None = None
    leaf_rows: int = 1
    split_rows: int = 2
    features: int | None = None
    random_cuts: bool = False
    seed: int = 42
    #: added to the weight of a leaf, whose mean it draws to nought; a split must then lower the error by more than it costs
    penalty: float = 0.0
    #: shares of the features and of the rows that are drawn, without replacement
    columns: float = 1.0
    rows: float = 1.0
    #: share of the rows that is never trained on, and the seed that draws it
    held: float = 0.0
    held_seed: int = 0

    def allowed(self, columns: int) -> np.ndarray:
        """Which features are drawn: the first by a hash of their numbers."""
        draw = _mixed(_seeded(self.seed, 9) + _mixed(np.arange(columns, dtype=np.uint64) + np.uint64(1)))
        out = np.zeros(columns, bool)
        out[np.argsort(draw, kind="stable")[: max(1, round(self.columns * columns))]] = True
        return out

    def weights(self, keys: np.ndarray, tree: int) -> np.ndarray:
        """How often each row counts in a tree."""
        w = times_drawn(keys, self.seed, tree) if self.bootstrap else np.ones(len(keys))
        if self.rows < 1:
            w[share_of(keys, self.seed, 8) >= self.rows] = 0
        if self.held:
            w[share_of(keys, self.held_seed, 7) < self.held] = 0
        return w

    def different(self) -> int:
        """Without any drawing all trees are the same one, which is grown once."""
        return self.trees if self.bootstrap or self.random_cuts or self.features else 1


@dataclass(frozen=True)
class Bins:
    """The cuts between the bins of each ordered feature and the largest value in each bin; the names of each named
    feature."""

    ordered: dict[str, list[float]]
    largest: dict[str, list[float]]
    named: dict[str, list[str]]

    def columns(self) -> list[str]:
        return [*self.ordered, *self.named]

    @property
    def kind(self) -> type:
        """The numbers that hold a bin: wider ones where a feature has more names than the small ones count to."""
        return np.int32 if any(len(names) > 1 << 15 for names in self.named.values()) else np.int16

    def kinds(self) -> list[type]:
        """The smallest numbers that hold the bins of each feature."""
        return [np.int32 if len(self.named.get(c, ())) > 1 << 15 else np.int16 for c in self.columns()]

    def by_feature(self, x: np.ndarray) -> bytes:
        """Bins of rows, a feature's together."""
        return b"".join(x[:, f].astype(kind).tobytes() for f, kind in enumerate(self.kinds()))

    def held(self, blocks: list[tuple[bytes, bytes, bytes]]) -> tuple["Columns", np.ndarray, np.ndarray]:
        """The bins, outputs and keys of blocks of rows, of which the bins are as ``by_feature`` writes them."""
        kinds, columns, counts = self.kinds(), [], [len(key) // 8 for _, _, key in blocks]
        y, key = (np.frombuffer(b"".join(block[i] for block in blocks), kind) for i, kind in ((1, np.int32), (2, np.uint64)))
        begins = [0] * len(blocks)
        for kind in kinds:
            columns.append(np.concatenate([np.frombuffer(block[0], kind, n, at) for block, n, at in zip(blocks, counts, begins)]))
            begins = [at + n * np.dtype(kind).itemsize for at, n in zip(begins, counts)]
        return Columns(columns, len(self.ordered)), y, key

    def place(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bin of each feature of each row. A null is as the smallest value; an unknown name as the first."""
        out = np.zeros((batch.num_rows, len(self.columns())), self.kind)
        for i, (c, cuts) in enumerate(self.ordered.items()):
            values = batch.column(c).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            out[:, i] = np.searchsorted(np.array(cuts), values)
        for i, (c, names) in enumerate(self.named.items(), len(self.ordered)):
            at = {name: k for k, name in enumerate(names)}
            out[:, i] = [at.get(v, 0) for v in batch.column(c).cast(pa.string()).to_pylist()]
        return out


def fit_bins(rows: DataFrame, ordered: Sequence[str], named: dict[str, Sequence[str]] | None = None, bins: int = BINS) -> Bins:
    """A bin for each value of a feature while there are few, else bins of about equal counts. A named feature
    stands for a flag per name but the first, as in one-hot vectors."""
    named = {c: [str(n) for n in names] for c, names in (named or {}).items()}
    if not ordered:
        return Bins({}, {}, named)
    plain = rows.select(*[F.col(name_col(c)).cast("double").alias(f"_{i}") for i, c in enumerate(ordered)])
    totals = plain.agg(*[F.count(f"_{i}") for i in range(len(ordered))]).first()

    def count(batches):
        """How often each value is among some rows."""
        held, size = [], 0

        def counted():
            whole = pa.Table.from_batches(held)
            for i in range(len(ordered)):
                values, n = np.unique(whole.column(i).drop_null().to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(values), pa.array(n)], ["f", "v", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COUNTED_ROWS:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    def choose(batches):
        """Of each feature's values in order: all while they are few, and those at the ends of bins of equal counts."""
        states: dict[int, list] = {}
        for batch in batches:
            f, v, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", "v", "n"))
            cuts = [0, *(np.flatnonzero(np.diff(f)) + 1).tolist(), len(f)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                state = states.setdefault(int(f[a]), [0, 0, [], []])
                wanted = np.ceil(np.arange(1, bins + 1) * (totals[int(f[a])] / bins))
                reached = state[0] + np.cumsum(n[a:b])
                at = np.searchsorted(reached, wanted[wanted > state[0]])
                state[3].append(v[a:b][np.unique(at[at < b - a])])
                if state[1] <= bins:
                    state[2].append(v[a:b])
                state[0], state[1] = int(reached[-1]), state[1] + b - a
        for f, (_, distinct, few, ends) in states.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([f], pa.int32()), pa.array([distinct <= bins]),
                pa.array([np.concatenate(few if distinct <= bins else ends).tolist()], pa.list_(pa.float64()))], ["f", "few", "v"])

    found = plain.mapInArrow(count, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    values, cuts = {c: [] for c in ordered}, {c: [] for c in ordered}
    for r in found.repartition("f").sortWithinPartitions("f", "v").mapInArrow(choose, "f int, few boolean, v array<double>").collect():
        c, v = ordered[r["f"]], r["v"]
        # Half way to the next value, so that a value between two trained on goes to the nearer one.
        values[c], cuts[c] = v, [(a + b) / 2 for a, b in zip(v, v[1:])] if r["few"] else v[:-1]
    return Bins(cuts, values, named)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _seeded(seed: int, number: int) -> np.ndarray:
    return _mixed(_mixed(np.array([seed], np.uint64)) + np.uint64(number + 1))


def share_of(keys: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number from 0 to 1 for each row, from a hash of its key."""
    return _mixed(keys ^ _seeded(seed, number)) / 2.0**64


def times_drawn(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson with mean one."""
    share = share_of(keys, seed, tree)
    return np.searchsorted(np.cumsum([1 / (e * factorial(n)) for n in range(16)]), share, "right").astype(np.float64)


# Cells and splits


@dataclass
class Cells:
    """Weights and sums by (feature, node, bin), in this order."""

    feature: np.ndarray
    node: np.ndarray
    bin: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray


def add_up(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, units: np.ndarray, squares: np.ndarray | None = None) -> Cells:
    """The cells of rows in nodes 0, 1, ...; every feature has its own cells of the same rows. Squares, of which only a
    node's total is of use, are those of the first feature's cells. With ``squares``, ``y`` are weighted sums of equal rows.

    While nodes times bins are few, each cell has a place of its own in a table; beyond that, rows are sorted."""
    n_rows, n_nodes, n_out = len(node), int(node.max(initial=0)) + 1, y.shape[1]
    alike = bool((w == 1).all())
    columns = [np.ascontiguousarray(y[:, i]) if alike or squares is not None else y[:, i] * w for i in range(n_out)]
    squares = ((y * units) ** 2).sum(axis=1) * w if squares is None else squares
    weighted, parts, small = None, [], None
    for f in range(x.shape[1]):
        own = x[:, f]
        bins = int(own.max(initial=0)) + 1
        if n_nodes * bins <= max(4 * n_rows, 1 << 12):
            code = own.astype(np.int64) if n_nodes == 1 else node * bins + own
            size = n_nodes * bins
            rows = np.bincount(code, minlength=size)
            at = np.flatnonzero(rows)
            n = rows[at].astype(np.float64) if alike else np.bincount(code, w, size)[at]
            sums = np.stack([np.bincount(code, c, size)[at] for c in columns], axis=1)
            q = np.bincount(code, squares, size)[at] if f == 0 else np.zeros(len(at))
            parts.append((np.full(len(at), f, np.int16), at // bins, (at % bins).astype(x.dtype), n, sums, q))
            continue
        if weighted is None:
            weighted = np.stack([w, squares, *columns], axis=1)
            small = node.astype(np.uint16) if n_nodes <= 1 << 16 else node
        by_bin = np.argsort(own, kind="stable")
        order = by_bin[np.argsort(small[by_bin], kind="stable")]
        at_node, bin_ = node[order], own[order]
        begin = np.flatnonzero(np.concatenate([[True], (at_node[1:] != at_node[:-1]) | (bin_[1:] != bin_[:-1])]))
        sums = np.add.reduceat(weighted[order], begin, axis=0)
        parts.append((np.full(len(begin), f, np.int16), at_node[begin], bin_[begin], sums[:, 0], sums[:, 2:],
                      sums[:, 1] if f == 0 else np.zeros(len(begin))))
    return Cells(*(np.concatenate(p) for p in zip(*parts)))


@dataclass
class Splits:
    """For each node 0, 1, ...: its weight and means, the feature of its best split (-1: none) and the bin, and by how much
    the split lowers the squared error."""

    n: np.ndarray
    means: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left_n: np.ndarray
    gain: np.ndarray


def best_splits(cells: Cells, keys: np.ndarray, growth: Growth, bins: Bins, units: np.ndarray) -> Splits:
    """The split of each node with the least squared error, the smallest feature and bin on a tie. A row goes left
    whose bin is not above the cut; with a named feature, one that has not the name. ``keys`` draw what a node
    tries: the same in whatever task it is split."""
    first_named, n_nodes, columns = len(bins.ordered), len(keys), len(bins.columns())
    # A segment is a feature of a node.
    new = np.concatenate([[True], (cells.node[1:] != cells.node[:-1]) | (cells.feature[1:] != cells.feature[:-1])])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(new)) - 1
    of = np.cumsum(new) - 1
    at_feature, at_node = cells.feature[begins], cells.node[begins]
    run_n, run = np.cumsum(cells.n), np.cumsum(cells.sums, axis=0)
    left_n = run_n - (run_n[begins] - cells.n[begins])[of]
    left = run - (run[begins] - cells.sums[begins])[of]
    # Each feature has all rows of the node, so the first one's totals are the node's.
    total_n, total, squares = np.zeros(n_nodes), np.zeros((n_nodes, cells.sums.shape[1])), np.zeros(n_nodes)
    head = at_feature == at_feature[0]
    total_n[at_node[head]], total[at_node[head]] = left_n[ends[head]], left[ends[head]]
    squares[at_node[head]] = np.add.reduceat(cells.squares, begins)[head]
    named = cells.feature >= first_named
    if named.any():
        own = np.flatnonzero(named)
        left_n[own] = total_n[cells.node[own]] - cells.n[own]
        left[own] = total[cells.node[own]] - cells.sums[own]
    right_n = total_n[cells.node] - left_n
    tried = (left_n >= growth.leaf_rows) & (right_n >= growth.leaf_rows)
    tried[ends[at_feature < first_named]] = False
    tried &= ~named | (cells.bin > 0)
    if growth.columns < 1:
        tried &= growth.allowed(columns)[cells.feature]
    varies = begins != ends
    if growth.features:
        # Of the features that vary in the node, the first by their draws.
        draw = _mixed(keys[at_node] + np.uint64(0x9E3779B97F4A7C15) * (at_feature.astype(np.uint64) + np.uint64(1)))
        order = np.lexsort((draw, ~varies, at_node))
        rank = np.empty(len(begins), np.int64)
        rank[order] = np.arange(len(begins)) - np.searchsorted(at_node[order], at_node[order])
        tried &= (rank < growth.features)[of]
    if growth.random_cuts:
        # One cut of each ordered feature, drawn between the node's least and largest value.
        draw = _mixed(keys[at_node] ^ _mixed(at_feature.astype(np.uint64) + np.uint64(77))) / 2.0**64
        chosen = np.zeros(len(new), bool)
        for f, largest in enumerate(bins.largest.values()):
            here = np.flatnonzero((at_feature == f) & varies)
            if not len(here):
                continue
            value, low, high = np.array(largest), cells.bin[begins[here]].astype(int), cells.bin[ends[here]].astype(int)
            point = value[low] + draw[here] * (value[high] - value[low])
            bin_at = np.clip(np.searchsorted(value, point, "right") - 1, low, high - 1)
            # The last cell that is not above the cut.
            cell = (of << 32) + cells.bin
            chosen[np.searchsorted(cell, (here << 32) + bin_at, "right") - 1] = True
        tried &= chosen | named
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = squares - ((total * units) ** 2).sum(axis=1) / total_n
        open_ = (spread > PURE * squares) & (total_n >= growth.split_rows)
        where = np.flatnonzero(tried & open_[cells.node])
        rest = total[cells.node[where]] - left[where]
        gain = np.full(len(new), -1.0)
        gain[where] = (((left[where] * units) ** 2).sum(axis=1) / (left_n[where] + growth.penalty)
                       + ((rest * units) ** 2).sum(axis=1) / (right_n[where] + growth.penalty))
        without = ((total * units) ** 2).sum(axis=1) / (total_n + growth.penalty)
    # The best of each segment, then the first feature that has the best of the node.
    most = np.maximum.reduceat(gain, begins)
    table = np.full((n_nodes, columns), -1.0)
    table[at_node, at_feature] = most
    best = table.argmax(axis=1)
    found = table[np.arange(n_nodes), best] >= 0
    if growth.penalty:
        found &= table[np.arange(n_nodes), best] > without * (1 + 1e-12)
    segment = np.zeros((n_nodes, columns), np.int64)
    segment[at_node, at_feature] = np.arange(len(begins))
    segment = segment[np.arange(n_nodes), best]
    cell = np.flatnonzero(gain == most[of])
    first = cell[np.searchsorted(of[cell], segment)]
    feature = np.where(found, best, -1).astype(np.int16)
    means = total * units / np.maximum(total_n + growth.penalty, 1e-300)[:, None]
    return Splits(total_n, means, feature, np.where(found, cells.bin[first], 0).astype(np.int32), np.where(found, left_n[first], 0),
                  np.where(found, table[np.arange(n_nodes), best] - without, 0.0))


def goes_right(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, first_named: int, rows: np.ndarray | None = None) -> np.ndarray:
    value = x[np.arange(len(x)) if rows is None else rows, feature]
    return np.where(feature >= first_named, value == cut, value > cut)


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    return _mixed(keys * np.uint64(2) + np.uint64(side + 1))


@dataclass
class Tree:
    """Nodes in an order in which both children follow each other: ``left`` is the first child of a node with a split
    (the other is next), and -1 - i for leaf i, whose means are row i of ``value``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaf_of(self, x: np.ndarray, first_named: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.left[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = self.left[node] + goes_right(x, self.feature[node], self.cut[node], first_named, open_)
            open_ = open_[self.left[at[open_]] >= 0]
        return -1 - self.left[at]


@dataclass
class Grown:
    """A tree with the means of all its nodes, and what each split gains."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    means: np.ndarray
    gain: np.ndarray

    def tree(self, leaves: int | None = None) -> Tree:
        """The whole tree, or that of the best splits: with a bound on the leaves, the node is split next whose split
        gains most, as if it had been grown so. A node's split does not depend on the order."""
        split = self.left >= 0
        if leaves is not None:
            open_, split, left = [(-self.gain[0], 0)] if split[0] else [], np.zeros(len(split), bool), leaves - 1
            while open_ and left > 0:
                node = heappop(open_)[1]
                split[node], left = True, left - 1
                for child in (self.left[node], self.left[node] + 1):
                    if self.left[child] >= 0:
                        heappush(open_, (-self.gain[child], int(child)))
        # Both children of a node follow each other, and those of the first nodes come first.
        levels, links, size = [np.zeros(1, np.int64)], [], 1
        while len(levels[-1]):
            open_ = split[levels[-1]]
            links.append(np.where(open_, size + 2 * (np.cumsum(open_) - open_), -1))
            first = self.left[levels[-1][open_]].astype(np.int64)
            levels.append(np.stack([first, first + 1], axis=1).reshape(-1))
            size += len(levels[-1])
        at, links = np.concatenate(levels), np.concatenate(links).astype(np.int32)
        ends = links < 0
        links[ends] = -1 - np.arange(ends.sum())
        return Tree(np.where(ends, -1, self.feature[at]).astype(np.int16), self.cut[at], links, self.means[at][ends])


def _splits_of(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, growth: Growth, bins: Bins,
               units: np.ndarray, squares: np.ndarray | None = None) -> Splits:
    """The splits of nodes whose rows follow each other, for so many nodes at a time that their cells stay few."""
    ends = np.searchsorted(node, np.arange(len(keys)), "right")
    parts, first, begin, most = [], 0, 0, max(1, LEVEL_CELLS // x.shape[1])
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(ends, begin + most, "right")))
        rows = slice(begin, int(ends[last - 1]))
        parts.append(best_splits(add_up(
            node[rows] - first, x[rows], y[rows], w[rows], units, None if squares is None else squares[rows]), keys[first:last], growth, bins, units))
        first, begin = last, rows.stop
    return parts[0] if len(parts) == 1 else Splits(*(np.concatenate([getattr(p, c.name) for p in parts]) for c in fields(Splits)))


class Columns:
    """The bins of rows that are held in memory, a feature's together and in the smallest numbers that hold them. Features of
    about as many bins share a table, of which a row is a feature."""

    def __init__(self, columns: Sequence[np.ndarray], first_named: int):
        self.sizes = [int(c.max(initial=0)) + 1 for c in columns]
        self.columns = [np.ascontiguousarray(c, np.int16 if n <= 1 << 15 else np.int32) for c, n in zip(columns, self.sizes)]
        self.first_named = first_named

    def __len__(self) -> int:
        return len(self.columns[0])

    def tables(self, features: Sequence[int]) -> list[list[int]]:
        """The features of each table; a named one has its own. One with a single bin is never split."""
        by_size: dict[int, list[int]] = {}
        for f in features:
            if self.sizes[f] > 1:
                by_size.setdefault(-1 - f if f >= self.first_named else self.sizes[f].bit_length() // 2, []).append(f)
        return list(by_size.values())

    def cells(self) -> int:
        """The places of all tables."""
        return sum(len(own) * max(self.sizes[f] for f in own) for own in self.tables(range(len(self.columns))))

    def counted(self, rows: np.ndarray | None, own: Sequence[int]) -> np.ndarray:
        """The rows by feature and bin."""
        return self.added(rows, own, [], None)[0]

    def added(self, rows: np.ndarray | None, own: Sequence[int], y: Sequence[np.ndarray], w: np.ndarray | None,
              counted: bool = True, summed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """By feature and bin the rows, or their weights, if they are to be ``counted``, and the weighted sums of each output."""
        width = max(self.sizes[f] for f in own)
        n, sums = np.zeros((len(own), width)), np.zeros((len(y), len(own), width))
        step = max(TABLE_ROWS, 8 * width)
        for part, weight, values in _weighted(rows, len(self), y, w, step, summed):
            for i, f in enumerate(own):
                code = (self.columns[f][part] if isinstance(part, slice) else self.columns[f].take(part)).astype(np.intp)
                if counted:
                    n[i] += np.bincount(code, weight, width)
                for k, value in enumerate(values):
                    sums[k, i] += np.bincount(code, value, width)
        return n, sums

    def right(self, rows: np.ndarray | None, feature: int, cut: int) -> np.ndarray:
        code = self.columns[feature] if rows is None else self.columns[feature].take(rows)
        return code == cut if feature >= self.first_named else code > cut

    def leaves(self, tree: Tree, rows: np.ndarray | None = None) -> list[tuple[int, np.ndarray | None]]:
        """The rows, or all, by the leaf of a tree they come to."""
        out, open_ = [], [(0, rows)]
        while open_:
            node, rows = open_.pop()
            if tree.left[node] < 0:
                out.append((-1 - int(tree.left[node]), rows))
                continue
            right = self.right(rows, int(tree.feature[node]), int(tree.cut[node]))
            for side, in_ in enumerate((~right, right)):
                open_.append((int(tree.left[node]) + side, np.flatnonzero(in_) if rows is None else rows[in_]))
        return out


def _weighted(rows: np.ndarray | None, n: int, y: Sequence[np.ndarray], w: np.ndarray | None, step: int, summed: bool = False) -> Iterator[tuple]:
    """Some rows at a time: which, their weights (None if all are one), and the outputs times the weights, unless they are sums."""
    for at in range(0, n if rows is None else len(rows), step):
        part = slice(at, at + step) if rows is None else rows[at:at + step]
        own = (lambda v: v[part]) if rows is None else (lambda v: v.take(part))
        weight = None if w is None else own(w)
        yield part, weight, [own(v) if w is None or summed else own(v) * weight for v in y]


@dataclass
class _Open:
    """A node of a tree that grows by tables: its rows (all if None), totals, and the tables that are known."""

    node: int
    rows: np.ndarray | None
    n: float
    total: np.ndarray
    key: int
    depth: int
    path: int = 0
    tables: list[tuple[np.ndarray, np.ndarray]] | None = None
    split: tuple[float, int, int] | None = None


class TableGrowth:
    """Grows one tree at a time over rows in memory, whose sums by feature and bin are tables. Of two children only the one with
    fewer rows is added up, the other's tables are what is left of their parent's: whole numbers, so nothing is lost. Splits
    are those of ``best_splits``."""

    def __init__(self, x: Columns, growth: Growth, bins: Bins, units: np.ndarray, small: int):
        self.x, self.growth, self.bins, self.units, self.small = x, growth, bins, units, small
        drawn = growth.allowed(len(x.columns)) if growth.columns < 1 else np.ones(len(x.columns), bool)
        self.tables = x.tables(np.flatnonzero(drawn).tolist())
        self.plain = not growth.features and not growth.random_cuts

    def grow(self, rows: np.ndarray | None, y: Sequence[np.ndarray], w: np.ndarray | None, key: int, depth: int = 0, leaves: int | None = None,
             counts: dict[int, np.ndarray] | None = None, later: list | None = None, squares_of: np.ndarray | None = None) -> Grown:
        """The tree of the rows, or all: ``w`` are weights (one if None) and ``y`` the outputs of all rows in memory. ``counts`` are
        the rows by bin of each feature where these are known. Nodes with less than ``small`` rows are left to the caller in
        ``later``, if given. With ``squares_of``, rows are several equal ones each and ``y`` are weighted sums."""
        growth, units, whole = self.growth, self.units, w is None or bool((w == np.rint(w)).all())
        feature, cut, left, means, gain = [-1], [0], [-1], [np.zeros(len(y))], [0.0]

        def totals(rows) -> tuple[float, np.ndarray, float]:
            n, total, squares = 0.0, np.zeros(len(y)), 0.0
            for part, weight, values in _weighted(rows, len(self.x), y, w, TABLE_ROWS, squares_of is not None):
                if squares_of is not None:
                    squares += float(squares_of[part].sum())
                n += len(values[0]) if weight is None else float(weight.sum())
                for k, (v, value, unit) in enumerate(zip(y, values, units.tolist())):
                    plain = value if weight is None else v[part] if rows is None else v.take(part)
                    total[k] += value.sum()
                    if squares_of is not None:
                        continue
                    squares += float(np.einsum("i,i->", plain, value, dtype=np.float64, casting="unsafe")) * unit * unit
            return n, total, squares

        def added(rows, counts=None):
            out = []
            for own in self.tables:
                n, sums = self.x.added(rows, own, y, w, not counts, squares_of is not None)
                for i, f in enumerate(own if counts else ()):
                    n[i, :self.x.sizes[f]] = counts[f]
                out.append((n, sums))
            return out

        def opened(at: _Open, squares: float) -> bool:
            """Looks for the node's split. Tables that were not known are added up."""
            total = (at.total * units) ** 2
            spread = squares - total.sum() / at.n
            means[at.node] = at.total * units / max(at.n + growth.penalty, 1e-300)
            if growth.depth is not None and at.depth >= growth.depth or not spread > PURE * squares or at.n < growth.split_rows:
                return False
            if at.tables is None:
                at.tables = added(at.rows)
            at.split = self._best(at, squares)
            if at.split:
                gain[at.node] = at.split[0]
            return at.split is not None

        if later is not None and (len(self.x) if rows is None else len(rows)) < self.small:
            later.append((0, np.arange(len(self.x)) if rows is None else rows, key, depth))
            return Grown(np.array(feature, np.int16), np.array(cut, np.int32), np.array(left, np.int32), np.array(means), np.array(gain))
        n, total, squares = totals(rows)
        top = _Open(0, rows, n, total, key, depth)
        if counts:
            top.tables = added(rows, counts)
        open_: list = []
        order = lambda at: (-at.split[0], at.depth, at.path, at.node, at) if leaves is not None else (0, -at.node, 0, at.node, at)
        if opened(top, squares):
            heappush(open_, order(top))
        made = 1
        while open_ and (leaves is None or made < leaves):
            at = heappop(open_)[-1]
            _, f, c = at.split
            right = self.x.right(at.rows, f, c)
            sides = [np.flatnonzero(s) if at.rows is None else at.rows[s] for s in (~right, right)]
            feature[at.node], cut[at.node], left[at.node] = f, c, len(left)
            made += 1
            children = []
            for side, rows in enumerate(sides):
                n, total, squares = totals(rows)
                key = int(child_keys(np.array([at.key], np.uint64), side)[0])
                children.append((_Open(len(left), rows, n, total, key, at.depth + 1, at.path * 2 + side), squares))
                for column, value in ((feature, -1), (cut, 0), (left, -1), (means, np.zeros(len(y))), (gain, 0.0)):
                    column.append(value)
            ends = growth.depth is not None and at.depth + 1 >= growth.depth
            put_off = [later is not None and not ends and len(c.rows) < self.small for c, _ in children]
            less, more = sorted((0, 1), key=lambda i: len(sides[i]))
            if not ends and whole and not put_off[more]:
                # The larger one's tables are the parent's without the smaller one's.
                children[less][0].tables = added(children[less][0].rows)
                for (n, s), (n_, s_) in zip(at.tables, children[less][0].tables):
                    n -= n_
                    s -= s_
                children[more][0].tables = at.tables
            at.tables = None
            for (child, squares), off in zip(children, put_off):
                if off:
                    later.append((child.node, child.rows, child.key, child.depth))
                elif opened(child, squares):
                    heappush(open_, order(child))
        return Grown(np.array(feature, np.int16), np.array(cut, np.int32), np.array(left, np.int32), np.array(means), np.array(gain))

    def _best(self, at: _Open, squares: float) -> tuple[float, int, int] | None:
        """(gain, feature, cut) of the best split, if there is one."""
        growth, units = self.growth, self.units
        if not self.plain:
            found = best_splits(self._cells(at, squares), np.array([at.key], np.uint64), growth, self.bins, units)
            return None if found.feature[0] < 0 else (float(found.gain[0]), int(found.feature[0]), int(found.cut[0]))
        best = (-1.0, -1, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            for own, (n, s) in zip(self.tables, at.tables):
                named = own[0] >= self.x.first_named
                left_n = at.n - n if named else np.cumsum(n, axis=1)
                right_n = at.n - left_n
                tried = (left_n >= growth.leaf_rows) & (right_n >= growth.leaf_rows)
                if named:
                    tried[:, 0] = False
                here = there = None
                for k, unit in enumerate(units.tolist()):
                    a = at.total[k] - s[k] if named else np.cumsum(s[k], axis=1)
                    b = at.total[k] - a
                    a *= unit
                    b *= unit
                    a *= a
                    b *= b
                    here, there = (a, b) if here is None else (here + a, there + b)
                here /= left_n + growth.penalty
                there /= right_n + growth.penalty
                here += there
                here[~tried] = -1.0
                cuts = here.argmax(axis=1)
                most = here[np.arange(len(own)), cuts]
                for f, g, c in zip(own, most.tolist(), cuts.tolist()):
                    if g > best[0] or g == best[0] and g >= 0 and f < best[1]:
                        best = (g, f, c)
        without = float(((at.total * units) ** 2).sum() / (at.n + growth.penalty))
        if best[0] < 0 or growth.penalty and not best[0] > without * (1 + 1e-12):
            return None
        return best[0] - without, best[1], best[2]

    def _cells(self, at: _Open, squares: float) -> Cells:
        parts = []
        held = {f: (n[i], s[:, i]) for own, (n, s) in zip(self.tables, at.tables) for i, f in enumerate(own)}
        for f in range(len(self.x.columns)):
            if f in held:
                n, s = held[f]
                where = np.flatnonzero(n)
                parts.append((np.full(len(where), f, np.int16), where.astype(np.int32), n[where], s[:, where].T))
            else:  # a feature with one bin
                parts.append((np.full(1, f, np.int16), np.zeros(1, np.int32), np.array([at.n]), at.total[None]))
        feature, bin_, n, sums = (np.concatenate(p) for p in zip(*parts))
        all_squares = np.zeros(len(n))
        all_squares[0] = squares
        return Cells(feature, np.zeros(len(n), np.int64), bin_, n, sums, all_squares)


def grow(root: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, depths: np.ndarray,
         growth: Growth, bins: Bins, units: np.ndarray, squares: np.ndarray | None = None) -> list[Grown]:
    """The trees below the roots 0, 1, ... that rows belong to: large nodes by tables, one by one, the small ones below them
    all together. With ``squares``, rows are several equal ones each: ``w`` are their weights and ``y`` their weighted sums."""
    held = Columns([x[:, f] for f in range(x.shape[1])], len(bins.ordered))
    by = TableGrowth(held, growth, bins, units, max(SMALL_ROWS, held.cells() // (TABLE_SHARE * len(held.columns))))
    outputs, weights = [np.ascontiguousarray(y[:, k]) for k in range(y.shape[1])], None if (w == 1).all() else w
    order = np.argsort(root, kind="stable")
    ends = np.searchsorted(root[order], np.arange(len(keys)), "right")
    tops, later = [], []
    for i, (key, depth, a, b) in enumerate(zip(keys.tolist(), depths.tolist(), [0, *ends[:-1].tolist()], ends.tolist())):
        off: list = []
        tops.append(by.grow(order[a:b], outputs, weights, key, depth, later=off, squares_of=squares))
        later += [(i, *part) for part in off]
    if not later:
        return tops
    below, begin, ends = [], 0, np.cumsum([len(rows) for _, _, rows, _, _ in later])
    while begin < len(later):
        # So many rows at a time that what a feature needs of them stays in fast memory.
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SORTED_ROWS, "right")))
        some = later[begin:end]
        rows = np.concatenate([rows for _, _, rows, _, _ in some])
        below += _together(np.repeat(np.arange(len(some)), [len(rows) for _, _, rows, _, _ in some]), taken(x, rows), y[rows], w[rows],
                           np.array([k for *_, k, _ in some], np.uint64), np.array([d for *_, d in some]), growth, bins, units,
                           None if squares is None else squares[rows])
        begin = end
    parts: dict[int, list[tuple[int, Grown]]] = {}
    for (i, node, *_), part in zip(later, below):
        parts.setdefault(i, []).append((node, part))
    return [_attached(top, parts.get(i, [])) for i, top in enumerate(tops)]


def _attached(top: Grown, parts: list[tuple[int, Grown]]) -> Grown:
    """A tree with what was grown below some of its nodes, of which the roots take the nodes' places."""
    out = [[getattr(top, f.name).copy()] for f in fields(Grown)]
    size = len(top.left)
    for node, part in parts:
        left = np.where(part.left >= 0, part.left - 1 + size, -1).astype(np.int32)
        for column, values in zip(out, (part.feature, part.cut, left, part.means, part.gain)):
            column[0][node] = values[0]
            column.append(values[1:])
        size += len(left) - 1
    return Grown(*(np.concatenate(column) for column in out))


def _together(root: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, depths: np.ndarray,
              growth: Growth, bins: Bins, units: np.ndarray, squares: np.ndarray | None = None) -> list[Grown]:
    """The trees below the roots 0, 1, ... that rows belong to, whose rows follow each other: all levels of all of them together."""
    if len(root) > FEW_ROWS and not growth.features and not growth.random_cuts and growth.columns == 1:
        return _in_order_of_bins(root, x, y, w, keys, depths, growth, bins, units, squares)
    n_roots, first_named = len(keys), len(bins.ordered)
    node, owner, place, depth = root.astype(np.int64), np.arange(n_roots), np.zeros(n_roots, np.int64), depths.copy()
    if (node[1:] < node[:-1]).any():
        order = np.argsort(node, kind="stable")
        node, x, y, w, squares = node[order], x[order], y[order], w[order], None if squares is None else squares[order]
    # Each feature's bins lie together, and so do the rows of a node.
    x = np.asfortranarray(x)
    size, found = np.ones(n_roots, np.int64), []
    while len(owner):
        if growth.depth is not None and (depth >= growth.depth).all():
            splits = _leaves_of(node, y, w, len(keys), growth, units, squares is not None)
        else:
            splits = _splits_of(node, x, y, w, keys, growth, bins, units, squares)
        if growth.depth is not None:
            splits.feature[depth >= growth.depth] = -1
        cut = splits.feature >= 0
        # The children of a root's nodes follow all that it has so far.
        rank = np.cumsum(cut) - cut
        first = np.searchsorted(owner, np.arange(n_roots))
        rank -= rank[np.minimum(first, len(rank) - 1)][owner]
        left = np.where(cut, size[owner] + 2 * rank, -1)
        size += 2 * np.bincount(owner, cut, n_roots).astype(np.int64)
        found.append((owner, place, splits.feature, splits.cut, left, splits.means, splits.gain))
        if not cut.any():
            break
        right = goes_right(x, np.maximum(splits.feature, 0)[node], splits.cut[node], first_named)
        # Rows of a node that go left stay before those that go right; rows of leaves go.
        child = np.where(cut[node], 2 * (np.cumsum(cut) - 1)[node] + right, -1)
        order = _stably(node, right, cut)
        node = child[order]
        x, y, w, squares = taken(x, order), y[order], w[order], None if squares is None else squares[order]
        pair = lambda a, b: np.stack([a[cut], b[cut]], axis=1).reshape(-1, *a.shape[1:])
        owner, place = np.repeat(owner[cut], 2), pair(left, left + 1)
        keys, depth = pair(child_keys(keys, 0), child_keys(keys, 1)), np.repeat(depth[cut] + 1, 2)
    owner, place, *columns = (np.concatenate(p) for p in zip(*found))
    order = np.lexsort((place, owner))
    return [Grown(*(c[part] for c in columns)) for part in np.split(order, np.cumsum(size)[:-1])]


def _in_order_of_bins(root: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, depths: np.ndarray,
                      growth: Growth, bins: Bins, units: np.ndarray, given: np.ndarray | None = None) -> list[Grown]:
    """As ``_together``, where every feature is tried at every cut: rows are put in the order of each feature's bins once, and stay in
    it while nodes are split. The last few rows are left to ``_together``."""
    n_rows, n_out, first_named = len(root), y.shape[1], len(bins.ordered)
    x = np.asfortranarray(x)
    weighted = [np.ascontiguousarray(y[:, k] * w if given is None else y[:, k]) for k in range(n_out)]
    squares = ((y * units) ** 2).sum(axis=1) * w if given is None else given
    small = root.astype(np.uint16) if len(keys) <= 1 << 16 else root
    used = [f for f in range(x.shape[1]) if x[:, f].min() != x[:, f].max()]
    orders = {}
    for f in used:
        by_bin = np.argsort(x[:, f], kind="stable")
        orders[f] = by_bin[np.argsort(small[by_bin], kind="stable")]
    rows = np.arange(n_rows)  # those of nodes, in an order of their nodes
    owner, place, depth, size = np.arange(len(keys)), np.zeros(len(keys), np.int64), depths.copy(), np.ones(len(keys), np.int64)
    counts, found, later = np.bincount(root, minlength=len(keys)), [], []
    while len(owner):
        starts = np.cumsum(counts) - counts
        own = [v.take(rows) for v in weighted]
        total_n, total = np.add.reduceat(w.take(rows), starts), np.stack([np.add.reduceat(v, starts) for v in own], axis=1)
        spread = np.add.reduceat(squares.take(rows), starts)
        without = ((total * units) ** 2).sum(axis=1) / (total_n + growth.penalty)
        open_ = (spread - ((total * units) ** 2).sum(axis=1) / total_n > PURE * spread) & (
            total_n >= max(growth.split_rows, 2 * growth.leaf_rows))
        if growth.depth is not None:
            open_ &= depth < growth.depth
        means = total * units / np.maximum(total_n + growth.penalty, 1e-300)[:, None]
        feature, cut, left = np.full(len(owner), -1, np.int16), np.zeros(len(owner), np.int32), np.full(len(owner), -1, np.int64)
        gain = np.zeros(len(owner))
        # Nodes without a split go at once.
        at = np.flatnonzero(open_)
        if not open_.all():
            kept = np.repeat(open_, counts)
            closed = np.zeros(n_rows, bool)
            closed[rows[~kept]] = True
            rows = rows[kept]
            orders = {f: o[~closed.take(o)] for f, o in orders.items()}
        if len(at) and len(rows) <= FEW_ROWS:
            # Their own parts are grown in another way.
            later = [(int(owner[i]), int(place[i])) for i in at]
            node = np.repeat(np.arange(len(at)), counts[at])
            later = list(zip(later, _together(node, taken(x, rows), y[rows], w[rows], keys[at], depth[at], growth, bins, units,
                                               None if given is None else given[rows])))
            at = at[:0]
        if len(at):
            best = _best_in_order(x, orders, weighted, w, counts[at], total_n[at], total[at], growth, first_named, units)
            most, feature[at], cut[at] = best
            found_any = most >= 0
            if growth.penalty:
                found_any &= most > without[at] * (1 + 1e-12)
            gain[at] = np.where(found_any, most - without[at], 0.0)
            feature[at[~found_any]], cut[at[~found_any]] = -1, 0
            at = at[found_any]
        # The children of a root's nodes follow all that it has so far.
        by_owner = np.argsort(owner[at], kind="stable")
        many = np.bincount(owner[at], minlength=len(size))
        rank = np.empty(len(at), np.int64)
        rank[by_owner] = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        left[at] = size[owner[at]] + 2 * rank
        size += 2 * many
        found.append((owner, place, feature, cut, left, means, gain))
        if not len(at):
            break
        # Left children first, then the right ones: the rows of each side stay in their order.
        split = feature >= 0
        of = np.repeat(np.flatnonzero(open_), counts[open_])
        right = goes_right(x, np.maximum(feature, 0)[of], cut[of], first_named, rows)
        side = np.full(n_rows, 2, np.uint8)
        side[rows] = np.where(split[of], right, 2)
        rights = np.bincount(of[right & split[of]], minlength=len(owner))[at]
        counts = np.concatenate([counts[at] - rights, rights])
        move = lambda o: (lambda s: np.concatenate([o[s == 0], o[s == 1]]))(side.take(o))
        rows, orders = move(rows), {f: move(o) for f, o in orders.items()}
        owner, place, depth = np.tile(owner[at], 2), np.concatenate([left[at], left[at] + 1]), np.tile(depth[at] + 1, 2)
        keys = np.concatenate([child_keys(keys[at], 0), child_keys(keys[at], 1)])
    owner, place, *columns = (np.concatenate(p) for p in zip(*found))
    order = np.lexsort((place, owner))
    made = [Grown(*(c[part] for c in columns)) for part in np.split(order, np.cumsum(size)[:-1])]
    below: dict[int, list[tuple[int, Grown]]] = {}
    for (i, node), part in later:
        below.setdefault(i, []).append((node, part))
    return [_attached(tree, below.get(i, [])) for i, tree in enumerate(made)]


def _best_in_order(x: np.ndarray, orders: dict[int, np.ndarray], weighted: Sequence[np.ndarray], w: np.ndarray, counts: np.ndarray, total_n: np.ndarray,
                   total: np.ndarray, growth: Growth, first_named: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain or -1, feature, cut) of the best split of each node, of rows in the order of their nodes and bins for each feature."""
    n_nodes, starts = len(counts), np.cumsum(counts) - counts
    ends = starts + counts - 1
    before_n, before = np.cumsum(total_n) - total_n, np.cumsum(total, axis=0) - total
    alike = bool((w == 1).all())

    def gains(b: np.ndarray, order: np.ndarray, base_n, base, whole_n, whole, last: np.ndarray, named: bool):
        """The gain after each row, of whole nodes one after the other; ``last`` are their last rows."""
        if alike:
            run_n = np.arange(1.0, len(order) + 1)
        else:
            run_n = np.cumsum(w.take(order))
        runs_ = [np.cumsum(v.take(order)) for v in weighted]
        new = np.empty(len(order), bool)  # whether the next row is in another cell
        np.not_equal(b[1:], b[:-1], out=new[:-1])
        new[last] = True
        if named:
            # Each name against all others.
            at = np.flatnonzero(new)
            n = np.diff(run_n[at], prepend=0.0)
            sums = [np.diff(r[at], prepend=0.0) for r in runs_]
            whole_n, whole, tried = whole_n[at], [t[at] for t in whole], b[at] > 0
            left_n, left = whole_n - n, [t - s for t, s in zip(whole, sums)]
            right_n, right = n, sums
        else:
            new[last] = False
            left_n, left, tried = run_n - base_n, [r - s for r, s in zip(runs_, base)], new
            right_n, right = whole_n - left_n, [t - s for t, s in zip(whole, left)]
        here = there = None
        for a, c, unit in zip(left, right, units.tolist()):
            a, c = a * unit, c * unit
            a *= a
            c *= c
            here, there = (a, c) if here is None else (np.add(here, a, out=here), np.add(there, c, out=there))
        here /= left_n + growth.penalty if growth.penalty else left_n
        there /= right_n + growth.penalty if growth.penalty else right_n
        here += there
        if growth.leaf_rows > 1 or not alike or named:
            tried = tried & (left_n >= growth.leaf_rows) & (right_n >= growth.leaf_rows)
        here[~tried] = -1.0
        if not named:
            return here
        out = np.full(len(order), -1.0)
        out[at] = here
        return out

    spread = lambda v, counts: np.repeat(v, counts)
    base_n, whole_n = spread(before_n, counts), spread(total_n, counts)
    base, whole = ([spread(np.ascontiguousarray(v[:, k]), counts) for k in range(len(weighted))] for v in (before, total))
    most, feature = np.full(n_nodes, -1.0), np.full(n_nodes, -1, np.int16)
    with np.errstate(divide="ignore", invalid="ignore"):
        for f in sorted(orders):
            order = orders[f]
            found = gains(x[:, f].take(order), order, base_n, base, whole_n, whole, ends, f >= first_named)
            own = np.maximum.reduceat(found, starts)
            better = own > most
            most[better], feature[better] = own[better], f
        cut = np.zeros(n_nodes, np.int32)
        for f in np.unique(feature[feature >= 0]).tolist():
            # Where the node's best is, the first if it is there more than once.
            at = np.flatnonzero(feature == f)
            many = counts[at]
            first = np.cumsum(many) - many
            rows = np.arange(many.sum()) + np.repeat(starts[at] - first, many)
            order = orders[f].take(rows)
            b = x[:, f].take(order)
            sums_n = np.cumsum(total_n[at]) - total_n[at]
            sums = np.cumsum(total[at], axis=0) - total[at]
            found = gains(b, order, spread(sums_n, many), [spread(np.ascontiguousarray(sums[:, k]), many) for k in range(len(weighted))],
                          whole_n.take(rows), [t.take(rows) for t in whole], first + many - 1, f >= first_named)
            hit = np.flatnonzero(found == np.repeat(most[at], many))
            node = np.repeat(np.arange(len(at)), many)[hit]
            one = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            cut[at[node[one]]] = b[hit[one]]
    return most, feature, cut


def taken(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of bins, each feature's together."""
    return np.stack([x[:, f][rows] for f in range(x.shape[1])]).T


def _leaves_of(node: np.ndarray, y: np.ndarray, w: np.ndarray, n_nodes: int, growth: Growth, units: np.ndarray, summed: bool = False) -> Splits:
    """Nodes of which none is split."""
    n = np.bincount(node, w, n_nodes)
    total = np.stack([np.bincount(node, y[:, i] if summed else y[:, i] * w, n_nodes) for i in range(y.shape[1])], axis=1)
    means = total * units / np.maximum(n + growth.penalty, 1e-300)[:, None]
    none = np.zeros(n_nodes)
    return Splits(n, means, np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.int32), none, none)


def _stably(node: np.ndarray, right: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The order of the rows, which are in that of their nodes, by node and side, without the rows of leaves."""
    begins = np.searchsorted(node, np.arange(len(cut)))
    before = np.cumsum(right) - right
    lefts = np.bincount(node, ~right, len(cut)).astype(np.int64)
    rank = before - before[np.minimum(begins, len(node) - 1)][node]
    at = begins[node] + np.where(right, lefts[node] + rank, np.arange(len(node)) - begins[node] - rank)
    order = np.empty(len(node), np.int64)
    order[at] = np.arange(len(node))
    return order[cut[node]]


# Rows in blocks


@dataclass(frozen=True)
class Packed:
    """Training rows as blocks of bins, outputs and keys, with what turns outputs back into their units."""

    blocks: DataFrame
    bins: Bins
    outputs: tuple[str, ...]
    units: np.ndarray
    n_rows: int
    #: whether blocks hold a weight for each row
    weighted: bool = False

    def rows_of(self, cells: int) -> int:
        return max(1, cells // len(self.bins.columns()))

    def parts(self) -> dict[int, int]:
        """The rows of each part."""
        return {r["part"]: r["n"] for r in self.blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}

    def only(self, sizes: dict[int, int], parts: Sequence[int]) -> "Packed":
        """The rows of some parts."""
        return replace(self, blocks=self.blocks.filter(F.col("part").isin(list(parts))), n_rows=sum(sizes.get(p, 0) for p in parts))

    def points(self) -> int:
        """How many points of bins there can be."""
        return prod(max(1, len(v)) for v in (*self.bins.largest.values(), *self.bins.named.values()))

    def by_point(self) -> "Packed":
        """The rows with all of one point in one task."""
        bins, n_out, width = self.bins, len(self.outputs), len(self.bins.columns())
        spark = self.blocks.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, -(-self.n_rows // POINT_ROWS))

        def deal(batches):
            for x, y, key in _unpacked(batches, bins, n_out):
                to = (_mixed(_codes(x, bins)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        own = order[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[
                            pa.array([v[own].tobytes()], pa.binary()) for v in (x, y, key)]], ["part", "x", "y", "key"])

        def meet(batches):
            held: dict[int, list] = {}
            for batch in batches:
                for part, *values in zip(*(batch.column(c).to_pylist() for c in ("part", "x", "y", "key"))):
                    held.setdefault(part, []).append(values)
            for part in sorted(held):
                x, y, key = (b"".join(v) for v in zip(*held.pop(part)))
                # Rows of a point follow each other.
                order = np.argsort(_codes(np.frombuffer(x, bins.kind).reshape(-1, width), bins), kind="stable")
                x, y, key = np.frombuffer(x, bins.kind).reshape(-1, width), np.frombuffer(y, np.int32).reshape(-1, n_out), np.frombuffer(key, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int32()), *[
                    pa.array([v[order].tobytes()], pa.binary()) for v in (x, y, key)]], ["n", "x", "y", "key"])

        dealt = self.blocks.mapInArrow(deal, "part int, x binary, y binary, key binary")
        return replace(self, blocks=durable(dealt.repartition(parts, "part").mapInArrow(meet, "n int, x binary, y binary, key binary")))

    def one(self, output: int) -> "Packed":
        """The rows with one of their outputs."""
        bins, n_out = self.bins, len(self.outputs)

        def run(batches):
            for x, y, key in _unpacked(batches, bins, n_out):
                own = (x, np.ascontiguousarray(y[:, output]), key)
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in own], ["x", "y", "key"])

        return self if n_out == 1 else replace(
            self, blocks=self.blocks.mapInArrow(run, "x binary, y binary, key binary"), outputs=(self.outputs[output],),
            units=self.units[output:output + 1])


def _codes(x: np.ndarray, bins: Bins) -> np.ndarray:
    """A number for each point of bins."""
    out = np.zeros(len(x), np.uint64)
    for f, values in enumerate((*bins.largest.values(), *bins.named.values())):
        out = out * np.uint64(max(1, len(values))) + x[:, f].astype(np.uint64)
    return out


def pack(rows: DataFrame, bins: Bins, outputs: Sequence[str], key: Sequence[str], part: Column | None = None) -> Packed:
    """Blocks of the rows that have all features and outputs. ``key`` names the columns that tell rows apart. A block has rows
    of one ``part`` only, a small number."""
    columns = bins.columns()
    whole = rows.dropna(subset=[name_col(c) for c in [*columns, *outputs]]).select(
        *[F.col(name_col(c)) for c in columns], *[F.col(name_col(c)).cast("double").alias(f"_y{i}") for i, c in enumerate(outputs)],
        F.xxhash64(*[F.col(name_col(c)) for c in key]).alias("_key"), (F.lit(0) if part is None else part).cast("int").alias("_part"))
    about = whole.agg(F.count(F.lit(1)), *[F.max(F.abs(f"_y{i}")) for i in range(len(outputs))]).first()
    units = np.array([2.0 ** (frexp(m or 1.0)[1] - BITS) for m in about[1:]])

    def run(batches):
        for batch in batches:
            numbers = batch.column("_part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for at, end in ((at, min(at + BLOCK, b)) for a, b in zip(cuts, cuts[1:]) for at in range(a, b, BLOCK)):
                part = batch.slice(at, end - at)
                y = np.stack([part.column(f"_y{i}").to_numpy(zero_copy_only=False) for i in range(len(units))], axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([numbers[at]], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([bins.place(part).tobytes()], pa.binary()),
                    pa.array([np.rint(y / units).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([part.column("_key").to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["part", "n", "x", "y", "key"])

    return Packed(durable(whole.mapInArrow(run, "part int, n int, x binary, y binary, key binary")), bins, tuple(outputs), units, about[0])


def _unpacked(batches: Iterator[pa.RecordBatch], bins: Bins, outputs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for x, y, key in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "key"))):
            yield (np.frombuffer(x, bins.kind).reshape(-1, len(bins.columns())), np.frombuffer(y, np.int32).reshape(-1, outputs),
                   np.frombuffer(key, np.uint64))


def _joined(batches: Iterator[pa.RecordBatch], bins: Bins, outputs: int, weighted: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins, outputs, keys and weights of several blocks at once, so that what they have in common is added up in the task."""
    held, size = [], 0

    def whole():
        return tuple(np.concatenate(part) if len(part) > 1 else part[0] for part in zip(*held))

    for batch in batches:
        weights = batch.column("w").to_pylist() if weighted else [None] * batch.num_rows
        for parts, w in zip(_unpacked([batch], bins, outputs), weights):
            held.append((*parts, np.ones(len(parts[0])) if w is None else np.frombuffer(w, np.float64)))
            size += len(parts[0])
            if size * (len(bins.columns()) + 2 * outputs) >= JOINED_CELLS:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole (tree, node) groups of sorted rows, of about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "node"))
        cuts = [0, *(np.flatnonzero((np.diff(tree) != 0) | (np.diff(node) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            same = held and all(held[-1].column(c)[0] == part.column(c)[0] for c in ("tree", "node"))
            if held and not same and size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += rows(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass
class Top:
    """The part of a tree that is grown level by level. A leaf is a pair: a node that a task grows on from, or None,
    and otherwise the means."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    leaves: list[tuple[int | None, list[float]]]

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.int16), np.array(self.cut, np.int32), np.array(self.left, np.int32), np.zeros((len(self.leaves), 0)))


@dataclass(frozen=True)
class Plan:
    """All trees of a fit: tree t is number t % ``each`` of the forest of output group t // ``each``."""

    growth: Growth
    groups: tuple[tuple[int, ...], ...]

    @property
    def each(self) -> int:
        return self.growth.different()

    def trees(self) -> range:
        return range(len(self.groups) * self.each)

    def outputs(self, tree: int) -> tuple[int, ...]:
        return self.groups[tree // self.each]

    def weights(self, keys: np.ndarray, tree: int) -> np.ndarray:
        return self.growth.weights(keys, tree % self.each)

    def key(self, tree: int) -> np.ndarray:
        return _seeded(self.growth.seed + 1, tree % self.each)


def _level(packed: Packed, plan: Plan, tops: dict[int, Top], keys: dict[tuple[int, int], int], ends: bool = False) -> list:
    """A split, or none, for each open node: one aggregate of cells, one row per node back. Nodes that are not split any more
    (``ends``) need the cells of one feature only, which has all their rows."""
    n_out, first_named = len(packed.outputs), len(packed.bins.ordered)
    k = len(plan.groups[0])
    spark = packed.blocks.sparkSession
    sent = spark.sparkContext.broadcast({t: (top.tree(), np.array([-1 if a is None else a for a, _ in top.leaves])) for t, top in tops.items()})
    bins, units, growth, packed_weighted = packed.bins, packed.units, plan.growth, packed.weighted
    # Counts and sums are whole numbers, but for those of rows with weights.
    number, numbers = ("double", np.float64) if packed.weighted else ("long", np.int64)
    kinds = f"tree int, node int, feature int, bin int, squares double, n {number}, {', '.join(f's{i} {number}' for i in range(k))}"
    names = [part.split()[0] for part in kinds.split(", ")]

    def count(batches):
        for x, y, key, weight in _joined(batches, bins, n_out, packed_weighted):
            for tree, (top, asked) in sent.value.items():
                node = asked[top.leaf_of(x, first_named)]
                w = plan.weights(key, tree) * weight
                in_ = np.flatnonzero((node >= 0) & (w > 0))
                if not len(in_):
                    continue
                out = list(plan.outputs(tree))
                known, slot = np.unique(node[in_], return_inverse=True)
                cells = add_up(slot, (x[:, :1] if ends else x)[in_], y[in_][:, out].astype(np.float64), w[in_], units[out])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cells.n), tree, np.int32)), pa.array(known[cells.node].astype(np.int32)),
                    pa.array(cells.feature.astype(np.int32)), pa.array(cells.bin.astype(np.int32)), pa.array(cells.squares),
                    pa.array(cells.n.astype(numbers)), *[pa.array(cells.sums[:, i].astype(numbers)) for i in range(k)]], names)

    def choose(batches):
        for rows in _whole_groups(batches, lambda b: b.num_rows, CELLS):
            col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in names}
            code = col["tree"].astype(np.int64) << 32 | col["node"]
            known, slot = np.unique(code, return_inverse=True)
            order = np.lexsort((col["bin"], slot, col["feature"]))
            sums = np.stack([col[f"s{i}"] for i in range(k)], axis=1)[order].astype(np.float64)
            own = units[list(plan.groups[0])] if len(plan.groups) == 1 else None
            parts = []
            for group in sorted({int(c >> 32) // plan.each for c in known}):
                # Trees of one group have the same outputs and so the same units.
                here = np.flatnonzero((known >> 32) // plan.each == group)
                take = np.isin(slot[order], here)
                cells = Cells(col["feature"][order][take].astype(np.int16), np.searchsorted(here, slot[order][take]),
                              col["bin"][order][take], col["n"][order][take].astype(np.float64), sums[take], col["squares"][order][take])
                unit = units[list(plan.groups[group])] if own is None else own
                splits = best_splits(cells, np.array([keys[(int(c >> 32), int(c & 0xFFFFFFFF))] for c in known[here]], np.uint64), growth, bins, unit)
                parts.append((known[here], splits))
            for codes, s in parts:
                yield pa.RecordBatch.from_arrays([
                    pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(s.feature.astype(np.int32)),
                    pa.array(s.cut.astype(np.int32)), pa.array(s.n), pa.array(s.left_n),
                    pa.array(s.means.tolist(), pa.list_(pa.float64())), pa.array(s.gain)],
                    ["tree", "node", "feature", "cut", "n", "left_n", "mean", "gain"])

    cells = packed.blocks.mapInArrow(count, kinds).groupBy("tree", "node", "feature", "bin").agg(
        *[F.sum(c).alias(c) for c in names[4:]])
    return cells.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
        choose, "tree int, node int, feature int, cut int, n double, left_n double, mean array<double>, gain double").collect()


def _tops(packed: Packed, plan: Plan, node_rows: int, trees: range) -> tuple[dict[int, Top], dict[int, dict[int, tuple[int, int]]]]:
    """The upper parts of trees, and for each the (key, depth) of the nodes that tasks grow on from."""
    tops = {t: Top([-1], [0], [-1], [(0, [])]) for t in trees}
    about = {t: {0: (int(plan.key(t)[0]), 0)} for t in trees}
    if packed.n_rows <= node_rows:
        return tops, about
    open_ = {(t, 0) for t in trees}
    while open_:
        asked = {t: Top(top.feature, top.cut, top.left, [(a if (t, a) in open_ else None, v) for a, v in top.leaves])
                 for t, top in tops.items() if any((t, a) in open_ for a, _ in top.leaves)}
        rows = _level(packed, plan, asked, {(t, a): about[t][a][0] for t, a in open_})
        open_ = set()
        for r in rows:
            t, a = r["tree"], r["node"]
            top, (key, depth) = tops[t], about[t].pop(a)
            i = next(i for i, (b, _) in enumerate(top.leaves) if b == a)
            at = top.left.index(-1 - i)
            if r["feature"] < 0 or plan.growth.depth is not None and depth >= plan.growth.depth:
                top.leaves[i] = (None, r["mean"])
                continue
            top.feature[at], top.cut[at], top.left[at] = r["feature"], r["cut"], len(top.left)
            for side, n in enumerate((r["left_n"], r["n"] - r["left_n"])):
                # Leaf i becomes the left child; the right one is a new leaf.
                number = max([b for b, _ in top.leaves if b is not None], default=0) + 1
                leaf = i if side == 0 else len(top.leaves)
                top.leaves[leaf:leaf + 1] = [(number, [])]
                top.feature.append(-1)
                top.cut.append(0)
                top.left.append(-1 - leaf)
                about[t][number] = (int(child_keys(np.array([key], np.uint64), side)[0]), depth + 1)
                if n > node_rows:
                    open_.add((t, number))
    return tops, about


def fit_trees(packed: Packed, plan: Plan, node_rows: int | None = None, task_rows: int | None = None) -> tuple[DataFrame, dict[int, Top]]:
    """((tree, node, size, feature, cut, left, value), upper parts): what tasks grow below each node of an upper part."""
    node_rows, task_rows = node_rows or NODE_ROWS, task_rows or TASK_ROWS
    width, k = len(packed.bins.columns()), len(plan.groups[0])
    # Rows that no split can tell apart are one in each tree, where there are more rows than points.
    if 2 * packed.points() <= packed.n_rows and packed.points() <= node_rows and not packed.weighted:
        packed = packed.by_point()
        at_once, fit = max(1, int(DEAL_BYTES // (packed.points() * (np.dtype(packed.bins.kind).itemsize * width + 8 * k + 16)))), _fit_points
    else:
        at_once, fit = max(1, int(DEAL_BYTES // (packed.n_rows * (np.dtype(packed.bins.kind).itemsize * width + 4 * k + 1)))), _fit_some
    trees, parts, tops = plan.trees(), [], {}
    for some in (trees[i:i + at_once] for i in range(0, len(trees), at_once)):
        part, upper = fit(packed, plan, some, node_rows, task_rows)
        parts.append(part)
        tops |= upper
        if len(trees) > at_once:
            let_go(packed.blocks.sparkSession)
    return reduce(DataFrame.unionByName, parts), tops


def _fit_some(packed: Packed, plan: Plan, trees: range, node_rows: int, task_rows: int) -> tuple[DataFrame, dict[int, Top]]:
    """Some of the trees, whose rows are dealt all at once."""
    tops, about = _tops(packed, plan, node_rows, trees)
    width, n_out, first_named = len(packed.bins.columns()), len(packed.outputs), len(packed.bins.ordered)
    spark = packed.blocks.sparkSession
    sent = spark.sparkContext.broadcast({t: (top.tree(), np.array([-1 if a is None else a for a, _ in top.leaves])) for t, top in tops.items()})
    roots = spark.sparkContext.broadcast(about)
    bins, units, growth = packed.bins, packed.units, plan.growth

    def deal(batches):
        for x, y, key in _unpacked(batches, bins, n_out):
            for tree, (top, asked) in sent.value.items():
                node = asked[top.leaf_of(x, first_named)]
                w = plan.weights(key, tree)
                in_ = np.flatnonzero((node >= 0) & (w > 0))
                if not len(in_):
                    continue
                in_ = in_[np.argsort(node[in_], kind="stable")]
                cuts = [0, *(np.flatnonzero(np.diff(node[in_])) + 1).tolist(), len(in_)]
                out = list(plan.outputs(tree))
                yield pa.RecordBatch.from_arrays([
                    pa.array([tree] * (len(cuts) - 1), pa.int32()), pa.array(node[in_][cuts[:-1]].astype(np.int32)),
                    pa.array([b - a for a, b in zip(cuts, cuts[1:])], pa.int32()),
                    *[pa.array([part[in_[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
                      for part in (x, y[:, out], w.astype(np.uint8))]], ["tree", "node", "n", "x", "y", "w"])

    def finish(batches):
        for rows in _whole_groups(batches, lambda b: sum(b.column("n").to_pylist()), task_rows):
            code = rows.column("tree").to_numpy().astype(np.int64) << 32 | rows.column("node").to_numpy()
            known, slot = np.unique(code, return_inverse=True)
            owner = (known >> 32) // plan.each
            for group in np.unique(owner).tolist():
                mine = np.flatnonzero(owner == group)
                take = np.flatnonzero(np.isin(slot, mine))
                x, y, w = (b"".join(rows.column(c)[int(i)].as_py() for i in take) for c in ("x", "y", "w"))
                out = list(plan.groups[group])
                root = np.repeat(np.searchsorted(mine, slot[take]), rows.column("n").to_numpy()[take])
                places = [roots.value[int(c >> 32)][int(c & 0xFFFFFFFF)] for c in known[mine]]
                grown = [g.tree() for g in grow(root, np.frombuffer(x, bins.kind).reshape(-1, width), np.frombuffer(y, np.int32).reshape(-1, len(out)).astype(np.float64),
                             np.frombuffer(w, np.uint8).astype(np.float64), np.array([p[0] for p in places], np.uint64),
                             np.array([p[1] for p in places]), growth, bins, units[out])]
                yield pa.RecordBatch.from_arrays([
                    pa.array((known[mine] >> 32).astype(np.int32)), pa.array((known[mine] & 0xFFFFFFFF).astype(np.int32)),
                    pa.array([len(t.left) for t in grown], pa.int64()), *[pa.array([getattr(t, c).tobytes() for t in grown], pa.binary())
                                                                         for c in ("feature", "cut", "left", "value")]],
                    ["tree", "node", "size", "feature", "cut", "left", "value"])

    dealt = packed.blocks.mapInArrow(deal, "tree int, node int, n int, x binary, y binary, w binary")
    # Nodes of trees are dealt anew, so that few trees do not meet in the same task.
    below = dealt.repartition(_tasks(packed, len(trees), task_rows), "tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
        finish, "tree int, node int, size long, feature binary, cut binary, left binary, value binary")
    return durable(below), tops


def _fit_points(packed: Packed, plan: Plan, trees: range, node_rows: int, task_rows: int) -> tuple[DataFrame, dict[int, Top]]:
    """Some of the trees, each with the sums of its rows at each point; rows of a point follow each other in a block."""
    width, n_out, bins, units, growth = len(packed.bins.columns()), len(packed.outputs), packed.bins, packed.units, plan.growth

    def deal(batches):
        for x, y, key in _unpacked(batches, bins, n_out):
            codes = _codes(x, bins)
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            x, outputs = x[begins], [y[:, i].astype(np.float64) for i in range(n_out)]
            for tree in trees:
                out, w = plan.outputs(tree), plan.weights(key, tree)
                n = np.add.reduceat(w, begins)
                in_ = np.flatnonzero(n)
                sums = np.stack([np.add.reduceat(outputs[i] * w, begins)[in_] for i in out], axis=1)
                squares = np.add.reduceat(sum((outputs[i] * units[i]) ** 2 for i in out) * w, begins)[in_]
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([len(in_)], pa.int32()), *[
                    pa.array([v.tobytes()], pa.binary()) for v in (x[in_], sums, n[in_], squares)]], ["tree", "n", "x", "y", "w", "q"])

    def finish(batches):
        held: dict[int, list] = {}

        def grown(tree):
            x, y, w, q = (b"".join(v) for v in zip(*held.pop(tree)))
            out, w = list(plan.outputs(tree)), np.frombuffer(w, np.float64)
            x, y = np.frombuffer(x, bins.kind).reshape(-1, width), np.frombuffer(y, np.float64).reshape(-1, len(out))
            t = grow(np.zeros(len(w), np.int64), x, y, w, plan.key(tree), np.zeros(1, np.int64), growth, bins, units[out], np.frombuffer(q, np.float64))[0].tree()
            return pa.RecordBatch.from_arrays([
                pa.array([tree], pa.int32()), pa.array([0], pa.int32()), pa.array([len(t.left)], pa.int64()),
                *[pa.array([getattr(t, c).tobytes()], pa.binary()) for c in ("feature", "cut", "left", "value")]],
                ["tree", "node", "size", "feature", "cut", "left", "value"])

        for batch in batches:
            for tree, *parts in zip(*(batch.column(c).to_pylist() for c in ("tree", "x", "y", "w", "q"))):
                if held and tree not in held:
                    yield grown(next(iter(held)))
                held.setdefault(tree, []).append(parts)
        if held:
            yield grown(next(iter(held)))

    dealt = packed.blocks.mapInArrow(deal, "tree int, n int, x binary, y binary, w binary, q binary")
    below = dealt.repartition(_tasks(replace(packed, n_rows=packed.points()), len(trees), task_rows), "tree").sortWithinPartitions("tree").mapInArrow(
        finish, "tree int, node int, size long, feature binary, cut binary, left binary, value binary")
    return durable(below), {t: Top([-1], [0], [-1], [(0, [])]) for t in trees}


def _tasks(packed: Packed, n_trees: int, task_rows: int) -> int:
    """Tasks for so many rows of so many trees: a few for each core, and none with more than it takes on at once."""
    spark = packed.blocks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return max(min(4 * cores, n_trees), -(-packed.n_rows * n_trees // task_rows), 1)


class ForestModel:
    """Trees of one or several forests; each predicts its own outputs by the mean of its trees."""

    def __init__(self, below: DataFrame, tops: dict[int, Top], plan: Plan, bins: Bins, outputs: Sequence[str]):
        self.below, self.tops, self.plan, self.bins, self.outputs = below, tops, plan, bins, list(outputs)

    @classmethod
    def fit(cls, rows: DataFrame, ordered: Sequence[str], outputs: Sequence[str], key: Sequence[str], growth: Growth,
            named: dict[str, Sequence[str]] | None = None, together: bool = True, packed: Packed | None = None,
            node_rows: int | None = None, task_rows: int | None = None) -> "ForestModel":
        """``together``: one forest whose trees predict all outputs at once, else a forest for each output."""
        packed = packed or pack(rows, fit_bins(rows, ordered, named), outputs, key)
        all_ = tuple(range(len(outputs)))
        plan = Plan(growth, (all_,) if together else tuple((i,) for i in all_))
        if not packed.n_rows:
            raise ValueError("no rows to train on")
        below, tops = fit_trees(packed, plan, node_rows, task_rows)
        return cls(below, tops, plan, packed.bins, outputs)

    def _whole(self, rows: list, tree: int) -> Tree:
        """A tree out of its upper part and what was grown below it."""
        top, k = self.tops[tree], len(self.plan.outputs(tree))
        # Models that were saved before have small cuts.
        cut_of = lambda r: np.int32 if len(r["cut"]) == 2 * len(r["feature"]) else np.int16
        below = {r["node"]: Tree(*(np.frombuffer(r[c], kind) for c, kind in (("feature", np.int16), ("cut", cut_of(r)), ("left", np.int32))),
                                 np.frombuffer(r["value"], np.float64).reshape(-1, k)) for r in rows}
        feature, cut, left, value = [np.array(top.feature, np.int16)], [np.array(top.cut, np.int32)], [np.array(top.left, np.int32)], []
        size, leaves = len(top.left), 0
        first = feature[0], cut[0], left[0]
        for i, (node, means) in enumerate(top.leaves):
            at = int(np.flatnonzero(first[2] == -1 - i)[0]) if i < len(top.leaves) else 0
            if node is None:
                value.append((at, np.array([means], np.float64), None))
            else:
                value.append((at, below[node].value, below[node]))
        values = []
        for at, means, sub in value:
            if sub is None or len(sub.left) == 1:
                first[2][at] = -1 - leaves
            else:
                # The root of the part takes the leaf's place, its other nodes follow.
                links = np.where(sub.left >= 0, sub.left - 1 + size, sub.left - leaves).astype(np.int32)
                first[0][at], first[1][at], first[2][at] = sub.feature[0], sub.cut[0], links[0]
                feature.append(sub.feature[1:])
                cut.append(sub.cut[1:])
                left.append(links[1:])
                size += len(sub.left) - 1
            values.append(means)
            leaves += len(means)
        return Tree(np.concatenate(feature), np.concatenate(cut), np.concatenate(left), np.concatenate(values))

    def transform(self, df: DataFrame, output: str = "predictions") -> DataFrame:
        """Adds an array with a prediction per output. Trees that a task can hold go to the rows; of more, a task holds a part
        and the rows go to the parts."""
        spark = df.sparkSession
        sizes = {r["tree"]: r["bytes"] for r in self.below.groupBy("tree").agg(
            F.sum(F.length("value") + 8 * F.col("size")).alias("bytes")).collect()}
        parts, held = [[]], 0
        for t in self.plan.trees():
            if parts[-1] and held + sizes.get(t, 0) > TREE_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(t)
            held += sizes.get(t, 0)
        if len(parts) > 1:
            return self._by_parts(df, parts, sizes, output)
        outputs, first_named, bins, plan = len(self.outputs), len(self.bins.ordered), self.bins, self.plan
        kinds = [*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))]
        rows = df.withColumn(output, F.array(*[F.lit(0.0)] * outputs))

        def add(sent, batches):
            for batch in batches:
                x = bins.place(batch)
                total = batch.column(output).flatten().to_numpy(zero_copy_only=False).reshape(-1, outputs).copy()
                for tree, whole in sent.value.items():
                    total[:, list(plan.outputs(tree))] += whole.value[whole.leaf_of(x, first_named)] / plan.each
                sums = pa.ListArray.from_arrays(np.arange(0, total.size + 1, outputs, dtype=np.int32), total.reshape(-1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sums], batch.schema.names)

        found: dict[int, list] = {}
        for r in self.below.collect():  # no more than TREE_BYTES, or one tree
            found.setdefault(r["tree"], []).append(r)
        sent = spark.sparkContext.broadcast({t: self._whole(found.get(t, []), t) for t in parts[0]})
        return rows.mapInArrow(partial(add, sent), T.StructType(kinds))

    def _by_parts(self, df: DataFrame, parts: list[list[int]], sizes: dict[int, int], output: str) -> DataFrame:
        """Blocks of rows meet each part of the trees in a task, as many parts at once as ``ROUND_BYTES`` have, and the parts'
        sums are added in the order of the parts."""
        spark, outputs, first_named, bins, plan = df.sparkSession, len(self.outputs), len(self.bins.ordered), self.bins, self.plan
        width, whole_tree = len(bins.columns()), ForestModel(None, self.tops, plan, bins, self.outputs)._whole
        rows = durable(df.withColumn("_asked", F.monotonically_increasing_id()))

        def place(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([
                    batch.column("_asked").slice(0, 1), pa.array([batch.column("_asked").to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                    pa.array([bins.place(batch).tobytes()], pa.binary())], ["block", "asked", "x"])

        def ask(batches):
            part, trees, waiting = None, {}, {}
            for batch in batches:
                for r in batch.to_pylist():
                    if r["part"] != part:
                        part, trees, waiting = r["part"], {}, {}
                    if r["x"] is None:
                        waiting.setdefault(r["tree"], []).append(r)
                        continue
                    if not trees:
                        trees = {t: whole_tree(waiting.pop(t, []), t) for t in parts[part]}
                    x = np.frombuffer(r["x"], bins.kind).reshape(-1, width)
                    total = np.zeros((len(x), outputs))
                    for tree, whole in trees.items():
                        total[:, list(plan.outputs(tree))] += whole.value[whole.leaf_of(x, first_named)] / plan.each
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([part], pa.int32()),
                                                      pa.array([total.tobytes()], pa.binary())], ["block", "part", "sums"])

        def add_up_(batches):
            for batch in batches:
                for block, found in zip(batch.column("block").to_pylist(), batch.column("found").to_pylist()):
                    total = sum(np.frombuffer(f["sums"], np.float64) for f in sorted(found, key=lambda f: f["part"]))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([min(f["part"] for f in found)], pa.int32()),
                                                      pa.array([total.tobytes()], pa.binary())], ["block", "part", "sums"])

        def added(sums: DataFrame) -> DataFrame:
            return sums.groupBy("block").agg(F.collect_list(F.struct("part", "sums")).alias("found")).mapInArrow(
                add_up_, "block long, part int, sums binary")

        def write(batches):
            for batch in batches:
                for asked, sums in zip(batch.column("asked").to_pylist(), batch.column("sums").to_pylist()):
                    total = pa.array(np.frombuffer(sums, np.float64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.frombuffer(asked, np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(total) + 1, outputs, dtype=np.int32), total)], ["_asked", output])

        blocks = durable(rows.select("_asked", *[F.col(name_col(c)) for c in bins.columns()]).mapInArrow(place, "block long, asked binary, x binary"))
        rounds, held = [[]], 0
        for i, part in enumerate(parts):
            size = sum(sizes.get(t, 0) for t in part)
            if rounds[-1] and held + size > ROUND_BYTES:
                rounds.append([])
                held = 0
            rounds[-1].append(i)
            held += size
        done = []
        for numbers in rounds:
            first, last = parts[numbers[0]][0], parts[numbers[-1]][-1]
            begins = [parts[i][0] for i in numbers]
            # A tree is in the last part that does not begin after it.
            part = F.lit(numbers[0] - 1) + sum((F.col("tree") >= b).cast("int") for b in begins)
            trees = self.below.filter(F.col("tree").between(first, last)).select(
                part.alias("part"), "tree", "node", "feature", "cut", "left", "value", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("x"))
            asked = blocks.select(F.explode(F.array(*[F.lit(i) for i in numbers])).alias("part"), "block", "x")
            both = trees.unionByName(asked, allowMissingColumns=True)
            sums = both.repartition(len(numbers), "part").sortWithinPartitions("part", F.col("block").asc_nulls_first(), "tree", "node").mapInArrow(
                ask, "block long, part int, sums binary")
            done.append(durable(added(sums)))
            if len(rounds) > 1:
                let_go(spark)
        answers = blocks.select("block", "asked").join(added(reduce(DataFrame.unionByName, done)), "block").select("asked", "sums").mapInArrow(
            write, T.StructType([T.StructField("_asked", T.LongType()), T.StructField(output, T.ArrayType(T.DoubleType()))]))
        return rows.join(answers, "_asked").drop("_asked")

    def save(self, path: str) -> None:
        self.below.write.mode("overwrite").parquet(f"{path}/trees")
        about = json.dumps({
            "tops": {t: asdict(top) for t, top in self.tops.items()}, "growth": asdict(self.plan.growth), "groups": self.plan.groups,
            "bins": asdict(self.bins), "outputs": self.outputs})
        self.below.sparkSession.createDataFrame([(about,)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ForestModel":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        tops = {int(t): Top(top["feature"], top["cut"], top["left"], [tuple(x) for x in top["leaves"]]) for t, top in about["tops"].items()}
        plan = Plan(Growth(**about["growth"]), tuple(tuple(g) for g in about["groups"]))
        return cls(spark.read.parquet(f"{path}/trees"), tops, plan, Bins(**about["bins"]), about["outputs"])
