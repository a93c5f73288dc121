"""Hard negatives: rows of another label that score just below a positive of an anchor.

Scores are integer inner products, taken tile by tile: a tile of anchors times a tile of candidates by
Strassen's recursion on int64, with zero padding to even sides. All sums and products are exact.

1. Positives: anchors meet the candidates of their own label only. Each tile keeps the best five of an anchor in
   a sorted heap, heaps of later tiles are merged in, and those of different tasks by rank.
2. Negatives: the scores of an anchor's positives give a window each. Anchors meet all candidates, and a heap
   of three for each anchor and positive keeps the best scores inside the window, merged in the same way.

Anchors and candidates are dealt into blocks of bounded size, so no task holds more than two blocks, whatever
the sizes of the labels; a heap is all that a task gives on for an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from airspan.llm.groups import map_group_batches
from airspan.session import durable

POSITIVES, NEGATIVES = 5, 3
# Rows of a block: anchors, whose number says how often candidates are sent, and candidates.
ANCHORS, CANDIDATES = 32768, 8192
# Rows of a tile that is multiplied at once.
TILE_ANCHORS, TILE_CANDIDATES = 256, 4096
# A side of at most so many is multiplied directly.
LEAF = 32
NONE = np.iinfo(np.int64).min


def strassen(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices by seven products of their quarters, padded with zeros to even sides."""
    n, d, m = x.shape[0], x.shape[1], y.shape[1]
    if min(n, d, m) <= LEAF:
        return x @ y
    if n % 2 or d % 2:
        x = np.pad(x, ((0, n % 2), (0, d % 2)))
    if d % 2 or m % 2:
        y = np.pad(y, ((0, d % 2), (0, m % 2)))
    h, k, w = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
    a, b, c, e = x[:h, :k], x[:h, k:], x[h:, :k], x[h:, k:]
    p, q, r, s = y[:k, :w], y[:k, w:], y[k:, :w], y[k:, w:]
    m1 = strassen(a + e, p + s)
    m2 = strassen(c + e, p)
    m3 = strassen(a, q - s)
    m4 = strassen(e, r - p)
    m5 = strassen(a + b, s)
    m6 = strassen(c - a, p + q)
    m7 = strassen(b - e, r + s)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w] = m1 + m4 - m5 + m7
    out[:h, w:] = m3 + m5
    out[h:, :w] = m2 + m4
    out[h:, w:] = m1 - m2 + m3 + m6
    return out[:n, :m]


class Heaps:
    """The best ``size`` scores of each of ``n`` rows with their ids: higher scores first, ties by smaller id."""

    def __init__(self, n: int, size: int):
        self.score = np.full((n, size), NONE)
        self.id = np.zeros((n, size), np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        size = self.score.shape[1]
        rows = np.unique(row)
        old = self.score[rows] != NONE
        row = np.concatenate([row, np.repeat(rows, size)[old.reshape(-1)]])
        score = np.concatenate([score, self.score[rows][old]])
        ids = np.concatenate([ids, self.id[rows][old]])
        order = np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < size
        self.score[row[keep], rank[keep]] = score[keep]
        self.id[row[keep], rank[keep]] = ids[keep]

    def worst(self) -> np.ndarray:
        """The score that a full heap gives up next; the least number where there is room."""
        return self.score[:, -1]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), max(int(sizes.max(initial=0)), 1)), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(anchors: np.ndarray, vectors: np.ndarray):
    """(first anchor, first candidate, scores) of all tiles; the first tiles of an anchor are small, so that its heaps
    are full early."""
    width = max(anchors.shape[1], vectors.shape[1])
    x = np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
    y = np.ascontiguousarray(np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))).T)
    for i in range(0, len(x), TILE_ANCHORS):
        j, step = 0, 64
        while j < y.shape[1]:
            yield i, j, strassen(x[i: i + TILE_ANCHORS], y[:, j: j + step])
            j, step = j + step, min(4 * step, TILE_CANDIDATES)


def _columns(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy(zero_copy_only=False) for c in names]


def _each_group(each, schema: str):
    """``each`` (anchors, candidates) over the groups of a batch; both sides are sorted by id."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        group, side = _columns(rows, "group", "side")
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            middle = a + int(np.searchsorted(side[a:b], 1))
            if a < middle < b:
                found.append(each(rows.slice(a, middle - a), rows.slice(middle, b - middle)))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    return run


def _positives(anchors: pa.RecordBatch, rows: pa.RecordBatch) -> tuple:
    (own,), (ids,) = _columns(anchors, "vec_id"), _columns(rows, "vec_id")
    heaps = Heaps(len(own), POSITIVES)
    for i, j, score in _tiles(_matrix(anchors.column("q")), _matrix(rows.column("q"))):
        part = own[i: i + len(score)]
        # Within a tile and over tiles ids go up, so that an equal score later on is no better.
        take = score > heaps.worst()[i: i + len(score), None]
        take &= part[:, None] != ids[None, j: j + score.shape[1]]
        r, c = np.nonzero(take)
        if len(r):
            heaps.add(r + i, score[r, c], ids[c + j])
    r, k = np.nonzero(heaps.score != NONE)
    return own[r], heaps.id[r, k], heaps.score[r, k]


def _negatives(anchors: pa.RecordBatch, rows: pa.RecordBatch) -> tuple:
    own, label = _columns(anchors, "vec_id", "label")
    ids, labels = _columns(rows, "vec_id", "label")
    lists = anchors.column("positives")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    parts = lists.flatten()
    positive, best = (parts.field(k).to_numpy(zero_copy_only=False) for k in ("positive_id", "positive_score"))
    begin = np.cumsum(size) - size
    # 50 * best <= 100 * score <= 95 * best, rounded inwards.
    low, high = -(-best // 2), best + -best // 20
    heaps = Heaps(len(positive), NEGATIVES)
    for i, j, score in _tiles(_matrix(anchors.column("q")), _matrix(rows.column("q"))):
        other = label[i: i + len(score), None] != labels[None, j: j + score.shape[1]]
        for k in range(POSITIVES):
            here = np.flatnonzero(size[i: i + len(score)] > k)
            at = begin[here + i] + k
            least = np.maximum(low[at], heaps.worst()[at] + 1)
            s = score[here]
            r, c = np.nonzero((s >= least[:, None]) & (s <= high[at][:, None]) & other[here])
            if len(r):
                heaps.add(at[r], s[r, c], ids[c + j])
    r, k = np.nonzero(heaps.score != NONE)
    return np.repeat(own, size)[r], positive[r], best[r], heaps.id[r, k], heaps.score[r, k]


def _met(anchors: DataFrame, rows: DataFrame, key: tuple[str, ...], more: tuple[str, ...]) -> DataFrame:
    """(group, side, ...): every block of anchors with every block of candidates of the same key."""
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    one = [F.lit(0).alias("_all"), *key]
    counted = anchors.select(*one).groupBy("_all", *key).agg(F.count(F.lit(1)).alias("n_a")).join(
        rows.select(*one).groupBy("_all", *key).agg(F.count(F.lit(1)).alias("n_c")), ["_all", *key])
    counted = durable(counted.select(*key, "_all", blocks("n_a", ANCHORS).alias("_ga"), blocks("n_c", CANDIDATES).alias("_gc")))
    empty = {c: F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>") for c in more}

    def side(df: DataFrame, number: int, own: str, other: str) -> DataFrame:
        df = df.withColumn("_all", F.lit(0)).join(counted, ["_all", *key])
        df = df.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own))
        pair = (mine, F.col("_o")) if number == 0 else (F.col("_o"), mine)
        return df.select(F.xxhash64(*key, *pair).alias("group"), F.lit(number).alias("side"), "vec_id", "label", "q",
                         *(F.col(c) if c in df.columns else empty[c].alias(c) for c in more))

    return side(anchors, 0, "_ga", "_gc").unionByName(side(rows, 1, "_gc", "_ga"))


def _ranked(found: DataFrame, by: tuple[str, ...], score: str, ids: str, size: int) -> DataFrame:
    """The best ``size`` rows of each heap, numbered from 1; each task keeps no more than that of what it has."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ids))
    return found.withColumn("rank", place).filter(F.col("rank") <= size)


def quantized(rows: DataFrame, vec_id: Column, label: Column, vector: Column) -> DataFrame:
    """(vec_id, label, q): q is floor(256 * x) of each component; rows that take no part are left out."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("q")))


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str | Column = "label",
                   vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. A row's
    score is its inner product with the anchor, of the components floor(256 * x); a shorter vector counts as
    filled up with zeros. Higher scores come first, ties by smaller id. ``anchor``, an expression on
    ``vec_id``, marks the anchors. An anchor's positives are its first five other rows of the same label, fewer
    if there are no more; each gets the first three rows of other labels whose score is at least half and at
    most 95 % of the positive's. Of rows with the same id the one with the smallest label and then vector
    counts. Scores must fit 64 bits, or an ArithmeticError is raised. Other columns are not looked at."""
    label = F.col(label) if isinstance(label, str) else label
    all_ = quantized(rows, F.col(vec_id), label, F.col(vector))
    repeated = all_.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id")
    if not repeated.isEmpty():
        one = all_.join(repeated, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")
        all_ = all_.join(repeated, "vec_id", "left_anti").unionByName(one)
    all_ = durable(all_)
    # By Cauchy and Schwarz no score is larger than the largest squared length.
    longest = all_.agg(F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0]
    if longest is not None and longest >= 2.0**63:
        raise ArithmeticError("an inner product may be beyond 64 bits")
    anchors = all_.filter(anchor)
    schema = "anchor_id long, positive_id long, positive_score long"
    near = map_group_batches(_met(anchors, all_, ("label",), ()), _each_group(_positives, schema), schema, ("side", "vec_id"))
    positives = _ranked(near, ("anchor_id",), "positive_score", "positive_id", POSITIVES).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    asked = durable(anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = map_group_batches(_met(asked, all_, (), ("positives",)), _each_group(_negatives, schema), schema, ("side", "vec_id"))
    return _ranked(found, ("anchor_id", "positive_id"), "negative_score", "negative_id", NEGATIVES).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
