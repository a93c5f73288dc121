"""Packing pieces of known length into sequences of fixed size.

The plan is made on the counts of each length, of which there are at most as many as a sequence
has tokens, so it costs the same for any corpus: the longest pieces first, their gap filled exactly by
a piece, a pair or a triple whose lengths sum to it, as often as there are such pieces; what is left goes
into the fullest sequence it fits. The plan is a list of patterns (lengths, how often). Each piece then
finds its place by its rank among those of its length, which a few counts per length give.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from airspan.session import durable

# Pieces of one length that are ranked together.
BUCKET_ROWS = 20_000


def _exact_fill(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three lengths that are there and sum to the gap, longest first."""
    if left[gap]:
        return (gap,)
    low = np.arange(1, gap // 2 + 1)
    pairs = np.flatnonzero((left[low] > 0) & (left[gap - low] > (low == gap - low)))
    if len(pairs):
        a = int(low[pairs[0]])
        return (gap - a, a)
    for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
        if not left[a]:
            continue
        rest = gap - a
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        need_b, need_c = 1 + (b == a).astype(int), 1 + (rest - b == b) + ((rest - b == a) & (b != a))
        need_c = np.where((b == a) & (rest - b == a), 3, need_c)
        ok = np.flatnonzero((left[b] >= need_b) & (left[rest - b] >= need_c))
        if len(ok):
            return (a, int(b[ok[0]]), int(rest - b[ok[0]]))
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use every piece once; no pattern is longer than ``size``."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: Counter = Counter()
    open_: list[tuple[tuple[int, ...], int]] = []
    for length in range(size, 0, -1):
        while left[length]:
            gap = size - length
            left[length] -= 1
            fill = _exact_fill(gap, left) if gap else ()
            left[length] += 1
            if fill is None:
                break
            need = Counter((length, *fill))
            times = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                left[x] -= times * k
            patterns[(length, *fill)] += times
        if left[length]:
            open_.append(((length,), int(left[length])))
            left[length] = 0
    # What has no exact complement: best fit, longest first, into the smallest gap that takes it.
    gaps: dict[int, list] = defaultdict(list)
    for (length,), n in open_:
        while n:
            gap = next((g for g in range(length, size + 1) if gaps.get(g)), None)
            if gap is None:
                per = size // length
                for k, times in ((per, n // per), (n % per, 1)):
                    if k and times:
                        gaps[size - k * length].append(((length,) * k, times))
                break
            pattern, m = gaps[gap].pop()
            times = min(m, n)
            if m > times:
                gaps[gap].append((pattern, m - times))
            gaps[gap - length].append(((*pattern, length), times))
            n -= times
    for found in gaps.values():
        for pattern, n in found:
            patterns[pattern] += n
    return sorted(patterns.items(), reverse=True)


def _slots(patterns: Iterable[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence, offset): the pieces of a length ranked first..last go to the
    sequences that begin at ``sequence``, one to each."""
    slots, used, begun = [], Counter(), 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times, begun, at))
            used[length] += times
            at += length
        begun += times
    return slots


def pack(pieces: DataFrame, size: int = 1024, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to the rows: gapless sequences of at most ``size`` tokens, each row
    in one of them. Every length must be from 1 to ``size``. The rows are saved once, as the ranks
    count on their order not to change. Numbers are given out in no particular order."""
    # A bucket is a few neighbouring places of one task's rows, so a length that a third of all pieces
    # have is ranked by many tasks.
    rows = durable(pieces.withColumn("_place", F.monotonically_increasing_id()))
    bucket = F.xxhash64("_place")
    total = rows.count()
    parts = max(1, total // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(bucket, F.lit(parts)))
    counts = durable(rows.groupBy(length, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    per_length = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("_n")).collect()}
    patterns = plan(per_length, size)
    slots = pieces.sparkSession.createDataFrame(_slots(patterns), "_l long, _first long, _last long, _begun long, _at long")
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = rows.join(starts, [length, "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(length, "_bucket").orderBy("_place")) - 1)
    # The plan has a few thousand rows at most, however many pieces there are.
    placed = ranked.join(F.broadcast(slots), (F.col(length) == F.col("_l")) & (F.col("_rank") >= F.col("_first"))
                         & (F.col("_rank") < F.col("_last")))
    return placed.withColumn("sequence_id", F.col("_begun") + F.col("_rank") - F.col("_first")).withColumn(
        "offset", F.col("_at")).drop(
        "_place", "_bucket", "_before", "_rank", "_l", "_first", "_last", "_begun", "_at")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, from the rows of ``pack`` with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x.ids)).alias("ids"))
