"""Work within groups of rows, where a group may be too large for one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.graph import components
from airspan.session import durable


def map_group_batches(rows: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                      order: tuple[str, ...] = ()) -> DataFrame:
    """``each`` over batches of whole groups, sorted by ``group`` and ``order``; a group is never split.

    One shuffle by the group; a task holds one batch, or one group where that is larger."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("group").to_numpy(zero_copy_only=False)
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or held and held[-1].column("group")[-1].as_py() != keys[0]:
                parts = [*held, batch.slice(0, cut)]
                found = each(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                if found is not None:
                    yield found
                held = []
            held.append(batch.slice(cut))
        if held:
            found = each(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if found is not None:
                yield found

    return rows.repartition("group").sortWithinPartitions("group", *order).mapInArrow(run, schema)


def map_groups(rows: DataFrame, each: Callable[[pa.RecordBatch], list[tuple]], schema: str,
               order: tuple[str, ...] = ()) -> DataFrame:
    """``each`` over the rows of every value of ``group``, its results as rows of ``schema``."""
    names = [part.split()[0] for part in schema.split(",")]

    def all_of(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = rows.column("group").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        found = [x for a, b in zip(cuts, cuts[1:]) for x in each(rows.slice(a, b - a))]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found))))) if found else None

    return map_group_batches(rows, all_of, schema, order)


class Parts:
    """The connected parts of the rows of one group."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.part = np.arange(len(ids))

    def join(self, i: int, others: np.ndarray) -> None:
        """Joins row i with the other rows."""
        parts = np.unique(self.part[others])
        if len(parts) > 1 or len(parts) and parts[0] != self.part[i]:
            self.part[np.isin(self.part, parts)] = self.part[i]

    def links(self) -> list[tuple[int, int]]:
        """Each row's id with the smallest id of its part: as few as can be, and short ways between them."""
        order = np.lexsort((self.ids, self.part))
        part, ids = self.part[order], self.ids[order]
        head = np.maximum.accumulate(np.where(np.append(True, part[1:] != part[:-1]), np.arange(len(part)), 0))
        return [(int(a), int(b)) for a, b in zip(ids, ids[head]) if a != b]


def linked_within(rows: DataFrame, key: str, weight: Column, most: int,
                  each: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """(a, b): links that join all rows of each key that ``each`` finds alike, few as they are.

    ``rows`` has an ``id`` (long) and what ``each`` needs. Keys of up to ``most`` weight are
    one group each. Larger ones are looked at in two rounds, so that the rows sent grow with the key and not with
    its square: first blocks of the key, each with the key's first row; then only rows that the first round has
    not joined to that row go to all other blocks and meet the rows they are not joined with. Any two rows
    of a key thus meet in a task or are joined already, and no pairs are given out.

    ``each(rows, part, asked)`` gets the rows of a group sorted by id, numbers of the parts already joined, and which
    rows are asked about: of two rows, one at least must be, and both must be of different parts."""
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"), F.min("id").alias("_first")).filter("_n > 1")
    sized = durable(total.withColumn("_blocks", F.ceil(F.col("_w") / most).cast("long")))
    names = [c for c in rows.columns if c not in (key, "id")]

    def found(split: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch) -> list[tuple]:
            part, asked = batch.column("part").to_numpy(zero_copy_only=False), batch.column("asked").to_numpy(zero_copy_only=False)
            return each(batch, part, asked)
        return map_groups(split.select("group", "id", "part", "asked", *names), run, "a long, b long", ("id",)).distinct()

    few = rows.join(sized.filter("_blocks = 1").select(key), key)
    links = found(few.select("*", F.xxhash64(key).alias("group"), F.col("id").alias("part"), F.lit(True).alias("asked")))
    sized = sized.filter("_blocks > 1")
    if sized.isEmpty():
        return links
    many = durable(rows.join(sized.select(key, "_blocks", "_first"), key).withColumn("_b", F.pmod(F.xxhash64("id"), "_blocks")))
    # The first row of a key is in all of its blocks.
    everywhere = F.when(F.col("id") == F.col("_first"), F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(F.array("_b"))
    first = durable(found(many.withColumn("_b", F.explode(everywhere)).select(
        "*", F.xxhash64(key, "_b").alias("group"), F.col("id").alias("part"), F.lit(True).alias("asked"))))
    links = links.unionByName(first)
    of = durable(components(first).select(F.col("node").alias("id"), F.col("component").alias("_of")))
    parted = many.join(of, "id", "left").withColumn("part", F.coalesce("_of", "id")).drop("_of")
    heads = sized.select(key, F.col("_first").alias("id")).join(of, "id", "left").select(
        key, F.coalesce("_of", "id").alias("_main"))
    parted = durable(parted.join(heads, key).withColumn("asked", F.col("part") != F.col("_main")))
    # Rows joined to the first one are done, unless a row that is not could be like them.
    loose = parted.filter("asked").groupBy(key).agg(F.ceil(F.sum(weight) / most).cast("long").alias("_chunks"))
    parted = parted.join(loose, key)
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), "_chunks")
    # An asked row goes to all blocks; every row goes, in its own block, to all chunks of asked rows.
    asked = parted.filter("asked").select(
        "*", chunk.alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_at"))
    others = parted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_c"), F.col("_b").alias("_at"))
    others = others.filter(~F.col("asked") | (F.col("_c") != chunk)).withColumn("asked", F.lit(False))
    return links.unionByName(found(asked.unionByName(others).withColumn("group", F.xxhash64(key, "_at", "_c"))))


def joining_links(rows: pa.RecordBatch, part: np.ndarray, asked: np.ndarray,
                  alike: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple]:
    """Links between the rows that ``alike(i, others)`` finds, looked for only among rows not joined yet."""
    ids = rows.column("id").to_numpy(zero_copy_only=False)
    parts = Parts(ids)
    parts.part = np.unique(part, return_inverse=True)[1].astype(np.int64)
    was = parts.part.copy()
    for i in np.flatnonzero(asked):
        others = np.flatnonzero((parts.part != parts.part[i]) & (~asked | (np.arange(len(ids)) > i)))
        if len(others):
            parts.join(i, others[alike(i, others)])
    # Rows that were of one part need no link again.
    links = parts.links()
    before = dict(zip(ids.tolist(), was.tolist()))
    return [(a, b) for a, b in links if before[a] != before[b]]
