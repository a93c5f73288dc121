"""Near-duplicate documents: MinHash bands find candidates, odd sketches thin them out, and the
full shingle sets decide.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with the same
set form a class, and only one of each class goes on. MinHash values in bands of ``ROWS`` put
similar sets into the same buckets. A pair with similarity 0.8 shares none of the ``BANDS`` buckets
with probability (1 - 0.8^6)^40 = 5e-6.

The odd sketch of a set is a bitmap in which each MinHash sample flips one bit, so that the XOR of
two sketches is the odd sketch of the samples that differ, and its population count tells how many
differ: similarity = 1 + BITS / (4 * HASHES) * ln(1 - 2 * ones / BITS). A pair estimated far below the
threshold is not compared further; the margin is five standard deviations.

No bucket is expanded into rows of pairs. Tasks compare the sketches of a bucket, and then the full
sets of a cluster, in memory, and give back only the links that join separate parts. A large bucket or
cluster is looked at in rounds, so that the rows sent grow with it and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspan.llm.graph import components
from airspan.llm.groups import joining_links, linked_within
from airspan.llm.text import hashes_of, list_column, mixed, shingles, slices, word_codes
from airspan.session import durable

BANDS, ROWS, BITS = 40, 6, 1024
HASHES = BANDS * ROWS
# The two arrays of random numbers behind the hash functions, the same on every executor.
_RNG = np.random.default_rng(20240229)
XORS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
ODDS = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
# Shingles hashed at a time, which bounds the work arrays for a very long text.
CHUNK = 4096
# Documents of a bucket, and shingles of a cluster, that one block holds; a task holds two blocks.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1_000_000


def _minhash(values: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    folded = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(folded), CHUNK):
        block = (folded[None, i: i + CHUNK] ^ XORS[:, None]) * ODDS[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def _bands(low: np.ndarray) -> np.ndarray:
    out = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for row in low.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out


def _odd_sketch(low: np.ndarray) -> np.ndarray:
    sample = mixed(low.astype(np.uint64) * np.uint64(HASHES) + np.arange(HASHES, dtype=np.uint64))
    ones = np.bincount((sample % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.uint64)


def _sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    ends, codes, words = word_codes(texts)
    hashes = hashes_of(words)[codes]
    start = 0
    for end in ends:
        yield np.unique(shingles(hashes[start:end], width))
        start = end


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, sketch) of every row: the size of its set, 128 bits
    that name the set, the bucket of each band and the odd sketch. Empty sets have no buckets."""
    def run(batches):
        for batch in slices(batches, "text"):
            sizes, a, b, bands, sketches, ends = [], [], [], [], [], []
            for values in _sets_of(batch.column("text"), width):
                sizes.append(len(values))
                a.append(mixed(values ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64))
                b.append(mixed(values + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64))
                if len(values):
                    low = _minhash(values)
                    bands.append(_bands(low))
                    sketches.append(_odd_sketch(low))
                ends.append(len(bands))
            flat = lambda parts: np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            count = np.array(ends)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()),
                pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)),
                list_column(flat(bands), count * BANDS, pa.int64()),
                list_column(flat(sketches), count * (BITS // 64), pa.int64()),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """(component, doc_id, shingles): the whole set of every row of (component, doc_id, text)."""
    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(_sets_of(batch.column("text"), width))
            ends = np.cumsum([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("doc_id"),
                 list_column(np.concatenate(sets).view(np.int64), ends, pa.int64())],
                ["component", "doc_id", "shingles"])

    return docs.select("component", "doc_id", "text").mapInArrow(run, "component long, doc_id long, shingles array<long>")


def most_ones(similarity: float) -> int:
    """The most ones in the XOR of two sketches that a pair of at least this similarity is let to have.

    The number of differing samples d is binomial; each stands for two elements of the symmetric
    difference. Five standard deviations are allowed on it and five more on the bitmap."""
    mean = HASHES * (1 - similarity)
    flips = 2 * min(HASHES, mean + 5 * math.sqrt(HASHES * similarity * (1 - similarity)))
    ones = BITS / 2 * (1 - math.exp(-2 * flips / BITS))
    return int(min(BITS, ones + 5 * math.sqrt(BITS) / 2 * math.sqrt(1 - math.exp(-4 * flips / BITS))))


def _plausible_links(rows: pa.RecordBatch, part: np.ndarray, asked: np.ndarray, ones: int) -> list[tuple]:
    """Links (a, b) that join all rows of one bucket whose sketches are near enough, few as they are."""
    sketch = rows.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(rows.num_rows, -1)
    return joining_links(rows, part, asked, lambda i, others: np.bitwise_count(
        sketch[others] ^ sketch[i]).sum(axis=1, dtype=np.int32) <= ones)


def _exact_links(rows: pa.RecordBatch, part: np.ndarray, asked: np.ndarray, percent: int) -> list[tuple]:
    """Links (a, b) that join all rows of one group whose full sets are similar enough.

    An index from shingles to rows counts what each row shares with all others at once."""
    sets = rows.column("shingles")
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, codes = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    by_kind = np.argsort(codes, kind="stable")
    holders, first = owner[by_kind], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(kinds)))])

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        own = codes[ends[i] - size[i]: ends[i]]
        lengths = first[own + 1] - first[own]
        steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shared = np.bincount(holders[np.repeat(first[own], lengths) + steps], minlength=len(size))[others]
        return 100 * shared >= percent * (size[i] + size[others] - shared)

    return joining_links(rows, part, asked, alike)


def near_duplicates(
        docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked where 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable, and ``kept`` marks the row that has it. A null or
    empty text has no set and is linked with nothing. Repeated rows of one id share its fate; where
    their texts differ, the id is linked with what any of them is linked with. A row without an id is
    linked with nothing and kept. Other columns of ``docs`` are not looked at.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sigs = durable(signatures(docs, width=width))
    known = sigs.filter("n_shingles > 0 and doc_id is not null")
    # Copies: one row for each set, the smallest id stands for it.
    classes = durable(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    named = known.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    reps = durable(known.join(classes.withColumnRenamed("rep", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi")
                   .dropDuplicates(["doc_id", "set_a", "set_b"]))
    # Documents that share a bucket and whose sketches allow the similarity fall into one cluster.
    buckets = reps.select("doc_id", F.explode("bands").alias("band"))
    full = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = durable(buckets.join(full, "band").join(reps.select("doc_id", "sketch"), "doc_id").select(
        "band", F.col("doc_id").alias("id"), "sketch"))
    ones = most_ones(percent / 100)
    clusters = durable(components(linked_within(
        members, "band", F.lit(1), BLOCK_ROWS, lambda rows, part, asked: _plausible_links(rows, part, asked, ones)).distinct()))
    # Within a cluster the full sets decide.
    sets = durable(shingle_sets(docs.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id"), width))
    links = linked_within(sets.withColumnRenamed("doc_id", "id"), "component", F.size("shingles"), BLOCK_SHINGLES,
                          lambda rows, part, asked: _exact_links(rows, part, asked, percent))
    # An id of several texts links their classes. Other copies are no part of the graph, but follow the
    # document that stands for them.
    several = named.join(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "doc_id")
    joined = components(links.unionByName(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    of = named.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles").join(of, "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
