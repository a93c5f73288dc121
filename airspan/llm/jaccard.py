"""N-gram Jaccard join by vertical partitioning: documents whose sets of word n-grams are similar.

The n-grams have one global order, that of their 64-bit hashes, and ranges of it are fragments that cut every
set vertically.

1. Candidates. Two sets of n and m n-grams with the similarity differ in at most d of them, which n and m bound. Of
   d + 1 fragments one at least is then the same in both. A set's size class fixes the number of fragments, and
   each of them is a key: (class, fragment, hash of what the set has in it). Sets of one class and the
   next have a key in common for certain.
2. Among the sets of a key, those whose parities differ too often are dropped: a set's parity vector has a bit for
   each residue of its hashes, so no two sets differ in fewer elements than their vectors in bits.
3. What is left forms clusters. In a cluster partial overlaps are counted fragment by fragment, summed per pair, and a
   pair leaves as soon as what is still to come cannot bring it to the threshold. The sum over all fragments
   is the exact intersection, which decides.

Copies of a set are one class throughout. Nothing here is approximate, and no pairs of a group are given out: only
links that join its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspan.llm.graph import components
from airspan.llm.groups import joining_links, linked_within
from airspan.llm.text import hashes_of, list_column, mixed, shingles, slices, word_codes
from airspan.session import durable

# Bits of a parity vector.
PARITY = 512
# Rows of a key, and n-grams of a cluster, that one task compares.
KEY_ROWS, CLUSTER_GRAMS = 16384, 4_000_000
# Fragments in which the overlaps of a cluster are counted.
FRAGMENTS = 8


def most_apart(n: int, m: int, percent: int) -> int:
    """The most elements in which sets of n and m elements with the similarity can differ."""
    return (n + m) * (100 - percent) // (100 + percent)


def largest_match(n: int, percent: int) -> int:
    """The size of the largest set that can have the similarity with one of n elements."""
    return 100 * n // percent


def size_classes(sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, fragments) of sizes. A set's matches are in its class or one beside it, and of the fragments of a
    class, the same one is equal in any two similar sets of it, or of it and the next."""
    low, fragments = [1], []
    while low[-1] <= sizes.max(initial=1):
        high = largest_match(low[-1], percent)
        fragments.append(most_apart(high, largest_match(high, percent), percent) + 1)
        low.append(high + 1)
    return np.searchsorted(low, sizes, "right") - 1, np.array(fragments, np.int64)


def gram_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct word n-grams."""
    ends, codes, words = word_codes(texts)
    hashes = hashes_of(words)[codes]
    start = 0
    for end in ends:
        yield np.unique(shingles(hashes[start:end], width))
        start = end


def fragment_of(values: np.ndarray, fragments: int) -> np.ndarray:
    """The range of the global order that each hash is in."""
    return ((values >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def fragment_keys(values: np.ndarray, kind: int, fragments: int) -> np.ndarray:
    """A key for each fragment of a set: the class, the fragment, and the sum of the mixed hashes in it."""
    sums = np.zeros(fragments, np.uint64)
    where = fragment_of(values, fragments)
    begin = np.searchsorted(where, np.arange(fragments))
    # Sums modulo 2^64 by differences, so that an empty fragment has a sum of zero.
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(values + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    sums = total[np.append(begin[1:], len(values))] - total[begin]
    return mixed(mixed(sums) + mixed(np.arange(fragments, dtype=np.uint64) + np.uint64(kind << 32)))


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, parity, keys) of every row of (doc_id, text): the size of its set, 128 bits
    that name it, its parity vector and the keys of its fragments."""
    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(gram_sets(batch.column("text"), width))
            sizes = np.array([len(s) for s in sets], np.int64)
            kinds, fragments = size_classes(sizes, percent)
            a, b, parity, keys, ends = [], [], [], [], []
            for values, kind in zip(sets, kinds):
                a.append(mixed(values ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64))
                b.append(mixed(values + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64))
                bits = np.bincount((mixed(values) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                parity.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                # Sets that differ in nothing are one class, so a class with one fragment needs no key.
                own = [fragment_keys(values, k, int(fragments[k])) for k in (kind - 1, kind) if len(values) and k >= 0 and fragments[k] > 1]
                keys += own
                ends.append((ends[-1] if ends else 0) + sum(map(len, own)))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes), pa.array(np.array(a, np.uint64).view(np.int64)),
                pa.array(np.array(b, np.uint64).view(np.int64)),
                list_column(np.concatenate(parity), np.arange(1, len(sets) + 1) * (PARITY // 64), pa.int64()),
                list_column(flat, np.array(ends), pa.int64())], ["doc_id", "n_shingles", "set_a", "set_b", "parity", "keys"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, parity array<long>, keys array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(component, id, grams): the whole set of every row of (component, doc_id, text)."""
    def run(batches):
        for batch in slices(batches, "text"):
            sets = list(gram_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("component"), batch.column("doc_id"),
                 list_column(np.concatenate(sets).view(np.int64), np.cumsum([len(s) for s in sets]), pa.int64())],
                ["component", "id", "grams"])

    return docs.select("component", "doc_id", "text").mapInArrow(run, "component long, id long, grams array<long>")


def _plausible(percent: int):
    def each(rows: pa.RecordBatch, part: np.ndarray, asked: np.ndarray) -> list[tuple]:
        n = rows.column("n_shingles").to_numpy(zero_copy_only=False)
        bits = rows.column("parity").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(n), -1)

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
            return (100 * small >= percent * large) & (apart * (100 + percent) <= (small + large) * (100 - percent))

        return joining_links(rows, part, asked, alike)

    return each


def _overlapping(percent: int):
    def each(rows: pa.RecordBatch, part: np.ndarray, asked: np.ndarray) -> list[tuple]:
        """Partial overlaps of a row with all others, one fragment after the other, and their sums."""
        lists = rows.column("grams")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        grams = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        where = fragment_of(grams, FRAGMENTS)
        index, held = [], np.zeros((FRAGMENTS, len(size)), np.int64)
        for f in range(FRAGMENTS):
            at = np.flatnonzero(where == f)
            codes = np.unique(grams[at], return_inverse=True)[1]
            by_gram = np.argsort(codes, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(codes))]).astype(np.int64)
            held[f] = np.bincount(owner[at], minlength=len(size))
            index.append((codes, np.concatenate([[0], np.cumsum(held[f])]), owner[at][by_gram], first))

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            # 100 * shared >= percent * (sum - shared)
            need = -(-percent * (size[i] + size[others]) // (100 + percent))
            # No fragment can add more than the smaller side has in it.
            most = np.minimum(held[:, i, None], held[:, others])
            shared, left = np.zeros(len(others), np.int64), most.sum(axis=0)
            open_ = np.flatnonzero(left >= need)
            for f, (codes, begin, holders, first) in enumerate(index):
                if not len(open_):
                    break
                own = codes[begin[i]: begin[i + 1]]
                lengths = first[own + 1] - first[own]
                steps = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                partial = np.bincount(holders[np.repeat(first[own], lengths) + steps], minlength=len(size))
                shared[open_] += partial[others[open_]]
                left[open_] -= most[f, open_]
                open_ = open_[shared[open_] + left[open_] >= need[open_]]
            out = np.zeros(len(others), bool)
            out[open_] = shared[open_] >= need[open_]
            return out

        return joining_links(rows, part, asked, alike)

    return each


def similar_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A set holds the distinct runs of ``width`` words of a text, lower-cased, or the whole sequence where there are
    fewer words. Rows are linked where 100 * intersection >= percent * union; ``component_id`` is the
    smallest id reachable by links. A null or empty text has no set and is linked with nothing. Repeated rows of an
    id share its fate; where their texts differ, the id is linked with what any of them is linked with. A
    row without an id is linked with nothing and has no component. Other columns are not looked at."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = durable(profiles(docs, width, percent))
    known = found.filter("n_shingles > 0 and doc_id is not null")
    # Copies: the smallest id stands for all rows with its set.
    classes = durable(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    named = known.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select("doc_id", "rep").distinct()
    reps = durable(known.join(classes.withColumnRenamed("rep", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi")
                   .dropDuplicates(["doc_id", "set_a", "set_b"]).withColumnRenamed("doc_id", "id"))
    keyed = reps.select("id", F.explode("keys").alias("key"))
    # Keys of one set alone go before the vectors are fetched.
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = durable(keyed.join(shared, "key").join(reps.select("id", "n_shingles", "parity"), "id"))
    near = linked_within(members, "key", F.lit(1), KEY_ROWS, _plausible(percent)).distinct()
    clusters = durable(components(near))
    sets = durable(whole_sets(docs.join(clusters.withColumnRenamed("node", "doc_id"), "doc_id"), width))
    links = linked_within(sets, "component", F.size("grams"), CLUSTER_GRAMS, _overlapping(percent))
    # An id of several texts joins their classes. Other copies are no part of the graph.
    several = named.join(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "doc_id")
    joined = components(links.unionByName(several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    of = named.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return found.select("doc_id", "n_shingles").join(of, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
