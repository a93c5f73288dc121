"""The n-gram join against all pairs of sets."""

import random

import numpy as np
import pytest

from airspan.llm import jaccard
from airspan.llm.groups import linked_within
from airspan.llm.jaccard import largest_match, most_apart, similar_sets, size_classes
from pyspark.sql import functions as F


def grams(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i: i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, []).append(grams(text, width))
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((root(x), root(y)))
                part[q] = p
    return {i: root(i) for i in ids}


def texts(seed, n):
    """Texts of all sizes, many of them edits of others, some at the threshold itself."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(9))
    out = []
    for _ in range(n):
        if out and rng.random() < 0.75:
            words = list(out[rng.randrange(len(out))])
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(words) + 1)
                words[at: at + rng.randrange(2)] = [word()] * rng.randrange(2)
        else:
            words = [word() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 250]))]
        out.append(words)
    return [rng.choice([" ", "  ", "\n"]).join(words) for words in out]


@pytest.mark.parametrize("width,percent", [(3, 90), (1, 90), (5, 80), (2, 60)])
def test_against_all_pairs(spark, width, percent):
    rows = [(100 - i, t) for i, t in enumerate(texts(width, 260))]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (505, "a b c"), (None, "a b"),
             (506, "a b"), (506, "one two three four five six"), (507, "ONE two three four five six"), (503, "A b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("x")).withColumn("id", F.lit(1)).repartition(4)
    got = similar_sets(df, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    sizes = sorted((r["n_shingles"] for r in got))
    assert sizes == sorted(len(grams(t, width)) for _, t in rows)
    assert len(set(want.values())) < len(want) - 40


def test_large_groups_in_blocks(spark, monkeypatch):
    """Keys and clusters far beyond a block: the same classes."""
    monkeypatch.setattr(jaccard, "KEY_ROWS", 9)
    monkeypatch.setattr(jaccard, "CLUSTER_GRAMS", 700)
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(60)]
    chain = list(base)
    rows = []
    for i in range(150):
        # A group around one text, and a chain that ends far from where it began.
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
        chain[i % 60] = f"y{i}"
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar_sets(df, width=1, percent=90).collect()}
    assert got == brute(rows, 1, 90)


def test_same_fragment_in_any_similar_sets():
    """Sizes at the bounds: so many elements can differ, and no more."""
    for percent in (60, 80, 90, 95):
        sizes = np.arange(1, 400)
        kinds, fragments = size_classes(sizes, percent)
        for n in range(1, 300):
            m = largest_match(n, percent)
            assert 100 * n >= percent * m and 100 * n < percent * (m + 1)
            assert kinds[min(m, 399) - 1] - kinds[n - 1] <= 1
            for k in range(n, min(m, 399) + 1):
                apart = most_apart(n, k, percent)
                shared = (n + k - apart) // 2
                assert fragments[kinds[n - 1]] > n + k - 2 * -(-percent * (n + k) // (100 + percent)) and shared >= 0


def test_links_grow_with_the_key_and_not_its_square(spark):
    """A key of many rows all alike: few links, and each row is sent to few groups."""
    rows = spark.range(20000).select(F.lit(1).alias("key"), "id")
    seen = spark.sparkContext.accumulator(0)

    def each(batch, part, asked):
        seen.add(batch.num_rows)
        ids = batch.column("id").to_pylist()
        return [(i, ids[0]) for i, p in zip(ids, part) if p != part[0]]

    links = linked_within(rows, "key", F.lit(1), 500, each)
    assert links.filter("a != b").count() == 19999
    assert seen.value < 4 * 20000


def test_empty_table(spark):
    assert similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
