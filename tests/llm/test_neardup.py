import random
from itertools import combinations

import numpy as np
import pytest

from airspan.llm import neardup
from airspan.llm.graph import components


def by_hand(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        first = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            text = list(first)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else " ".join(text))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate([*rows, "", None, "one", "one", "one two", "two  one"])]


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("width", [4, 5])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, blocks, width):
    if blocks:  # every group is cut into blocks
        monkeypatch.setattr(neardup, "BLOCK_ROWS", 3)
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=width).collect()}
    assert found == by_hand(rows, width, 80)


def test_odd_sketches_estimate_and_let_similar_sets_pass():
    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.9, 0.97):
        shared = int(2000 * similarity / (1 + similarity))
        for _ in range(40):
            values = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            a, b = values[: 1000], np.concatenate([values[: shared], values[1000: 2000 - shared]])
            low = [neardup._minhash(np.unique(x)) for x in (a, b)]
            ones = int(np.bitwise_count(neardup._odd_sketch(low[0]) ^ neardup._odd_sketch(low[1])).sum())
            estimate = 1 + neardup.BITS / (4 * neardup.HASHES) * np.log(max(1e-9, 1 - 2 * ones / neardup.BITS))
            assert abs(estimate - similarity) < 0.2 and ones <= neardup.most_ones(0.8)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300) if i % 50 != 49]
    random.Random(1).shuffle(edges)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, i // 50 * 50) for i in range(301) if i != 300}
