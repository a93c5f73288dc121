import random

import numpy as np
import pyarrow as pa

from airspan.llm import decontam
from airspan.llm.decontam import contaminated, edit_distance, normal_words, prepared, walk


def distance_by_hand(item, text):
    """Free ends on the side of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def test_edit_distance_with_free_ends():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 30))]
        found, a, b = edit_distance(np.array(item, np.uint64), np.array(text, np.uint64))
        assert found == distance_by_hand(item, text)
        assert 0 <= a <= b <= len(text)
        assert distance_by_hand(item, text[a:b]) == found


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            words.insert(at, f"add{rng.randrange(10**6)}")
        elif len(words) > 1:
            words.pop(at)
    return words


def test_walks_over_equal_windows_are_equal_and_edits_keep_them_near():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 2**62, 400, dtype=np.uint64)
    both = np.concatenate([words[:40], words[:20], words[21:40], words[200:240]])
    a, same, near, far = walk(both, np.array([0, 0, 40, 79]), np.array([40, 40, 79, 119]), 40, 5)
    assert (a == same).all() and (a == near).mean() > (a == far).mean() + 0.2


def test_contamination_is_that_of_all_windows(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 8, 20, 45])))) for i in range(30)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        if d % 2:
            item = rng.choice(items)[1].split()
            planted = edited(rng, item, rng.randrange(0, max(1, len(item) // 4) + 1))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in planted]
        docs.append((d, " \n".join(words)))
    want = {}
    for d, text in docs:
        words = text.lower().replace(",", "").split()
        for i, item in items:
            own = item.split()
            if len(own) >= 8 and (x := distance_by_hand(own, words)) <= int(0.2 * len(own)):
                want[d, i] = x
    for chars in (decontam.BLOCK_CHARS, 2000):  # and in several blocks of items
        monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), recall=0.995).collect()
        found = {(r["doc_id"], r["item_id"]): r["distance"] for r in got}
        assert set(found) <= set(want) and all(found[k] == want[k] for k in found)
        assert len(found) >= 0.97 * len(want) and len(want) > 40
        assert {k for k, x in want.items() if x == 0} <= set(found)
        texts = dict(docs)
        for r in got:
            part = texts[r["doc_id"]][r["start"]:r["end"]].lower().replace(",", "").split()
            assert distance_by_hand(dict(items)[r["item_id"]].split(), part) == r["distance"]


def test_recall_at_all_edits():
    rng = random.Random(9)
    items = [" ".join(f"t{rng.randrange(5000)}" for _ in range(40)) for _ in range(200)]
    block = prepared(list(range(200)), items, 0.2, 8, 0.99)
    found = 0
    for i, item in enumerate(items):
        words = ["pre"] * 30 + edited(rng, item.split(), 8) + ["post"] * 30
        ends, hashes, _ = normal_words(pa.array([" ".join(words)]))
        found += any(m[1] == i for m in decontam._matches(block, ends, hashes))
    assert found >= 190
