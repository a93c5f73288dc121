import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from airspan.llm.packing import pack, plan, sequences
from airspan.llm.queries import vocabulary
from airspan.llm.tokens import encode, pieces

plain = st.text(st.sampled_from(list("ab the's'll  \n09.,!|#ÄéßÿÀ×÷")), max_size=60)
anything = st.text(max_size=40)


@given(st.lists(st.one_of(plain, anything), max_size=5))
@settings(max_examples=300, deadline=None)
def test_the_faster_reader_gives_the_ids_of_the_tokenizer(texts):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    assert encode(texts, **vocabulary()) == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_plans_use_every_piece_once_and_come_near_the_bound():
    for seed in range(8):
        rng = random.Random(seed)
        counts = Counter(rng.choice([1, 100, 512, 1024, rng.randrange(1, 1025), rng.randrange(1, 200)]) for _ in range(rng.choice([0, 1, 30, 5000])))
        patterns, used = plan(counts, 1024), Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= 1024 and times > 0
            for x in lengths:
                used[x] += times
        assert used == counts
        bound = -(-sum(x * n for x, n in counts.items()) // 1024)
        assert sum(n for _, n in patterns) <= bound * 1.02 + 1


def test_exact_complements_are_found():
    assert sum(n for _, n in plan({700: 4, 324: 4}, 1024)) == 4
    assert sum(n for _, n in plan({700: 2, 200: 2, 124: 2}, 1024)) == 2
    assert sum(n for _, n in plan({600: 1, 200: 1, 124: 1, 100: 1}, 1024)) == 1
    assert sum(n for _, n in plan({400: 1, 208: 3}, 1024)) == 1


def test_sequences_hold_the_ids_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr("airspan.llm.packing.BUCKET_ROWS", 40)  # many ranks of one length
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "Haus", "x1", "é"]) for _ in range(rng.choice([0, 3, 3, 3, 400, 2500]))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").repartition(5)
    packed = pack(pieces(df, **vocabulary())).collect()
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, ids in enumerate(encode([*texts, ""], **vocabulary())):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*ids, 2]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        assert [r["start"] for r in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    joined = sequences(pack(pieces(df, **vocabulary()))).collect()
    assert sum(len(r["ids"]) for r in joined) == sum(r["length"] for r in packed)
