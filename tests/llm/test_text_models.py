import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airspan.llm import classlm, langid, toxicity
from airspan.llm.queries import LLM_QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text").collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    return {r["doc_id"]: (r["lang"], toxic.get(r["doc_id"]), r["text"]) for r in docs}


def test_language_of_held_out_documents(spark, labels):
    got = LLM_QUERIES["op3_language"](spark, SF_DIR).collect()
    assert len(got) == len(labels)
    aside = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in got)
    assert sum(r["lang_pred"] == labels[r["doc_id"]][0] for r in aside) >= 0.97 * len(aside)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_gram_counts_do_not_depend_on_the_other_texts():
    texts = ["Das Haus", None, "", " x", "été  -- 12 a", "\U0001f600"]
    together, has = langid.gram_counts(texts)
    assert has.tolist() == [True, False, False, True, True, False]
    for i, t in enumerate(texts):
        assert (langid.gram_counts([t])[0][0] == together[i]).all()
    # " das haus ": 7 letters, 9 pairs, and 7 triples without a separator within
    assert together[0].sum() == 7 + 9 + 7


def test_texts_unlike_any_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([("xqzwvk jxqz kkvw " * 40,), ("Сегодня хорошая погода " * 20,)], "text string")
    assert all(r["rejected"] for r in langid.predict(odd, model).collect())
    share = langid.predict(docs, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    assert share < 0.05


def test_base_scores_are_those_by_hand_and_classes_do_better(spark, labels):
    got = LLM_QUERIES["op7_class_lm"](spark, SF_DIR).collect()
    counts, tokens = Counter(), {}
    for i, (_, _, text) in labels.items():
        tokens[i] = (text or "").encode().lower().split() + [None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r["train_tokens"] == n and r["n_tokens"] == len(own) and r["n_known"] == sum(counts[w] > 0 for w in own)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    aside = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in aside) > sum(r["base_score"] for r in aside) * 0.95


def test_class_model_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    known = classlm.Vocabulary(
        1000, 90, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), rng.integers(5, 50, 20),
        rng.integers(0, 4, classlm.GROUPS) * 3, np.ones(classlm.GROUPS, np.int64))
    known.group_words[known.group_tokens == 0] = 0
    classes = rng.integers(0, classlm.CLASSES, known.size)
    beside = rng.integers(0, 9, (2, known.size, classlm.CLASSES + 1))
    m = classlm.model_of(known, classes, beside)
    assert np.allclose(m.moves.sum(axis=1), 1)
    own = len(known.clustered)
    # A group gives each of its words (count + 0.5), and 0.5 to an unseen one.
    mass = m.emits.copy()
    mass[:own] *= known.clustered + 0.5
    mass[own:] *= known.group_tokens + 0.5 * (known.group_words + 1)
    sums = np.bincount(classes, mass, classlm.CLASSES)
    assert (sums < 1 + 1e-9 + 0.5 * (known.group_tokens == 0).sum()).all() and sums.min() > 0.99


def objective(classes, pairs):
    k = classes.max() + 1
    table = np.zeros((k, k))
    np.add.at(table, (classes[pairs[:, 0]], classes[pairs[:, 1]]), 1)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0).sum()
    return xlogx(table) - xlogx(table.sum(axis=0)) - xlogx(table.sum(axis=1))


def test_exchange_raises_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(classlm, "CLASSES", 4)
    rng = random.Random(1)
    kinds = {0: [1], 1: [2], 2: [0, 3], 3: [0]}
    rows, pairs = [], []
    for _ in range(200):
        kind, ids = 0, []
        for _ in range(30):
            ids.append(kind * 10 + rng.randrange(10))
            kind = rng.choice(kinds[kind])
        rows.append((bytearray(np.array(ids, "<u2").tobytes()),))
        pairs += list(zip(ids, ids[1:]))
    texts, pairs = spark.createDataFrame(rows, "ids binary").repartition(3), np.array(pairs)
    classes = np.arange(40) % 4
    scores = [objective(classes, pairs)]
    for _ in range(6):
        beside = classlm.neighbours(texts, classes)
        assert beside[0].sum() == beside[1].sum() == 200 * 30 and (beside[0, :, 4].sum(), beside[1, :, 4].sum()) == (200, 200)
        classes = classlm.exchange(classes, beside)
        scores.append(objective(classes, pairs))
    true = objective(np.arange(40) // 10, pairs)
    assert scores[-1] > scores[0] + 0.8 * (true - scores[0])


def test_toxicity_of_held_out_documents(spark, labels):
    got = LLM_QUERIES["op9_toxicity"](spark, SF_DIR).collect()
    assert len(got) == len(labels)
    aside = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"] and labels[r["doc_id"]][1] is not None]
    clean = [p for p, t in aside if t == 0]
    toxic = [p for p, t in aside if t == 1]
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.5 * len(toxic)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_learns_words_that_no_lexicon_has(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = [f"word{rng.randrange(400)}" for _ in range(40)]
        if i % 6 == 0:
            words[3], words[9] = f"grumpf{rng.choice('abcdef')}", rng.choice(["zorkish", "zorkly"])
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 400"))
    got = toxicity.score(df.filter("doc_id >= 400"), model, "text", F.col("label")).collect()
    assert sum((r["score"] >= 0.7) == (r["label"] == 1) for r in got) >= 0.98 * len(got)
    lone = toxicity.fit(df.limit(0))
    scores = lone.scores(pa.array(["you are an idiot", "a fine day", None]))
    assert scores[0] > 0.7 > 0.3 > scores[1] == scores[2]


def test_correlated_voters_share_their_weight():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.3
    single = rng.random(3000) < np.where(truth, 0.6, 0.02)
    copied = rng.random(3000) < np.where(truth, 0.5, 0.1)
    fires = np.stack([single, *[copied] * 8], axis=1)
    labels = np.where(rng.random(3000) < 0.9, truth, ~truth).astype(int)
    p = toxicity.posterior(fires, labels)
    assert ((p > 0.5) == truth).mean() > 0.9
