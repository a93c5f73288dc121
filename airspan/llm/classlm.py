"""Scores of texts under a class-based bigram model (Brown et al.).

Every word belongs to one of ``CLASSES`` classes, and P(word | previous) = P(class | class of the previous) *
P(word | class), mixed with the unigram. Words with at least ``CLUSTERED`` of all tokens are clustered one by
one; all other words, unseen ones included, by groups of equal endings, in which a word's own count decides.

The exchange algorithm moves a word to the class that raises the likelihood most. What it needs are the
counts of each word next to each class, which one pass over the encoded texts gives; the passes
repeat with the new classes. A table of words by classes is bounded by 1 / CLUSTERED words, so it may come to
the driver; the counts of all words never do. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from airspan.llm.groups import map_groups
from airspan.llm.text import hashes_of, list_column, mixed, slices, word_codes
from airspan.session import durable

CLASSES = 64
# Share of all tokens from which on a word is clustered by itself, and from which on its count is sent to
# all tasks; at most 1 / share words have it.
CLUSTERED, SENT = 2e-5, 2e-6
GROUPS = 1024
PASSES = 5
# Weight of the class model against the unigram, and of the unigram classes in the transitions.
CLASS_WEIGHT, PRIOR = 0.95, 10.0
# The end of a text as a word.
END = np.uint64(0x5EED)
# Words whose counts by class are summed together.
CHUNK = 256
# Distinct words that a task holds before it gives its counts on.
HELD = 2_000_000


def _known(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, group) of each word; the group is that of its last three bytes."""
    data = words.cast(pa.large_binary()).to_pylist()
    tails = pa.array([w[-3:] for w in data], pa.large_binary())
    return hashes_of(words), (hashes_of(tails, 1) % np.uint64(GROUPS)).astype(np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, grp, n): the count of each word of all texts, ends included."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed():
            words, groups, counts = (np.concatenate(x) for x in zip(*held))
            kinds, first, codes = np.unique(words, return_index=True, return_inverse=True)
            return kinds, groups[first], np.bincount(codes, counts, len(kinds)).astype(np.int64)

        def given():
            words, groups, counts = summed()
            return pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(groups), pa.array(counts)], ["word", "grp", "n"])

        texts = 0
        for batch in slices(batches, "text"):
            ends, codes, words = word_codes(batch.column("text"))
            texts += batch.num_rows
            counts = np.bincount(codes, minlength=len(words))
            hashes, groups = _known(words)
            used = counts > 0
            held.append((hashes[used], groups[used], counts[used]))
            if sum(len(h[0]) for h in held) > HELD:
                held = [summed()]
                if len(held[0][0]) > HELD // 2:
                    yield given()
                    held = []
        if texts:
            held.append((np.array([END]), np.zeros(1, np.int32), np.array([texts])))
            yield given()

    return docs.select("text").mapInArrow(run, "word long, grp int, n long").groupBy("word", "grp").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the training tokens. Ids: the clustered words, then the groups; the start of a text is
    not a word but a class of its own."""
    tokens: int
    distinct: int
    #: sorted hashes, counts and ids (-1: not clustered) of the words that are sent
    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    clustered: np.ndarray
    group_tokens: np.ndarray
    group_words: np.ndarray

    @property
    def size(self) -> int:
        return len(self.clustered) + GROUPS

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def id_counts(self) -> np.ndarray:
        return np.concatenate([self.clustered, self.group_tokens])


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the saved counts of all words."""
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = total[0] or 0, total[1]
    end = int(END.view(np.int64))
    # At most 1 / SENT words.
    sent = counts.filter((F.col("n") >= SENT * tokens) & (F.col("n") > 1) | (F.col("word") == end)).toPandas()
    words = sent["word"].to_numpy(np.int64).view(np.uint64)
    n = sent["n"].to_numpy(np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    alone = (n >= CLUSTERED * tokens) | (words == END)
    ids = np.where(alone, np.cumsum(alone) - 1, -1)
    clustered = (F.col("n") >= CLUSTERED * tokens) & (F.col("n") > 1) | (F.col("word") == end)
    rest = counts.filter(~clustered).groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()
    group_tokens, group_words = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    group_tokens[rest["grp"]] = rest["n"]
    group_words[rest["grp"]] = rest["k"]
    return Vocabulary(tokens, distinct, words, n, ids, n[alone], group_tokens, group_words)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(doc_id, aside, n_tokens, ids, logs, n_sent, rest): each row's ids as 16-bit numbers, the sum of
    log10(count + 0.5) and the number of its words among those sent, and the hashes of its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        v = shared.value
        clustered = len(v.clustered)
        end_at = int(np.searchsorted(v.words, END)) if len(v.words) else 0
        for batch in slices(batches, "text"):
            ends, codes, words = word_codes(batch.column("text"))
            hashes, groups = _known(words)
            at = np.minimum(np.searchsorted(v.words, hashes), max(0, len(v.words) - 1))
            hit = v.words[at] == hashes if len(v.words) else np.zeros(len(hashes), bool)
            logs = np.where(hit, np.log10(v.counts[at] + 0.5), 0.0) if len(v.words) else np.zeros(len(hashes))
            own = np.where(hit & (v.ids[at] >= 0), v.ids[at], clustered + groups) if len(v.words) else clustered + groups
            # The end of each text after its words.
            n = np.diff(np.concatenate([[0], ends]))
            ids = np.insert(own[codes], ends, v.ids[end_at] if len(v.words) else 0).astype("<u2")
            lasts = ends + np.arange(1, len(ends) + 1)
            cuts = np.concatenate([[0], lasts])
            owner = np.repeat(np.arange(len(n)), n)
            last_log = np.log10(v.counts[end_at] + 0.5) if len(v.words) else np.log10(0.5)
            sums = np.bincount(owner, logs[codes], len(n)) + last_log
            sent = np.bincount(owner, hit[codes], len(n)).astype(np.int64) + (len(v.words) > 0)
            other = ~hit[codes]
            rest_ends = np.cumsum(np.bincount(owner[other], minlength=len(n)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("aside"), pa.array(n + 1),
                pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                pa.array(sums), pa.array(sent), list_column(hashes[codes][other].view(np.int64), rest_ends, pa.int64()),
            ], ["doc_id", "aside", "n_tokens", "ids", "logs", "n_sent", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "aside", "text").mapInArrow(
        run, f"doc_id {kind}, aside boolean, n_tokens long, ids binary, logs double, n_sent long, rest array<long>")


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, and which of them begin a text."""
    ids = np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids, first


def neighbours(texts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """(2, ids, classes + 1): how often each id has each class before and after it; the last class is
    the start and the end of texts. Summed by chunks of ids, each in one task."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(classes)
    size, k = len(classes), CLASSES + 1

    def run(batches):
        own, total = shared.value, np.zeros(2 * size * k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = _sequences(batch.column("ids"))
            cls = own[ids]
            before = np.where(first, CLASSES, np.concatenate([[CLASSES], cls[:-1]]))
            after = np.where(np.concatenate([first[1:], [True]]), CLASSES, np.concatenate([cls[1:], [CLASSES]]))
            total[: size * k] += np.bincount(ids * k + before, minlength=size * k)
            total[size * k:] += np.bincount(ids * k + after, minlength=size * k)
        # What is not nought, by chunks of ids: a small task says little.
        at = np.flatnonzero(total)
        side, word, cls = at // (size * k), at // k % size, at % k
        chunk = word // CHUNK
        place = ((side * CHUNK + word % CHUNK) * k + cls).astype("<u4")
        order = np.argsort(chunk, kind="stable")
        numbers, begins = np.unique(chunk[order], return_index=True)
        if len(numbers):
            cuts = [*begins.tolist(), len(at)]
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            counts = total[at].astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array([place[p].tobytes() for p in parts], pa.binary()),
                 pa.array([counts[p].tobytes() for p in parts], pa.binary())], ["group", "places", "counts"])

    def add(rows: pa.RecordBatch) -> list[tuple]:
        total = np.zeros(2 * CHUNK * k, np.int64)
        for places, counts in zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist()):
            total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<u4")
        return [(rows.column("group")[0].as_py(), total.tobytes())]

    partial = texts.select("ids").mapInArrow(run, "group long, places binary, counts binary")
    out = np.zeros((2, -(-size // CHUNK) * CHUNK, k), np.int64)
    # The table of all clustered words and groups: at most (1 / CLUSTERED + GROUPS) * 2 * (CLASSES + 1) numbers.
    for row in map_groups(partial, add, "chunk long, counts binary").collect():
        out[:, row["chunk"] * CHUNK: (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.int64).reshape(2, CHUNK, k)
    return out[:, :size]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(classes: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """One round of the exchange algorithm: each word, the most frequent first, goes to the class that
    gives the largest sum of n(a, b) log n(a, b) - n(a) log n(a) - n(b) log n(b)."""
    k, new = CLASSES, classes.copy()
    left, right = beside[0].astype(float), beside[1].astype(float)
    pairs = np.zeros((k + 1, k + 1))
    for c in range(k):
        pairs[:, c] = left[new == c].sum(axis=0)
    pairs[:, k] = 0
    for c in range(k):
        pairs[c, k] = right[new == c, k].sum()
    sizes = np.bincount(new, left.sum(axis=1), k)
    total = left.sum(axis=1)
    members = np.bincount(new, minlength=k)
    for w in np.argsort(-total, kind="stable"):
        if not total[w] or members[new[w]] == 1:
            continue
        a = new[w]
        # Without the word, its neighbours' classes taken as they were in the pass.
        pairs[:, a] -= left[w]
        pairs[a, :] -= right[w]
        np.maximum(pairs, 0, out=pairs)
        sizes[a] -= total[w]
        gain = (_xlogx(pairs[:, :k] + left[w][:, None]) - _xlogx(pairs[:, :k])).sum(axis=0)
        gain += (_xlogx(pairs[:k] + right[w]) - _xlogx(pairs[:k])).sum(axis=1)
        gain -= 2 * (_xlogx(sizes + total[w]) - _xlogx(sizes))
        b = int(gain.argmax())
        pairs[:, b] += left[w]
        pairs[b, :] += right[w]
        sizes[b] += total[w]
        members[a] -= 1
        members[b] += 1
        new[w] = b
    return new


@dataclass
class Model:
    classes: np.ndarray
    #: P(class | class before), the last row is for the start
    moves: np.ndarray
    #: P(word | class) / (count + 0.5) of an id
    emits: np.ndarray
    unigram: float


def model_of(known: Vocabulary, classes: np.ndarray, beside: np.ndarray) -> Model:
    counts = known.id_counts().astype(float)
    sizes = np.bincount(classes, counts, CLASSES)
    moves = np.zeros((CLASSES + 1, CLASSES))
    for c in range(CLASSES):
        moves[:, c] = beside[0][classes == c].sum(axis=0)
    # Unseen transitions fall back on how often a class occurs.
    prior = (sizes + 1) / (sizes + 1).sum()
    moves = (moves + PRIOR * prior) / (moves.sum(axis=1, keepdims=True) + PRIOR)
    own = len(known.clustered)
    # A share of a class for each of its words and groups; a group without training tokens has half a token's.
    share = np.maximum(counts, 0.5) / np.maximum(sizes, 0.5)[classes]
    emits = share.copy()
    emits[:own] /= counts[:own] + 0.5
    emits[own:] /= known.group_tokens + 0.5 * (known.group_words + 1)
    return Model(classes, moves, emits, 1 / known.denominator)


def trained(texts: DataFrame, known: Vocabulary, passes: int = PASSES) -> Model:
    """Classes by exchange over the encoded training texts, and the probabilities they give."""
    order = np.argsort(-known.id_counts(), kind="stable")
    classes = np.empty(known.size, np.int64)
    classes[order] = np.arange(known.size) % CLASSES
    for _ in range(passes):
        classes = exchange(classes, neighbours(texts, classes))
    return model_of(known, classes, neighbours(texts, classes))


def score(docs: DataFrame, aside: str = "aside", text: str = "text", doc_id: str = "doc_id", passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows with ``aside`` true are scored but not learnt from. ``base_score`` is the log10 probability under
    the unigram with half a count added, ``score`` that of the class model. A null text is an empty one,
    whose only token is its end. Repeated rows count as often as they stand there; a row without an id is
    scored like any other; other columns are not looked at."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(aside), F.lit(False)).alias("aside"),
                       F.col(text).cast("string").alias("text"))
    counts = durable(word_counts(rows.filter("not aside")))
    known = vocabulary(counts)
    texts = durable(encoded(rows, known).withColumn("row", F.monotonically_increasing_id()))
    model = trained(texts.filter("not aside"), known, passes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, first = _sequences(batch.column("ids"))
            cls = m.classes[ids]
            before = np.where(first, CLASSES, np.concatenate([[CLASSES], cls[:-1]]))
            p = CLASS_WEIGHT * m.moves[before, cls] * m.emits[ids] + (1 - CLASS_WEIGHT) * m.unigram
            owner = np.cumsum(first) - 1
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.bincount(owner, np.log10(p), batch.num_rows))], [*names, "class_logs"])

    slim = texts.select("row", "doc_id", "aside", "n_tokens", "logs", "n_sent", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = slim.mapInArrow(
        run, f"row long, doc_id {kind}, aside boolean, n_tokens long, logs double, n_sent long, class_logs double")
    # The other words are rare, so no word here has many rows.
    rare = texts.select("row", F.explode("rest").alias("word")).join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.count("n").alias("seen"))
    out = scored.join(rare, "row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", F.col("aside").alias("held_out"), "n_tokens",
        (F.when(F.lit(known.tokens > 0), F.col("n_sent")).otherwise(0) + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(known.denominator)))).alias("base_score"),
        (logs + F.col("class_logs")).alias("score"))
