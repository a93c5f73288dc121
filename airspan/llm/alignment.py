"""Which tokens of two tokenizers stand for the same bytes of a text.

Both token sequences of a text spell the same bytes. Where a token of each ends at the same byte, both
sequences are cut: the ends of either side go into a dictionary from end to index, the common ends are the
intersection of the keys, and in their order they slice both id lists into groups. Within a group, two
tokens are linked where their byte ranges overlap.

How often an id pair is linked in the whole corpus is counted per task first and summed over tasks. The
frequent pairs, at most ``FREQUENT`` of them, are sent to every task; the rest, of which none is
frequent, meet the documents that hold them in a join.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.text import list_column, slices
from airspan.llm.tokens import _encoders, encode
from airspan.session import checkpoint_root, durable

# Pairs whose counts every task holds: 24 bytes each.
FREQUENT = 1 << 19
# Bytes of text that are tokenized at a time: ids in lists take thirty times as many.
SLICE = 1 << 18
# Links that a task adds up before it gives their counts on.
HELD = 4_000_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it can be printed, else one
    of those from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@functools.lru_cache(maxsize=2)
def byte_level_tokens(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters, (tokenizer, _) = byte_letters(), _encoders(vocabulary, None)
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode() for name in names]


@functools.lru_cache(maxsize=2)
def piece_model(model: str):
    """A piece model, and the bytes of each of its ids."""
    from sentencepiece import SentencePieceProcessor
    reader = SentencePieceProcessor(model_file=model)
    names = [reader.id_to_piece(i) for i in range(reader.get_piece_size())]
    return reader, [bytes([int(name[3:5], 16)]) if reader.is_byte(i) else name.replace("▁", " ").encode()
                    for i, name in enumerate(names)]


def cuts_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either list lie before each common end: where both lists are cut."""
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1)))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1)))
    # A dictionary keeps its keys in the order of the ends, so what both have is sorted.
    common = list(filter(index_b.__contains__, index_a))
    return (np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)))


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of tokens whose byte ranges overlap, slice by slice. In a slice no end is common but
    the last, so passing the tokens of both sides in the order of their ends, one at a time, gives each pair once:
    one less than the slice has tokens."""
    inner_a, inner_b = np.ones(len(ends_a), bool), np.ones(len(ends_b), bool)
    inner_a[cuts_a - 1] = inner_b[cuts_b - 1] = False
    # After a token that ends inside a slice the next one of its side is paired with what the other side has there.
    i, j = np.flatnonzero(inner_a) + 1, np.flatnonzero(inner_b) + 1
    first_a, first_b = np.append(0, cuts_a)[:-1], np.append(0, cuts_b)[:-1]
    return (np.concatenate([first_a, i, np.searchsorted(ends_a, ends_b[j - 1], "right")]),
            np.concatenate([first_b, np.searchsorted(ends_b, ends_a[i - 1], "right"), j]))


def group_text(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, names: "Names") -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``: the ids of both sides by turns, each with the sign that follows it."""
    sizes_a, sizes_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    parts = np.empty(len(a) + len(b), object)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cuts_a - 1] = last_b[cuts_b - 1] = True
    at_a = np.arange(len(a)) + np.repeat(cuts_b - sizes_b, sizes_a)
    at_b = np.arange(len(b)) + np.repeat(cuts_a, sizes_b)
    parts[at_a] = names.inner[a]
    parts[at_b] = names.inner[b]
    parts[at_a[last_a]] = names.last_a[a[last_a]]
    parts[at_b[last_b]] = names.last_b[b[last_b]]
    return "".join(parts.tolist())[:-1]


class Names:
    """Ids below a bound as text, with each sign that can follow."""

    def __init__(self, n: int):
        self.inner, self.last_a, self.last_b = (np.array([f"{i}{sign}" for i in range(n)], object) for sign in ",|;")


@functools.lru_cache(maxsize=1)
def names_of(n: int) -> Names:
    return Names(n)


def align(a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray, names: Names) -> tuple[str, int, np.ndarray]:
    """(groups as text, their number, links as a id * 2^32 + b id) of ids whose tokens have ``size`` bytes each."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts_a, cuts_b = cuts_of(ends_a, ends_b)
    i, j = links_of(ends_a, ends_b, cuts_a, cuts_b)
    return group_text(a, b, cuts_a, cuts_b, names), len(cuts_a), a[i] << 32 | b[j]


def alignments(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, a, b, times) of every row: the sizes of both token lists and of the
    list of groups, the groups as text ``a1,a2|b1;a3|b2,b3``, and the id pairs linked, each with how often.

    A is the byte-level vocabulary on a space and the text, B the piece model on the text, which adds the
    space itself. A text that is null or empty, or whose bytes one side changes, has no tokens. Rows are
    kept as they are, repeated ids and null ids too."""
    def run(batches):
        reader, bytes_b = piece_model(model)
        bytes_a = byte_level_tokens(vocabulary)
        size_a, size_b = (np.array([len(t) for t in tokens]) for tokens in (bytes_a, bytes_b))
        names = names_of(max(len(bytes_a), len(bytes_b)))
        for batch in slices(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found_a = encode([" " + t if t else "" for t in texts], vocabulary, ranks)
            found_b = reader.encode(texts, num_threads=1)
            counts, groups, links, times = [], [], [], []
            for t, a, b in zip(texts, found_a, found_b):
                whole = f" {t}".encode()
                if not t or b"".join([bytes_a[i] for i in a]) != whole or b"".join([bytes_b[i] for i in b]) != whole:
                    counts.append((0, 0, 0))
                    groups.append("")
                    found = np.zeros(0, np.int64)
                else:
                    named, n, found = align(a, b, size_a, size_b, names)
                    counts.append((len(a), len(b), n))
                    groups.append(named)
                kinds, often = np.unique(found, return_counts=True)
                links.append(kinds)
                times.append(often)
            ends, flat = np.cumsum([len(x) for x in links]), np.concatenate(links)
            n_a, n_b, n_groups = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()),
                list_column(flat >> 32, ends, pa.int32()), list_column(flat & 0xFFFFFFFF, ends, pa.int32()),
                list_column(np.concatenate(times), ends, pa.int32()),
            ], ["doc_id", "n_a", "n_b", "n_groups", "groups", "a", "b", "times"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, "
                                "a array<int>, b array<int>, times array<int>")


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
    return a << 32 | b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how often each id pair is linked in all rows, and whether no other pair of its b id is
    linked more often."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            codes, n = (np.concatenate(x) for x in zip(*held))
            kinds, at = np.unique(codes, return_inverse=True)
            return kinds, np.bincount(at, n, len(kinds)).astype(np.int64)

        for batch in batches:
            held.append((_codes(batch), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(x) for x, _ in held) > HELD:
                held = [summed()]
                if len(held[0][0]) > HELD // 2:
                    yield _counted(*held.pop())
        if held:
            yield _counted(*summed())

    def _counted(kinds, n):
        return pa.RecordBatch.from_arrays([pa.array((kinds >> 32).astype(np.int32)), pa.array((kinds & 0xFFFFFFFF).astype(np.int32)),
                                           pa.array(n)], ["a", "b", "n"])

    parts = aligned.select("a", "b", "times").mapInArrow(run, "a int, b int, n long")
    counts = durable(parts.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are linked so often."""
    size = F.floor(F.log2("n") + 1e-9).cast("int")
    steps = counts.groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    least, total = 62, 0
    for k, pairs in sorted(((r["k"], r["pairs"]) for r in steps), reverse=True):
        total += pairs
        if total > most:
            break
        least = k
    return 1 << least


def cross_tokenizer(docs: DataFrame, vocabulary: str, model: str, ranks: str | None = None, text: str = "text",
                    doc_id: str = "doc_id", frequent: int = FREQUENT, more: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    ``n_links`` counts the linked occurrences of A and B tokens; a pair's count is how many links of the
    whole corpus hold it. ``n_best`` counts the row's links whose pair has the highest count of its B id,
    ties included, and ``count_sum`` adds the counts over its links. ``groups`` is the text that
    ``alignments`` gives; ``more`` are columns made from it and kept in its place. Empty tables give none;
    other columns of ``docs`` are not looked at."""
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/alignment-{uuid.uuid4().hex}"
    found = alignments(docs, vocabulary, model, ranks, text, doc_id)
    kept = [c for c in found.columns if c != "groups"] if more else found.columns
    found.select(*kept, *more).withColumn("row", F.monotonically_increasing_id()).write.option(
        "compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    counts = durable(pair_counts(aligned))
    least = _frequent(counts, frequent)
    known = counts.filter(F.col("n") >= least).toArrow()
    code = known["a"].to_numpy().astype(np.int64) << 32 | known["b"].to_numpy().astype(np.int64)
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], known["n"].to_numpy()[order], known["best"].to_numpy()[order]))

    def run(batches):
        codes, n, best = shared.value
        for batch in batches:
            own, times = _codes(batch), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(batch.column("times").value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
            hit = codes[at] == own if len(codes) else np.zeros(len(own), bool)
            at = at[hit]
            weight = np.zeros((3, len(own) + 1), np.int64)
            weight[0, 1:] = times
            weight[1, 1:][hit] = times[hit] * best[at]
            weight[2, 1:][hit] = times[hit] * n[at]
            sums = np.cumsum(weight, axis=1)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            # Sums over each row; what is not frequent is left for the join.
            columns = [pa.array(s[ends] - s[begins]) for s in sums]
            left = np.cumsum(np.concatenate([[0], ~hit]))[ends] if len(ends) else ends
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *columns, list_column((own >> 32)[~hit], left, pa.int32()),
                 list_column((own & 0xFFFFFFFF)[~hit], left, pa.int32()), list_column(times[~hit], left, pa.int32())],
                [*kept, "n_links", "n_best", "count_sum", "a", "b", "times"])

    kept = [c for c in aligned.columns if c not in ("a", "b", "times")]
    first = aligned.mapInArrow(run, ", ".join(
        [*(f"`{c}` {t}" for c, t in aligned.select(*kept).dtypes), "n_links long, n_best long, count_sum long",
         "a array<int>, b array<int>, times array<int>"]))
    rest = counts.filter(F.col("n") < least)
    if rest.isEmpty():
        return first.drop("row", "a", "b", "times")
    first = durable(first)
    pairs = first.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row", "p.*")
    late = pairs.join(rest, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    return first.join(late, "row", "left").select(
        *[c for c in kept if c != "row"], "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
