"""Language identification by nearest centroid.

A text is the vector of its letter n-grams of one to three, hashed into ``DIMENSIONS`` places and weighted by
TF-IDF, scaled to length one. Each language has several centroids, found by spherical k-means over its
labelled texts, as a language may have several styles. A text gets the language of the centroid with the
largest cosine; one that is farther from it than nearly all training texts of its language are from
theirs is reported as rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.text import slices
from airspan.session import durable

BITS = 13
DIMENSIONS = 1 << BITS
CENTROIDS = 4
# The least share of a language's texts that a centroid stands for.
LEAST_SHARE = 0.1
# Labelled rows of a language that the centroids are fitted on; document frequencies are of all rows.
SAMPLE_ROWS = 1000
# The share of the training texts of a language that may lie beyond its bound.
REJECTED = 0.005
UNKNOWN = "und"
# Texts whose counts are held at a time, a row of DIMENSIONS numbers for each.
ROWS = 256


@functools.cache
def _alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, has_letter): how often each text has the n-grams of each place, a row for each text.

    Letters are lower-cased; whatever stands between them is one separator, as are the ends of the
    text. An n-gram may begin or end with a separator but has none within."""
    lower = [f" {(t or '').lower()} " for t in texts]
    flat = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    letter = _alphabetic()[flat]
    has = np.bincount(owner[letter], minlength=len(lower)) > 0
    first = np.ones(len(flat), bool)
    first[1:] = letter[:-1] | (owner[1:] != owner[:-1])
    keep = letter | first
    chars, owner = np.where(letter, flat, 0).astype(np.uint64)[keep], owner[keep]
    counts = np.zeros(len(lower) * DIMENSIONS, np.int64)
    h = np.zeros(len(chars), np.uint64)
    for n in range(3):
        m = max(0, len(chars) - n)
        h = h[:m] * np.uint64(0x100000001B3) + chars[n:] + np.uint64(n + 1)
        use = chars[:m] != 0 if n == 0 else owner[:m] == owner[n:]
        if n == 2:
            use &= chars[1: m + 1] != 0
        place = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
        counts += np.bincount(owner[:m][use] * DIMENSIONS + place[use], minlength=len(counts))
    return counts.reshape(len(lower), DIMENSIONS), has


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one; zero for a text without n-grams."""
    out = np.zeros(counts.shape, np.float32)
    rows, places = np.nonzero(counts)
    out[rows, places] = counts[rows, places] * idf[places]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def _clustered(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from k of the texts. Centroids of few texts are left out: they stand for odd
    texts, not for a style of the language."""
    centers = x[np.random.default_rng(len(x)).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        new = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        new /= np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, centers, atol=1e-6):
            break
        centers = new
    sizes = np.bincount((x @ centers.T).argmax(axis=1), minlength=len(centers))
    return centers[sizes >= min(LEAST_SHARE * len(x), sizes.max())]


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centers: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        for start in range(0, len(texts), ROWS):
            part = texts[start: start + ROWS]
            counts, has = gram_counts(part)
            cosines = _vectors(counts, self.idf) @ self.centers.T
            for i in range(len(part)):
                if not has[i] or not len(self.languages):
                    yield UNKNOWN, 0.0, True
                    continue
                c = int(cosines[i].argmax())
                cosine = float(min(1.0, max(0.0, cosines[i, c])))
                yield self.languages[self.owner[c]], cosine, bool(cosine < self.bounds[self.owner[c]])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Centroids:
    """Centroids from the rows that have a language.

    Document frequencies count all these rows. The vectors of about ``sample_rows`` rows of each
    language, those with the smallest hash of their text and each text once, come to the driver for the clustering."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        "text is not null and lang is not null")
    rows = rows.withColumn("key", F.xxhash64("text"))
    # Copies of a text are one text of the sample.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang", "key").agg(F.lit(1)).groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Centroids([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(0))
    # The share of a language's texts to be taken, as a bound on a hash that is even over its range.
    bound = F.lit(0.0)
    for name in languages:
        bound = F.when(F.col("lang") == name, F.lit(min(1.0, sample_rows / sizes[name]))).otherwise(bound)
    picked = (F.pmod("key", F.lit(1 << 30)) / float(1 << 30)) < bound

    def run(batches):
        seen = np.zeros(DIMENSIONS, np.int64)
        total, kind, given = 0, pa.list_(pa.int32()), set()
        for batch in slices(batches, "text"):
            texts, picks = batch.column("text").to_pylist(), batch.column("picked").to_pylist()
            names = list(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist()))
            for start in range(0, len(texts), ROWS):
                counts, has = gram_counts(texts[start: start + ROWS])
                seen += (counts > 0).sum(axis=0)
                total += len(counts)
                taken = []
                for i in range(len(counts)):
                    if picks[start + i] and has[i] and names[start + i] not in given:
                        given.add(names[start + i])
                        taken.append(i)
                used = [np.flatnonzero(counts[i]) for i in taken]
                if taken:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("lang").take(pa.array([start + i for i in taken])),
                        batch.column("key").take(pa.array([start + i for i in taken])), pa.array([u.tolist() for u in used], kind),
                        pa.array([counts[i][u].tolist() for i, u in zip(taken, used)], kind)], ["lang", "key", "places", "counts"])
        used = np.flatnonzero(seen)
        if total:
            yield pa.RecordBatch.from_arrays([
                pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([[-1, *used.tolist()]], kind), pa.array([[total, *seen[used].tolist()]], kind),
            ], ["lang", "key", "places", "counts"])

    found = durable(rows.select("text", "lang", "key", picked.alias("picked")).mapInArrow(
        run, "lang string, key long, places array<int>, counts array<int>"))
    # One row per n-gram place, of which there are DIMENSIONS, and one for the number of texts.
    frequency = found.filter("lang is null").select(F.explode(F.arrays_zip("places", "counts")).alias("z")).groupBy(
        F.col("z.places").alias("place")).agg(F.sum("z.counts").alias("n")).collect()
    n = {r["place"]: r["n"] for r in frequency}
    idf = np.zeros(DIMENSIONS, np.float32)
    for place, count in n.items():
        if place >= 0:
            idf[place] = np.log((1 + n[-1]) / (1 + count)) + 1
    samples = {}
    for name in languages:
        got = found.filter(F.col("lang") == name).dropDuplicates(["key"]).collect()
        if got:
            counts = np.zeros((len(got), DIMENSIONS), np.int32)
            for i, r in enumerate(got):
                counts[i, r["places"]] = r["counts"]
            samples[name] = _vectors(counts, idf)
    known = list(samples)
    means = np.array([x.mean(axis=0) for x in samples.values()], np.float32).reshape(-1, DIMENSIONS)
    means /= np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-12)
    centers, owner, bounds = [means[:0]], [], []
    for k, (name, x) in enumerate(samples.items()):
        # Texts nearer to another language are wrongly labelled and must not make a centroid.
        own = x[(x @ means.T).argmax(axis=1) == k]
        own = own if 2 * len(own) >= len(x) else x
        fitted = _clustered(own, CENTROIDS)
        bounds.append(float(np.quantile((own @ fitted.T).max(axis=1), REJECTED)))
        owner += [k] * len(fitted)
        centers.append(fitted)
    return Centroids(known, idf, np.concatenate(centers), np.array(owner, int), np.array(bounds))


def predict(docs: DataFrame, model: Centroids, text: str = "text", *keep: Column) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred, score and rejected. ``score`` is the cosine with
    the nearest centroid. A text that is null or has no letter is ``und`` with score 0, and rejected."""
    df = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "_text"):
            lang, score, rejected = zip(*sent.value.predict(batch.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected)],
                [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    schema = df.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return df.mapInArrow(run, schema)
