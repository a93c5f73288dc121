"""Toxicity by weak supervision.

Voters are words and beginnings of words: a small lexicon, and those that the labelled rows show almost
only in toxic texts, once or, if that is what tells, twice. A voter fires in a text that has its word so
often. A generative model of the hidden true
label estimates by expectation-maximisation how often each voter fires in toxic and in clean texts; voters
that fire together within a class (as nested beginnings do) are one piece of evidence and share its weight.
The posterior labels train a logistic classifier on the voters' firing and the number of hits, and that
classifier scores all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.text import slices, word_codes
from airspan.session import durable

LEXICON = (
    "bastard", "clown", "cretin", "disgusting", "dumb", "filthy", "freak", "idiot", "imbecile", "loser", "moron",
    "pathetic", "pig", "scum", "shut", "stupid", "trash", "ugly", "vermin", "worthless",
)
# Whole words, and beginnings of these lengths.
WHOLE, BEGINNINGS = 0, (4, 5, 6, 7)
# How often a text must have the term.
TIMES = (1, 2)
# Labelled rows that the model is fitted on, and voters it has at most.
SAMPLE_ROWS, MOST_VOTERS = 10_000, 512
# A voter is found in so many toxic texts of the sample at least, and so rarely in clean ones.
SUPPORT, PRECISION = 3, 0.9
ROUNDS = 30
# The correlation within a class from which on two voters share their weight.
CORRELATED = 0.2


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, pa.Array]]:
    """(ends, codes, terms by kind) of the words of letters: the word itself, and its beginnings where it
    is longer (null elsewhere)."""
    ends, codes, words = word_codes(texts)
    clean = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    size = pc.utf8_length(clean)
    kinds = {WHOLE: pc.if_else(pc.greater(size, 2), clean, None)}
    for n in BEGINNINGS:
        kinds[n] = pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(clean, 0, n), None)
    return ends, codes, kinds


def _cells(owner: np.ndarray, of: np.ndarray, size: int, times: int) -> np.ndarray:
    """owner * size + of, of the terms (of >= 0) that an owner has at least so often."""
    cells, counts = np.unique(owner[of >= 0] * np.int64(size) + of[of >= 0], return_counts=True)
    return cells[counts >= times]


@dataclass
class Voters:
    """The terms of each kind and number of times; a voter's number is its place in all of them together."""
    terms: dict[tuple[int, int], list[str]]

    @property
    def size(self) -> int:
        return sum(map(len, self.terms.values()))

    def fired(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, voter, hits): who fires where, and how many words of each text have a voter that
        fires on a single one."""
        ends, codes, kinds = _terms(texts)
        owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        hit, cells, base, size = np.zeros(len(codes), bool), [np.zeros(0, np.int64)], 0, max(1, self.size)
        for (kind, times), terms in self.terms.items():
            if terms and len(codes):
                at = pc.index_in(kinds[kind], value_set=pa.array(terms, kinds[kind].type))
                at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)[codes]
                hit |= (at >= 0) & (times == 1)
                cells.append(_cells(owner, np.where(at >= 0, at + base, -1), size, times))
            base += len(terms)
        found = np.sort(np.concatenate(cells))
        return found // size, found % size, np.bincount(owner[hit], minlength=len(ends))


def find_voters(sample: DataFrame, lexicon=LEXICON) -> Voters:
    """The lexicon and the terms that the rows (text, label) show in toxic texts almost alone. A term whose
    single occurrence tells is not looked for twice."""
    def run(batches):
        for batch in slices(batches, "text"):
            ends, codes, kinds = _terms(batch.column("text"))
            owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            toxic = batch.column("label").to_numpy(zero_copy_only=False) == 1
            for kind, terms in kinds.items():
                coded = terms.dictionary_encode()
                number = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                n = len(coded.dictionary)
                if not len(codes) or not n:
                    continue
                out = [pa.array(np.full(n, kind, np.int32)), coded.dictionary.cast(pa.string())]
                for times in TIMES:
                    cells = _cells(owner, number[codes], n, times)
                    term, in_toxic = cells % n, toxic[cells // n]
                    out += [pa.array(np.bincount(term[in_toxic], minlength=n)), pa.array(np.bincount(term, minlength=n))]
                yield pa.RecordBatch.from_arrays(out, ["kind", "term", "toxic1", "texts1", "toxic2", "texts2"])

    counts = sample.select("text", "label").mapInArrow(
        run, "kind int, term string, toxic1 long, texts1 long, toxic2 long, texts2 long")
    sums = counts.groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in ("toxic1", "texts1", "toxic2", "texts2")])
    tells = lambda t: (F.col(f"toxic{t}") >= SUPPORT) & (F.col(f"toxic{t}") >= PRECISION * F.col(f"texts{t}"))
    found = sums.withColumn("times", F.when(tells(1), 1).when(tells(2), 2)).filter("times is not null").orderBy(
        F.desc(F.when(F.col("times") == 1, F.col("toxic1")).otherwise(F.col("toxic2"))), "kind", "term").limit(MOST_VOTERS)
    terms: dict[tuple[int, int], list[str]] = {(k, t): [] for k in (WHOLE, *BEGINNINGS) for t in TIMES}
    for row in found.collect():
        terms[row["kind"], row["times"]].append(row["term"])
    terms[WHOLE, 1] += [w for w in lexicon if w not in terms[WHOLE, 1]]
    return Voters(terms)


def _rates(votes: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter fires in toxic and in clean texts, given their probabilities."""
    on1 = (p @ votes + 0.5) / (p.sum() + 1)
    on0 = ((1 - p) @ votes + 0.05) / ((1 - p).sum() + 1)
    return np.clip(on1, 1e-4, 1 - 1e-4), np.clip(on0, 1e-4, 1 - 1e-4)


def _expected(votes: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The probabilities after expectation-maximisation from p, each voter's evidence times its weight."""
    for _ in range(ROUNDS):
        on1, on0 = _rates(votes, p)
        odds = np.log((p.sum() + 1) / ((1 - p).sum() + 1)) + votes @ (weight * np.log(on1 / on0)) + (1 - votes) @ (
            weight * np.log((1 - on1) / (1 - on0)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return p


def posterior(fires: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The probability of each text to be toxic, from who fires (texts x voters) and the given labels,
    which are one voter more that never abstains.

    Correlations are those within the rows of each given label; a voter shares its weight with the voters
    that it is correlated with. They are not taken from the estimate, where many copies of a voter would
    have made themselves the truth and seem independent."""
    votes = np.concatenate([fires, labels[:, None] == 1], axis=1).astype(float)
    given = np.where(labels == 1, 1.0, 0.0)
    on1, on0 = _rates(votes, given)
    rest = votes - np.outer(given, on1) - np.outer(1 - given, on0)
    cov = rest.T @ rest / max(1, len(votes))
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    together = cov / np.outer(sd, sd)
    together = np.where(together >= CORRELATED, np.minimum(together, 1), 0)
    np.fill_diagonal(together, 0)
    # The label itself is left over as a constant within its classes.
    together[-1], together[:, -1] = 0, 0
    return _expected(votes, np.where(labels == 1, 0.95, 0.05), 1 / (1 + together.sum(axis=1)))


def _features(rows: np.ndarray, voters: np.ndarray, hits: np.ndarray, size: int) -> np.ndarray:
    """A constant, any hit, the logarithm of hits, and who fires; scaled by nothing."""
    x = np.zeros((len(hits), size + 3))
    x[:, 0], x[:, 1], x[:, 2] = 1, hits > 0, np.log1p(hits)
    x[rows, voters + 3] = 1
    return x


def _logistic(x: np.ndarray, p: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps with an L2 penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[0], ridge[1:3] = 1e-3, 0.3
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (p - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, voters, hits = self.voters.fired(texts)
        w = self.weights
        odds = w[0] + w[1] * (hits > 0) + w[2] * np.log1p(hits)
        odds += np.bincount(rows, w[voters + 3], len(hits)) if len(rows) else 0.0
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon=LEXICON) -> Classifier:
    """From rows (text, label) with labels 0 and 1; others are left out, as are null texts.

    Different texts only, about ``sample_rows`` of them, those with the smallest hash. Their votes, a few
    numbers per text, come to the driver. Without labelled rows the lexicon alone decides."""
    rows = labelled.filter("text is not null and label in (0, 1)").select(F.col("text").cast("string").alias("text"), "label")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    total = rows.count()
    sample = durable(rows.filter(place < min(1.0, sample_rows / max(1, total))).groupBy("text").agg(F.max("label").alias("label")))
    voters = find_voters(sample, lexicon)
    shared = labelled.sparkSession.sparkContext.broadcast(voters)

    def run(batches):
        for batch in slices(batches, "text"):
            owner, fired, hits = shared.value.fired(batch.column("text"))
            cuts = np.searchsorted(owner, np.arange(len(hits) + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("label").cast(pa.int32()),
                pa.array([fired[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32())), pa.array(hits)],
                ["label", "fired", "hits"])

    got = sample.mapInArrow(run, "label int, fired array<int>, hits long").collect()
    if not got:
        return Classifier(voters, np.concatenate([[-3.0, 4.0, 0.0], np.zeros(voters.size)]))
    labels, hits = np.array([r["label"] for r in got]), np.array([r["hits"] for r in got])
    owner = np.repeat(np.arange(len(got)), [len(r["fired"]) for r in got])
    fired = np.array([v for r in got for v in r["fired"]], np.int64)
    fires = np.zeros((len(got), voters.size), bool)
    fires[owner, fired] = True
    return Classifier(voters, _logistic(_features(owner, fired, hits, voters.size), posterior(fires, labels)))


def score(docs: DataFrame, model: Classifier, text: str = "text", *keep: Column) -> DataFrame:
    """The ``keep`` columns of every row with its score, from 0 to 1, higher for toxic texts. A null or empty
    text has no words and so the score of a text in which no voter fires."""
    df = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(shared.value.scores(batch.column("_text")))], [*batch.schema.names[:-1], "score"])

    return df.mapInArrow(run, df.drop("_text").schema.add("score", "double"))
