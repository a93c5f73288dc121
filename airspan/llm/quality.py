"""Document quality by weak supervision: rules vote or abstain, expectation-maximisation finds how far
each rule can be trusted on each kind of document, and the posterior probability of a good document decides.

Everything runs as SQL expressions. The driver sees only the counts of the vote patterns, of which
there are at most 3 to the number of rules whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airspan.llm.text import SPACES
from airspan.session import durable

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"
GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Looks for one kind of bad document: votes BAD beyond one bound and GOOD within another; between
    them it abstains."""
    kind: str
    value: Column
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(F.col("n_words") == 0, F.lit(ABSTAIN)).when(self.bad, F.lit(BAD)).when(
            self.good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _above(kind: str, value: Column, bad: float, good: float) -> Rule:
    return Rule(kind, value, value > bad, value <= good)


def default_rules() -> list[Rule]:
    """Symbols, repeated words, capitals, word length, repeated lines, few different words, exclamations."""
    length = _share("word_chars", "n_words")
    variety = _share("n_distinct", "n_words")
    longer = F.least(F.lit(1.0), F.pow(5000 / F.greatest(F.col("n_words"), F.lit(1)), F.lit(0.4)))
    return [
        _above("symbols", _share("n_symbols", "n_words"), 0.1, 0.02),
        _above("repetition", _share("n_repeat_words", "n_words"), 0.3, 0.15),
        _above("shouting", _share("n_upper", "word_chars"), 0.4, 0.2),
        Rule("words", length, (length < 2) | (length > 15), length.between(3, 10)),
        _above("repetition", _share("n_dup_lines", "n_lines"), 0.3, 0.1),
        # The longer a text, the fewer of its words are new: beyond 5,000 words both bounds fall with a power of it.
        Rule("repetition", variety, variety < (0.1 + 20 / (F.col("n_words") + 20)) * longer,
             variety > (0.2 + 20 / (F.col("n_words") + 20)) * longer),
        _above("shouting", _share("n_shouts", "n_words"), 0.2, 0.05),
    ]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the struct ``name``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_distinct, n_upper, n_shouts.

    Words are runs without white space. A repeated word stands in a window of eight words that
    the text has twice or more; windows are compared by 64-bit hash. Only a text that has such
    windows sorts them, so the work per text is linear or a sort."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    at = lambda i: f"`{name}`.{i}"
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(body, SPACES, -1), "")
    df = docs.withColumn(name, F.struct(body.alias("body"), words.alias("words"), lines.alias("lines")))
    df = df.withColumn(name, F.struct(
        F.size(at("words")).cast("long").alias("n_words"),
        F.length(F.array_join(at("words"), "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(at("body"), SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(at("body"), r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.split(at("body"), r"!!(?=[\x20\x09-\x0D]|$)", -1)).cast("long").alias("n_shouts"),
        F.size(at("lines")).cast("long").alias("n_lines"),
        F.size(F.array_distinct(at("lines"))).cast("long").alias("n_line_kinds"),
        F.transform(at("words"), lambda w: F.xxhash64(w)).alias("h")))
    df = df.withColumn(name, F.col(name).withField("windows", F.when(
        F.size(at("h")) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(at("h")) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(at("h"), i, WINDOW))))))
    df = df.withColumn(name, F.col(name).withField("sorted", F.when(
        F.size(F.array_distinct(at("windows"))) < F.size(at("windows")),
        F.sort_array(F.transform(at("windows"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))))
    df = df.withColumn(name, F.col(name).withField("twice", F.sort_array(F.array_compact(F.transform(
        at("sorted"), lambda e, k: F.when(
            F.coalesce(e.x == F.get(at("sorted"), k - 1).x, F.lit(False))
            | F.coalesce(e.x == F.get(at("sorted"), k + 1).x, F.lit(False)), e.i))))))
    covered = F.aggregate(
        F.transform(at("twice"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at("twice"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda s, x: s + x)
    # A generator of one row: what follows reads its result and does not compute it again for each use.
    return df.withColumn(name, F.explode(F.array(F.struct(
        F.col(at("n_words")).alias("n_words"), F.col(at("word_chars")).alias("word_chars"),
        F.col(at("n_symbols")).alias("n_symbols"), F.col(at("n_lines")).alias("n_lines"),
        (F.col(at("n_lines")) - F.col(at("n_line_kinds"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(at("h"))).cast("long").alias("n_distinct"),
        F.col(at("n_upper")).alias("n_upper"), (F.col(at("n_shouts")) - 1).alias("n_shouts")))))


@dataclass(frozen=True)
class Trust:
    """The share of each class and how often each rule votes BAD on it. The first class is that of
    the good documents; each kind of bad document is one of the others."""
    share: tuple[float, ...]
    bad: tuple[tuple[float, ...], ...]


def _kinds(rules: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(r.kind for r in rules))


def estimate(patterns: Sequence[tuple[tuple[int, ...], int]], rules: Sequence[Rule], rounds: int = 200) -> Trust:
    """Expectation-maximisation over (votes, documents) counts. Abstentions say nothing.

    Rules of one kind look for the same fault and are right together, so each kind has a class of
    its own; with a single bad class, the kind that several rules find would become that class.
    A rule starts as one that is seldom wrong about a good document and finds most of its own
    kind. The start counts like ten documents, so a kind that does not occur stays defined."""
    kinds = _kinds(rules)
    share = [0.8] + [0.2 / len(kinds)] * len(kinds)
    bad = [[0.005] * len(rules)] + [[0.6 if r.kind == k else 0.05 for r in rules] for k in kinds]
    start = [row[:] for row in bad]
    for _ in range(rounds):
        voted = [[10.0] * len(rules) for _ in bad]
        found = [[10 * p for p in row] for row in start]
        weight = [10 * x for x in share]
        for votes, n in patterns:
            for c, p in enumerate(_posterior(share, bad, votes)):
                weight[c] += n * p
                for r, v in enumerate(votes):
                    if v != ABSTAIN:
                        voted[c][r] += n * p
                        found[c][r] += n * p * (v == BAD)
        before = [*share, *(p for row in bad for p in row)]
        share = [x / sum(weight) for x in weight]
        bad = [[min(0.99, max(0.001, f / v)) for f, v in zip(*rows)] for rows in zip(found, voted)]
        # A rule that a good document often fails is no rule; what it finds is then its kind.
        bad[0] = [min(0.02, p) for p in bad[0]]
        if max(abs(x - y) for x, y in zip(before, [*share, *(p for row in bad for p in row)])) < 1e-9:
            break
    return Trust(tuple(share), tuple(map(tuple, bad)))


def _posterior(share: Sequence[float], bad: Sequence[Sequence[float]], votes: Sequence[int]) -> list[float]:
    odds = [x * math.prod(p if v == BAD else 1 - p for p, v in zip(row, votes) if v != ABSTAIN)
            for x, row in zip(share, bad)]
    return [x / sum(odds) for x in odds]


def _probability(trust: Trust, rules: Sequence[Rule]) -> Column:
    """The posterior probability of the class of good documents."""
    against = F.lit(0.0)
    for share, row in zip(trust.share[1:], trust.bad[1:]):
        odds = F.lit(math.log(share / trust.share[0]))
        for rule, p, q in zip(rules, row, trust.bad[0]):
            odds = odds + F.when(rule.vote() == BAD, F.lit(math.log(p / q))).when(
                rule.vote() == GOOD, F.lit(math.log((1 - p) / (1 - q)))).otherwise(F.lit(0.0))
        against = against + F.exp(odds)
    return 1 / (1 + against)


def learn(statistics: DataFrame, rules: Sequence[Rule]) -> Trust:
    """Trust in the rules from the columns of ``with_statistics`` over all documents."""
    names = [f"v{i}" for i in range(len(rules))]
    counts = statistics.select(*[r.vote().alias(n) for r, n in zip(rules, names)]).groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"))
    # At most 3 ** len(rules) rows.
    return estimate(sorted((tuple(r[:-1]), r[-1]) for r in counts.collect()), rules)


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5,
            rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the statistics, base_failed, p_good and kept of every row.

    ``base_failed``: fewer than 20 words, or more than 30 % repeated words. ``kept``: not failed, and
    the posterior probability of a good document is at least the threshold. A null text has no
    words and fails. Repeated rows and rows without an id are judged like any other; other columns
    are not looked at."""
    rules = default_rules() if rules is None else rules
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = durable(with_statistics(slim, "text", "s").select("doc_id", "s.*"))
    out = stats.withColumn("base_failed", _failed()).withColumn("p_good", _probability(learn(stats, rules), rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5,
              rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows that ``quality`` keeps, with their columns. The texts are measured twice, for the trust
    and for the verdict, as storing them would cost more than reading them again."""
    rules = default_rules() if rules is None else rules
    trust = learn(with_statistics(docs.select(F.col(text).alias("text")), "text", "s").select("s.*"), rules)
    name = fresh(docs, "quality_statistics")
    judged = with_statistics(docs, text, name)
    verdict = fresh(docs, "quality_row")
    rows = judged.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(verdict), F.col(f"`{name}`.*"))
    return rows.filter(~_failed() & (_probability(trust, rules) >= threshold)).select(f"`{verdict}`.*")
