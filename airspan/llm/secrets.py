"""Secrets in texts: assignments, access keys and hex runs by pattern, others by entropy.

A candidate is a run of characters of one class. A window slides over it; the counts of the characters in
it change by one character in and one out, and with them the sum of n * log2(n), from which the Shannon
entropy follows: log2(width) - sum / width. Sums are whole numbers, so every engine finds the same
windows. Windows above the class's threshold join into spans. Candidates that the allow list knows are
passed over, as are spans within one found by pattern. All of it is SQL expressions on the row.

No expression walks a text or a list of matches again for each character or match: texts are split once, running sums
go in chunks, and a window starts anew in each chunk of a long run. So time grows with a text's length, whether
it has a run of megabytes or hundreds of thousands of matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The patterns, and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A run is taken whole, so asking for the least length in the pattern gives the same runs.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

KINDS = ("assign", "access", "hex", "hex_entropy", "base64_entropy")
# n * log2(n) as whole numbers of this many parts.
PARTS = 1 << 20
# Matches that one pass over a list takes before the next chunk, and characters of a long run or text.
CHUNK, BLOCK = 128, 1024


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` at least ``width`` long; ``alphabet`` numbers their characters (after
    ``fold``); a window of ``width`` with an entropy of ``bits`` or more is suspicious."""
    kind: str
    pattern: str
    alphabet: str
    width: int
    bits: float
    fold: bool = False

    @property
    def most(self) -> int:
        """The largest sum of n * log2(n) that still has the entropy."""
        return math.floor((math.log2(self.width) - self.bits) * self.width * PARTS)

    @property
    def table(self) -> list[int]:
        return [0, *(round(n * math.log2(n) * PARTS) for n in range(1, self.width + 1))]


CLASSES = (
    CharacterClass("hex_entropy", "[0-9A-Fa-f]", "0123456789abcdef", 16, 2.9, fold=True),
    CharacterClass("base64_entropy", "[A-Za-z0-9+/_-]",
                   "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.7),
)

# Candidates that are no secrets: words and words joined by marks, numbers and marks alone, UUIDs,
# the alphabet or the digits written out, and placeholders.
# The first says what words have not, as a pattern with a group for each word needs stack for each.
ALLOWED = (
    r"^(?![-+/_]*([0-9]|$))(?!.*([a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]|[A-Z]{2}[a-z]|[0-9]{5}))",
    r"^[0-9+/_-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"(?i)example|placeholder|xxxxxxxx",
)


def _let(value: Column, body: Callable) -> Column:
    """What ``body`` makes of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, item: str, value: Callable, plus: Callable) -> Column:
    """For each item of a list, of type ``item``, (item, before): what ``plus`` makes of the values of all before it, from 0.
    Each chunk begins with what the chunks before it come to."""
    none = F.array().cast(f"array<struct<item:{item},before:int>>")

    def within(chunk, head):
        return F.aggregate(
            chunk, F.struct(head.alias("now"), none.alias("all")),
            lambda a, x: F.struct(plus(a.now, value(x)).alias("now"), F.concat(a.all, F.array(F.struct(
                x.alias("item"), a.now.alias("before")))).alias("all")), lambda a: a.all)

    def heads(chunks):
        return F.aggregate(
            chunks, F.struct(F.lit(0).alias("now"), F.array().cast("array<int>").alias("all")),
            lambda a, chunk: F.struct(plus(a.now, F.aggregate(chunk, F.lit(0), lambda s, x: plus(s, value(x)))).alias("now"),
                                      F.concat(a.all, F.array(a.now)).alias("all")), lambda a: a.all)

    chunks = lambda v: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
    return _let(items, lambda v: F.when(F.size(v) == 0, none).otherwise(
        _let(chunks(v), lambda parts: F.flatten(F.zip_with(parts, heads(parts), within)))))


def _runs(text: Column, pattern: str) -> Column:
    """(start, end, hit) of every leftmost match, in code points: the parts between the matches and the matches
    themselves, laid end to end."""
    step = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.zip_with(
        F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit"))))
    at = _running(step, "struct<gap:int,hit:string>", lambda x: x.gap + F.length(x.hit), lambda a, b: a + b)
    runs = F.transform(at, lambda x: F.struct(
        (x.before + x.item.gap).alias("start"), (x.before + x.item.gap + F.length(x.item.hit)).alias("end"), x.item.hit.alias("hit")))
    return F.when(text.rlike(pattern), runs).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _blocks(text: Column, size: int) -> Column:
    """The text in pieces of so many code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _hot_windows(piece: Column, kind: CharacterClass) -> Column:
    """(start, end) within a piece of a run of the joined windows that reach the class's entropy."""
    w, sums = kind.width, F.array(*[F.lit(x).cast("long") for x in kind.table])
    # Counts are packed in whole numbers, of which a step changes two.
    bits = w.bit_length()
    per = 63 // bits
    word_of = F.array(*[F.lit(c // per) for c in range(len(kind.alphabet))])
    shift_of = F.array(*[F.lit(c % per * bits) for c in range(len(kind.alphabet))])
    unit_of = F.array(*[F.lit(1 << c % per * bits).cast("long") for c in range(len(kind.alphabet))])
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(kind.alphabet) // per)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("at"), none.alias("spans"))

    def count(counts, c):
        return F.call_function("shiftright", F.get(counts, F.get(word_of, c)), F.get(shift_of, c)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def slide(a, x):
        # x: the character that comes in and the one that leaves (null while the window fills).
        old, new, first = F.coalesce(count(a.counts, x.old), F.lit(1)), count(a.counts, x.new), x.old.isNull()
        out = F.when(first, F.lit(0).cast("long")).otherwise(F.get(sums, old - 1) - F.get(sums, old))
        before = new - F.when(x.new == x.old, 1).otherwise(0)
        total = a.sum + out + F.get(sums, before + 1) - F.get(sums, before)
        counts = F.transform(a.counts, lambda n, i: n + F.when(i == F.get(word_of, x.new), F.get(unit_of, x.new)).otherwise(F.lit(0).cast("long"))
                             - F.when(i == F.get(word_of, x.old), F.get(unit_of, x.old)).otherwise(F.lit(0).cast("long")))
        begin, end = a.at + 1 - w, a.at + 1
        joined = F.when(
            (F.size(a.spans) > 0) & (begin <= F.try_element_at(a.spans, F.lit(-1)).end),
            F.concat(F.slice(a.spans, 1, F.size(a.spans) - 1), F.array(F.struct(
                F.try_element_at(a.spans, F.lit(-1)).start.alias("start"), end.alias("end"))))).otherwise(
            F.concat(a.spans, F.array(F.struct(begin.alias("start"), end.alias("end")))))
        return F.struct(counts.alias("counts"), total.alias("sum"), end.alias("at"),
                        F.when((begin >= 0) & (total <= kind.most), joined).otherwise(a.spans).alias("spans"))

    letters = F.slice(F.split(F.lower(piece) if kind.fold else piece, "", -1), 1, F.length(piece))
    codes = F.transform(letters, lambda c: F.instr(F.lit(kind.alphabet), c) - 1)
    past = F.concat(F.array_repeat(F.lit(None).cast("int"), w), codes)
    pairs = F.zip_with(codes, F.slice(past, 1, F.length(piece)), lambda n, o: F.struct(n.alias("new"), o.alias("old")))
    return F.aggregate(pairs, start, slide, lambda a: a.spans)


def _entropy_spans(text: Column, kind: CharacterClass, allowed: Sequence[str]) -> Column:
    """(start, end) in the text of what the class finds."""
    known = lambda r: F.lit(False) if not allowed else _any(*[r.hit.rlike(p) for p in allowed])
    left = F.filter(_runs(text, f"(?<!{kind.pattern}){kind.pattern}{{{kind.width},}}"), lambda r: ~known(r))

    def of_run(r):
        # The windows that begin in a block need the letters that the next one begins with.
        piece = lambda blocks, b, i: F.concat(b, F.coalesce(F.substring(F.get(blocks, i + 1), 1, kind.width - 1), F.lit("")))
        return _let(_blocks(r.hit, BLOCK), lambda blocks: F.flatten(F.transform(blocks, lambda b, i: F.transform(
            _hot_windows(piece(blocks, b, i), kind), lambda s: F.struct(
                (r.start + i * BLOCK + s.start).alias("start"), (r.start + i * BLOCK + s.end).alias("end"))))))

    def joined(hot):
        # Spans that meet across blocks are one: it begins after a gap and ends before one.
        begins = F.filter(hot, lambda s, i: (i == 0) | (s.start > F.get(hot, i - 1).end))
        ends = F.filter(hot, lambda s, i: (i == F.size(hot) - 1) | (F.get(hot, i + 1).start > s.end))
        return F.zip_with(begins, ends, lambda s, e: F.struct(s.start.alias("start"), e.end.alias("end")))

    return _let(F.flatten(F.transform(left, of_run)), joined)


def _any(first: Column, *more: Column) -> Column:
    for condition in more:
        first = first | condition
    return first


def _beyond(spans: Column, by: Column) -> Column:
    """The spans that are not within one of ``by``: in the order of their starts, those that end after all of ``by`` that
    have begun."""
    part = lambda own: lambda s: F.struct(s.start.alias("start"), F.lit(own).alias("own"), s.end.alias("end"), s.kind.alias("kind"))

    def left(found):
        both = F.array_sort(F.concat(F.transform(by, part(0)), F.transform(found, part(1))))
        ran = _running(both, "struct<start:int,own:int,end:int,kind:int>", lambda x: F.when(x.own == 0, x.end).otherwise(0), lambda a, b: F.greatest(a, b))
        out = F.transform(F.filter(ran, lambda x: (x.item.own == 1) & (x.before < x.item.end)), lambda x: F.struct(
            x.item.start.alias("start"), x.item.kind.alias("kind"), x.item.end.alias("end")))
        return F.when(F.size(found) > 0, out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))

    return _let(spans, left)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once per row, however often it is used later."""
    return df.withColumn(name, F.explode(F.array(value)))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of (start, kind, end, hit), in code points of the text, end
    exclusive, sorted by start and kind. ``base`` is found by pattern, ``added`` by entropy.

    A null text is an empty one. Repeated rows and rows without an id are searched like any other; other columns
    are not looked at."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def of_kind(runs: Column, kind: str, *more: str) -> Column:
        return F.transform(runs, lambda r: F.struct(
            r.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), r.end.alias("end"), *[r[c].alias(c) for c in more]))

    long_enough = F.filter(_runs(F.col("text"), ASSIGN), lambda r: F.length(F.regexp_extract(r.hit, ASSIGN, 2)) >= ASSIGN_LEAST)
    df = _once(df, "base", F.array_sort(F.concat(
        of_kind(long_enough, "assign", "hit"), of_kind(_runs(F.col("text"), ACCESS), "access", "hit"),
        of_kind(_runs(F.col("text"), HEX), "hex", "hit"))))
    plain = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def more(seen: Column, found: Column, left: Sequence[CharacterClass]) -> Column:
        """The spans of each class that are not within those seen before it."""
        if not left:
            return found
        new = _beyond(of_kind(_entropy_spans(F.col("text"), left[0], allowed), left[0].kind), seen)
        return _let(new, lambda spans: more(F.concat(seen, spans), F.concat(found, spans), left[1:]))

    df = _once(df, "found", F.array_sort(more(plain, none, classes)))
    # A span's text is cut out of the blocks that it touches.
    df = _once(df, "blocks", F.when(F.size("found") > 0, _blocks(F.col("text"), BLOCK)))

    def hit(s):
        block = F.floor(s.start / BLOCK).cast("int")
        around = F.array_join(F.slice("blocks", block + 1, F.floor((s.end - 1) / BLOCK).cast("int") - block + 1), "")
        return F.substr(around, s.start - block * BLOCK + 1, s.end - s.start)

    hits = F.transform("found", lambda s: s.withField("hit", hit(s)))
    return df.select("doc_id", "base", hits.alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
