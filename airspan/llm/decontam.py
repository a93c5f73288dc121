"""Benchmark items that stand in documents, whole and up to a share of changed words.

Item and text are compared as sequences of words, in lower case and without punctuation. The search for an
item of n words with at most k edits (insertions, deletions, replacements of a word) goes in three steps:

1. Of k + 1 runs that make up the item, one must be in the text unchanged. Only item-sized windows around
   such a run can be near the item, so all others are left out without loss.
2. The CGK random walk turns each window into a string of fixed length: step j copies the current word and
   moves on if a random bit, drawn for the step and the word, says so. Few edits give a small Hamming
   distance, as walks over equal words meet again. Bit sampling over several walks finds the items
   with equal words at the sampled steps. How many walks are needed for the wanted recall is measured
   on the items themselves, with k random edits.
3. The edit distance decides, with free ends on the side of the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from airspan.llm.text import hashes_of, mixed, slices, word_codes

# Characters of items that go to the executors at a time; a larger benchmark takes several passes.
BLOCK_CHARS = 32_000_000
SAMPLED = 2
MOST_WALKS = 1024
# Edited copies of items, and walks over each, on which the recall is measured.
TRIALS, TRIAL_WALKS = 1000, 32
NO_WORD = np.uint64(0)


def normal_words(texts: pa.Array, hashed: Callable[[pa.Array], np.ndarray] = hashes_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, hashes, places): hashes of the words of each text without punctuation; places are the
    numbers of these words among all words of their text, those of punctuation alone included."""
    ends, codes, words = word_codes(texts)
    clean = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")
    hashes = hashed(clean)
    hashes[pc.binary_length(clean).to_numpy(zero_copy_only=False) == 0] = NO_WORD
    found = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(np.concatenate([[0], ends]))
    places = np.arange(len(found)) - np.repeat(ends - sizes, sizes)
    keep = found != NO_WORD
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[ends], found[keep], places[keep]


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, within and across texts alike."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[i: i + n]
    return mixed(out)


def walk(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK strings (windows x steps) of the windows texts[starts:ends]; beyond its end a window has
    NO_WORD."""
    at, out = starts.astype(np.int64).copy(), np.empty((len(starts), steps), np.uint64)
    last = max(0, len(texts) - 1)
    for j in range(steps):
        word = np.where(at < ends, texts[np.minimum(at, last)], NO_WORD)
        out[:, j] = word
        at += (mixed(word ^ np.uint64((seed << 20) + j + 1)) & np.uint64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of the text that is nearest to the item; the first such end."""
    def ends(a, b, free):
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, word in enumerate(a, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (b != word))
            row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
        return row

    row = ends(item, text, True)
    end = int(row.argmin())
    back = ends(item[::-1], text[:end][::-1], False)
    # The shortest part among those equally near.
    return int(row[end]), end - int(back.argmin()), end


@dataclass
class Items:
    """A block of items, with what the search needs of them."""
    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    sizes: np.ndarray
    #: width -> (run hashes, item, offset), sorted by hash
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: for each walk (keys of the items, items), sorted by key
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def _strings(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, number: int) -> np.ndarray:
    """As many steps of a walk as the longest item has words."""
    return walk(words, starts, ends, int(sizes.max()) if len(sizes) else 0, number)


def _keys(strings: np.ndarray, sizes: np.ndarray, number: int) -> np.ndarray:
    """The sampled words of each string: at random parts of the item's length, the same for all of a length."""
    out = sizes.astype(np.uint64)
    for part in np.random.default_rng(number).random(SAMPLED):
        step = (part * sizes).astype(np.int64)
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + strings[np.arange(len(sizes)), step])
    return out


def walks_for(words: list[np.ndarray], edits: np.ndarray, recall: float) -> int:
    """How many walks find an item with all its edits with the wanted probability.

    Measured on copies of the items with random edits: if the sampled steps of a walk agree with
    probability p, then 1 - (1 - p) ** t of such copies are found by t walks."""
    if not words:
        return 0
    rng = np.random.default_rng(7)
    parts, sizes = [], []
    for i in rng.integers(0, len(words), TRIALS):
        copy = list(words[i])
        for _ in range(edits[i]):
            kind, at = rng.integers(0, 3), int(rng.integers(0, max(1, len(copy))))
            copy[at: at + (kind > 0)] = [] if kind == 2 else [rng.integers(1, 2**63, dtype=np.uint64)]
        parts += [words[i], np.array(copy, np.uint64)]
        sizes.append(len(words[i]))
    lengths = np.array([len(p) for p in parts])
    flat, ends, sizes = np.concatenate(parts), np.cumsum(lengths), np.array(sizes)
    steps = np.arange(sizes.max())[None, :] < sizes[:, None]
    met = np.zeros(TRIALS)
    for number in range(TRIAL_WALKS):
        strings = _strings(flat, ends - lengths, ends, sizes, number)
        met += (((strings[::2] == strings[1::2]) & steps).sum(axis=1) / sizes) ** SAMPLED / TRIAL_WALKS
    for t in range(1, MOST_WALKS):
        if (1 - (1 - met) ** t).mean() >= recall:
            return t
    return MOST_WALKS


def prepared(ids: list, texts: list[str], share: float, min_words: int, recall: float) -> Items:
    ends, words, _ = normal_words(pa.array(texts, pa.large_string()))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    own = [(i, words[a:b]) for i, a, b in zip(ids, starts, ends) if b - a >= min_words]
    sizes = np.array([len(w) for _, w in own], np.int64)
    items = Items([i for i, _ in own], [w for _, w in own], (share * sizes).astype(np.int64), sizes)
    seeds: dict[int, list] = {}
    for i, (w, k) in enumerate(zip(items.words, items.edits)):
        width = len(w) // (k + 1)
        hashes = runs(w, width)
        seeds.setdefault(width, []).extend((hashes[r * width], i, r * width) for r in range(k + 1))
    for width, found in seeds.items():
        h = np.array([f[0] for f in found], np.uint64)
        order = np.argsort(h, kind="stable")
        items.seeds[width] = (h[order], np.array([f[1] for f in found])[order], np.array([f[2] for f in found])[order])
    if own:
        flat, last = np.concatenate(items.words), np.cumsum(sizes)
        for number in range(walks_for(items.words, items.edits, recall)):
            keys = _keys(_strings(flat, last - sizes, last, sizes, number), sizes, number)
            order = np.argsort(keys, kind="stable")
            items.tables.append((keys[order], order))
    return items


def _windows(items: Items, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(text, start, length) of the item-sized windows that hold an unchanged run of an item of that length,
    at every shift that its edits allow."""
    found = []
    text_of = None
    for width, (hashes, item, offset) in items.seeds.items():
        got = runs(words, width)
        # A bitmap of the runs of the items leaves few places to look up.
        bits = np.zeros(1 << 20, bool)
        bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        places = np.flatnonzero(bits[(got & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low, high = (np.searchsorted(hashes, got[places], side) for side in ("left", "right"))
        places, low, high = places[high > low], low[high > low], high[high > low]
        if not len(places):
            continue
        if text_of is None:
            text_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        inside = text_of[places] == text_of[places + width - 1]
        places, low, high = places[inside], low[inside], high[inside]
        times = high - low
        seed = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        places = np.repeat(places, times)
        which = item[seed]
        edits, sizes = items.edits, items.sizes
        shifts = 2 * edits[which] + 1
        row = np.repeat(np.arange(len(seed)), shifts)
        shift = np.arange(shifts.sum()) - np.repeat(np.cumsum(shifts) - shifts, shifts) - edits[which][row]
        start = (places - offset[seed])[row] + shift
        found.append(np.stack([text_of[places][row], start, sizes[which][row]], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    return np.unique(np.concatenate(found), axis=0)


def _candidates(items: Items, ends: np.ndarray, words: np.ndarray, windows: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """(text, item) -> starts of the windows that share a sampled walk with the item."""
    out: dict[tuple[int, int], list[int]] = {}
    if not len(windows):
        return out
    text, start, sizes = windows.T
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)[text]
    start, stop = np.maximum(start, first), np.minimum(start + sizes, ends[text])
    hits = []
    for number, (keys, of) in enumerate(items.tables):
        got = _keys(_strings(words, start, stop, sizes, number), sizes, number)
        low, high = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
        times = high - low
        if not times.any():
            continue
        row = np.repeat(np.arange(len(got)), times)
        at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hits.append(np.stack([text[row], of[at], start[row]], axis=1))
    if hits:
        for i, item, begin in np.unique(np.concatenate(hits), axis=0).tolist():
            out.setdefault((i, item), []).append(begin)
    return out


def _matches(items: Items, ends: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word) of the nearest place of each item found in a text."""
    begins = np.concatenate([[0], ends[:-1]])
    for (text, item), starts in sorted(_candidates(items, ends, words, _windows(items, ends, words)).items()):
        own, k = items.words[item], int(items.edits[item])
        best = None
        # Windows that overlap are read as one stretch.
        stretches: list[list[int]] = []
        for s in sorted(starts):
            a, b = max(int(begins[text]), s - k), min(int(ends[text]), s + len(own) + k)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        for a, b in stretches:
            distance, x, y = edit_distance(own, words[a:b])
            if distance <= k and (best is None or distance < best[0]):
                best = (distance, a + x, a + y)
        if best:
            yield text, item, best[0], best[1], best[2]


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, min_words: int = 8, recall: float = 0.99,
                 text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, n_words, start, end): for each row and each item that stands in its text with at
    most ``share`` of the item's words edited, the nearest place, as characters of the text.

    Items of fewer than ``min_words`` words say too little and are not looked for; a null text or item has
    no words. An item that has no id, or a repeated id, is one of its own. A row without an id is reported with
    a null id, repeated rows are reported each. Other columns are not looked at."""
    import re

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    given = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((slim, "doc_id"), (given, "item_id"))}
    spark = docs.sparkSession
    out = None
    for block in range(blocks):
        own = given.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(
            prepared([r["item_id"] for r in own], [r["text"] for r in own], share, min_words, recall))

        def run(batches, sent=sent):
            items = sent.value
            for batch in slices(batches, "text"):
                ends, words, places = normal_words(batch.column("text"))
                rows = []
                for i, item, distance, a, b in _matches(items, ends, words):
                    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", batch.column("text")[i].as_py())]
                    rows.append((i, items.ids[item], distance, len(items.words[item]), spans[places[a]][0], spans[places[b - 1]][1]))
                if rows:
                    i, item, *numbers = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(i, pa.int64())), pa.array(item),
                         *[pa.array(x, pa.int64()) for x in numbers]],
                        ["doc_id", "item_id", "distance", "n_words", "start", "end"])

        found = slim.mapInArrow(run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, distance long, "
                                     "n_words long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out
