"""Words, hashes and batches of texts, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, functions as F

# Bytes of text that a task turns into arrays at a time; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
# Words of more bytes are hashed one by one.
WORD_BYTES = 64
# The white space that separates words: space and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows again, in pieces of bounded text size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // (size or SLICE_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ends, codes, words): the words of text i are words[codes[ends[i-1]:ends[i]]].

    Words are runs without white space; A-Z are lower-cased; a null text has no words.
    """
    # A copy, as Arrow's lower-casing reads beyond the rows of a slice.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    keep = filled[codes] if len(words) else np.zeros(0, bool)
    ends = np.cumsum(counts)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[ends] if len(ends) else ends, codes[keep], words


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes, of all words at once, eight bytes at a time; long words one by one."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset: words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]]
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out = mixed(sizes)
    for k in range(0, WORD_BYTES, 8):
        at = np.flatnonzero((sizes > k) & (sizes <= WORD_BYTES))
        if len(at):
            out[at] = mixed((out[at] ^ (eight[starts[at] + k] & keep[np.minimum(sizes[at] - k, 8)])) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(sizes > WORD_BYTES).tolist():
        out[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i: i + n])
    return out


def held_out(doc_id: Column, folds: int, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def list_column(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of a flat array as a list column."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))
