import numpy as np
import pyarrow as pa

from airspan.llm.text import hashes_of, shingles, slices, word_codes


def by_hand(texts):
    return [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]


def words_of(column):
    ends, codes, words = word_codes(column)
    names, out, start = words.to_pylist(), [], 0
    for end in ends:
        out.append([names[c] for c in codes[start:end]])
        start = end
    return out


def test_words_of_whole_and_sliced_batches_are_those_of_bytes():
    rng = np.random.default_rng(3)
    alphabet = list("abAB \t\n\r\x0b\x0cÉé \u0085ß!")
    texts = [None, "", " ", " Ä b"] + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 60, 500)]
    column = pa.array(texts)
    assert words_of(column) == by_hand(texts)
    for a, b in ((0, 1), (3, 90), (90, 504), (503, 504)):
        assert words_of(column.slice(a, b - a)) == by_hand(texts[a:b])
    batch = pa.RecordBatch.from_arrays([column], ["t"]).slice(7)
    assert [w for s in slices([batch], "t") for w in words_of(s.column("t"))] == by_hand(texts[7:])


def test_a_long_text_is_a_slice_of_its_own(monkeypatch):
    monkeypatch.setattr("airspan.llm.text.SLICE_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["a " * 30, "b " * 500, None, "c"])], ["t"])
    parts = list(slices([batch], "t"))
    assert len(parts) == 2 and sum(p.num_rows for p in parts) == 4


def test_shingles_of_short_texts_are_the_whole_sequence():
    h = hashes_of(pa.array(["a", "b", "c"]))
    assert len(shingles(h, 4)) == 1 and len(shingles(h, 2)) == 2 and len(shingles(h[:0], 4)) == 0
    assert shingles(h, 4)[0] != shingles(h[::-1], 4)[0]
    assert shingles(h, 2)[0] == shingles(h[:2], 4)[0]
