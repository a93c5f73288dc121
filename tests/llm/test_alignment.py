"""Alignment of two tokenizers against a version that compares all byte ranges of a text."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from airspan.llm.alignment import cross_tokenizer
from airspan.llm.queries import vocabulary

FILES = {**vocabulary(), "model": public_tokenizers.path("piece_bpe_32k.model")}
TEXTS = [
    "The cat sat on the mat.", "Ünïcode straße, naïve café — 東京 🙂", "  two  spaces\n\ttabs\r\n", "", None, "a", " ", "▁ piece space",
    "<|endoftext|> and </s> are text", "repeat repeat repeat repeat", "The cat sat on the mat.", "1234567890 3.14159", "\x00\x01 odd",
    "supercalifragilisticexpialidocious " * 300, "é", "ﬁ ligature ＦＵＬＬ width",
]


def tokens(text):
    """(ids, byte strings) by both files, as the files' own decoders tell."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a_file = Tokenizer.from_file(FILES["vocabulary"])
    a_file.encode_special_tokens = True
    b_file = SentencePieceProcessor(model_file=FILES["model"])
    a = a_file.encode(" " + text, add_special_tokens=False).ids
    from tokenizers.pre_tokenizers import ByteLevel
    letters = {}
    for code in range(256):
        for letter, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code)):
            for c, byte in zip(letter, chr(code).encode()):
                letters[c] = byte
    name = lambda i: a_file.id_to_token(i)
    bytes_a = [bytes(letters.get(c, 0) for c in name(i)) for i in a]
    b = b_file.encode(text)
    bytes_b = [bytes([int(b_file.id_to_piece(i)[3:5], 16)]) if b_file.is_byte(i) else b_file.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, bytes_a, b, bytes_b


def spans(parts):
    at, out = 0, []
    for part in parts:
        out.append((at, at + len(part)))
        at += len(part)
    return out


def brute(texts):
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append((0, 0, [], ""))
            continue
        a, bytes_a, b, bytes_b = tokens(text)
        if b"".join(bytes_b) != b" " + text.encode():
            rows.append((0, 0, [], ""))
            continue
        x, y = spans(bytes_a), spans(bytes_b)
        links = [(i, j) for i, s in zip(a, x) for j, t in zip(b, y) if s[0] < t[1] and t[0] < s[1]]
        cuts = sorted({s[1] for s in x} & {t[1] for t in y})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s in zip(a, x) if low < s[1] <= cut) + "|"
                          + ",".join(str(j) for j, t in zip(b, y) if low < t[1] <= cut))
            low = cut
        rows.append((len(a), len(b), links, ";".join(groups)))
        counts.update(links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(n_a, n_b, text.count(";") + 1 if text else 0, len(links), sum(counts[p] == top[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "") for n_a, n_b, links, text in rows]


@pytest.mark.parametrize("frequent", [1 << 19, 8, 0])
def test_against_all_byte_ranges(spark, frequent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = cross_tokenizer(docs, **FILES, frequent=frequent)
    got = got.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    found = {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()}
    assert [found[i] for i in range(len(TEXTS))] == brute(TEXTS)
    assert found[0][0] > 0 and found[7][0] == 0


def test_rows_without_id_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "x y", 1), (5, "x y", 2), (5, "x y", 3), (6, None, 4)], "doc_id long, text string, a int")
    got = cross_tokenizer(docs, **FILES).select("doc_id", "n_a", "n_links", "count_sum").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 2, 6), (5, 2, 2, 6), (5, 2, 2, 6), (6, 0, 0, 0)], key=str)


def test_empty_table(spark):
    assert cross_tokenizer(spark.createDataFrame([], "doc_id long, text string"), **FILES).count() == 0
