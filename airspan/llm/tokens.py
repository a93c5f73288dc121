"""Token ids of a public vocabulary, in pieces that fit a training sequence."""

from __future__ import annotations

import base64
import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspan.llm.text import list_column, slices

END = 2
# Texts of these characters alone are split into words alike by both libraries.
PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*")


@functools.lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None):
    """The tokenizer, and a faster reader of the same vocabulary for plain texts if its ranks are given."""
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = True  # their strings in a text are ordinary text
    if ranks is None:
        return slow, None
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return slow, tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(texts: list[str], vocabulary: str, ranks: str | None = None) -> list[list[int]]:
    """Ids of each text, without special tokens."""
    slow, fast = _encoders(vocabulary, ranks)
    plain = [fast is not None and PLAIN.fullmatch(t) is not None for t in texts]
    rest = iter(slow.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
    return [fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, size: int = 1024, text: str = "text",
           doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each row's ids and the end id 2, cut at ``size``.

    Only the first piece may be shorter than ``size``. A null text is an empty one, whose only id is the
    end. ``ids_crc32`` is of the ids as little-endian 32-bit numbers."""
    def run(batches):
        for batch in slices(batches, "text"):
            found = encode([t or "" for t in batch.column("text").to_pylist()], vocabulary, ranks)
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, ids in enumerate(found):
                ids = np.array([*ids, END], "<u4")
                first = len(ids) % size or size
                at = 0
                for k, end in enumerate(range(first, len(ids) + 1, size)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    parts.append(ids[at:end])
                    at = end
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(list_column(np.concatenate(parts).astype(np.int32), np.cumsum(length), pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + (", ids array<int>" if with_ids else ""))
