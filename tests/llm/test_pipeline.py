"""Each stage against a brute-force version on what the one before kept, and the whole run against the stages."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from airspan.llm.decontam import edit_distance, normal_words
from airspan.llm.quality import quality
from airspan.llm.queries import vocabulary
from airspan.llm.tokens import encode
from test_neardup import by_hand as near_by_hand
from test_quality_and_lines import by_hand as lines_by_hand

SF_DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, before):
        stages[name](spark, before, SF_DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        return after, {r["doc_id"]: r for r in after.collect()}

    good, rows = kept("quality_rules", docs)
    judged = {r["doc_id"]: r["kept"] for r in quality(docs).collect()}
    assert set(rows) == {i for i, k in judged.items() if k} and 0 < len(rows) < len(judged)

    lines, after = kept("line_dedup", good)
    want = lines_by_hand([(i, r["text"], r["source"]) for i, r in rows.items()], 10)
    assert {i: r["text"] for i, r in after.items()} == {i: t for i, t, _ in want}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] != rows[i]["text"] else rows[i]["n_chars"]) for i, r in after.items())

    single, one_each = kept("near_dedup", lines)
    groups = near_by_hand([(i, r["text"]) for i, r in after.items()], 5, 80)
    assert set(one_each) == {i for i, (_, first) in groups.items() if i == first}

    clean, left = kept("decontaminate", single)
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]

    def words(text):
        return normal_words(pa.array([text or ""]))[1]
    items = [w for w in map(words, items) if len(w) >= 8]
    leaks = {i for i, r in one_each.items() if any(
        edit_distance(w, words(r["text"]))[0] <= int(0.2 * len(w)) for w in items)}
    assert set(left) == set(one_each) - leaks

    packed = stages["packing"](spark, clean, SF_DIR).collect()
    ids = dict(zip(left, encode([r["text"] or "" for r in left.values()], **vocabulary())))
    totals = {}
    for r in packed:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert totals == {i: len(x) + 1 for i, x in ids.items()}
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        ends = np.cumsum([n for _, n in parts])
        assert [o for o, _ in parts] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(by_sequence) <= -(-sum(totals.values()) // 1024) * 1.05 + 1

    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert len({r["sequence_id"] for r in whole}) == len(by_sequence)
