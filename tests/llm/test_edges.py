"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from airspan.llm import classlm, langid, toxicity
from airspan.llm.decontam import contaminated
from airspan.llm.linededup import drop_boilerplate, line_sites
from airspan.llm.neardup import near_duplicates
from airspan.llm.packing import pack
from airspan.llm.passages import repeated_passages
from airspan.llm.quality import keep_good, quality
from airspan.llm.queries import vocabulary
from airspan.llm.secrets import find_secrets
from airspan.llm.tokens import pieces

LONG = " ".join(f"word{i * 7919 % 30011}" for i in range(60_000))
ROWS = [
    (1, "", "en", "s"), (2, None, None, None), (None, "no id at all but a few words here", "en", "s"),
    (3, "the same row", "en", "s"), (3, "the same row", "en", "s"), (3, "another text of that id", "de", None),
    (4, " \t\n ", "en", "s"), (5, LONG, "en", "s"), (6, "!!! ???   � \U0001f600", "xx", "s"),
    (7, "eine Ähnliche Zeile\n\nund noch eine", "de", "t"), (None, None, None, None),
]
# Names that the operators use themselves.
CLASHES = ["kept", "score", "component", "component_id", "bands", "quality_statistics", "line_hits", "line_key",
           "words", "ids", "length", "row", "label", "aside", "held_out", "n_words", "_text", "group", "base"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("x").alias(c) for c in CLASHES])


def benchmark(spark):
    return spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten"), (2, None), (None, "a b"), (3, ""),
         (1, "one two three four five six seven eight nine ten")], "item_id long, text string")


PER_ROW = {
    "secrets": find_secrets,
    "language": lambda d: langid.predict(d, langid.fit(d), "text", F.col("doc_id")),
    "near": near_duplicates,
    "lines": drop_boilerplate,
    "quality": quality,
    "lm": lambda d: classlm.score(d.withColumn("aside", F.lit(False)), passes=1),
    "toxicity": lambda d: toxicity.score(
        d, toxicity.fit(d.withColumn("label", (F.col("doc_id") % 2).cast("int"))), "text", F.col("doc_id")),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(docs, name):
    out = PER_ROW[name](docs).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables_have_no_rows(docs, name):
    assert PER_ROW[name](docs.limit(0)).collect() == []


def test_results_of_odd_rows(docs):
    found = {(r["doc_id"], r["n_words"]): r for r in quality(docs).collect()}
    assert found[1, 0]["base_failed"] and found[2, 0]["base_failed"] and not found[4, 0]["kept"]
    near = near_duplicates(docs).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in near)
    assert {r["n_shingles"] for r in near if r["doc_id"] in (1, 2, 4)} == {0}
    said = {r["doc_id"]: r for r in PER_ROW["language"](docs).collect()}
    assert all(said[i]["lang_pred"] == "und" and said[i]["score"] == 0 for i in (1, 2, 4, 6))
    for r in PER_ROW["toxicity"](docs).collect():
        assert 0 <= r["score"] <= 1
    for r in PER_ROW["lm"](docs).collect():
        assert r["score"] < 0 and r["base_score"] < 0 and r["n_tokens"] >= 1
    assert {c for c in docs.columns} == set(drop_boilerplate(docs).columns) == set(keep_good(docs).columns)


def test_packing_of_odd_rows(docs):
    cut = pack(pieces(docs, **vocabulary(), with_ids=False)).collect()
    assert sum(r["length"] == 1 for r in cut) == 3  # the empty texts and the null ones are just their end
    assert {r["length"] for r in cut if r["doc_id"] == 5 and r["piece"] > 0} == {1024}
    assert pack(pieces(docs.limit(0), **vocabulary(), with_ids=False)).collect() == []


def test_searches_over_odd_rows(docs, spark):
    assert contaminated(docs, benchmark(spark)).collect() == []
    assert contaminated(docs.limit(0), benchmark(spark)).collect() == []
    assert contaminated(docs, benchmark(spark).limit(0)).collect() == []
    hit = spark.createDataFrame([(None, "x one two three four five six seven eight nine ten y")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(hit, benchmark(spark)).collect()} == {(None, 1)}
    assert repeated_passages(docs).collect() == []
    assert repeated_passages(docs.limit(0)).collect() == []
    assert line_sites(docs.limit(0), 2).collect() == []


def test_stages_keep_the_columns_of_documents(docs, spark, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert left.filter("doc_id = 3").count() == 2  # the repeated row stays once, beside the other text
