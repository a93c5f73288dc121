"""From raw documents to packed training sequences, in five stages.

Every stage works on what the one before kept. ``run`` writes each stage's rows as Parquet into the
shared checkpoint folder and reads them again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.llm.decontam import contaminated
from airspan.llm.linededup import drop_boilerplate
from airspan.llm.neardup import near_duplicates
from airspan.llm.packing import pack
from airspan.llm.quality import fresh, keep_good
from airspan.llm.queries import table, vocabulary
from airspan.llm.tokens import pieces
from airspan.session import checkpoint_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules find good."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites; ``n_chars`` follows the text."""
    gone = fresh(docs, "lines_removed")
    cut = drop_boilerplate(docs, removed=gone)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; once, where the same id and text are
    repeated. Rows without an id are linked with nothing and all stay."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    once = left.join(repeated.select("doc_id"), "doc_id").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without an item of the benchmark."""
    leaks = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return pack(pieces(docs, **vocabulary(), with_ids=False))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

# Expectation-maximisation, edit distances and token ids are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
