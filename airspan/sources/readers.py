"""Files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.functions.numbers import to_number
from airspan.functions.texts import target_label
from airspan.operators.fields import conform, rename, require_columns
from airspan.schemas import (
    CLEAN_COLUMNS, CLEAN_POLLUTANTS, METRICS_LONG, METRICS_WIDE, RENAMED, name_col,
)

# Where a row stood: file, start of the split in it, and place among the rows of its task.
ROW_ORDER = "_seq"


def read_raw(spark: SparkSession, path: str | list[str], with_order: bool = False) -> DataFrame:
    """CSV with a header, every column as text, columns known by name.

    ``with_order`` adds a sortable position, as rows of a DataFrame have none.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    if not with_order:
        return rows
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn(ROW_ORDER, position)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned CSV with text keys and six doubles."""
    rows = conform(rename(read_raw(spark, path), RENAMED), CLEAN_COLUMNS)
    return rows.select(*[
        to_number(F.col(name_col(c))).alias(c) if c in CLEAN_POLLUTANTS else F.col(name_col(c))
        for c in CLEAN_COLUMNS])


def load_table(spark: SparkSession, root: str, name: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A stored table; with ``jdbc`` options, one of a database whose driver is on the class path."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Long metrics with the display names of target and model."""
    rows = spark.read.schema(METRICS_LONG).option("header", True).csv(path)
    return rows.withColumns({
        "target_label": target_label(F.col("target")), "model_label": F.upper("modelo")})


def read_model_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of the models with six outputs."""
    return spark.read.schema(METRICS_WIDE).option("header", True).csv(path)


def read_scoring_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A user's CSV of features and truth, all numbers; a missing column is an error."""
    rows = require_columns(spark.read.option("header", True).csv(path), columns)
    return rows.select(*[to_number(F.col(name_col(c))).alias(c) for c in columns])
