"""Files written for others to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from airspan.operators.dedup import unseen_rows


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header each; nulls are empty cells. Quotes are doubled and blanks kept, so that
    texts are read again as they were."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def stored_or_none(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The parquet table at a path, or None before the first write. With a schema, partition
    columns get their types from it rather than from what their values look like."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        # Any other refusal is an error: taken for an empty table, it would cost the old rows.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(
    batch: DataFrame, path: str, keys: Sequence[str], order: Sequence,
    partition_by: str | None = None,
) -> None:
    """Appends the rows whose key the table does not hold yet. Running it again adds nothing.

    Where the table is partitioned by one of the keys, a text, only the partitions named in the
    batch are read: the batch's values, one per folder it writes, become a filter. As a folder
    name cannot tell an empty text from a missing one, both count as empty there.
    """
    spark = batch.sparkSession
    if partition_by:
        batch = batch.fillna("", [partition_by])
    known = stored_or_none(spark, path, batch.schema)
    if known is None:
        known = spark.createDataFrame([], batch.schema)
    elif partition_by:
        values = [r[0] for r in batch.select(partition_by).distinct().collect()]
        named = F.col(partition_by).isin([v for v in values if v != ""])
        known = known.filter(named | F.col(partition_by).isNull() if "" in values else named).fillna("", [partition_by])
    fresh = unseen_rows(batch, known, keys, order)
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
