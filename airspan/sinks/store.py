"""Station ids and the measurement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airspan.functions.texts import folded, station_name
from airspan.operators.dedup import merge_rows
from airspan.operators.order import with_row_number
from airspan.schemas import TABLE_POLLUTANTS
from airspan.session import durable
from airspan.sinks.writers import stored_or_none

KEY = ["station_id", "ts"]
COLUMNS = KEY + TABLE_POLLUTANTS


def assign_ids(names: DataFrame, stations: DataFrame, column: str = "name") -> DataFrame:
    """The stations with a new id for each name not known yet, ignoring accents and case.

    Exact repeats collapse first, so only distinct spellings are compared in the collation. New
    names are numbered in name order after the highest id, over all tasks.
    """
    spelled = durable(
        names.select(station_name(F.col(column)).alias("name")).filter("name != ''").distinct())
    one_each = spelled.groupBy(folded(F.col("name")).alias("_folded")).agg(F.min("name").alias("name"))
    known = stations.select(folded(F.col("name")).alias("_known"))
    new = one_each.join(known, F.col("_folded") == F.col("_known"), "left_anti").select("name")
    top = stations.agg(F.max("id")).first()[0] or 0
    numbered = with_row_number(new, ["name"], "_row")
    fresh = numbered.select((F.col("_row") + top + 1).cast("int").alias("id"), "name")
    return stations.select("id", "name").unionByName(fresh)


def with_station_ids(rows: DataFrame, stations: DataFrame, column: str) -> DataFrame:
    """Replaces the station name by its id. Names are matched once per distinct spelling, so
    the large join is on plain text."""
    spelled = rows.select(F.col(column).alias("_name")).distinct()
    ids = spelled.join(
        stations.select("id", "name"), folded(F.col("_name")) == folded(F.col("name")),
    ).select("_name", F.col("id").alias("station_id"))
    return rows.join(ids, F.col(column) == F.col("_name")).drop("_name", column)


def upsert_measurements(existing: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """(station_id, ts) with the values of the last update, or the old ones."""
    return merge_rows(existing.select(*COLUMNS), updates, KEY, order)


def save_measurements(updates: DataFrame, path: str, order: list[str]) -> None:
    """Upserts into a table partitioned by day, rewriting only the days the updates touch.

    The merged days are saved in the checkpoint folder before the table is written: the write
    never reads what it replaces, and tasks may be lost and run again at any point.
    """
    spark = updates.sparkSession
    updates = updates.withColumn("day", F.to_date("ts"))
    old = stored_or_none(spark, path)
    if old is None:
        old = spark.createDataFrame([], updates.select(*COLUMNS, "day").schema)
    # One value per day partition, as many as the driver lists of the table anyway. A plain
    # filter prunes partitions whatever join the optimizer would have picked.
    touched = [r["day"] for r in updates.select("day").distinct().collect()]
    old = old.filter(F.col("day").isin(touched))
    merged = durable(upsert_measurements(old, updates, order).withColumn("day", F.to_date("ts")))
    (
        merged.repartition("day", F.pmod(F.hash("station_id"), F.lit(_files_per_day(merged))))
        .sortWithinPartitions("day", "station_id", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def _files_per_day(merged: DataFrame, rows_per_file: int = 5_000_000) -> int:
    """Files that the fullest day needs. Counts are combined before the shuffle."""
    fullest = merged.groupBy("day").count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-fullest // rows_per_file))
