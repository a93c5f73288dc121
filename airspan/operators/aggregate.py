"""Time-bucket aggregates and the hour-of-day heatmap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airspan.functions.numbers import unit_ratio
from airspan.functions.times import day_bucket, hour_bucket, pick_zone, wall_time_in
from airspan.operators.fields import in_time_range, with_ids
from airspan.operators.median import group_median
from airspan.schemas import FIELD_COLUMNS, TABLE_POLLUTANTS

BUCKETS = {"hourly": hour_bucket, "daily": day_bucket}
AGGREGATES = {"avg": F.avg, "max": F.max, "min": F.min}


def bucket_aggregate(
    m: DataFrame, granularity: str, agg: str = "avg", station_ids: Sequence[int] | None = None,
    start=None, end=None, columns: Sequence[str] = TABLE_POLLUTANTS,
) -> DataFrame:
    """(station_id, bucket) with one aggregate of every value column."""
    if granularity not in BUCKETS:
        raise ValueError("granularity must be one of: hourly, daily")
    agg = agg.lower()
    if agg not in AGGREGATES and agg != "median":
        raise ValueError("agg must be one of: avg, median, max, min")
    rows = in_time_range(with_ids(m, station_ids), start, end)
    rows = rows.select("station_id", BUCKETS[granularity](F.col("ts")).alias("bucket"), *columns)
    if agg == "median":
        return group_median(rows, ["station_id", "bucket"], columns)
    return rows.groupBy("station_id", "bucket").agg(*[AGGREGATES[agg](c).alias(c) for c in columns])


def heatmap_cells(hourly: DataFrame, tz: str | None = None) -> DataFrame:
    """(pollutant, hour, value): mean of the hourly means, hours told in the wanted zone.

    The partial aggregate leaves at most 144 rows per task for the shuffle.
    """
    hour = F.hour(wall_time_in(F.col("bucket"), pick_zone(tz)))
    renamed = hourly.select(
        hour.alias("hour"), *[F.col(c).alias(k) for k, c in FIELD_COLUMNS.items()])
    return (
        renamed.unpivot(["hour"], list(FIELD_COLUMNS), "pollutant", "reading")
        .groupBy("pollutant", "hour")
        .agg(F.avg("reading").alias("value"))
    )


def heatmap_matrix(cells: DataFrame) -> DataFrame:
    """One row per pollutant, one column ``h0`` .. ``h23`` per hour; empty cells are null."""
    return cells.groupBy("pollutant").agg(
        *[F.max(F.when(F.col("hour") == h, F.col("value"))).alias(f"h{h}") for h in range(24)])


def heatmap_scale(cells: DataFrame) -> DataFrame:
    return cells.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def heatmap_totals(hourly: DataFrame, tz: str | None = None) -> DataFrame:
    """Rows that went in, and distinct hours among them."""
    local = wall_time_in(F.col("bucket"), pick_zone(tz))
    return hourly.agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct(local).alias("hour_buckets"))


def heatmap_ratios(cells: DataFrame) -> DataFrame:
    """Cells with their place between the smallest and the largest cell of the map."""
    scale = cells.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    return (
        cells.withColumn("_scale", scale)
        .withColumn("ratio", unit_ratio(F.col("value"), F.col("_scale.low"), F.col("_scale.high")))
        .drop("_scale")
    )
