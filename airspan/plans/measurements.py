"""The questions asked of the station and measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airspan.functions.times import iso_time
from airspan.operators.aggregate import (
    bucket_aggregate, heatmap_cells, heatmap_matrix, heatmap_ratios, heatmap_scale, heatmap_totals,
)
from airspan.operators.fields import (
    in_time_range, name_contains, reading_columns, require_row, with_ids, with_names,
)
from airspan.operators.latest import latest_per_station
from airspan.operators.order import name_order, page, time_order
from airspan.schemas import FIELD_COLUMNS
from airspan.sinks.writers import write_csv


def list_stations(stations: DataFrame, q: str | None = None, limit=None, offset=None) -> DataFrame:
    """(id, name, total): one page in name order, with the count of all matches."""
    found = name_contains(stations.select("id", "name"), q)
    total = found.agg(F.count(F.lit(1))).scalar()
    return page(found, name_order("name", "id"), limit, offset).withColumn("total", total)


def get_station(stations: DataFrame, station_id: int) -> DataFrame:
    return require_row(stations.filter(F.col("id") == station_id).select("id", "name"), "station")


def station_latest(stations: DataFrame, m: DataFrame, station_id: int, tz: str | None = None) -> DataFrame:
    """One row; time and values are null when the station has no reading."""
    station = get_station(stations, station_id)
    newest = latest_per_station(m, [station_id])
    return station.join(newest, F.col("id") == F.col("station_id"), "left").select(
        F.col("id").alias("station_id"), F.col("name").alias("station_name"),
        *reading_columns(None, tz))


def latest_readings(stations: DataFrame, m: DataFrame, tz: str | None = None) -> DataFrame:
    """Newest reading of every station that has one."""
    newest = latest_per_station(m)
    return newest.join(stations, F.col("station_id") == F.col("id")).select(
        "station_id", F.col("name").alias("station_name"), *reading_columns(None, tz))


def latest_page(stations: DataFrame, m: DataFrame, tz=None, limit=None, offset=None) -> DataFrame:
    return page(latest_readings(stations, m, tz), name_order("station_name", "station_id"), limit, offset)


def station_measurements(
    stations: DataFrame, m: DataFrame, station_id: int, start=None, end=None,
    fields: str | None = None, order: str = "asc", tz=None, limit=None, offset=None,
) -> DataFrame:
    """One page of a station's readings in time order."""
    get_station(stations, station_id)
    rows = in_time_range(with_ids(m, [station_id]), start, end)
    return page(rows, time_order("ts", order), limit, offset).select(*reading_columns(fields, tz))


def find_measurements(
    stations: DataFrame, m: DataFrame, ids: Sequence[int] | None = None,
    names: Sequence[str] | None = None, start=None, end=None,
) -> DataFrame:
    """Readings with station names, by ids, names and time. The filters reach the scan; the
    stations join by broadcast when their table is measured to be small."""
    rows = in_time_range(with_ids(m, ids), start, end)
    chosen = with_names(stations, names).select("id", F.col("name").alias("station_name"))
    return rows.join(chosen, F.col("station_id") == F.col("id")).drop("id")


def measurements_page(
    stations: DataFrame, m: DataFrame, ids=None, names=None, start=None, end=None,
    fields: str | None = None, order: str = "asc", tz=None, limit=None, offset=None,
) -> DataFrame:
    rows = find_measurements(stations, m, ids, names, start, end)
    return page(rows, time_order("ts", order, "station_id"), limit, offset).select(
        "station_id", "station_name", *reading_columns(fields, tz))


def export_rows(
    stations: DataFrame, m: DataFrame, ids=None, names=None, start=None, end=None,
    fields: str | None = None, order: str | None = None, tz=None,
) -> DataFrame:
    """All matching readings, without a page; sorted over all tasks when an order is given."""
    rows = find_measurements(stations, m, ids, names, start, end)
    if order:
        rows = rows.orderBy(*time_order("ts", order, "station_id"))
    return rows.select("station_name", *reading_columns(fields, tz))


def export_csv(stations: DataFrame, m: DataFrame, path: str, order: str = "asc", **filters) -> None:
    """CSV files under ``path``, in the order of their names."""
    write_csv(export_rows(stations, m, order=order, **filters), path)


def aggregate(
    m: DataFrame, granularity: str, station_ids: Sequence[int], agg: str = "avg",
    start=None, end=None, tz: str | None = None,
) -> DataFrame:
    """(station_id, ts, six values) per hour or day of the named stations."""
    if not station_ids:
        raise ValueError("station_id is required (one or more).")
    return aggregate_all(m, granularity, agg, start, end, tz, station_ids)


def aggregate_all(
    m: DataFrame, granularity: str, agg: str = "avg", start=None, end=None, tz: str | None = None,
    station_ids: Sequence[int] | None = None,
) -> DataFrame:
    """As ``aggregate``, over every station."""
    buckets = bucket_aggregate(m, granularity, agg, station_ids, start, end)
    return buckets.select(
        "station_id", iso_time(F.col("bucket"), tz).alias("ts"),
        *[F.col(c).alias(k) for k, c in FIELD_COLUMNS.items()])


def heatmap(m: DataFrame, start=None, end=None, tz: str | None = None, station_ids=None) -> DataFrame:
    """One row per pollutant with a mean per hour of the day."""
    return heatmap_matrix(_cells(m, start, end, tz, station_ids))


def heatmap_long(m: DataFrame, start=None, end=None, tz: str | None = None, station_ids=None) -> DataFrame:
    """(pollutant, hour, value, ratio)."""
    return heatmap_ratios(_cells(m, start, end, tz, station_ids))


def heatmap_bounds(m: DataFrame, start=None, end=None, tz: str | None = None, station_ids=None) -> DataFrame:
    return heatmap_scale(_cells(m, start, end, tz, station_ids))


def heatmap_counts(m: DataFrame, start=None, end=None, tz: str | None = None, station_ids=None) -> DataFrame:
    return heatmap_totals(bucket_aggregate(m, "hourly", "avg", station_ids, start, end), tz)


def _cells(m: DataFrame, start, end, tz, station_ids) -> DataFrame:
    return heatmap_cells(bucket_aggregate(m, "hourly", "avg", station_ids, start, end), tz)
