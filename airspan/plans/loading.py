"""Clean rows into the station and measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.functions.numbers import to_number
from airspan.functions.texts import station_name
from airspan.functions.times import reading_time
from airspan.operators.fields import conform, rename
from airspan.schemas import CLEAN_COLUMNS, RAW_TO_TABLE, RENAMED, STATIONS, name_col
from airspan.session import durable
from airspan.sinks.store import assign_ids, save_measurements, with_station_ids
from airspan.sinks.writers import stored_or_none
from airspan.sources.readers import ROW_ORDER


def loadable_rows(clean: DataFrame, order: str = ROW_ORDER) -> DataFrame:
    """(station, ts, six values, order) of the rows with a time and a station."""
    rows = conform(rename(clean, RENAMED), CLEAN_COLUMNS)
    kinds = dict(rows.dtypes)
    values = [
        (F.col(name_col(c)) if kinds[c] == "double" else to_number(F.col(name_col(c)))).alias(t)
        for c, t in RAW_TO_TABLE.items()]
    rows = rows.select(
        station_name(F.col("Estacion")).alias("station"),
        reading_time(F.col("Fecha"), F.col("Hora")).alias("ts"), *values, order)
    return rows.filter("ts is not null and station != ''")


def load(
    clean: DataFrame, stations: DataFrame, order: str = ROW_ORDER
) -> tuple[DataFrame, DataFrame]:
    """All stations, and the new measurements with their station id.

    The rows are saved once cleaned, as ids, touched days and the upsert all read them. The
    stations are saved so that ids stay what they are when a part is computed again.
    """
    rows = durable(loadable_rows(clean, order))
    known = durable(assign_ids(rows, stations, "station"))
    return known, with_station_ids(rows, known, "station")


def load_into(spark: SparkSession, clean: DataFrame, root: str, order: str = ROW_ORDER) -> None:
    """Loads into ``root/stations`` and ``root/measurements``. Loading again changes nothing."""
    stations = stored_or_none(spark, f"{root}/stations")
    if stations is None:
        stations = spark.createDataFrame([], STATIONS)
    known, updates = load(clean, stations, order)
    known.join(stations.select("id"), "id", "left_anti").write.mode("append").parquet(f"{root}/stations")
    save_measurements(updates, f"{root}/measurements", [order])
