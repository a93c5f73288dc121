"""Column names and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The names and formats of the files, tables and parameters.
RAW_KEY = ["Estacion", "Fecha", "Hora"]
RAW_POLLUTANTS = ["PM 2,5", "PM 10", "SO2", "NO2", "O3", "CO"]
RAW_COLUMNS = RAW_KEY + RAW_POLLUTANTS
CLEAN_POLLUTANTS = ["PM 2.5", "PM 10", "SO2", "NO2", "O3", "CO"]
CLEAN_COLUMNS = RAW_KEY + CLEAN_POLLUTANTS
RENAMED = {"PM 2,5": "PM 2.5"}
TABLE_POLLUTANTS = ["pm2_5", "pm10", "so2", "no2", "o3", "co"]
FIELD_COLUMNS = {
    "pm25": "pm2_5",
    "pm10": "pm10",
    "so2": "so2",
    "no2": "no2",
    "o3": "o3",
    "co": "co",
}
RULE_OPERATORS = ["gt", "ge", "lt", "le"]
HOME_ZONE = "America/Lima"
DATE_FORMAT = "d/M/yyyy"
MINUTE_FORMAT = "d/M/yyyy H:m"

RAW_TO_TABLE = dict(zip(CLEAN_POLLUTANTS, TABLE_POLLUTANTS))

_DOUBLES = [T.StructField(c, T.DoubleType()) for c in TABLE_POLLUTANTS]

STATIONS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
])

MEASUREMENTS = T.StructType([
    T.StructField("station_id", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    *_DOUBLES,
])

ALERT_RULES = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("station_id", T.IntegerType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("time_window", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ALERT_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("station_id", T.IntegerType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("operator", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

METRICS_LONG = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("modelo", T.StringType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
])

METRICS_WIDE = T.StructType([
    T.StructField("Modelo", T.StringType()),
    T.StructField("R2", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()),
])


def name_col(name: str) -> str:
    """Back-quoted column name, as several headers hold dots or commas."""
    return f"`{name}`"
