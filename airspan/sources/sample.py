"""Station data made from the TPC-H-like test tables, so every query grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.functions.times import hour_bucket
from airspan.schemas import FIELD_COLUMNS, RAW_COLUMNS, TABLE_POLLUTANTS, name_col

# Which events are readings of which pollutant.
EVENT_OF = {"pm2_5": "click", "pm10": "view", "so2": "purchase", "no2": "signup", "o3": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with events."""
    seen = table(spark, sf_dir, "events").select("user_id").distinct()
    customers = table(spark, sf_dir, "customer")
    return customers.join(seen, F.col("c_custkey") == F.col("user_id"), "left_semi").select(
        F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: readings whose key (station, hour) comes more than once."""
    return versions_of(table(spark, sf_dir, "events"))


def versions_of(events: DataFrame) -> DataFrame:
    values = [F.when(F.col("event_type") == e, F.col("value")).alias(c) for c, e in EVENT_OF.items()]
    return events.select(
        F.col("user_id").cast("int").alias("station_id"), hour_bucket(F.col("ts")).alias("ts"),
        *values, (F.col("value") * 10).alias("co"), "event_id")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and hour."""
    return versions(spark, sf_dir).groupBy("station_id", "ts").agg(
        *[F.max(c).alias(c) for c in TABLE_POLLUTANTS])


def named_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements under the column names of the feature plans."""
    return measurements(spark, sf_dir).select(
        F.col("station_id").alias("Estacion"), F.col("ts").alias("datetime"),
        F.col("pm2_5").alias("PM2_5"), F.col("pm10").alias("PM10"), F.col("so2").alias("SO2"),
        F.col("no2").alias("NO2"), F.col("o3").alias("O3"), F.col("co").alias("CO"))


def _number_texts(value):
    """The ways a reading is written, by event number."""
    plain = F.format_string("%.2f", value)
    whole = F.lpad(F.floor(value).cast("string"), 3, "0")
    cents = F.substring_index(plain, ".", -1)
    kind = F.pmod(F.col("event_id"), F.lit(7))
    return (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("1,"), whole, F.lit("."), cents))
        .when(kind == 2, F.concat(F.lit("2."), whole, F.lit("."), cents))
        .when(kind == 3, F.translate(plain, ".", ","))
        .when(kind == 4, F.concat(F.lit("\"  "), plain, F.lit(" '")))
        .when(kind == 5, F.concat(F.lit("-"), plain))
        .otherwise("  ")
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text readings, one per event, badly formatted; ``event_id`` is their order."""
    text = _number_texts(F.col("value"))
    values = {"PM 2,5": "click", "PM 10": "view", "SO2": "purchase", "NO2": "signup", "O3": "error"}
    cells = [F.when(F.col("event_type") == e, text).otherwise("").alias(c) for c, e in values.items()]
    return table(spark, sf_dir, "events").select(
        F.format_string(" 'Estacion %d' ", "user_id").alias("Estacion"),
        F.date_format("ts", "dd/MM/yyyy").alias("Fecha"),
        F.date_format("ts", "HH:00").alias("Hora"),
        *cells, text.alias("CO"), "event_id",
    ).select(*[F.col(name_col(c)) for c in RAW_COLUMNS], "event_id")


def station_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One popup page per event: its reading, a blank row, and a short row of the hour before."""
    return pages_of(table(spark, sf_dir, "events"))


def pages_of(events: DataFrame) -> DataFrame:
    text = F.col("text")
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    rows = events.select(
        F.col("event_id").alias("page_id"), F.format_string("Estación %d", "user_id").alias("name"),
        F.date_format("ts", "dd/MM/yyyy").alias("date"), F.date_format("ts", "HH:00").alias("time"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.translate(F.format_string("%.2f", "value"), ".", ","))
        .when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit("1,"), F.format_string("%06.2f", F.col("value") % 1000)))
        .otherwise("s/d").alias("text"))
    full = F.concat(F.lit("<tr>"), cell(F.col("date")), cell(F.col("time")), *[cell(text)] * 6, F.lit("</tr>"))
    blank = F.lit("<tr><td></td><td> </td></tr>")
    short = F.concat(F.lit("<tr>"), cell(F.col("date")), cell(F.lit("00:00")), cell(text), F.lit("</tr>"))
    html = F.concat(
        F.lit("<table><tr><td><b>Estación:</b></td><td> "), F.col("name"),
        F.lit(" </td></tr></table><div class='content'><div class='content-1'>x</div>"
              "<div class='content-2'><table><thead><tr><th>Fecha</th></tr></thead><tbody>"),
        full, blank, short, F.lit("</tbody></table></div></div>"))
    return rows.select("page_id", html.alias("html"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each customer's station and one for all stations per nation: every operator,
    some switched off, some with an unknown pollutant or operator."""
    pollutants = F.array(*[F.lit(p) for p in [*FIELD_COLUMNS, "PM25", "x9"]])
    operators = F.array(*[F.lit(o) for o in ["gt", "ge", "lt", "le", "GT", "eq"]])
    key = F.col("key")
    pick = lambda of, n: F.element_at(of, (F.pmod(key, F.lit(n)) + 1).cast("int"))
    own = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), (F.col("c_custkey") + 1000).alias("id"),
        F.col("c_custkey").alias("station_id"), F.concat(F.lit("rule of "), "c_name").alias("name"))
    every = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("key"), (F.col("n_nationkey") + 1).alias("id"),
        F.lit(None).cast("long").alias("station_id"), F.concat(F.lit("rule of "), "n_name").alias("name"))
    return own.unionByName(every).select(
        F.col("id").cast("int"), "name", F.col("station_id").cast("int"),
        pick(pollutants, 8).alias("pollutant"), pick(operators, 6).alias("operator"),
        (F.pmod(key, F.lit(40)) * 2.5).cast("double").alias("threshold"),
        F.lit("1h").alias("time_window"), (F.pmod(key, F.lit(11)) != 10).alias("enabled"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
