"""Queries that write files or tables and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airspan.catalog.features import _FRAME, METRICS_SQL, NAMED, scored
from airspan.catalog.intake import _CLEAN_SQL
from airspan.catalog.readings import END, RANGE_SQL, START
from airspan.catalog.registry import (
    LIMA_ISO, MEASUREMENTS_SQL, NAMED_VALUES, STATIONS_SQL, VALUES, VERSIONS_SQL, query, with_sql,
)
from airspan.operators.fields import in_time_range
from airspan.operators.metrics import regression_metrics
from airspan.plans.cleaning import clean_readings
from airspan.plans.measurements import export_csv
from airspan.schemas import FIELD_COLUMNS, RAW_COLUMNS, name_col
from airspan.session import checkpoint_root
from airspan.sinks.store import KEY, save_measurements
from airspan.sinks.writers import write_clean, write_csv
from airspan.sources import sample
from airspan.sources.readers import load_table, read_clean, read_metrics, read_raw, read_scoring_rows


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/files-{uuid.uuid4().hex}"


@query("clean_csv_files", with_sql("SELECT * EXCLUDE (user_id, bucket) FROM clean", _CLEAN_SQL))
def clean_csv_files(spark, sf_dir):
    """Raw readings written as CSV, read, cleaned, written as clean CSV and read again."""
    root = _folder(spark)
    write_csv(sample.raw_readings(spark, sf_dir), f"{root}/raw")
    raw = read_raw(spark, f"{root}/raw").withColumn("event_id", F.col("event_id").cast("long"))
    raw = raw.select(*[F.coalesce(name_col(c), F.lit("")).alias(c) for c in RAW_COLUMNS], "event_id")
    write_clean(clean_readings(raw, order="event_id"), f"{root}/clean", "csv")
    return read_clean(spark, f"{root}/clean")


@query("export_csv_files", with_sql(
    f"""SELECT name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM m JOIN st ON st.id = station_id WHERE {RANGE_SQL}""", STATIONS_SQL, MEASUREMENTS_SQL))
def export_csv_files(spark, sf_dir):
    root = _folder(spark)
    export_csv(sample.stations(spark, sf_dir), sample.measurements(spark, sf_dir), root, start=START, end=END)
    schema = "station_name string, ts string, " + ", ".join(f"{c} double" for c in FIELD_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(root)


@query("stored_days", with_sql(
    f"""SELECT station_id, ts, {', '.join(VALUES)} FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id DESC) AS rn FROM v) WHERE rn = 1 AND {RANGE_SQL}""", VERSIONS_SQL))
def stored_days(spark, sf_dir):
    """Readings of a time range out of the table by day, of which only those days are read."""
    root = _folder(spark)
    save_measurements(sample.versions(spark, sf_dir), f"{root}/measurements", ["event_id"])
    return in_time_range(load_table(spark, root, "measurements"), START, END).select(*KEY, *VALUES)


@query("metrics_csv_files", with_sql(
    "SELECT target, model AS modelo, upper(model) AS model_label, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM metrics",
    *_FRAME, METRICS_SQL))
def metrics_csv_files(spark, sf_dir):
    root = _folder(spark)
    rows = regression_metrics(scored(spark, sf_dir))
    write_csv(rows.select("target", F.col("model").alias("modelo"), "mae", "rmse", "r2"), root)
    return read_metrics(spark, root).select(
        "target", "modelo", "model_label", F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))


@query("scoring_csv_files", with_sql(
    "SELECT " + ", ".join(f'round("{n}", 6) AS "{n}"' for n in NAMED) + " FROM named",
    *_FRAME))
def scoring_csv_files(spark, sf_dir):
    root = _folder(spark)
    write_csv(sample.named_measurements(spark, sf_dir).select("Estacion", *NAMED), root)
    return read_scoring_rows(spark, root, NAMED).select(*[F.round(n, 6).alias(n) for n in NAMED])
