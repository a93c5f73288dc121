"""Queries that run the events table through a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspan.catalog.alerts import RULES_SQL, hits_sql
from airspan.catalog.intake import _PAGE_B, _PAGE_KEY, _six
from airspan.catalog.readings import NEWEST_SQL
from airspan.catalog.registry import MEASUREMENTS_SQL, STATIONS_SQL, VALUES, VERSIONS_SQL, query, with_sql
from airspan.schemas import RAW_COLUMNS, name_col
from airspan.session import checkpoint_root
from airspan.sinks.store import KEY
from airspan.sources import sample
from airspan.streaming import jobs


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample.versions`` as a stream."""
    return sample.versions_of(sample.event_stream(spark, sf_dir))


def _places(spark: SparkSession) -> tuple[str, str]:
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


@query("stream_new_rows", with_sql(
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id) AS rn FROM v) WHERE rn = 1""", VERSIONS_SQL))
def stream_new_rows(spark, sf_dir):
    path, checkpoint = _places(spark)
    jobs.intake(versions(spark, sf_dir), path, checkpoint, KEY, ["event_id"]).awaitTermination()
    return spark.read.parquet(path)


@query("stream_pages", f"""
SELECT * EXCLUDE (rn) FROM (
    SELECT event_id AS page_id, {_PAGE_KEY}, strftime(ts, '%H:00') AS "Hora", {_six(_PAGE_B)},
           row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) AS rn
    FROM events) WHERE rn = 1""")
def stream_pages(spark, sf_dir):
    path, checkpoint = _places(spark)
    pages = sample.pages_of(sample.event_stream(spark, sf_dir))
    jobs.intake_pages(pages, path, checkpoint).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.select("page_id", *[F.col(name_col(c)).cast("string").alias(c) for c in RAW_COLUMNS])


@query("stream_dedup_keys", with_sql("SELECT DISTINCT station_id, ts FROM v", VERSIONS_SQL))
def stream_dedup_keys(spark, sf_dir):
    path, checkpoint = _places(spark)
    jobs.intake_within(
        versions(spark, sf_dir).select(*KEY), path, checkpoint, KEY, delay="2 hours").awaitTermination()
    return spark.read.parquet(path)


@query("stream_upsert", with_sql(
    f"""SELECT station_id, ts, {', '.join(VALUES)} FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id DESC) AS rn FROM v) WHERE rn = 1""", VERSIONS_SQL))
def stream_upsert(spark, sf_dir):
    path, checkpoint = _places(spark)
    jobs.upsert(versions(spark, sf_dir), path, checkpoint, ["event_id"]).awaitTermination()
    return spark.read.parquet(path).select(*KEY, *VALUES)


@query("stream_alerts", with_sql(
    "SELECT * FROM hits", STATIONS_SQL, VERSIONS_SQL,
    """m AS (SELECT station_id, ts, pm2_5, pm10, so2, no2, o3, co FROM v JOIN (
             SELECT station_id, ts, max(event_id) AS event_id FROM v GROUP BY 1, 2) USING (station_id, ts, event_id))""",
    NEWEST_SQL, RULES_SQL, hits_sql("newest", "hits")))
def stream_alerts(spark, sf_dir):
    """Loads by stream and checks the rules on what each batch brings."""
    table, checkpoint = _places(spark)
    events, newest = _places(spark)
    jobs.load_and_watch(
        versions(spark, sf_dir), sample.alert_rules(spark, sf_dir), sample.stations(spark, sf_dir), table, events,
        newest, checkpoint, ["event_id"]).awaitTermination()
    return jobs.recorded_events(spark, events).select(
        "rule_id", "station_id", "ts", "pollutant", "value", "operator", "threshold")


@query("stream_hourly_avg", with_sql(
    f"""SELECT station_id, ts AS bucket, {', '.join(f'round(avg({c}), 6) AS {c}' for c in VALUES)} FROM v
        WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM v) - INTERVAL '1 hour'
        GROUP BY station_id, ts""", VERSIONS_SQL))
def stream_hourly_avg(spark, sf_dir):
    """The hours closed at the end of the stream."""
    path, checkpoint = _places(spark)
    jobs.aggregate_to(versions(spark, sf_dir), path, checkpoint, delay="1 hour").awaitTermination()
    return spark.read.parquet(path).select(
        "station_id", "bucket", *[F.round(c, 6).alias(c) for c in VALUES])
