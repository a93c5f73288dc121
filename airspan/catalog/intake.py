"""Queries that clean, deduplicate and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspan.catalog.registry import (
    MEASUREMENTS_SQL, STATIONS_SQL, VALUES, VERSIONS_SQL, query, with_sql,
)
from airspan.functions.numbers import clean_number, commas_to_dots_if_digits, commas_to_dots_if_number
from airspan.operators.dedup import one_per_key, unseen_rows
from airspan.plans.cleaning import clean_readings, numbered_clean
from airspan.plans.loading import load
from airspan.schemas import RAW_KEY, STATIONS
from airspan.session import durable
from airspan.sinks.store import KEY, assign_ids, upsert_measurements
from airspan.sources import sample
from airspan.sources.pages import parse_pages, station_of_pages

# What each way of writing a reading stands for.
_NUMBER_SQL = """CASE event_id % 7
    WHEN 0 THEN CAST(printf('%.2f', value) AS DOUBLE)
    WHEN 1 THEN CAST(printf('1%06.2f', value) AS DOUBLE)
    WHEN 2 THEN CAST(printf('2%06.2f', value) AS DOUBLE)
    WHEN 3 THEN CAST(printf('%.2f', value) AS DOUBLE)
    WHEN 4 THEN CAST(printf('%.2f', value) AS DOUBLE)
    WHEN 5 THEN CAST(printf('-%.2f', value) AS DOUBLE) END"""
_RAW_SQL = """CASE event_id % 7
    WHEN 0 THEN printf('%.2f', value)
    WHEN 1 THEN printf('1,%06.2f', value)
    WHEN 2 THEN printf('2.%06.2f', value)
    WHEN 3 THEN replace(printf('%.2f', value), '.', ',')
    WHEN 4 THEN '"  ' || printf('%.2f', value) || ' ''' 
    WHEN 5 THEN printf('-%.2f', value) ELSE '  ' END"""


@query("clean_numbers", f"""
SELECT event_id, {_NUMBER_SQL} AS number,
       CASE WHEN event_id % 7 = 2 THEN CAST('2.' || right(printf('%.2f', value), 2) AS DOUBLE)
            ELSE {_NUMBER_SQL} END AS number_compat
FROM events""")
def clean_numbers(spark, sf_dir):
    return sample.raw_readings(spark, sf_dir).select(
        "event_id", clean_number(F.col("CO")).alias("number"),
        clean_number(F.col("CO"), compat=True).alias("number_compat"))


@query("comma_rules", f"""
SELECT event_id,
       CASE WHEN event_id % 7 IN (1, 3) THEN replace({_RAW_SQL}, ',', '.') ELSE {_RAW_SQL} END AS rule_a,
       CASE WHEN event_id % 7 = 3 THEN replace({_RAW_SQL}, ',', '.') ELSE {_RAW_SQL} END AS rule_b
FROM events""")
def comma_rules(spark, sf_dir):
    return sample.raw_readings(spark, sf_dir).select(
        "event_id", commas_to_dots_if_digits(F.col("CO")).alias("rule_a"),
        commas_to_dots_if_number(F.col("CO")).alias("rule_b"))


_EVENT_OF = {"PM 2.5": "click", "PM 10": "view", "SO2": "purchase", "NO2": "signup", "O3": "error"}
_CLEAN_SQL = f"""
n AS (SELECT *, {_NUMBER_SQL} AS number, date_trunc('hour', ts) AS bucket FROM events),
kept AS (SELECT * FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY event_id DESC) AS rn FROM n)
         WHERE rn = 1 AND number IS NOT NULL),
clean AS (SELECT 'Estacion ' || user_id AS "Estacion", strftime(bucket, '%d/%m/%Y') AS "Fecha",
                 strftime(bucket, '%H:00') AS "Hora",
                 {', '.join(f'''CASE WHEN event_type = '{e}' AND number >= 0 THEN number END AS "{c}"''' for c, e in _EVENT_OF.items())},
                 CASE WHEN number >= 0 THEN number END AS "CO", user_id, bucket
          FROM kept)"""


def clean(spark, sf_dir):
    return clean_readings(sample.raw_readings(spark, sf_dir), order="event_id")


@query("clean_readings", with_sql("SELECT * EXCLUDE (user_id, bucket) FROM clean", _CLEAN_SQL))
def _clean(spark, sf_dir):
    return clean(spark, sf_dir)


@query("clean_row_order", with_sql(
    """SELECT * EXCLUDE (user_id, bucket), row_number() OVER (ORDER BY "Estacion", "Fecha", "Hora") - 1 AS row_no FROM clean""",
    _CLEAN_SQL))
def clean_row_order(spark, sf_dir):
    return numbered_clean(clean(spark, sf_dir))


@query("load_measurements", with_sql(
    """SELECT ids.id::INTEGER AS station_id, bucket AS ts, "PM 2.5" AS pm2_5, "PM 10" AS pm10,
              "SO2" AS so2, "NO2" AS no2, "O3" AS o3, "CO" AS co
       FROM clean JOIN (SELECT "Estacion" AS name, row_number() OVER (ORDER BY "Estacion") AS id
                        FROM (SELECT DISTINCT "Estacion" FROM clean)) ids ON ids.name = clean."Estacion" """,
    _CLEAN_SQL))
def load_measurements(spark, sf_dir):
    rows = clean(spark, sf_dir).withColumn("_seq", F.lit(0))
    _, updates = load(rows, spark.createDataFrame([], STATIONS), "_seq")
    return updates.select(*KEY, *VALUES)


@query("dedup_keep_last", with_sql(
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id DESC) AS rn FROM v) WHERE rn = 1""", VERSIONS_SQL))
def dedup_keep_last(spark, sf_dir):
    return one_per_key(sample.versions(spark, sf_dir), KEY, ["event_id"], "last")


@query("dedup_keep_first", with_sql(
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id) AS rn FROM v) WHERE rn = 1""", VERSIONS_SQL))
def dedup_keep_first(spark, sf_dir):
    return one_per_key(sample.versions(spark, sf_dir), KEY, ["event_id"], "first")


@query("new_rows_anti", with_sql(
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id) AS rn FROM v) WHERE rn = 1
       AND (station_id, ts) NOT IN (SELECT (station_id, ts) FROM v WHERE ts < TIMESTAMP '2024-01-15')""",
    VERSIONS_SQL))
def new_rows_anti(spark, sf_dir):
    rows = sample.versions(spark, sf_dir)
    known = rows.filter("ts < timestamp_ntz'2024-01-15 00:00:00'")
    return unseen_rows(rows, known, KEY, ["event_id"])


@query("upsert_measurements", with_sql(
    """SELECT station_id, ts, pm2_5, pm10, so2, no2, o3, co FROM m WHERE ts < TIMESTAMP '2024-01-20'
          AND (station_id, ts) NOT IN (SELECT (station_id, ts) FROM v WHERE ts >= TIMESTAMP '2024-01-10')
       UNION ALL
       SELECT station_id, ts, pm2_5, pm10, so2, no2, o3, co FROM (SELECT *, row_number() OVER (
           PARTITION BY station_id, ts ORDER BY event_id DESC) AS rn FROM v
           WHERE ts >= TIMESTAMP '2024-01-10') WHERE rn = 1""", MEASUREMENTS_SQL))
def upsert(spark, sf_dir):
    existing = sample.measurements(spark, sf_dir).filter("ts < timestamp_ntz'2024-01-20 00:00:00'")
    updates = sample.versions(spark, sf_dir).filter("ts >= timestamp_ntz'2024-01-10 00:00:00'")
    return upsert_measurements(existing, updates, ["event_id"])


@query("assign_station_ids", with_sql(
    """SELECT id, name FROM st UNION ALL
       SELECT ((SELECT max(id) FROM st) + row_number() OVER (ORDER BY name))::INTEGER AS id, name FROM (
           SELECT upper(c_name) AS name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(name) FROM st)
           UNION SELECT s_name FROM supplier)""", STATIONS_SQL))
def assign_station_ids(spark, sf_dir):
    customers = sample.table(spark, sf_dir, "customer").select(F.upper("c_name").alias("name"))
    suppliers = sample.table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name").alias("name"))
    return assign_ids(customers.unionByName(suppliers), sample.stations(spark, sf_dir))


def _all_pages(spark, sf_dir):
    """The station pages, and the web pages, none of which has a readings table."""
    web = sample.table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    return sample.station_pages(spark, sf_dir).unionByName(web)


_PAGE_TEXT = """CASE event_id % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE 's/d' END"""
_PLAIN = "printf('%.2f', value)"
_DOTTED = "printf('1.%06.2f', value % 1000)"
_PAGE_A = _PAGE_TEXT.format(_PLAIN, _DOTTED)
_PAGE_B = _PAGE_TEXT.format(_PLAIN, "printf('1,%06.2f', value % 1000)")
_SIX = ["PM 2,5", "PM 10", "SO2", "NO2", "O3", "CO"]


def _six(text: str) -> str:
    return ", ".join(f'{text} AS "{c}"' for c in _SIX)


_PAGE_KEY = """'Estación ' || user_id AS "Estacion", strftime(ts, '%d/%m/%Y') AS "Fecha" """


@query("page_parse", f"""
SELECT event_id AS page_id, 0::INTEGER AS row_no, {_PAGE_KEY}, strftime(ts, '%H:00') AS "Hora", {_six(_PAGE_A)}
FROM events UNION ALL
SELECT event_id AS page_id, 2::INTEGER AS row_no, {_PAGE_KEY}, '00:00' AS "Hora", {_PAGE_A} AS "PM 2,5",
       '' AS "PM 10", '' AS "SO2", '' AS "NO2", '' AS "O3", '' AS "CO" FROM events""")
def page_parse(spark, sf_dir):
    return parse_pages(_all_pages(spark, sf_dir))


@query("page_first_row", f"""
SELECT event_id AS page_id, 0::INTEGER AS row_no, {_PAGE_KEY}, strftime(ts, '%H:00') AS "Hora", {_six(_PAGE_B)}
FROM events""")
def page_first_row(spark, sf_dir):
    return parse_pages(_all_pages(spark, sf_dir), first_only=True)


@query("page_station", """
SELECT event_id AS page_id, 'Estación ' || user_id AS station FROM events UNION ALL
SELECT -1 - page_id AS page_id, '' AS station FROM pages""")
def page_station(spark, sf_dir):
    return station_of_pages(_all_pages(spark, sf_dir))
