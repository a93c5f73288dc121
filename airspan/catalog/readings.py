"""Queries over the station and measurement tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspan.catalog.registry import (
    FIELDS, LIMA_ISO, MEASUREMENTS_SQL, NAMED_VALUES, STATIONS_SQL, VALUES, query, with_sql,
)
from airspan.functions.times import iso_time
from airspan.operators.latest import latest_per_station
from airspan.plans import measurements as q
from airspan.schemas import FIELD_COLUMNS
from airspan.sources import sample

START, END = "2024-01-05T00:00:00-05:00", "2024-01-20T17:30:00Z"
RANGE_SQL = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:30:00'"
NEWEST_SQL = "newest AS (SELECT m.* FROM m JOIN (SELECT station_id, max(ts) AS ts FROM m GROUP BY 1) USING (station_id, ts))"


def _both(spark, sf_dir):
    return sample.stations(spark, sf_dir), sample.measurements(spark, sf_dir)


@query("latest_per_station", with_sql("SELECT * FROM newest", MEASUREMENTS_SQL, NEWEST_SQL))
def latest(spark, sf_dir):
    return latest_per_station(sample.measurements(spark, sf_dir))


@query("station_latest", with_sql(
    f"""SELECT st.id AS station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM st LEFT JOIN newest ON newest.station_id = st.id WHERE st.id = 7""",
    STATIONS_SQL, MEASUREMENTS_SQL, NEWEST_SQL))
def station_latest(spark, sf_dir):
    return q.station_latest(*_both(spark, sf_dir), 7)


@query("latest_all", with_sql(
    f"""SELECT station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM newest JOIN st ON st.id = station_id""",
    STATIONS_SQL, MEASUREMENTS_SQL, NEWEST_SQL))
def latest_all(spark, sf_dir):
    return q.latest_readings(*_both(spark, sf_dir))


@query("latest_page", with_sql(
    f"""SELECT station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM newest JOIN st ON st.id = station_id ORDER BY name, station_id LIMIT 50 OFFSET 10""",
    STATIONS_SQL, MEASUREMENTS_SQL, NEWEST_SQL))
def latest_page(spark, sf_dir):
    return q.latest_page(*_both(spark, sf_dir), limit=50, offset=10)


@query("station_by_id", with_sql("SELECT id, name FROM st WHERE id = 11", STATIONS_SQL))
def station_by_id(spark, sf_dir):
    return q.get_station(sample.stations(spark, sf_dir), 11)


@query("station_search", with_sql(
    """SELECT id, name, (SELECT count(*) FROM st WHERE name ILIKE '%R#00000001%') AS total
       FROM st WHERE name ILIKE '%R#00000001%' ORDER BY name, id LIMIT 30 OFFSET 2""", STATIONS_SQL))
def station_search(spark, sf_dir):
    return q.list_stations(sample.stations(spark, sf_dir), "ŕ#00000001", 30, 2)


@query("station_list", with_sql(
    "SELECT id, name, (SELECT count(*) FROM st) AS total FROM st ORDER BY name, id LIMIT 100", STATIONS_SQL))
def station_list(spark, sf_dir):
    return q.list_stations(sample.stations(spark, sf_dir))


@query("station_range", with_sql(
    f"""SELECT {LIMA_ISO.format('ts')} AS ts, pm2_5 AS pm25, NULL::DOUBLE AS pm10, NULL::DOUBLE AS so2,
               NULL::DOUBLE AS no2, NULL::DOUBLE AS o3, co
        FROM m WHERE station_id = 7 AND {RANGE_SQL} ORDER BY m.ts DESC LIMIT 500""", MEASUREMENTS_SQL))
def station_range(spark, sf_dir):
    return q.station_measurements(
        *_both(spark, sf_dir), 7, START, END, "co, pm25, nope", "desc", limit=500)


@query("measurements_by_ids", with_sql(
    f"""SELECT station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM m JOIN st ON st.id = station_id WHERE station_id IN (1, 2, 3, 5, 8) AND {RANGE_SQL}
        ORDER BY m.ts, station_id LIMIT 1000 OFFSET 20""", STATIONS_SQL, MEASUREMENTS_SQL))
def measurements_by_ids(spark, sf_dir):
    return q.measurements_page(
        *_both(spark, sf_dir), ids=[1, 2, 3, 5, 8], start=START, end=END, limit=5000, offset=20)


@query("measurements_by_names", with_sql(
    f"""SELECT station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM m JOIN st ON st.id = station_id
        WHERE name IN ('Customer#000000003', 'Customer#000000012')
        ORDER BY m.ts DESC, station_id LIMIT 100""", STATIONS_SQL, MEASUREMENTS_SQL))
def measurements_by_names(spark, sf_dir):
    return q.measurements_page(
        *_both(spark, sf_dir), names=["CUSTOMER#000000003", " cústomer#000000012 "], order="DESC")


@query("fields_none_valid", with_sql(
    f"""SELECT station_id, name AS station_name, {LIMA_ISO.format('ts')} AS ts,
               {', '.join(f'NULL::DOUBLE AS {f}' for f in FIELDS)}
        FROM m JOIN st ON st.id = station_id ORDER BY m.ts, station_id LIMIT 100""",
    STATIONS_SQL, MEASUREMENTS_SQL))
def fields_none_valid(spark, sf_dir):
    return q.measurements_page(*_both(spark, sf_dir), fields="humidity")


@query("export_rows", with_sql(
    f"""SELECT name AS station_name, {LIMA_ISO.format('ts')} AS ts, {NAMED_VALUES}
        FROM m JOIN st ON st.id = station_id WHERE {RANGE_SQL}""", STATIONS_SQL, MEASUREMENTS_SQL))
def export_rows(spark, sf_dir):
    return q.export_rows(*_both(spark, sf_dir), start=START, end=END)


def _aggregate_sql(granularity: str, agg: str, where: str = "TRUE") -> str:
    bucket = "date_trunc('hour', ts)" if granularity == "hourly" else "date_trunc('day', ts)"
    call = {"avg": "round(avg({c}), 6)", "median": "median({c})", "max": "max({c})", "min": "min({c})"}[agg]
    values = ", ".join(f"{call.format(c=c)} AS {f}" for c, f in zip(VALUES, FIELDS))
    return with_sql(
        f"""SELECT station_id, {LIMA_ISO.format(bucket)} AS ts, {values}
            FROM m WHERE {where} GROUP BY station_id, {bucket}""", MEASUREMENTS_SQL)


def _aggregate(granularity: str, agg: str, **filters):
    def run(spark, sf_dir):
        rows = q.aggregate_all(sample.measurements(spark, sf_dir), granularity, agg, **filters)
        if agg != "avg":
            return rows
        return rows.select("station_id", "ts", *[F.round(f, 6).alias(f) for f in FIELDS])
    return run


for _granularity in ("hourly", "daily"):
    for _agg in ("avg", "max", "min", "median"):
        query(f"agg_{_granularity}_{_agg}", _aggregate_sql(_granularity, _agg))(
            _aggregate(_granularity, _agg))

query("agg_daily_avg_range", _aggregate_sql(
    "daily", "avg", f"station_id IN (3, 4, 5) AND {RANGE_SQL}"))(
    _aggregate("daily", "avg", station_ids=[3, 4, 5], start=START, end=END))

_CELLS = """
long AS (UNPIVOT (SELECT hour(ts) AS hour, pm2_5 AS pm25, pm10, so2, no2, o3, co FROM m)
         ON pm25, pm10, so2, no2, o3, co INTO NAME pollutant VALUE reading),
cells AS (SELECT pollutant, hour, avg(reading) AS value FROM long GROUP BY pollutant, hour)"""


@query("heatmap", with_sql(
    "SELECT p.pollutant, " + ", ".join(
        f"round(max(CASE WHEN hour = {h} THEN value END), 6) AS h{h}" for h in range(24))
    + f" FROM (VALUES {', '.join(repr((f,)).replace(',)', ')') for f in FIELDS)}) p(pollutant)"
      " LEFT JOIN cells ON cells.pollutant = p.pollutant GROUP BY p.pollutant", MEASUREMENTS_SQL, _CELLS))
def heatmap(spark, sf_dir):
    rows = q.heatmap(sample.measurements(spark, sf_dir))
    return rows.select("pollutant", *[F.round(f"h{h}", 6).alias(f"h{h}") for h in range(24)])


@query("heatmap_scale", with_sql(
    "SELECT round(min(value), 6) AS low, round(max(value), 6) AS high FROM cells", MEASUREMENTS_SQL, _CELLS))
def heatmap_scale(spark, sf_dir):
    rows = q.heatmap_bounds(sample.measurements(spark, sf_dir))
    return rows.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("heatmap_totals", with_sql(
    "SELECT count(*) AS items, count(DISTINCT ts) AS hour_buckets FROM m", MEASUREMENTS_SQL))
def heatmap_totals(spark, sf_dir):
    return q.heatmap_counts(sample.measurements(spark, sf_dir))


@query("heatmap_long_ratio", with_sql(
    """SELECT pollutant, hour::INTEGER AS hour, round(value, 6) AS value,
              round((value - (SELECT min(value) FROM cells))
                    / ((SELECT max(value) FROM cells) - (SELECT min(value) FROM cells)), 6) AS ratio
       FROM cells""", MEASUREMENTS_SQL, _CELLS))
def heatmap_long_ratio(spark, sf_dir):
    rows = q.heatmap_long(sample.measurements(spark, sf_dir))
    return rows.select("pollutant", "hour", F.round("value", 6).alias("value"),
                       F.round("ratio", 6).alias("ratio"))


@query("heatmap_tokyo", with_sql(
    """SELECT pollutant, ((hour + 14) % 24)::INTEGER AS hour, round(value, 6) AS value,
              round((value - (SELECT min(value) FROM cells))
                    / ((SELECT max(value) FROM cells) - (SELECT min(value) FROM cells)), 6) AS ratio
       FROM cells""", MEASUREMENTS_SQL, _CELLS))
def heatmap_tokyo(spark, sf_dir):
    rows = q.heatmap_long(sample.measurements(spark, sf_dir), tz="Asia/Tokyo")
    return rows.select("pollutant", "hour", F.round("value", 6).alias("value"),
                       F.round("ratio", 6).alias("ratio"))


_ISO_MICROS = "replace(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), ' ', 'T')"


@query("iso_time_zone", f"""
SELECT event_id,
       replace({_ISO_MICROS.format('ts')}, '.000000', '') || '-05:00' AS home,
       replace({_ISO_MICROS.format("ts + INTERVAL '10 hours 30 minutes'")}, '.000000', '') || '+05:30' AS kolkata,
       replace({_ISO_MICROS.format('ts')}, '.000000', '') || '-05:00' AS new_york,
       replace({_ISO_MICROS.format('ts')}, '.000000', '') || '-05:00' AS unknown_zone,
       strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S') || '-05:00' AS day
FROM events""")
def iso_time_zone(spark, sf_dir):
    ts = F.col("ts")
    return sample.table(spark, sf_dir, "events").select(
        "event_id", iso_time(ts).alias("home"), iso_time(ts, "Asia/Kolkata").alias("kolkata"),
        iso_time(ts, "America/New_York").alias("new_york"),
        iso_time(ts, "Mars/Olympus").alias("unknown_zone"), iso_time(F.to_date(ts)).alias("day"))


@query("long_values", with_sql(
    """SELECT * FROM (UNPIVOT (SELECT station_id, ts, pm2_5 AS pm25, pm10, so2, no2, o3, co FROM m)
       ON pm25, pm10, so2, no2, o3, co INTO NAME pollutant VALUE value)""", MEASUREMENTS_SQL))
def long_values(spark, sf_dir):
    m = sample.measurements(spark, sf_dir)
    wide = m.select("station_id", "ts", *[F.col(c).alias(k) for k, c in FIELD_COLUMNS.items()])
    return wide.unpivot(["station_id", "ts"], list(FIELD_COLUMNS), "pollutant", "value").filter(
        F.col("value").isNotNull())
