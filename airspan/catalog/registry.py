"""The named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The station tables as SQL; they match airspan.sources.sample.
STATIONS_SQL = """
st AS (SELECT c_custkey::INTEGER AS id, c_name AS name FROM customer
       WHERE c_custkey IN (SELECT user_id FROM events))"""
VERSIONS_SQL = """
v AS (SELECT user_id::INTEGER AS station_id, date_trunc('hour', ts) AS ts,
             CASE WHEN event_type = 'click' THEN value END AS pm2_5,
             CASE WHEN event_type = 'view' THEN value END AS pm10,
             CASE WHEN event_type = 'purchase' THEN value END AS so2,
             CASE WHEN event_type = 'signup' THEN value END AS no2,
             CASE WHEN event_type = 'error' THEN value END AS o3,
             value * 10 AS co, event_id
      FROM events)"""
MEASUREMENTS_SQL = f"""{VERSIONS_SQL},
m AS (SELECT station_id, ts, max(pm2_5) AS pm2_5, max(pm10) AS pm10, max(so2) AS so2,
             max(no2) AS no2, max(o3) AS o3, max(co) AS co
      FROM v GROUP BY station_id, ts)"""
# Lima keeps UTC-5 all year.
LIMA_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '-05:00'"
VALUES = ["pm2_5", "pm10", "so2", "no2", "o3", "co"]
FIELDS = ["pm25", "pm10", "so2", "no2", "o3", "co"]
NAMED_VALUES = ", ".join(f"{c} AS {f}" for c, f in zip(VALUES, FIELDS))


def with_sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register
