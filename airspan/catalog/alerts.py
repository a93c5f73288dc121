"""Queries about rules and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspan.catalog.registry import (
    FIELDS, MEASUREMENTS_SQL, NAMED_VALUES, STATIONS_SQL, query, with_sql,
)
from airspan.catalog.readings import NEWEST_SQL
from airspan.plans import alerts as a
from airspan.schemas import ALERT_EVENTS, FIELD_COLUMNS, RULE_OPERATORS
from airspan.sources import sample

MADE_AT = "2024-02-01 00:00:00"
CUT = "2024-01-25 00:00:00"

RULES_SQL = """
keyed AS (SELECT c_custkey AS key, c_custkey + 1000 AS id, c_custkey AS station_id, 'rule of ' || c_name AS name FROM customer
          UNION ALL SELECT n_nationkey, n_nationkey + 1, NULL, 'rule of ' || n_name FROM nation),
rules AS (SELECT id::INTEGER AS id, name, station_id::INTEGER AS station_id,
                 ['pm25', 'pm10', 'so2', 'no2', 'o3', 'co', 'PM25', 'x9'][(key % 8 + 1)::INTEGER] AS pollutant,
                 ['gt', 'ge', 'lt', 'le', 'GT', 'eq'][(key % 6 + 1)::INTEGER] AS operator,
                 ((key % 40) * 2.5)::DOUBLE AS threshold, '1h' AS time_window, key % 11 <> 10 AS enabled,
                 TIMESTAMP '2024-01-01' AS created_at FROM keyed)"""


def hits_sql(newest: str, out: str) -> str:
    return f"""
{out}_values AS (UNPIVOT (SELECT station_id, ts, {NAMED_VALUES} FROM {newest})
                 ON {', '.join(FIELDS)} INTO NAME pollutant VALUE value),
{out} AS (SELECT r.id AS rule_id, l.station_id, l.ts, l.pollutant, l.value, lower(r.operator) AS operator, r.threshold
          FROM {out}_values l JOIN rules r ON lower(r.pollutant) = l.pollutant
               AND (r.station_id IS NULL OR r.station_id = l.station_id)
          WHERE r.enabled AND CASE lower(r.operator) WHEN 'gt' THEN l.value > r.threshold
                WHEN 'ge' THEN l.value >= r.threshold WHEN 'lt' THEN l.value < r.threshold
                WHEN 'le' THEN l.value <= r.threshold ELSE FALSE END)"""


EARLIER_SQL = f"""
early AS (SELECT * FROM m WHERE ts < TIMESTAMP '{CUT}'),
earlier AS (SELECT early.* FROM early JOIN (SELECT station_id, max(ts) AS ts FROM early GROUP BY 1) USING (station_id, ts))"""
EVENTS_SQL = f"""
events_made AS (SELECT row_number() OVER (ORDER BY rule_id, station_id, ts) AS id, old.*,
                       TIMESTAMP '{MADE_AT}' AS created_at FROM old)"""
_ALL = (STATIONS_SQL, MEASUREMENTS_SQL, NEWEST_SQL, EARLIER_SQL, RULES_SQL)
_LISTED = """
listed AS (SELECT e.id, e.rule_id, r.name AS rule_name, e.station_id, st.name AS station_name, e.ts, e.pollutant,
                  e.value, e.operator, e.threshold, e.created_at
           FROM events_made e JOIN rules r ON r.id = e.rule_id JOIN st ON st.id = e.station_id)"""


def _tables(spark, sf_dir):
    return (sample.alert_rules(spark, sf_dir), sample.stations(spark, sf_dir),
            sample.measurements(spark, sf_dir))


def _made_at():
    return F.lit(MADE_AT).cast("timestamp_ntz")


def stored_events(spark, sf_dir):
    """Events as if the rules had been evaluated once, some days before the end."""
    rules, stations, m = _tables(spark, sf_dir)
    hits = a.rule_hits(rules, stations, m.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")))
    return a.record_events(hits, spark.createDataFrame([], ALERT_EVENTS), _made_at())


@query("rules_list", with_sql(
    """SELECT r.id, r.name, r.station_id, st.name AS station_name, pollutant, operator, threshold,
              time_window AS window, enabled, created_at
       FROM rules r LEFT JOIN st ON st.id = r.station_id""", STATIONS_SQL, RULES_SQL))
def rules_list(spark, sf_dir):
    return a.newest_rules_first(
        a.list_rules(sample.alert_rules(spark, sf_dir), sample.stations(spark, sf_dir)))


@query("alert_evaluate", with_sql("SELECT * FROM hits", *_ALL, hits_sql("newest", "hits")))
def alert_evaluate(spark, sf_dir):
    return a.rule_hits(*_tables(spark, sf_dir))


@query("alert_evaluate_one", with_sql(
    "SELECT * FROM hits WHERE rule_id = 3", *_ALL, hits_sql("newest", "hits")))
def alert_evaluate_one(spark, sf_dir):
    return a.rule_hits(*_tables(spark, sf_dir), rule_id=3)


@query("alert_new_count", with_sql(
    """SELECT count(*) AS created FROM hits
       WHERE (rule_id, station_id, ts) NOT IN (SELECT (rule_id, station_id, ts) FROM old)""",
    *_ALL, hits_sql("newest", "hits"), hits_sql("earlier", "old")))
def alert_new_count(spark, sf_dir):
    new = a.new_events(a.rule_hits(*_tables(spark, sf_dir)), stored_events(spark, sf_dir))
    return new.agg(F.count(F.lit(1)).alias("created"))


@query("alert_record", with_sql(
    f"""SELECT * FROM events_made UNION ALL
        SELECT (SELECT max(id) FROM events_made) + row_number() OVER (ORDER BY rule_id, station_id, ts) AS id,
               hits.*, TIMESTAMP '{MADE_AT}' AS created_at
        FROM hits WHERE (rule_id, station_id, ts) NOT IN (SELECT (rule_id, station_id, ts) FROM old)""",
    *_ALL, hits_sql("newest", "hits"), hits_sql("earlier", "old"), EVENTS_SQL))
def alert_record(spark, sf_dir):
    return a.record_events(
        a.rule_hits(*_tables(spark, sf_dir)), stored_events(spark, sf_dir), _made_at())


@query("alert_events_list", with_sql(
    f"SELECT * FROM listed WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id LIMIT 200 OFFSET 5",
    *_ALL, hits_sql("earlier", "old"), EVENTS_SQL, _LISTED))
def alert_events_list(spark, sf_dir):
    rules, stations, _ = _tables(spark, sf_dir)
    return a.events_page(
        stored_events(spark, sf_dir), rules, stations, 200, 5, start="2024-01-20T00:00:00")


def _js_text(c: str) -> str:
    """Fixed decimals of the exact value; an exact tie goes up."""
    return f"""CASE WHEN {c} >= 100 THEN printf('%.0f', {c} + CASE WHEN {c} * 2 = floor({c} * 2) THEN 0.1 ELSE 0 END)
                    WHEN {c} >= 10 THEN printf('%.1f', {c} + CASE WHEN {c} * 4 = floor({c} * 4) AND {c} * 2 <> floor({c} * 2) THEN 0.01 ELSE 0 END)
                    ELSE printf('%.2f', {c} + CASE WHEN {c} * 8 = floor({c} * 8) AND {c} * 4 <> floor({c} * 4) THEN 0.001 ELSE 0 END) END"""


@query("alert_text", with_sql(
    f"""SELECT *, upper(pollutant) || ' alcanzó ' || {_js_text('value')} || ' en ' || station_name || '.' AS summary,
               {_js_text('value')} AS value_text, {_js_text('threshold')} AS threshold_text FROM listed""",
    *_ALL, hits_sql("earlier", "old"), EVENTS_SQL, _LISTED))
def alert_text(spark, sf_dir):
    rules, stations, _ = _tables(spark, sf_dir)
    return a.described(a.list_events(stored_events(spark, sf_dir), rules, stations))


@query("latest_event", with_sql(
    f"""SELECT *, upper(pollutant) || ' alcanzó ' || {_js_text('value')} || ' en ' || station_name || '.' AS summary,
               {_js_text('value')} AS value_text, {_js_text('threshold')} AS threshold_text
        FROM listed ORDER BY ts DESC, id LIMIT 1""",
    *_ALL, hits_sql("earlier", "old"), EVENTS_SQL, _LISTED))
def latest_event(spark, sf_dir):
    rules, stations, _ = _tables(spark, sf_dir)
    return a.latest_event(stored_events(spark, sf_dir), rules, stations)


@query("value_texts", f"SELECT event_id, {_js_text('value')} AS value_text FROM events")
def value_texts(spark, sf_dir):
    return sample.table(spark, sf_dir, "events").select(
        "event_id", a.value_text(F.col("value")).alias("value_text"))


def _candidates(spark, sf_dir):
    key = F.col("c_custkey")
    pick = lambda values, n: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(n)) + 1).cast("int"))
    return sample.table(spark, sf_dir, "customer").select(
        F.when(F.pmod(key, F.lit(9)) == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(F.pmod(key, F.lit(7)) == 1, "abc").when(F.pmod(key, F.lit(7)) == 2, F.lit(None))
        .otherwise(key.cast("string")).alias("station_id"),
        pick([*FIELD_COLUMNS, "CO", "x9"], 8).alias("pollutant"),
        pick([*RULE_OPERATORS, "GE", "ne"], 6).alias("operator"),
        F.when(F.pmod(key, F.lit(5)) == 0, "high").otherwise(F.pmod(key, F.lit(40)).cast("string")).alias("threshold"),
        F.lit("1h").alias("time_window"), F.lit("true").alias("enabled"), key.alias("key"))


_CANDIDATES_SQL = """
cand AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_name END AS name,
                CASE WHEN c_custkey % 7 = 1 THEN 'abc' WHEN c_custkey % 7 = 2 THEN NULL ELSE c_custkey::VARCHAR END AS station_id,
                ['pm25', 'pm10', 'so2', 'no2', 'o3', 'co', 'CO', 'x9'][(c_custkey % 8 + 1)::INTEGER] AS pollutant,
                ['gt', 'ge', 'lt', 'le', 'GE', 'ne'][(c_custkey % 6 + 1)::INTEGER] AS operator,
                CASE WHEN c_custkey % 5 = 0 THEN 'high' ELSE (c_custkey % 40)::VARCHAR END AS threshold,
                '1h' AS time_window, 'true' AS enabled, c_custkey AS key FROM customer),
judged AS (SELECT *, CASE WHEN trim(name) = '' THEN 'name is required'
                WHEN pollutant = 'x9' THEN 'pollutant must be one of: pm25,pm10,so2,no2,o3,co'
                WHEN operator = 'ne' THEN 'operator must be one of: gt,ge,lt,le'
                WHEN threshold = 'high' THEN 'threshold must be numeric'
                WHEN station_id = 'abc' THEN 'station_id must be integer or null'
                WHEN station_id IS NOT NULL AND key NOT IN (SELECT id FROM st) THEN 'station_id not found' END AS reason
           FROM cand)"""


@query("rules_validate", with_sql("SELECT * FROM judged", STATIONS_SQL, _CANDIDATES_SQL))
def rules_validate(spark, sf_dir):
    return a.validate_rules(_candidates(spark, sf_dir), sample.stations(spark, sf_dir))


@query("rules_accepted", with_sql(
    """SELECT key, name, station_id::INTEGER AS station_id, lower(pollutant) AS pollutant, lower(operator) AS operator,
              threshold::DOUBLE AS threshold, time_window, TRUE AS enabled FROM judged WHERE reason IS NULL""",
    STATIONS_SQL, _CANDIDATES_SQL))
def rules_accepted(spark, sf_dir):
    judged = a.validate_rules(_candidates(spark, sf_dir), sample.stations(spark, sf_dir))
    return a.typed_rules(judged.filter("reason is null"), "key")


def _changes(spark, sf_dir):
    """A change for each customer's rule, a second one for many of them, some of which are gone by
    then, and an insert per supplier, some of them faulty."""
    customers, suppliers = sample.table(spark, sf_dir, "customer"), sample.table(spark, sf_dir, "supplier")
    key = F.col("key")
    no = F.lit(False)
    shape = lambda df, **cols: df.select(*[
        cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in [
            ("seq", "long"), ("action", "string"), ("id", "int"), ("name", "string"), ("station_id", "int"),
            ("pollutant", "string"), ("operator", "string"), ("threshold", "double"),
            ("time_window", "string"), ("enabled", "boolean")]],
        *[cols.get(f"set_{c}", no).alias(f"set_{c}") for c in a.SETTABLE])
    kind, fault = F.pmod(key, F.lit(5)), F.pmod(key, F.lit(7))
    first = shape(
        customers.withColumn("key", F.col("c_custkey")), seq=key, id=key + 1000,
        action=F.when(kind == 1, "delete").otherwise("update"),
        threshold=F.lit(1.5), set_threshold=kind == 0, set_station_id=kind == 0,
        operator=F.when(F.pmod(key, F.lit(10)) == 2, "zz").otherwise("LE"), set_operator=kind == 2,
        enabled=no, set_enabled=kind == 4)
    second = shape(
        suppliers.withColumn("key", F.col("s_suppkey")), seq=key + 10_000_000, id=key * 2 + 1000,
        action=F.lit("update"), threshold=F.lit(2.5), set_threshold=F.lit(True))
    inserts = shape(
        suppliers.withColumn("key", F.col("s_suppkey")), seq=key + 20_000_000, action=F.lit("insert"),
        name=F.when(fault == 0, " ").otherwise(F.col("s_name")),
        pollutant=F.when(fault == 1, "zzz").otherwise("CO"), operator=F.when(fault == 2, "nope").otherwise("gt"),
        threshold=F.when(fault != 3, key.cast("double")), station_id=F.when(fault == 4, -5))
    return first.unionByName(second).unionByName(inserts)


_CHANGED_SQL = """
first AS (SELECT c_custkey + 1000 AS id, c_custkey AS key, c_custkey % 5 AS kind FROM customer),
second AS (SELECT s_suppkey * 2 + 1000 AS id FROM supplier),
kept AS (SELECT r.id, r.name, CASE WHEN f.kind = 0 THEN NULL ELSE r.station_id END AS station_id, r.pollutant,
                CASE WHEN f.kind = 2 AND f.key % 10 <> 2 THEN 'le' ELSE r.operator END AS operator,
                CASE WHEN s.id IS NOT NULL THEN 2.5 WHEN f.kind = 0 THEN 1.5 ELSE r.threshold END AS threshold,
                r.time_window, CASE WHEN f.kind = 4 THEN FALSE ELSE r.enabled END AS enabled, r.created_at
         FROM rules r LEFT JOIN first f ON f.id = r.id LEFT JOIN second s ON s.id = r.id
         WHERE f.kind IS NULL OR f.kind <> 1)"""


@query("rules_apply", with_sql(
    f"""SELECT * FROM kept UNION ALL
        SELECT ((SELECT max(id) FROM rules) + row_number() OVER (ORDER BY s_suppkey))::INTEGER, s_name, NULL, 'co', 'gt',
               s_suppkey::DOUBLE, NULL, TRUE, TIMESTAMP '{MADE_AT}' FROM supplier WHERE s_suppkey % 7 > 4""",
    RULES_SQL, _CHANGED_SQL))
def rules_apply(spark, sf_dir):
    return a.apply_rule_changes(
        sample.alert_rules(spark, sf_dir), _changes(spark, sf_dir), _made_at(), sample.stations(spark, sf_dir))


@query("rules_outcomes", with_sql(
    """SELECT key AS seq, CASE WHEN kind = 2 AND key % 10 = 2 THEN 'invalid operator'
                               WHEN kind = 3 THEN 'no fields to update' ELSE 'ok' END AS outcome FROM first
       UNION ALL SELECT s_suppkey + 10000000, CASE WHEN s_suppkey * 2 + 1000 IN (SELECT id FROM rules)
                               AND s_suppkey * 2 + 1000 NOT IN (SELECT id FROM first WHERE kind = 1) THEN 'ok'
                               ELSE 'rule not found' END FROM supplier
       UNION ALL SELECT s_suppkey + 20000000, coalesce(['name is required', 'pollutant must be one of: pm25,pm10,so2,no2,o3,co',
                               'operator must be one of: gt,ge,lt,le', 'threshold must be numeric', 'station_id not found'][
                               (s_suppkey % 7 + 1)::INTEGER], 'ok') FROM supplier""", RULES_SQL, _CHANGED_SQL))
def rules_outcomes(spark, sf_dir):
    return a.change_outcomes(
        sample.alert_rules(spark, sf_dir), _changes(spark, sf_dir), sample.stations(spark, sf_dir)).select("seq", "outcome")


@query("events_after_rule_delete", with_sql(
    "SELECT e.id, e.rule_id FROM events_made e WHERE e.rule_id IN (SELECT id FROM kept)",
    *_ALL, hits_sql("earlier", "old"), EVENTS_SQL, _CHANGED_SQL))
def events_after_rule_delete(spark, sf_dir):
    rules = a.apply_rule_changes(sample.alert_rules(spark, sf_dir), _changes(spark, sf_dir), _made_at())
    return a.drop_orphan_events(stored_events(spark, sf_dir), rules).select("id", "rule_id")
