"""Rules and events on small tables."""

from pyspark.sql import functions as F

from airspan.plans import alerts as a
from airspan.schemas import ALERT_EVENTS, ALERT_RULES


def setup(spark):
    stations = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    m = spark.sql("""select * from values
        (1, timestamp_ntz'2024-01-01 01:00:00', 50D, 2D, 3D, 4D, 5D, 6D),
        (1, timestamp_ntz'2024-01-01 02:00:00', null, 20D, 3D, 4D, 5D, 7D),
        (2, timestamp_ntz'2024-01-01 03:00:00', 9D, 2D, 3D, 4D, 5D, 8D)
        as t(station_id, ts, pm2_5, pm10, so2, no2, o3, co)""")
    rows = [
        (1, "null in latest", 1, "pm25", "gt", 1.0, True), (2, "all stations", None, "CO", "GE", 7.0, True),
        (3, "off", None, "co", "gt", 0.0, False), (4, "no such", None, "x", "gt", 0.0, True),
        (5, "no such", None, "co", "eq", 7.0, True), (6, "one station", 1, "pm10", "lt", 21.0, True),
        (7, "equal", 2, "co", "gt", 8.0, True), (8, "equal", 2, "co", "le", 8.0, True)]
    rules = spark.createDataFrame(rows, "id int, name string, station_id int, pollutant string, operator string, threshold double, enabled boolean")
    rules = rules.withColumn("time_window", F.lit("1h")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    return rules.select(*ALERT_RULES.names), stations, m


def test_hits_and_no_doubled_events(spark):
    rules, stations, m = setup(spark)
    hits = a.rule_hits(rules, stations, m)
    assert sorted((r["rule_id"], r["station_id"], r["value"]) for r in hits.collect()) == [
        (2, 1, 7.0), (2, 2, 8.0), (6, 1, 20.0), (8, 2, 8.0)]
    none = spark.createDataFrame([], ALERT_EVENTS)
    events = a.record_events(hits, none)
    assert sorted(r["id"] for r in events.collect()) == [1, 2, 3, 4]
    assert a.new_events(hits, events).count() == 0
    changed = a.record_events(hits.withColumn("value", F.lit(1.5)), events)
    assert {r["value"] for r in changed.collect()} == {1.5} and changed.count() == 4
    assert a.rule_hits(rules, stations, m, rule_id=0).count() == 0


def test_update_can_set_null_and_unknown_rule_is_told(spark):
    rules, _, _ = setup(spark)
    flags = ", ".join(f"false as set_{c}" for c in a.SETTABLE if c not in ("station_id", "threshold"))
    changes = spark.sql(f"""
        select s as seq, act as action, i as id, cast(null as string) name, cast(null as int) station_id,
               cast(null as string) pollutant, cast(null as string) operator, th as threshold,
               cast(null as string) time_window, cast(null as boolean) enabled,
               st as set_station_id, tt as set_threshold, {flags}
        from values (1L, 'update', 1, 5D, true, true), (2L, 'update', 1, 6D, false, true),
                    (3L, 'delete', 2, null, false, false), (4L, 'update', 99, 1D, false, true),
                    (5L, 'update', 6, null, false, false) as t(s, act, i, th, st, tt)""")
    after = {r["id"]: r for r in a.apply_rule_changes(rules, changes).collect()}
    assert after[1]["station_id"] is None and after[1]["threshold"] == 6.0 and after[1]["pollutant"] == "pm25"
    assert 2 not in after and after[6]["threshold"] == 21.0 and len(after) == 7
    said = {r["seq"]: r["outcome"] for r in a.change_outcomes(rules, changes).collect()}
    assert said == {1: "ok", 2: "ok", 3: "ok", 4: "rule not found", 5: "no fields to update"}


def test_changes_count_in_order_and_inserts_are_checked(spark):
    rules, stations, _ = setup(spark)
    flags = ", ".join(f"{'true' if c == 'threshold' else 'false'} as set_{c}" for c in a.SETTABLE)
    changes = spark.sql(f"""
        select s as seq, act as action, i as id, n as name, cast(null as int) station_id, p as pollutant, 'gt' as operator,
               cast(9 as double) as threshold, cast(null as string) time_window, cast(null as boolean) enabled, {flags}
        from values (1L, 'delete', 2, null, null), (2L, 'update', 2, null, null), (3L, 'delete', 2, null, null),
                    (4L, 'update', 1, null, null), (5L, 'delete', 1, null, null), (6L, 'insert', null, ' ', 'co'),
                    (7L, 'insert', null, 'n', 'zzz'), (8L, 'insert', null, 'n', 'CO') as t(s, act, i, n, p)""")
    said = {r["seq"]: r["outcome"] for r in a.change_outcomes(rules, changes, stations).collect()}
    assert said == {1: "ok", 2: a.NO_RULE, 3: a.NO_RULE, 4: "ok", 5: "ok", 6: a.NO_NAME, 7: a.BAD_POLLUTANT, 8: "ok"}
    after = a.apply_rule_changes(rules, changes, stations=stations).collect()
    before = {r["id"] for r in rules.collect()}
    assert {r["id"] for r in after} == before - {1, 2} | {max(before) + 1}


def test_rules_too_many_to_send_find_the_same(spark, monkeypatch):
    rules, stations, m = setup(spark)
    want = sorted(map(tuple, a.rule_hits(rules, stations, m).collect()))
    monkeypatch.setattr(a, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, a.rule_hits(rules, stations, m).collect())) == want
