"""Alert rules and the events they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airspan.functions.numbers import strip_blanks, to_number
from airspan.functions.texts import alert_sentence, value_text
from airspan.operators.fields import in_time_range
from airspan.operators.latest import latest_per_station
from airspan.operators.order import page, with_row_number
from airspan.operators.sizing import BROADCAST_ROWS
from airspan.schemas import ALERT_RULES, FIELD_COLUMNS, RULE_OPERATORS

EVENT_KEY = ["rule_id", "station_id", "ts"]
# Parts of the rules of one pollutant, where they are too many to be sent to every executor.
RULE_PARTS = 64

# The reasons for which a rule is turned down, in the order they are checked.
NO_NAME = "name is required"
BAD_POLLUTANT = "pollutant must be one of: pm25,pm10,so2,no2,o3,co"
BAD_OPERATOR = "operator must be one of: gt,ge,lt,le"
BAD_THRESHOLD = "threshold must be numeric"
BAD_STATION = "station_id must be integer or null"
NO_STATION = "station_id not found"
BAD_POLLUTANT_UPDATE = "invalid pollutant"
BAD_OPERATOR_UPDATE = "invalid operator"
NO_FIELDS = "no fields to update"
NO_RULE = "rule not found"

SETTABLE = ["name", "station_id", "pollutant", "operator", "threshold", "time_window", "enabled"]


def list_rules(rules: DataFrame, stations: DataFrame) -> DataFrame:
    """Rules with the station's name, if they have one."""
    named = stations.select(F.col("id").alias("_sid"), F.col("name").alias("station_name"))
    return rules.join(named, F.col("station_id") == F.col("_sid"), "left").select(
        "id", "name", "station_id", "station_name", "pollutant", "operator", "threshold",
        F.col("time_window").alias("window"), "enabled", "created_at")


def newest_rules_first(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.desc("created_at"), F.asc("id"))


def list_events(
    events: DataFrame, rules: DataFrame, stations: DataFrame, rule_id: int | None = None,
    station_id: int | None = None, start=None, end=None,
) -> DataFrame:
    """Events with the names of their rule and station."""
    rows = in_time_range(events, start, end)
    if rule_id is not None:
        rows = rows.filter(F.col("rule_id") == rule_id)
    if station_id is not None:
        rows = rows.filter(F.col("station_id") == station_id)
    by_rule = rules.select(F.col("id").alias("_rid"), F.col("name").alias("rule_name"))
    by_station = stations.select(F.col("id").alias("_sid"), F.col("name").alias("station_name"))
    return (
        rows.join(by_rule, F.col("rule_id") == F.col("_rid"))
        .join(by_station, F.col("station_id") == F.col("_sid"))
        .select("id", "rule_id", "rule_name", "station_id", "station_name", "ts", "pollutant",
                "value", "operator", "threshold", "created_at")
    )


def events_page(events, rules, stations, limit=None, offset=None, **filters) -> DataFrame:
    rows = list_events(events, rules, stations, **filters)
    return page(rows, [F.desc("ts"), F.asc("id")], limit, offset)


def described(listed: DataFrame) -> DataFrame:
    """Events with their sentence and the texts of value and threshold."""
    station = F.coalesce(
        F.nullif(F.col("station_name"), F.lit("")),
        F.concat(F.lit("Estación "), F.col("station_id").cast("string")))
    rule = F.coalesce(
        F.nullif(F.col("rule_name"), F.lit("")),
        F.concat(F.lit("Regla "), F.col("rule_id").cast("string")))
    return listed.withColumns({
        "summary": alert_sentence(F.col("pollutant"), F.col("value"), station, rule),
        "value_text": value_text(F.col("value")),
        "threshold_text": value_text(F.col("threshold")),
    })


def latest_event(events: DataFrame, rules: DataFrame, stations: DataFrame) -> DataFrame:
    """The newest event, described."""
    return described(events_page(events, rules, stations, limit=1))


def usable_rules(rules: DataFrame, rule_id: int | None = None) -> DataFrame:
    """Enabled rules with a known pollutant and operator, both in lower case."""
    rows = rules.filter("enabled")
    if rule_id is not None:
        rows = rows.filter(F.col("id") == rule_id)
    rows = rows.withColumns({"pollutant": F.lower("pollutant"), "operator": F.lower("operator")})
    return rows.filter(
        F.col("pollutant").isin(list(FIELD_COLUMNS)) & F.col("operator").isin(RULE_OPERATORS))


def breaks(value: Column, operator: Column, threshold: Column) -> Column:
    """Whether the value meets the rule's condition; a missing one never does."""
    met = (
        F.when(operator == "gt", value > threshold)
        .when(operator == "ge", value >= threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "le", value <= threshold)
    )
    return F.coalesce(met, F.lit(False))


def rule_hits(
    rules: DataFrame, stations: DataFrame, m: DataFrame, rule_id: int | None = None
) -> DataFrame:
    """(rule_id, station_id, ts, pollutant, value, operator, threshold) of the rules that the
    newest reading of a station meets, from one pass over the readings.

    The newest readings become one row per station and pollutant. Rules for one station then
    join on station and pollutant, rules for all of them on the pollutant, so no rule is paired
    with a station or pollutant it does not watch.
    """
    usable = usable_rules(rules, rule_id).select(
        F.col("id").alias("rule_id"), F.col("station_id").alias("_for"),
        F.col("pollutant").alias("_watched"), "operator", "threshold")
    newest = latest_per_station(m).join(
        stations.select(F.col("id").alias("_sid")), F.col("station_id") == F.col("_sid"), "left_semi")
    values = (
        newest.select("station_id", "ts", *[F.col(c).alias(k) for k, c in FIELD_COLUMNS.items()])
        .unpivot(["station_id", "ts"], list(FIELD_COLUMNS), "pollutant", "value")
        .filter(F.col("value").isNotNull())
    )
    watched = F.col("pollutant") == F.col("_watched")
    # Six pollutants would be six tasks: the rules go to where the readings are while they are
    # counted to be few; beyond that each reading meets them in one of several parts.
    everywhere_rules = usable.filter("_for is null").drop("_for")
    if everywhere_rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        everywhere = values.join(F.broadcast(everywhere_rules), watched)
    else:
        part = F.pmod(F.xxhash64("rule_id"), F.lit(RULE_PARTS))
        spread = values.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(RULE_PARTS - 1))))
        everywhere = spread.join(
            everywhere_rules.withColumn("_rule_part", part), watched & (F.col("_part") == F.col("_rule_part")))
    single = values.join(
        usable.filter("_for is not null"), watched & (F.col("station_id") == F.col("_for")))
    met = breaks(F.col("value"), F.col("operator"), F.col("threshold"))
    found = [*EVENT_KEY, "pollutant", "value", "operator", "threshold"]
    return everywhere.filter(met).select(*found).unionByName(single.filter(met).select(*found))


def new_events(hits: DataFrame, events: DataFrame) -> DataFrame:
    """The hits that are no event yet; their count is the number of events made."""
    return hits.join(events.select(*EVENT_KEY), EVENT_KEY, "left_anti")


def record_events(
    hits: DataFrame, events: DataFrame, created_at: Column | None = None, top: int | None = None
) -> DataFrame:
    """The event table after the hits: a known event gets the new value, operator and threshold,
    a new one the next id after ``top``, the largest one, which is looked up if not given."""
    created_at = F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at
    changed = hits.select(
        *EVENT_KEY, *[F.col(c).alias(f"_{c}") for c in ("value", "operator", "threshold")],
        F.lit(True).alias("_hit"))
    updated = events.join(changed, EVENT_KEY, "left").select(*[
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        if c in ("value", "operator", "threshold") else F.col(c)
        for c in events.columns])
    top = events.agg(F.max("id")).first()[0] or 0 if top is None else top
    fresh = with_row_number(new_events(hits, events), EVENT_KEY, "_row")
    fresh = fresh.withColumn("id", F.col("_row") + top + 1).withColumn("created_at", created_at)
    return updated.unionByName(fresh.select(*events.columns))


def validate_rules(candidates: DataFrame, stations: DataFrame) -> DataFrame:
    """Adds ``reason``: why a candidate (all columns text) is turned down, null if it is not."""
    station = F.nullif(strip_blanks(F.col("station_id")), F.lit(""))
    number = station.try_cast("int")
    known = stations.select(F.col("id").alias("_known"))
    checked = candidates.withColumn("_station", number).join(
        known, F.col("_station") == F.col("_known"), "left")
    reason = (
        F.when(strip_blanks(F.coalesce("name", F.lit(""))) == "", NO_NAME)
        .when(~F.coalesce(F.lower("pollutant"), F.lit("")).isin(list(FIELD_COLUMNS)), BAD_POLLUTANT)
        .when(~F.coalesce(F.lower("operator"), F.lit("")).isin(RULE_OPERATORS), BAD_OPERATOR)
        .when(to_number(F.col("threshold")).isNull(), BAD_THRESHOLD)
        .when(station.isNotNull() & number.isNull(), BAD_STATION)
        .when(number.isNotNull() & F.col("_known").isNull(), NO_STATION)
    )
    return checked.withColumn("reason", reason).select(*candidates.columns, "reason")


def typed_rules(accepted: DataFrame, *extra: str) -> DataFrame:
    """Accepted candidates in the types of the rule table, without id and creation time."""
    enabled = F.coalesce(F.col("enabled").try_cast("boolean"), F.lit(True))
    return accepted.select(
        *extra, strip_blanks(F.col("name")).alias("name"), F.col("station_id").try_cast("int").alias("station_id"),
        F.lower("pollutant").alias("pollutant"), F.lower("operator").alias("operator"),
        to_number(F.col("threshold")).alias("threshold"), "time_window", enabled.alias("enabled"))


def change_outcomes(rules: DataFrame, changes: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """All changes with ``outcome``: ok, or the reason why not. They count in the order of ``seq``: what
    follows the deletion of a rule finds no rule.

    A change row has ``seq``, ``action`` (insert, update, delete), ``id``, the settable columns
    and a flag ``set_<column>`` for each, as a null can be a value to set. Inserts are checked as
    ``validate_rules`` does where the stations are given; else only updates and deletes are judged.
    """
    known = rules.select(F.col("id").alias("_known"))
    any_set = F.greatest(*[F.coalesce(F.col(f"set_{c}"), F.lit(False)).cast("int") for c in SETTABLE]) == 1
    update = F.col("action") == "update"
    outcome = (
        F.when(update & F.col("set_pollutant")
               & ~F.coalesce(F.lower("pollutant"), F.lit("")).isin(list(FIELD_COLUMNS)), BAD_POLLUTANT_UPDATE)
        .when(update & F.col("set_operator")
              & ~F.coalesce(F.lower("operator"), F.lit("")).isin(RULE_OPERATORS), BAD_OPERATOR_UPDATE)
        .when(update & F.col("set_threshold") & F.col("threshold").isNull(), BAD_THRESHOLD)
        .when(update & ~any_set, NO_FIELDS)
        .when(F.col("_known").isNull() | (F.col("_gone") < F.col("seq")), NO_RULE)
        .otherwise("ok")
    )
    edits = changes.filter("action in ('update', 'delete')")
    gone = edits.filter("action = 'delete'").groupBy(F.col("id").alias("_gone_id")).agg(F.min("seq").alias("_gone"))
    edits = (edits.join(known, F.col("id") == F.col("_known"), "left").join(gone, F.col("id") == F.col("_gone_id"), "left")
             .withColumn("outcome", outcome).drop("_known", "_gone", "_gone_id"))
    if stations is None:
        return edits
    texts = {c: F.col(c).cast("string").alias(c) for c in SETTABLE}
    inserts = changes.filter("action = 'insert'")
    checked = validate_rules(inserts.select("seq", *texts.values()), stations).select(
        F.col("seq").alias("_seq"), "reason")
    return edits.unionByName(inserts.join(checked, F.col("seq") == F.col("_seq")).select(
        *changes.columns, F.coalesce("reason", F.lit("ok")).alias("outcome")))


def apply_rule_changes(
    rules: DataFrame, changes: DataFrame, created_at: Column | None = None, stations: DataFrame | None = None
) -> DataFrame:
    """The rule table after the changes. Several updates of a rule count field by field, the last
    one that sets a field wins; a deleted rule is gone. Inserts that pass the checks get the next
    free ids; without the stations it is not asked whether a rule's station exists."""
    created_at = F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at
    judged = change_outcomes(rules, changes, _named_stations(changes) if stations is None else stations)
    good = judged.filter("outcome = 'ok'")
    folds = [F.bool_or(F.col("action") == "delete").alias("_deleted")]
    for c in SETTABLE:
        sets = (F.col("action") == "update") & F.coalesce(F.col(f"set_{c}"), F.lit(False))
        folds.append(F.max_by(c, F.when(sets, F.col("seq"))).alias(f"_{c}"))
        folds.append(F.bool_or(sets).alias(f"_set_{c}"))
    edits = good.filter("action != 'insert'").groupBy(F.col("id").alias("_id")).agg(*folds)
    value = {
        "name": strip_blanks(F.coalesce(F.col("_name"), F.lit(""))),
        "pollutant": F.lower("_pollutant"),
        "operator": F.lower("_operator"),
        "enabled": F.coalesce(F.col("_enabled"), F.lit(False)),
    }
    kept = (
        rules.join(edits, F.col("id") == F.col("_id"), "left")
        .filter(~F.coalesce(F.col("_deleted"), F.lit(False)))
        .select(*[
            F.when(F.col(f"_set_{c}"), value.get(c, F.col(f"_{c}"))).otherwise(F.col(c)).alias(c)
            if c in SETTABLE else F.col(c) for c in ALERT_RULES.names])
    )
    inserts = good.filter("action = 'insert'").drop("outcome")
    top = rules.agg(F.max("id")).first()[0] or 0
    fresh = (
        with_row_number(inserts, ["seq"], "_row")
        .withColumn("id", (F.col("_row") + top + 1).cast("int"))
        .withColumn("created_at", created_at)
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        .withColumns({"pollutant": F.lower("pollutant"), "operator": F.lower("operator")})
    )
    return kept.unionByName(fresh.select(*ALERT_RULES.names))


def _named_stations(changes: DataFrame) -> DataFrame:
    return changes.select(F.col("station_id").cast("int").alias("id")).filter("id is not null").distinct()


def drop_orphan_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events go with their rule."""
    return events.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
