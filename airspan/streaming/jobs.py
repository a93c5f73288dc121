"""Intake, loading, alerts and aggregates as streams.

Each stream takes what is there and stops (``availableNow``), or goes on when given a trigger of
its own. All are exact after a restart: replayed batches add nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from airspan.operators.aggregate import AGGREGATES
from airspan.operators.dedup import one_per_key
from airspan.operators.latest import latest_per_station
from airspan.plans import alerts
from airspan.schemas import ALERT_EVENTS, RAW_COLUMNS, RAW_KEY, TABLE_POLLUTANTS
from airspan.session import durable, remove
from airspan.sinks.store import COLUMNS, KEY, save_measurements
from airspan.sinks.writers import append_new, stored_or_none
from airspan.sources.pages import parse_pages

NOW = {"availableNow": True}


def _each_batch(
    stream: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    def run(batch: DataFrame, _: int) -> None:
        work(batch)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or NOW))
    return writer.foreachBatch(run).start()


def intake(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence,
    partition_by: str | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Appends rows with keys never seen before, over all history; the first one wins."""
    return _each_batch(
        stream, lambda batch: append_new(batch, path, keys, order, partition_by), checkpoint, trigger)


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """New raw CSV files as a stream. A file whose header is not the expected one fails instead
    of being read by position."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
    return spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).csv(folder)


def intake_pages(
    stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = "Fecha",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Newest row of each new page (page_id, html), kept if its station, date and time are new."""
    def work(batch: DataFrame) -> None:
        rows = durable(parse_pages(batch, first_only=True).drop("row_no"))
        append_new(rows, path, RAW_KEY, ["page_id"], partition_by)
    return _each_batch(stream.select("page_id", "html"), work, checkpoint, trigger)


def intake_within(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str = "ts",
    *, delay: str, trigger: dict | None = None,
) -> StreamingQuery:
    """As ``intake`` with bounded state: a key is remembered until the watermark has passed it.

    Rows later than the delay are dropped, as whether their key is known cannot be told any more;
    how many is in ``late_rows``. Watermarks need an instant, so the wall time is read in the session's
    zone (UTC).
    """
    rows = (
        stream.withColumn("_at", F.col(ts).cast("timestamp"))
        .withWatermark("_at", delay)
        .dropDuplicatesWithinWatermark(list(keys))
        .drop("_at")
    )
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or NOW))
        .format("parquet").option("path", path).outputMode("append").start()
    )


def upsert(
    stream: DataFrame, path: str, checkpoint: str, order: Sequence[str], trigger: dict | None = None
) -> StreamingQuery:
    """Upserts every batch into the measurement table at ``path``."""
    return _each_batch(
        stream, lambda batch: save_measurements(batch, path, list(order)), checkpoint, trigger)


def load_and_watch(
    stream: DataFrame, rules: DataFrame, stations: DataFrame, table: str, events: str, newest: str, checkpoint: str,
    order: Sequence[str], trigger: dict | None = None,
) -> StreamingQuery:
    """Upserts every batch into the measurement table, then checks the rules on the same batch. A
    stream over the table's files would see each day again whenever it is rewritten."""
    def work(batch: DataFrame) -> None:
        rows = durable(one_per_key(batch, KEY, list(order)).select(*COLUMNS))
        save_measurements(batch, table, list(order))
        check_rules(rows, rules, stations, events, newest)
    return _each_batch(stream, work, checkpoint, trigger)


def watch_rules(
    stream: DataFrame, rules: DataFrame, stations: DataFrame, path: str, checkpoint: str,
    trigger: dict | None = None, newest: str | None = None, table: str | None = None,
) -> StreamingQuery:
    """Checks the rules on the newest reading of every station in a batch, as ``check_rules``."""
    return _each_batch(
        stream, lambda batch: check_rules(batch.select(*COLUMNS), rules, stations, path, newest, table), checkpoint, trigger)


def check_rules(
    rows: DataFrame, rules: DataFrame, stations: DataFrame, events: str, newest: str | None = None,
    table: str | None = None,
) -> None:
    """Records the events of the rules that the newest readings meet, once per rule, station and
    time; a known event gets the new value, operator and threshold. Doing it again changes nothing.

    ``newest`` is a table of the newest reading of each station, which is kept up to date here (the first
    time from the measurement table ``table``). With it a late reading does not count as the newest,
    and a batch costs what its stations cost, however long the history is.
    """
    spark = rows.sparkSession
    if newest is not None:
        rows = keep_newest(rows, newest, table)
    hits = durable(alerts.rule_hits(rules, stations, rows))
    log = stored_or_none(spark, events)
    if log is None:
        log = spark.createDataFrame([], T.StructType([*ALERT_EVENTS.fields, T.StructField("change", T.LongType())]))
    top, last = log.agg(F.max("id"), F.max("change")).first()
    known = log.join(hits.select(*alerts.EVENT_KEY), alerts.EVENT_KEY, "left_semi")
    recorded = alerts.record_events(hits, one_per_key(known, alerts.EVENT_KEY, ["change"]).drop("change"), top=top or 0)
    changed = recorded.join(known.select(*ALERT_EVENTS.names), ALERT_EVENTS.names, "left_anti")
    changed.select(*ALERT_EVENTS.names, F.lit((last or 0) + 1).cast("long").alias("change")).write.mode("append").parquet(events)


def recorded_events(spark: SparkSession, events: str) -> DataFrame:
    """The events in their last state. The folder holds a row for each change of an event."""
    return one_per_key(spark.read.parquet(events), alerts.EVENT_KEY, ["change"]).select(*ALERT_EVENTS.names)


def keep_newest(rows: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Brings the newest readings at ``path`` up to date with the rows, and returns those of the stations in
    the rows. Every call writes a version of its own and then lets the one before the last go, so
    a lost driver leaves a whole version behind."""
    spark = rows.sparkSession
    stored = stored_or_none(spark, path)
    if stored is not None:
        version = stored.agg(F.max("version")).first()[0]
        old = stored.filter(F.col("version") == version).select(*COLUMNS)
    else:
        version = -1
        measured = stored_or_none(spark, table) if table is not None else None
        old = rows.limit(0) if measured is None else latest_per_station(measured.select(*COLUMNS))
    batch = durable(latest_per_station(rows))
    values = F.struct(*[c for c in COLUMNS if c != "station_id"])
    both = old.select("station_id", values.alias("old")).join(batch.select("station_id", values.alias("new")), "station_id", "full")
    later = F.col("old").isNull() | (F.col("new.ts") >= F.col("old.ts"))
    picked = F.when(F.col("new").isNotNull() & later, F.col("new")).otherwise(F.col("old"))
    merged = durable(both.select("station_id", picked.alias("r"), F.col("new").isNotNull().alias("in_batch")).select(
        "station_id", "r.*", "in_batch"))
    merged.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/version={version + 1}")
    remove(spark, f"{path}/version={version - 1}")
    return merged.filter("in_batch").select(*COLUMNS)


def bucket_stream(
    stream: DataFrame, granularity: str = "hourly", agg: str = "avg", *, delay: str,
    columns: Sequence[str] = TABLE_POLLUTANTS,
) -> DataFrame:
    """(station_id, bucket, values) of the hours or days that the watermark has closed, ``delay`` after
    the newest reading; what comes later is dropped and counted in ``late_rows``. Wall times
    go through the session's zone (UTC) and back, as watermarks need an instant."""
    width = {"hourly": "1 hour", "daily": "1 day"}[granularity]
    rows = stream.select("station_id", *columns, F.col("ts").cast("timestamp").alias("_at")).withWatermark("_at", delay)
    grouped = rows.groupBy("station_id", F.window("_at", width).alias("_window")).agg(
        *[AGGREGATES[agg](c).alias(c) for c in columns])
    bucket = F.col("_window.start").cast("timestamp_ntz").alias("bucket")
    return grouped.select("station_id", bucket, *columns)


def aggregate_to(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **how
) -> StreamingQuery:
    """Appends closed buckets to a parquet table."""
    return (
        bucket_stream(stream, **how).writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or NOW)).format("parquet").option("path", path).outputMode("append").start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them and were dropped, over the progress kept."""
    return sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])
