"""A stream over several files gives what one batch gives."""

from pyspark.sql import functions as F

from airspan.operators.aggregate import bucket_aggregate
from airspan.operators.dedup import one_per_key
from airspan.schemas import RAW_KEY
from airspan.sinks.store import KEY, save_measurements
from airspan.sources import sample
from airspan.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"
VALUES = ["pm2_5", "pm10", "so2", "no2", "o3", "co"]


def in_files(spark, tmp_path, n=3):
    """The readings as files in time order, read one file per batch."""
    rows, folder = sample.versions(spark, SF_DIR), str(tmp_path / "in")
    spans = [("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-02")]
    for a, b in spans[:n]:
        rows.filter(f"ts >= timestamp_ntz'{a} 00:00:00' and ts < timestamp_ntz'{b} 00:00:00'").coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_intake_and_restart(spark, tmp_path):
    rows, stream = in_files(spark, tmp_path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.intake(stream, out, mark, KEY, ["event_id"]).awaitTermination()
    assert same(one_per_key(rows, KEY, ["event_id"], "first"), spark.read.parquet(out))
    # a lost checkpoint replays everything, and adds nothing
    jobs.intake(stream, out, mark + "2", KEY, ["event_id"]).awaitTermination()
    assert same(one_per_key(rows, KEY, ["event_id"], "first"), spark.read.parquet(out))


def test_upsert(spark, tmp_path):
    rows, stream = in_files(spark, tmp_path)
    out = str(tmp_path / "out")
    jobs.upsert(stream, out, str(tmp_path / "mark"), ["event_id"]).awaitTermination()
    assert same(one_per_key(rows, KEY, ["event_id"]).select(*KEY, *VALUES), spark.read.parquet(out))


def test_bounded_intake_has_each_key_once(spark, tmp_path):
    rows, stream = in_files(spark, tmp_path)
    out = str(tmp_path / "out")
    jobs.intake_within(stream.select(*KEY), out, str(tmp_path / "mark"), KEY, delay="2 hours").awaitTermination()
    assert same(rows.select(*KEY).distinct(), spark.read.parquet(out))


def test_closed_hours_equal_the_batch(spark, tmp_path):
    rows, stream = in_files(spark, tmp_path)
    out = str(tmp_path / "out")
    jobs.aggregate_to(stream, out, str(tmp_path / "mark"), agg="max", delay="1 hour").awaitTermination()
    newest = rows.agg(F.max("ts")).first()[0]
    batch = bucket_aggregate(rows, "hourly", "max").filter(
        F.col("bucket") + F.expr("interval 2 hours") <= F.lit(str(newest)).cast("timestamp_ntz"))
    assert same(batch, spark.read.parquet(out))


def test_rules_make_each_event_once(spark, tmp_path):
    _, stream = in_files(spark, tmp_path)
    rules, stations = sample.alert_rules(spark, SF_DIR), sample.stations(spark, SF_DIR)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    jobs.watch_rules(stream, rules, stations, out, mark).awaitTermination()
    first = spark.read.parquet(out).count()
    jobs.watch_rules(stream, rules, stations, out, mark + "2").awaitTermination()
    events = spark.read.parquet(out)
    assert first == events.count() == events.select("rule_id", "station_id", "ts").distinct().count() > 0
    assert events.select("id").distinct().count() == first


def test_late_reading_raises_nothing(spark, tmp_path):
    schema = "station_id int, ts timestamp_ntz, pm2_5 double, pm10 double, so2 double, no2 double, o3 double, co double, event_id long"
    def rows(day, co):
        return spark.sql(f"""select 1, timestamp_ntz'2024-01-{day} 00:00:00', null, null, null, null, null, {co}D, 1L""").toDF(
            *[c.split()[0] for c in schema.split(", ")]).select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    save_measurements(rows("05", 1.0), str(tmp_path / "table"), ["event_id"])
    save_measurements(rows("03", 9.0), str(tmp_path / "table"), ["event_id"])
    rows("03", 9.0).write.parquet(str(tmp_path / "in"))
    rules = spark.sql("select 1 id, 'r' name, cast(null as int) station_id, 'co' pollutant, 'gt' operator, 5D threshold, '1h' time_window, true enabled, timestamp_ntz'2024-01-01 00:00:00' created_at")
    stations = spark.createDataFrame([(1, "A")], "id int, name string")
    for name, newest, n in (("with", str(tmp_path / "newest"), 0), ("without", None, 1)):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / name)
        jobs.watch_rules(stream, rules, stations, out, out + "-mark", newest=newest, table=str(tmp_path / "table")).awaitTermination()
        assert spark.read.parquet(out).count() == n
    # the reading of an event sent anew: the event gets the value and keeps its id
    jobs.check_rules(rows("03", 7.0).select(*jobs.COLUMNS), rules, stations, str(tmp_path / "without"))
    assert [(r["id"], r["value"]) for r in jobs.recorded_events(spark, str(tmp_path / "without")).collect()] == [(1, 7.0)]
    jobs.check_rules(rows("03", 7.0).select(*jobs.COLUMNS), rules, stations, str(tmp_path / "without"))
    assert spark.read.parquet(str(tmp_path / "without")).count() == 2


def test_newest_readings_have_the_last_word_and_few_versions(spark, tmp_path):
    path = str(tmp_path / "newest")
    row = lambda station, day, co: spark.sql(
        f"select {station} station_id, timestamp_ntz'2024-01-{day} 00:00:00' ts, null pm2_5, null pm10, null so2, null no2, null o3, {co}D co").select(
        *[F.col(c).cast("double") if c in VALUES else F.col(c) for c in jobs.COLUMNS])
    for station, day, co in ((1, "02", 1.0), (2, "01", 2.0), (1, "01", 3.0), (1, "02", 4.0)):
        seen = jobs.keep_newest(row(station, day, co), path).collect()
        assert [r["station_id"] for r in seen] == [station]
    stored = spark.read.parquet(path)
    last = stored.filter(f"version = {stored.agg(F.max('version')).first()[0]}").collect()
    assert sorted((r["station_id"], r["co"]) for r in last) == [(1, 4.0), (2, 2.0)]
    assert stored.select("version").distinct().count() == 2


def test_appends_read_only_the_folders_of_the_batch(spark, tmp_path):
    from airspan.sinks.writers import append_new
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("d1", 1), ("d2", 2), ("", 3), (None, 4)], "day string, k int")
    append_new(df, path, ["day", "k"], ["k"], "day")
    append_new(df.limit(1).unionByName(spark.createDataFrame([("d1", 9)], df.schema)), path, ["day", "k"], ["k"], "day")
    append_new(df, path, ["day", "k"], ["k"], "day")
    assert sorted((r["day"] or "", r["k"]) for r in spark.read.parquet(path).collect()) == [("", 3), ("", 4), ("d1", 1), ("d1", 9), ("d2", 2)]
    plan = spark.read.schema(df.schema).parquet(path).filter(F.col("day").isin(["d1"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_late_rows_are_counted(spark, tmp_path):
    _, stream = in_files(spark, tmp_path)
    query = jobs.intake_within(stream.select(*KEY), str(tmp_path / "out"), str(tmp_path / "mark"), KEY, delay="1 hour")
    query.awaitTermination()
    assert jobs.late_rows(query) == 0


def test_csv_files_as_stream(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    head = 'Estacion,Fecha,Hora,"PM 2,5",PM 10,SO2,NO2,O3,CO\n'
    (folder / "a.csv").write_text(head + 'A,01/01/2024,01:00,"1,5",,,,,\nA,01/01/2024,01:00,2,,,,,\n')
    (folder / "b.csv").write_text(head + "A,01/01/2024,01:00,3,,,,,\nB,01/01/2024,01:00,4,,,,,\n")
    stream = jobs.raw_files(spark, str(folder))
    jobs.intake(stream, str(tmp_path / "out"), str(tmp_path / "mark"), RAW_KEY, ["PM 2,5"], "Fecha").awaitTermination()
    assert sorted(r["Estacion"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]
