"""Cleaning, loading and appending on small files."""

import pytest
from pyspark.sql import functions as F

from airspan.operators.fields import conform, rename, require_columns
from airspan.plans import measurements as q
from airspan.plans.cleaning import clean_readings, sorted_clean
from airspan.plans.loading import load_into
from airspan.schemas import RAW_COLUMNS
from airspan.sinks.store import assign_ids
from airspan.sinks.writers import append_new, write_clean
from airspan.sources.readers import read_clean, read_metrics, read_raw, read_scoring_rows

HEADER = 'Estacion,Fecha,Hora,"PM 2,5",PM 10,SO2,NO2,O3,CO\n'


def raw(spark, rows):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        ", ".join(f"`{c}` string" for c in RAW_COLUMNS) + ", _seq int")


def cleaned(spark, rows, **how):
    return [tuple(r) for r in sorted_clean(clean_readings(raw(spark, rows), **how)).collect()]


def test_later_empty_row_removes_an_earlier_good_one(spark):
    assert cleaned(spark, [
        ("A", "01/01/2024", "01:00", "5", "", "", "", "", ""),
        ("A", "01/01/2024", "01:00", "", "", "", "", "", ""),
    ]) == []


def test_row_of_only_negatives_stays_without_values(spark):
    assert cleaned(spark, [("A", "01/01/2024", "01:00", "-5", "", "", "", "", "-1")]) == [
        ("A", "01/01/2024", "01:00", None, None, None, None, None, None)]


def test_clean_order_is_by_text(spark):
    got = cleaned(spark, [
        ("B", "02/01/2024", "01:00", "1", "", "", "", "", ""),
        (" 'A' ", "10/01/2024", "01:00", "2", "", "", "", "", ""),
        ("A", "02/02/2024", "01:00", "3", "", "", "", "", "")])
    assert [(r[0], r[1]) for r in got] == [("A", "02/02/2024"), ("A", "10/01/2024"), ("B", "02/01/2024")]


def test_both_spellings_are_one_column(spark):
    df = spark.createDataFrame([("1", ""), ("2", "3")], "`PM 2,5` string, `PM 2.5` string")
    assert [r[0] for r in rename(df, {"PM 2,5": "PM 2.5"}).collect()] == ["1", "3"]


def test_conform_adds_and_keeps(spark):
    df = conform(spark.createDataFrame([("x", "y")], "b string, extra string"), ["a", "b"])
    assert df.columns == ["a", "b", "extra"] and tuple(df.first()) == ("", "x", "y")
    with pytest.raises(ValueError):
        require_columns(df, ["z"])


def test_read_raw_strips_the_mark_and_keeps_file_order(spark, tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text(
        HEADER + 'A,01/01/2024,01:00,"1,929.70",2.723.37,,,,\nA,01/01/2024,01:00,7,,,,,\n', encoding="utf-8-sig")
    rows = read_raw(spark, str(file), with_order=True)
    assert rows.columns[:4] == ["Estacion", "Fecha", "Hora", "PM 2,5"]
    assert [r["PM 2.5"] for r in clean_readings(rows).collect()] == [7.0]


def test_clean_files_round_trip(spark, tmp_path):
    rows = clean_readings(raw(spark, [("A", "01/01/2024", "01:00", "5,5", "", "", "", "", "2")]))
    write_clean(rows, str(tmp_path / "clean"), "csv")
    got = read_clean(spark, str(tmp_path / "clean")).first()
    assert got["PM 2.5"] == 5.5 and got["CO"] == 2.0 and got["O3"] is None


def test_loading_again_changes_nothing(spark, tmp_path):
    rows = clean_readings(raw(spark, [
        ("Ñaña", "01/01/2024", "01:00", "5", "", "", "", "", ""),
        ("nana", "01/01/2024", "02:00", "6", "", "", "", "", ""),
        ("B", "31/01/2024", "02:00", "7", "", "", "", "", "1"),
        ("B", "bad", "02:00", "8", "", "", "", "", ""),
        ("  ", "31/01/2024", "02:00", "9", "", "", "", "", ""),
    ])).withColumn("_seq", F.lit(0))
    tables = []
    for _ in range(2):
        load_into(spark, rows, str(tmp_path))
        tables.append([
            sorted(map(str, spark.read.parquet(str(tmp_path / t)).collect())) for t in ("stations", "measurements")])
    assert tables[0] == tables[1]
    assert len(tables[0][0]) == 2 and len(tables[0][1]) == 3


def test_upsert_replaces_by_null_and_leaves_other_days(spark, tmp_path):
    first = clean_readings(raw(spark, [
        ("A", "01/01/2024", "01:00", "5", "4", "", "", "", ""),
        ("A", "02/01/2024", "01:00", "6", "", "", "", "", "")])).withColumn("_seq", F.lit(0))
    later = clean_readings(raw(spark, [("A", "01/01/2024", "01:00", "9", "", "", "", "", "")])).withColumn("_seq", F.lit(0))
    load_into(spark, first, str(tmp_path))
    load_into(spark, later, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "measurements")).orderBy("ts").collect()
    assert [(r["pm2_5"], r["pm10"]) for r in got] == [(9.0, None), (6.0, None)]


def test_append_new_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([("A", "d", 1, "x"), ("A", "d", 2, "y"), ("A", "e", 3, "z")], "s string, f string, n int, v string")
    for by in (None, "f"):
        path = str(tmp_path / f"t{by}")
        for _ in range(2):
            append_new(rows, path, ["s", "f"], ["n"], by)
        assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == ["x", "z"]


def test_append_new_with_odd_partition_texts(spark, tmp_path):
    rows = spark.createDataFrame([("A", "01", 1), ("A", "1", 2), ("A", "", 3), ("A", None, 4), ("A", "2024-01-01", 5)], "s string, f string, n int")
    for _ in range(2):
        append_new(rows, str(tmp_path / "t"), ["s", "f"], ["n"], "f")
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3, 5]


def test_ids_ignore_accents_and_case(spark):
    stations = spark.createDataFrame([(4, "Ate")], "id int, name string")
    names = spark.createDataFrame([("ÁTE",), ("Puente",), ("puente ",), ("",), (None,)], "name string")
    got = assign_ids(names, stations).collect()
    assert sorted((r["id"], r["name"]) for r in got)[0] == (4, "Ate") and sorted(r["id"] for r in got) == [4, 5]


def tables(spark):
    stations = spark.createDataFrame([(1, "Áte"), (2, "50%_x"), (3, "Empty")], "id int, name string")
    m = spark.sql("""select * from values
        (1, timestamp_ntz'2024-01-01 01:00:00', 1D, 2D, 3D, 4D, 5D, 6D),
        (1, timestamp_ntz'2024-01-01 02:00:00', null, 2D, 3D, 4D, 5D, 7D),
        (2, timestamp_ntz'2024-01-01 03:00:00', 9D, 2D, 3D, 4D, 5D, 8D)
        as t(station_id, ts, pm2_5, pm10, so2, no2, o3, co)""")
    return stations, m


def test_name_search_is_plain_text(spark):
    stations, _ = tables(spark)
    assert [r["name"] for r in q.list_stations(stations, "%").collect()] == ["50%_x"]
    assert [r["name"] for r in q.list_stations(stations, "ATE").collect()] == ["Áte"]
    assert q.list_stations(stations, "zzz").count() == 0


def test_latest_null_counts_and_missing_station(spark):
    stations, m = tables(spark)
    row = q.station_latest(stations, m, 1).first()
    assert row["pm25"] is None and row["co"] == 7.0 and row["ts"] == "2024-01-01T02:00:00-05:00"
    assert q.station_latest(stations, m, 3).first()["ts"] is None
    with pytest.raises(LookupError):
        q.station_latest(stations, m, 99)


def test_bad_parameters_raise(spark):
    stations, m = tables(spark)
    with pytest.raises(ValueError):
        q.measurements_page(stations, m, end="not a date")
    with pytest.raises(ValueError):
        q.aggregate(m, "hourly", [])
    with pytest.raises(ValueError):
        q.aggregate(m, "hourly", [1], "mode")


def test_export_csv(spark, tmp_path):
    stations, m = tables(spark)
    q.export_csv(stations, m, str(tmp_path / "out"), order="desc", fields="co")
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.columns == ["station_name", "ts", "pm25", "pm10", "so2", "no2", "o3", "co"]
    assert [r["co"] for r in got.collect()] == ["8.0", "7.0", "6.0"] and got.first()["pm25"] is None


def test_metrics_and_scoring_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("target,modelo,mae,rmse,r2\nPM2_5_next_hour,rf,3.0,4.9,0.7\n")
    row = read_metrics(spark, str(tmp_path / "m.csv")).first()
    assert (row["target_label"], row["model_label"], row["r2"]) == ("PM 2.5", "RF", 0.7)
    (tmp_path / "s.csv").write_text("Hora_Num,PM 10\n3,1.5\n")
    assert tuple(read_scoring_rows(spark, str(tmp_path / "s.csv"), ["Hora_Num", "PM 10"]).first()) == (3.0, 1.5)
    with pytest.raises(ValueError):
        read_scoring_rows(spark, str(tmp_path / "s.csv"), ["Mes"])
