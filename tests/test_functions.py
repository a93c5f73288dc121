"""Scalar expressions on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from airspan.functions import numbers, texts, times
from airspan.operators.order import page_bounds


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("c"))).collect()]


def test_clean_number(spark):
    cases = {
        "1,929.70": 1929.7, "2.723.37": 2723.37, "'  15,32 '": 15.32, '"7"': 7.0, "-3,5": -3.5,
        "1,234,567": 1.234567, "1,234,567.89": None, "": None, "  ": None, "s/d": None, "nan": None, "1d": None,
        "1.0f": None, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "12": 12.0, "1,5,2": None, "1.2.3.4": 123.4,
        "2,723.37": 2723.37, None: None, "inf": float("inf"), " 15,3 ": 15.3, "1,9x": None,
    }
    assert column(spark, list(cases), numbers.clean_number) == list(cases.values())


def test_clean_number_compat_loses_a_part(spark):
    got = column(spark, ["2.723.37", "1.2.3.4", "15,32"], lambda c: numbers.clean_number(c, compat=True))
    assert got == [2.37, 12.4, 15.32]


def test_comma_rules(spark):
    texts_in = ["15,32", "2,723.37", "-1,5", "a,b", "1,2,3", ",", "12"]
    assert column(spark, texts_in, numbers.commas_to_dots_if_digits) == [
        "15.32", "2.723.37", "-1.5", "a,b", "1.2.3", ",", "12"]
    assert column(spark, texts_in, numbers.commas_to_dots_if_number) == [
        "15.32", "2,723.37", "-1.5", "a,b", "1,2,3", ",", "12"]


def test_negative_and_blank(spark):
    assert column(spark, [-1.0, 0.0, 2.5, None], numbers.negative_to_null, "double") == [None, 0.0, 2.5, None]
    assert column(spark, [" ", "", "x "], numbers.blank_to_null) == [None, None, "x"]


def test_value_text_follows_the_exact_value(spark):
    values = [12.35, 12.25, 99.96, 100.5, 1.005, 0.125, 150.49, 10.0, 9.999, None, -12.25, 0.0]
    assert column(spark, values, texts.value_text, "double") == [
        "12.3", "12.3", "100.0", "101", "1.00", "0.13", "150", "10.0", "10.00", None, "-12.3", "0.00"]


def test_target_label(spark):
    assert column(spark, ["PM2_5_next_hour", "PM10_next_hour", "CO_next_hour"], texts.target_label) == [
        "PM 2.5", "PM 10", "CO"]


def test_alert_sentence_fallbacks(spark):
    df = spark.createDataFrame([
        (1, "co", 12.0, "A", "R"), (2, "co", 12.0, None, "R"), (3, None, None, "A", "R"),
        (4, "", None, "", "R"), (5, None, None, None, None)], "i int, p string, v double, s string, r string")
    got = df.orderBy("i").select(texts.alert_sentence(*[F.col(c) for c in "pvsr"])).collect()
    assert [r[0] for r in got] == [
        "CO alcanzó 12.0 en A.", "CO alcanzó 12.0.", "La regla R se activó en A.", "La regla R se activó.",
        "Se registró un evento de alerta."]


def test_times(spark):
    assert column(spark, ["08:00", "8", "x:1", "", None, " 7:05"], times.hour_of_text) == [8, 8, None, None, None, 7]
    dates = column(spark, ["31/01/2024", "1/2/2024", "30/02/2024", "2024-01-01"], times.date_of_text)
    assert [str(d) if d else None for d in dates] == ["2024-01-31", "2024-02-01", None, None]
    df = spark.createDataFrame([(" 05/02/2024 ", "13:00"), ("05/02/2024", "25:00")], "d string, t string")
    got = [r[0] for r in df.select(times.reading_time(F.col("d"), F.col("t"))).collect()]
    assert got == [datetime(2024, 2, 5, 13), None]
    with pytest.raises(Exception):
        df.select(times.reading_time(F.col("d"), F.col("t"), strict=True)).collect()


def test_bounds_and_zones():
    assert times.parse_bound("2024-01-01T05:00:00Z") == datetime(2024, 1, 1)
    assert times.parse_bound("2024-01-01T00:00:00.7") == datetime(2024, 1, 1)
    assert times.parse_bound("") is None and times.parse_bound(None) is None
    with pytest.raises(ValueError):
        times.parse_bound("yesterday")
    assert times.pick_zone("Nowhere/City") == "America/Lima" and times.pick_zone("Asia/Tokyo") == "Asia/Tokyo"


def test_iso_time_with_daylight_saving(spark):
    df = spark.sql("select timestamp_ntz'2024-07-01 12:00:00.5' t")
    assert df.select(times.iso_time(F.col("t"), "America/New_York")).first()[0] == "2024-07-01T13:00:00.500000-04:00"
    assert df.select(times.iso_time(F.to_date("t"))).first()[0] == "2024-07-01T00:00:00-05:00"


def test_page_bounds():
    assert page_bounds(0, -5) == (1, 0)
    assert page_bounds(5000, "7") == (1000, 7)
    assert page_bounds("abc", None) == (100, 0)


def test_unit_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0, 4.0), (9.0, 0.0, 4.0), (1.0, 1.0, 1.0), (None, 0.0, 1.0)], "v double, a double, b double")
    got = [r[0] for r in df.select(numbers.unit_ratio(F.col("v"), F.col("a"), F.col("b"))).collect()]
    assert got == [0.25, 1.0, 0.0, None]
