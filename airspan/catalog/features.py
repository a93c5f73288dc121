"""Queries about feature frames, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspan.catalog.intake import _CLEAN_SQL, clean
from airspan.catalog.registry import MEASUREMENTS_SQL, VALUES, query, with_sql
from airspan.operators.lags import add_lags
from airspan.operators.fields import distinct_sorted
from airspan.operators.metrics import metrics_of, multi_output_metrics, rank_models, regression_metrics
from airspan.operators.order import first_complete_rows
from airspan.plans import features as f
from airspan.sources import sample

NAMED = ["PM2_5", "PM10", "SO2", "NO2", "O3", "CO"]
KEY = ["Estacion", "datetime"]

NAMED_SQL = "named AS (SELECT station_id AS \"Estacion\", ts AS datetime, " + ", ".join(
    f'{c} AS "{n}"' for c, n in zip(VALUES, NAMED)) + " FROM m)"
FILLED_SQL = (
    "filled1 AS (SELECT \"Estacion\", datetime, " + ", ".join(
        f'coalesce("{n}", median("{n}") OVER (PARTITION BY "Estacion")) AS "{n}"' for n in NAMED) + " FROM named),\n"
    "filled AS (SELECT \"Estacion\", datetime, " + ", ".join(
        f'coalesce("{n}", (SELECT median("{n}") FROM filled1)) AS "{n}"' for n in NAMED) + " FROM filled1)")
FRAME_SQL = (
    "timed AS (SELECT *, hour(datetime)::INTEGER AS hour, (isodow(datetime) - 1)::INTEGER AS dayofweek,"
    " month(datetime)::INTEGER AS month, (isodow(datetime) >= 6)::INTEGER AS is_weekend FROM filled),\n"
    "lagged AS (SELECT *, " + ", ".join(
        f'lag("{n}", {k}) OVER w AS "{n}_lag{k}"' for n in NAMED for k in (1, 2, 3)) + ", " + ", ".join(
        f'lead("{n}", 1) OVER w AS "{n}_next_hour"' for n in NAMED)
    + ' FROM timed WINDOW w AS (PARTITION BY "Estacion" ORDER BY datetime)),\n'
    'frame AS (SELECT * FROM lagged WHERE "CO_lag3" IS NOT NULL AND "CO_next_hour" IS NOT NULL)')
_BASE = (MEASUREMENTS_SQL, NAMED_SQL)
_FRAME = (*_BASE, FILLED_SQL, FRAME_SQL)


def frame(spark, sf_dir):
    return f.next_hour_frame(sample.named_measurements(spark, sf_dir))


@query("impute_median", with_sql("SELECT * FROM filled", *_BASE, FILLED_SQL))
def impute_median(spark, sf_dir):
    return f.fill_medians(sample.named_measurements(spark, sf_dir), "Estacion", NAMED)


@query("time_features", with_sql(
    """SELECT "Estacion", datetime, hour(datetime)::INTEGER AS hour, (isodow(datetime) - 1)::INTEGER AS dayofweek,
              month(datetime)::INTEGER AS month, (isodow(datetime) >= 6)::INTEGER AS is_weekend FROM named""", *_BASE))
def time_features(spark, sf_dir):
    rows = sample.named_measurements(spark, sf_dir).select(*KEY)
    return rows.withColumns(f.time_features(F.col("datetime")))


@query("lags_raw", with_sql(
    """SELECT "Estacion", datetime, "CO", lag("CO", 1) OVER w AS "CO_lag1", lag("CO", 2) OVER w AS "CO_lag2",
              lag("CO", 3) OVER w AS "CO_lag3", lead("CO", 1) OVER w AS "CO_next_hour"
       FROM named WINDOW w AS (PARTITION BY "Estacion" ORDER BY datetime)""", *_BASE))
def lags_raw(spark, sf_dir):
    rows = sample.named_measurements(spark, sf_dir).select(*KEY, "CO")
    return add_lags(rows, "Estacion", ["datetime"], ["CO"])


@query("lags_max_gap", with_sql(
    """SELECT "Estacion", datetime, "CO",
              CASE WHEN date_diff('second', lag(datetime, 1) OVER w, datetime) <= 7200 THEN lag("CO", 1) OVER w END AS "CO_lag1",
              CASE WHEN date_diff('second', datetime, lead(datetime, 1) OVER w) <= 7200 THEN lead("CO", 1) OVER w END AS "CO_next_hour"
       FROM named WINDOW w AS (PARTITION BY "Estacion" ORDER BY datetime)""", *_BASE))
def lags_max_gap(spark, sf_dir):
    rows = sample.named_measurements(spark, sf_dir).select(*KEY, "CO")
    return add_lags(rows, "Estacion", ["datetime"], ["CO"], lags=(1,), max_gap=7200)


@query("lags_next_hour", with_sql("SELECT * FROM frame", *_FRAME))
def lags_next_hour(spark, sf_dir):
    return frame(spark, sf_dir)


@query("frame_without_empty_columns", with_sql("SELECT * FROM frame", *_FRAME))
def frame_without_empty_columns(spark, sf_dir):
    """A pollutant that no row has a value of leaves no column behind, and costs no row."""
    return f.next_hour_frame(sample.named_measurements(spark, sf_dir).withColumn("NH3", F.lit(None).cast("double")))


@query("split_sequential", with_sql(
    """SELECT "Estacion", datetime, row_number() OVER (ORDER BY "Estacion", datetime) - 1 AS row_no,
              row_number() OVER (ORDER BY "Estacion", datetime) - 1
                  >= (SELECT count(*) - ceil(count(*) * 0.2) FROM named) AS is_test FROM named""", *_BASE))
def split_sequential(spark, sf_dir):
    return f.sequential_split(sample.named_measurements(spark, sf_dir).select(*KEY), KEY)


@query("split_by_time", with_sql(
    """SELECT "Estacion", datetime, row_number() OVER (ORDER BY datetime, "Estacion") - 1 AS row_no,
              row_number() OVER (ORDER BY datetime, "Estacion") - 1
                  >= (SELECT count(*) - ceil(count(*) * 0.2) FROM named) AS is_test FROM named""", *_BASE))
def split_by_time(spark, sf_dir):
    return f.sequential_split(sample.named_measurements(spark, sf_dir).select(*KEY), KEY[::-1])


@query("ts_folds", with_sql(
    """SELECT "Estacion", datetime, ((row_no - first_row) // size)::INTEGER AS fold FROM (
           SELECT *, n - 3 * (n // 4) AS first_row, n // 4 AS size FROM (
               SELECT "Estacion", datetime, row_number() OVER (ORDER BY "Estacion", datetime) - 1 AS row_no,
                      (SELECT count(*) FROM named) AS n FROM named))
       WHERE row_no >= first_row""", *_BASE))
def ts_folds(spark, sf_dir):
    rows = f.with_row_number(sample.named_measurements(spark, sf_dir).select(*KEY), KEY)
    bounds = f.expanding_folds(rows.count())
    fold = F.coalesce(*[
        F.when((F.col("row_no") >= s) & (F.col("row_no") < e), F.lit(i)) for i, (s, e) in enumerate(bounds)])
    return rows.select(*KEY, fold.alias("fold")).filter("fold is not null")


def scored(spark, sf_dir):
    """Two simple forecasts of each pollutant: the present value, and the mean of the lags."""
    rows = frame(spark, sf_dir)
    kinds = [
        F.struct(F.lit(n).alias("target"), F.lit(kind).alias("model"),
                 F.col(f"{n}_next_hour").alias("y"), pred.alias("pred"))
        for n in NAMED
        for kind, pred in [
            ("present", F.col(n)),
            ("lags", (F.col(f"{n}_lag1") + F.col(f"{n}_lag2") + F.col(f"{n}_lag3")) / 3)]]
    return rows.select(F.inline(F.array(*kinds)))


METRICS_SQL = "scored AS (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS target, '{kind}' AS model, "{n}_next_hour" AS y, {pred} AS pred FROM frame"""
    for n in NAMED for kind, pred in [
        ("present", f'"{n}"'), ("lags", f'("{n}_lag1" + "{n}_lag2" + "{n}_lag3") / 3')]) + """),
metrics AS (SELECT target, model, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse,
                   1 - avg((y - pred) * (y - pred)) / var_pop(y) AS r2 FROM scored GROUP BY target, model)"""


@query("metrics_eval", with_sql(
    "SELECT target, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM metrics",
    *_FRAME, METRICS_SQL))
def metrics_eval(spark, sf_dir):
    rows = regression_metrics(scored(spark, sf_dir))
    return rows.select("target", "model", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")])


@query("metrics_multi", with_sql(
    "SELECT model, round(avg(r2), 6) AS r2, round(sqrt(avg(rmse * rmse)), 6) AS rmse FROM metrics GROUP BY model",
    *_FRAME, METRICS_SQL))
def metrics_multi(spark, sf_dir):
    rows = multi_output_metrics(regression_metrics(scored(spark, sf_dir)))
    return rows.select("model", *[F.round(c, 6).alias(c) for c in ("r2", "rmse")])


@query("model_rank", with_sql(
    """SELECT target, model, row_number() OVER (PARTITION BY target ORDER BY r2 DESC, model)::INTEGER AS place
       FROM metrics""", *_FRAME, METRICS_SQL))
def model_rank(spark, sf_dir):
    return rank_models(regression_metrics(scored(spark, sf_dir))).select("target", "model", "place")


_VECTOR = ["hour", "dayofweek", "month", "is_weekend", *NAMED, *[f"{n}_lag{k}" for n in NAMED for k in (1, 2, 3)]]


@query("median_vector", with_sql(
    "SELECT " + ", ".join(f'median("{c}") AS "{c}"' for c in _VECTOR) + " FROM frame", *_FRAME))
def median_vector(spark, sf_dir):
    return f.median_vector(frame(spark, sf_dir), _VECTOR)


@query("one_hot", with_sql(
    """SELECT "Estacion", datetime, (dense_rank() OVER (ORDER BY "Estacion") - 1)::INTEGER AS slot FROM named""", *_BASE))
def one_hot(spark, sf_dir):
    """Slot 0 is the station without a flag of its own."""
    rows = sample.named_measurements(spark, sf_dir).select(*KEY)
    flagged = f.one_hot(rows, "Estacion", f.station_names(rows, "Estacion"))
    return flagged.select(*KEY, f.flag_slot(F.col("station_flags")).alias("slot"))


@query("station_codes", with_sql(
    """SELECT "Estacion", (row_number() OVER (ORDER BY "Estacion") - 1)::INTEGER AS "Estacion_Code"
       FROM (SELECT DISTINCT "Estacion" FROM clean)""", _CLEAN_SQL))
def station_codes(spark, sf_dir):
    return f.station_codes(clean(spark, sf_dir))


def clean_like(spark, sf_dir):
    """Complete rows under the names of the clean file."""
    rows = f.fill_medians(sample.named_measurements(spark, sf_dir), "Estacion", NAMED)
    return rows.select(
        F.format_string("E%05d", "Estacion").alias("Estacion"),
        F.date_format("datetime", "dd/MM/yyyy").alias("Fecha"), F.date_format("datetime", "HH:mm").alias("Hora"),
        F.col("PM2_5").alias("PM 2.5"), F.col("PM10").alias("PM 10"), "SO2", "NO2", "O3", "CO")


def multi_frame(spark, sf_dir):
    rows = clean_like(spark, sf_dir)
    return f.multi_output_frame(rows, f.station_codes(rows))


@query("multi_output_frame", with_sql(
    """SELECT printf('E%05d', "Estacion") AS "Estacion", strftime(datetime, '%d/%m/%Y') AS "Fecha",
              strftime(datetime, '%H:%M') AS "Hora", hour(datetime)::INTEGER AS "Hora_Num",
              month(datetime)::INTEGER AS "Mes", (isodow(datetime) - 1)::INTEGER AS "Dia_Semana",
              (dense_rank() OVER (ORDER BY "Estacion") - 1)::INTEGER AS "Estacion_Code",
              "PM2_5" AS "PM 2.5", "PM10" AS "PM 10", "SO2", "NO2", "O3", "CO" FROM filled""", *_BASE, FILLED_SQL))
def multi_output_frame(spark, sf_dir):
    return multi_frame(spark, sf_dir)


@query("impute_mode", with_sql(
    'SELECT "Estacion", datetime, ' + ", ".join(
        f'coalesce("{n}", (SELECT "{n}" FROM named WHERE "{n}" IS NOT NULL GROUP BY "{n}"'
        f' ORDER BY count(*) DESC, "{n}" LIMIT 1)) AS "{n}"' for n in NAMED) + " FROM named", *_BASE))
def impute_mode(spark, sf_dir):
    return f.fill_modes(sample.named_measurements(spark, sf_dir), NAMED)


@query("first_complete_rows", with_sql(
    'SELECT * FROM frame ORDER BY "Estacion", datetime LIMIT 400', *_FRAME))
def first_rows(spark, sf_dir):
    rows = frame(spark, sf_dir)
    return first_complete_rows(rows, rows.columns, KEY)


@query("random_split", with_sql(
    """SELECT "Estacion", datetime, ('0x' || substr(md5('42|' || "Estacion" || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S')), 1, 8))::BIGINT
              < (0.2 * 4294967296)::BIGINT AS is_test FROM named""", *_BASE))
def random_split(spark, sf_dir):
    rows = f.random_split(sample.named_measurements(spark, sf_dir), KEY)
    return rows.select(*KEY, "is_test")


@query("metrics_of_target", with_sql(
    "SELECT target, model, round(r2, 6) AS r2 FROM metrics WHERE target = 'CO'", *_FRAME, METRICS_SQL))
def metrics_of_target(spark, sf_dir):
    rows = metrics_of(regression_metrics(scored(spark, sf_dir)), "CO")
    return rows.select("target", "model", F.round("r2", 6).alias("r2"))


@query("station_names", with_sql('SELECT DISTINCT "Estacion" FROM named', *_BASE))
def station_names(spark, sf_dir):
    return distinct_sorted(sample.named_measurements(spark, sf_dir), "Estacion")
