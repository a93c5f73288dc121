"""Feature frames, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from airspan.functions.times import date_of_text, hour_of_text, reading_time, weekday, weekend_flag
from airspan.operators.lags import add_lags
from airspan.operators.median import group_median
from airspan.operators.order import with_row_number
from airspan.operators.sizing import GROUP_ROWS, broadcast_if_small
from airspan.schemas import CLEAN_POLLUTANTS, RAW_KEY, name_col
from airspan.session import durable

# Column names of the feature frames.
NEXT_HOUR_NAMES = {"PM 2.5": "PM2_5", "PM 10": "PM10"}
BASE_COLUMNS = ["Estacion", "Fecha", "Hora", "datetime"]
TIME_FEATURES = ["hour", "dayofweek", "month", "is_weekend"]
TARGET_ENDING = "_next_hour"
MULTI_FEATURES = ["Hora_Num", "Mes", "Dia_Semana", "Estacion_Code"]
MULTI_TARGETS = CLEAN_POLLUTANTS


@dataclass(frozen=True)
class Profile:
    """What one pass of counts tells about the readings."""

    largest_station: int
    filled: list[str]
    without_median: list[str]


def profile(df: DataFrame, station: str, columns: Sequence[str]) -> Profile:
    """Rows of the largest station, columns that hold any value, and those of them that some
    station lacks altogether. One scan; one row per station reaches the second aggregate."""
    per_station = df.groupBy(station).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(name_col(c))).alias(f"_n{i}") for i, c in enumerate(columns)])
    found = per_station.agg(
        F.max("_rows").alias("_rows"),
        *[F.sum(f"_n{i}").alias(f"_sum{i}") for i in range(len(columns))],
        *[F.min(f"_n{i}").alias(f"_min{i}") for i in range(len(columns))]).first()
    filled = [c for i, c in enumerate(columns) if found[f"_sum{i}"]]
    lacking = [c for i, c in enumerate(columns) if found[f"_sum{i}"] and not found[f"_min{i}"]]
    return Profile(found["_rows"] or 0, filled, lacking)


def fill_medians(
    df: DataFrame, station: str, columns: Sequence[str], group_rows: int = GROUP_ROWS,
    known: Profile | None = None,
) -> DataFrame:
    """Nulls become the station's median; what is still null, the median of all rows after that."""
    known = known or profile(df, station, columns)
    medians = group_median(df, [station], columns, group_rows, known.largest_station)
    medians = durable(medians.select(
        F.col(station).alias("_station"), *[F.col(c).alias(f"_{c}") for c in columns]))
    filled = df.join(
        broadcast_if_small(medians), F.col(station).eqNullSafe(F.col("_station")), "left",
    ).select(*[
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])
    lacking = [c for c in known.without_median if c in columns]
    if not lacking:
        return filled
    overall = group_median(filled, [], lacking, group_rows)
    packed = overall.agg(F.struct(*[F.max(c).alias(c) for c in lacking])).scalar()
    return filled.withColumn("_overall", packed).select(*[
        F.coalesce(F.col(c), F.col(f"_overall.{c}")).alias(c) if c in lacking else F.col(c)
        for c in df.columns])


def time_features(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts), "dayofweek": weekday(ts), "month": F.month(ts),
        "is_weekend": weekend_flag(ts),
    }


def next_hour_frame(
    readings: DataFrame, station: str = "Estacion", ts: str = "datetime", order: Sequence[str] = (),
    max_gap: int | None = None, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Readings with filled gaps, time features, lags and next values, complete rows only.

    Every column that is not station, time, date text or a sort column counts as a pollutant;
    those without any value are left out.
    """
    base = [c for c in readings.columns if c in {*BASE_COLUMNS, station, ts, *order}]
    known = profile(readings, station, [c for c in readings.columns if c not in base])
    rows = readings.select(*base, *known.filled)
    rows = fill_medians(rows, station, known.filled, group_rows, known)
    rows = add_lags(
        rows.withColumns(time_features(F.col(ts))), station, [ts, *order], known.filled,
        max_gap=max_gap, group_rows=group_rows, largest=known.largest_station)
    made = [c for c in rows.columns if c.endswith(TARGET_ENDING) or "_lag" in c]
    return rows.dropna(how="any", subset=made)


def next_hour_from_clean(clean: DataFrame, max_gap: int | None = None) -> DataFrame:
    """From cleaned files. A time that cannot be read is an error here."""
    rows = clean.withColumnsRenamed(NEXT_HOUR_NAMES)
    rows = rows.withColumn("datetime", reading_time(F.col("Fecha"), F.col("Hora"), strict=True))
    return next_hour_frame(rows, max_gap=max_gap)


def target_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.endswith(TARGET_ENDING)]


def feature_columns(frame: DataFrame, base: Sequence[str] = BASE_COLUMNS) -> list[str]:
    """All but base columns, row numbers and targets."""
    skipped = {*base, *target_columns(frame), "station_id", "ts", "row_no"}
    return [c for c in frame.columns if c not in skipped]


def station_names(frame: DataFrame, station: str) -> list[str]:
    """Distinct names in order: the labels of the one-hot vector. They are part of the model, so
    the driver has to hold them as it does the labels of any indexer."""
    return [r[0] for r in frame.select(station).distinct().orderBy(station).collect()]


def one_hot(frame: DataFrame, station: str, names: Sequence[str], output: str = "station_flags") -> DataFrame:
    """Sparse 0/1 vector over the names without the first; an unknown name is all zeros."""
    if len(names) < 2:
        return frame
    labels = frame.withColumn("_names", F.array(F.coalesce(F.col(station).cast("string"), F.lit(""))))
    model = CountVectorizerModel.from_vocabulary(
        [str(n) for n in names[1:]], inputCol="_names", outputCol=output)
    return model.transform(labels).drop("_names")


def flag_slot(flags: Column) -> Column:
    """The place, from 1, of the flag that is set; 0 without one. Read from the sparse vector as it is stored: written out,
    a row would have as many numbers as there are names."""
    return F.coalesce(F.get(F.unwrap_udt(flags)["indices"], F.lit(0)) + 1, F.lit(0))


def multi_output_frame(clean: DataFrame, codes: DataFrame) -> DataFrame:
    """Hour, month, weekday and station code with the six readings, complete rows only."""
    date = date_of_text(F.col("Fecha"))
    rows = clean.join(broadcast_if_small(codes), "Estacion", "left").select(
        *RAW_KEY,
        hour_of_text(F.col("Hora")).alias("Hora_Num"), F.month(date).alias("Mes"),
        F.weekday(date).alias("Dia_Semana"), "Estacion_Code",
        *[F.col(name_col(c)) for c in MULTI_TARGETS])
    return drop_incomplete(rows, MULTI_FEATURES + MULTI_TARGETS)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=[name_col(c) for c in columns])


def station_codes(clean: DataFrame) -> DataFrame:
    """(Estacion, Estacion_Code): 0, 1, ... in name order, which is that of first appearance in
    the sorted clean file."""
    names = with_row_number(clean.select("Estacion").distinct(), ["Estacion"], "_row")
    return names.select("Estacion", F.col("_row").cast("int").alias("Estacion_Code"))


def fill_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the most frequent value of the column, the smallest on a tie. Equal values
    are counted before anything meets in one task."""
    flat = df.select(*[F.col(name_col(c)).cast("double").alias(c) for c in columns])
    counts = flat.unpivot([], [name_col(c) for c in columns], "_what", "_value") \
        .filter("_value is not null").groupBy("_what", "_value").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("_what").agg(F.max_by("_value", F.struct("_n", -F.col("_value"))).alias("_mode"))
    modes = {r["_what"]: r["_mode"] for r in best.collect()}
    return df.fillna({c: modes[c] for c in columns if c in modes})


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``. Drawn from the md5 of the seed and the row's key as text, so a row run again on
    another executor, in another order or by another engine, always lands on the same side."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(name_col(k)).cast("string") for k in keys])
    drawn = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", drawn < int(test_share * 2**32))


def sequential_split(df: DataFrame, order: Sequence[str], test_share: float = 0.2) -> DataFrame:
    """Adds ``row_no`` in the given order and ``is_test`` for the last part of the rows, whose
    size is rounded up."""
    numbered = with_row_number(df, order, "row_no")
    total = numbered.count()
    n_test = -int(-total * test_share // 1)
    return numbered.withColumn("is_test", F.col("row_no") >= total - n_test)


def expanding_folds(n_rows: int, wanted: int = 3) -> list[tuple[int, int]]:
    """(start, end) of each test fold by row number; training is all rows before the start.
    No folds when fewer than two fit."""
    n = min(wanted, n_rows - 1)
    if n < 2:
        return []
    size = n_rows // (n + 1)
    first = n_rows - n * size
    return [(first + i * size, first + (i + 1) * size) for i in range(n)]


def contiguous_folds(n_rows: int, n: int = 5) -> list[tuple[int, int]]:
    """(start, end) of ``n`` test folds that cover all rows, the first ones a row longer."""
    size, longer = divmod(n_rows, n)
    ends = [(i + 1) * size + min(i + 1, longer) for i in range(n)]
    return list(zip([0, *ends[:-1]], ends))


def median_vector(frame: DataFrame, columns: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row with the median of each column."""
    return group_median(frame, [], columns, group_rows)
