"""Raw reading files to clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airspan.functions.numbers import clean_number, negative_to_null, strip_quotes
from airspan.operators.dedup import one_per_key
from airspan.operators.fields import conform, drop_empty_rows, rename
from airspan.operators.order import with_row_number
from airspan.schemas import CLEAN_COLUMNS, CLEAN_POLLUTANTS, RAW_KEY, RENAMED, name_col
from airspan.sources.readers import ROW_ORDER


def clean_readings(raw: DataFrame, compat: bool = False, order: str = ROW_ORDER) -> DataFrame:
    """Cleans the texts and keeps the last row of each key, in this order: repeats go before
    empty rows do, and negatives after both, so an empty later row removes an earlier one and a
    row of only negatives stays without values."""
    rows = conform(rename(raw, RENAMED), CLEAN_COLUMNS)
    rows = rows.select(
        *[strip_quotes(F.col(c)).alias(c) for c in RAW_KEY],
        *[clean_number(F.col(name_col(c)), compat).alias(c) for c in CLEAN_POLLUTANTS],
        order,
    )
    rows = drop_empty_rows(one_per_key(rows, RAW_KEY, [order], keep="last"), CLEAN_POLLUTANTS)
    return rows.select(
        *RAW_KEY, *[negative_to_null(F.col(name_col(c))).alias(c) for c in CLEAN_POLLUTANTS])


def sorted_clean(clean: DataFrame) -> DataFrame:
    """By station, then date and time as text; only where the order of the output matters."""
    return clean.orderBy(*RAW_KEY)


def numbered_clean(clean: DataFrame) -> DataFrame:
    """Adds ``row_no``, each row's place in the order of ``sorted_clean``."""
    return with_row_number(clean, RAW_KEY, "row_no")
