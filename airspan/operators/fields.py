"""Column choice and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from airspan.functions.texts import folded
from airspan.functions.times import iso_time, ntz_literal, parse_bound
from airspan.schemas import FIELD_COLUMNS, name_col


def conform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds the missing columns as empty text; extra columns stay, after the expected ones."""
    present = [F.col(name_col(c)) if c in df.columns else F.lit("").alias(c) for c in columns]
    extra = [F.col(name_col(c)) for c in df.columns if c not in columns]
    return df.select(*present, *extra)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renames columns. Where the new name is there already, both spellings are one column:
    the text under the new name counts, and the old one where that is blank."""
    both = {old: new for old, new in mapping.items() if old in df.columns and new in df.columns}
    for old, new in both.items():
        kept = F.coalesce(F.nullif(F.trim(F.col(name_col(new))), F.lit("")), F.col(name_col(old)))
        df = df.withColumn(new, kept).drop(old)
    return df.withColumnsRenamed({o: n for o, n in mapping.items() if o not in both})


def chosen_fields(fields: str | None) -> list[str]:
    """Names asked for, unknown ones dropped. No request means all; only unknown ones mean none."""
    if not fields:
        return list(FIELD_COLUMNS)
    asked = [f.strip().lower() for f in fields.split(",")]
    return [f for f in FIELD_COLUMNS if f in asked]


def reading_columns(fields: str | None = None, tz: str | None = None) -> list[Column]:
    """ISO time and always all six values, null where not asked for."""
    wanted = chosen_fields(fields)
    values = [
        (F.col(column) if name in wanted else F.lit(None).cast("double")).alias(name)
        for name, column in FIELD_COLUMNS.items()
    ]
    return [iso_time(F.col("ts"), tz).alias("ts"), *values]


def in_time_range(df: DataFrame, start=None, end=None, ts: str = "ts", day: str = "day") -> DataFrame:
    """Both ends included, either optional. Prunes the day partitions where the table has them."""
    low, high = parse_bound(start), parse_bound(end)
    for bound, compare in ((low, "__ge__"), (high, "__le__")):
        if bound is None:
            continue
        df = df.filter(getattr(F.col(ts), compare)(ntz_literal(bound)))
        if day in df.columns:
            df = df.filter(getattr(F.col(day), compare)(F.lit(bound.date())))
    return df


def with_ids(df: DataFrame, ids: Sequence[int] | None, column: str = "station_id") -> DataFrame:
    return df.filter(F.col(column).isin([int(i) for i in ids])) if ids else df


def with_names(df: DataFrame, names: Sequence[str] | None, column: str = "name") -> DataFrame:
    """Names in the list, ignoring accents and case."""
    wanted = [n.strip() for n in names or [] if n.strip()]
    return df.filter(folded(F.col(column)).isin([folded(F.lit(n)) for n in wanted])) if wanted else df


def name_contains(df: DataFrame, text: str | None, column: str = "name") -> DataFrame:
    """Plain text search, ignoring accents and case; ``%`` and ``_`` are ordinary characters."""
    text = (text or "").strip()
    return df.filter(F.contains(folded(F.col(column)), folded(F.lit(text)))) if text else df


def require_row(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error when there is none."""
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(F.coalesce(*[F.col(name_col(c)) for c in columns]).isNotNull())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
