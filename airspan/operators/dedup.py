"""One row per key, unseen rows and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from airspan.schemas import name_col


FIXED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def one_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: str = "last",
    total: bool = False,
) -> DataFrame:
    """Keeps the ``last`` or ``first`` row of each key in the given order.

    An aggregate, not a window: copies of a key collapse before the shuffle, so a key that
    holds a third of all rows never meets in one task. Say ``total`` where no two rows of a key
    have the same order: columns of fixed width are then picked one by one, which a hash
    aggregate can do, while a whole row needs a sort.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    rest = [c for c in df.columns if c not in keys]
    marks = [F.col(name_col(o)) if isinstance(o, str) else o for o in order]
    mark = marks[0] if len(marks) == 1 else F.struct(*marks)
    pick = F.max_by if keep == "last" else F.min_by
    if total and len(marks) == 1 and all(isinstance(df.schema[c].dataType, FIXED) for c in rest):
        picked = df.groupBy(*[F.col(name_col(k)) for k in keys]).agg(
            *[pick(F.col(name_col(c)), mark).alias(c) for c in rest])
        return picked.select(*[F.col(name_col(c)) for c in df.columns])
    packed = F.struct(*[F.col(name_col(c)) for c in rest])
    picked = df.groupBy(*[F.col(name_col(k)) for k in keys]).agg(pick(packed, mark).alias("_row"))
    return picked.select(
        *[F.col(name_col(c)) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def unseen_rows(
    batch: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Rows of the batch whose key is not known yet; inside the batch the first one wins."""
    first = one_per_key(batch, keys, order, keep="first").alias("batch")
    seen = known.select(*[F.col(name_col(k)) for k in keys]).alias("seen")
    same = [F.col(f"batch.{name_col(k)}").eqNullSafe(F.col(f"seen.{name_col(k)}")) for k in keys]
    return first.join(seen, same, "left_anti")


def merge_rows(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Upsert: all value columns of a known key are replaced, even by nulls; the last update wins."""
    columns = existing.columns
    new = one_per_key(updates, keys, order).select(*columns)
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    # A key has one old and one new row at most.
    return one_per_key(both, keys, ["_new"], total=True).drop("_new")
