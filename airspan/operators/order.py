"""Sorting, paging and row numbers that never pass through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from airspan.functions.texts import folded
from airspan.session import durable

# Page bounds.
PAGE_LIMIT = (1, 1000, 100)
PAGE_OFFSET = (0, 10**9, 0)

# Deepest page served by a top-n sort, which keeps offset + limit rows in each task.
SHALLOW_OFFSET = 100_000

_ROW_BITS = 33


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Adds the 0-based position in the total order of ``order``.

    Rows are range-partitioned on the whole sort key, so a station with a third of all rows is
    spread over a third of the tasks. Each row then knows its partition and its place in it;
    the result is saved, and the partitions' counts (one small row each) give the offsets.
    """
    spark = df.sparkSession
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_place"), _ROW_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the sort, so bounded by the number of shuffle partitions.
    sizes = sorted((r["_part"], r["_n"]) for r in counts.collect())
    starts = [0, *accumulate(n for _, n in sizes)][: len(sizes)]
    offsets = spark.createDataFrame(
        [(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _start long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + (F.col("_place") - F.shiftleft(F.col("_part"), _ROW_BITS)))
        .drop("_part", "_start", "_place")
    )


def clamp_page_value(value: object, bounds: tuple[int, int, int]) -> int:
    low, high, default = bounds
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError):
        return default


def page_bounds(limit: object = None, offset: object = None) -> tuple[int, int]:
    return clamp_page_value(limit, PAGE_LIMIT), clamp_page_value(offset, PAGE_OFFSET)


def page(df: DataFrame, order: Sequence[Column], limit: object = None, offset: object = None) -> DataFrame:
    """One page of the ordered rows. Deep pages are cut by row number instead of a top-n sort."""
    limit, offset = page_bounds(limit, offset)
    if offset <= SHALLOW_OFFSET:
        return df.orderBy(*order).offset(offset).limit(limit)
    numbered = with_row_number(df, order, "_row")
    cut = numbered.filter((F.col("_row") >= offset) & (F.col("_row") < offset + limit))
    return cut.orderBy("_row").drop("_row")


def time_order(ts: str, direction: str | None, *ties: str) -> list[Column]:
    """Ascending unless ``desc`` is asked for; the tie columns make the order total."""
    descending = (direction or "asc").lower() == "desc"
    return [F.desc(ts) if descending else F.asc(ts), *(F.asc(t) for t in ties)]


def name_order(name: str = "name", *ties: str) -> list[Column]:
    return [folded(F.col(name)).asc(), *(F.asc(t) for t in ties)]


def first_complete_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], n: int = 400) -> DataFrame:
    """The first rows of the order that have no null in the columns."""
    return df.dropna(how="any", subset=list(columns)).orderBy(*order).limit(n)
