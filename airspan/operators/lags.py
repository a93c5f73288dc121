"""Previous and next readings of a station, by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from airspan.operators.order import with_row_number
from airspan.operators.sizing import GROUP_ROWS, largest_group

# Rows of one block when stations are too large for a window each.
BLOCK_ROWS = 1_000_000


def add_lags(
    df: DataFrame, station: str, order: Sequence[str], columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 3), max_gap: int | None = None, group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS, largest: int | None = None,
) -> DataFrame:
    """Adds ``<column>_lag<k>`` and ``<column>_next_hour``.

    They count rows, not hours; with ``max_gap`` (seconds per step) a value from further away in
    time becomes null.

    While every station is counted to fit a task, one window per station does it. Otherwise the
    rows are numbered in station and time order and cut into equal blocks; each block also gets
    the few rows next to its ends, so a station may span any number of blocks.
    """
    ts = order[0]
    largest = largest_group(df, [station]) if largest is None else largest
    if largest <= group_rows:
        near = W.partitionBy(station).orderBy(*order)
        return df.select("*", *_shifted(columns, lags, near, ts, max_gap))
    reach = max(lags)
    numbered = with_row_number(df, [station, *order], "_row")
    place = F.pmod(F.col("_row"), F.lit(block_rows))
    block = F.floor(F.col("_row") / block_rows)
    copies = F.array_compact(F.array(
        block,
        F.when(place >= block_rows - reach, block + 1),
        F.when(place == 0, block - 1),
    ))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(copies))
    near = W.partitionBy("_block").orderBy("_row")
    shifted = spread.select("*", *_shifted(columns, lags, near, ts, max_gap, station))
    return shifted.filter("_home = _block").drop("_row", "_home", "_block")


def _shifted(columns, lags, near, ts: str, max_gap: int | None, station: str | None = None) -> list[Column]:
    def from_row(column: str, step: int) -> Column:
        value = F.lag(column, step).over(near)
        if station is not None:
            value = F.when(F.lag(station, step).over(near).eqNullSafe(F.col(station)), value)
        if max_gap is not None:
            distance = F.abs(F.timestamp_diff("SECOND", F.lag(ts, step).over(near), F.col(ts)))
            value = F.when(distance <= max_gap * abs(step), value)
        return value

    made = [from_row(c, k).alias(f"{c}_lag{k}") for c in columns for k in lags]
    return made + [from_row(c, -1).alias(f"{c}_next_hour") for c in columns]
