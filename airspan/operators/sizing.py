"""Measured sizes. Plans that hold a whole group in one task are chosen only behind these."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Rows of one group that a single task may hold in memory.
GROUP_ROWS = 2_000_000
# Rows of a table that may be sent to every executor.
BROADCAST_ROWS = 200_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group. Counts are combined before the shuffle and only keys are read."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only for a side counted to be small; else the shuffled join with its
    skew handling is left to the optimizer."""
    few = df.select(F.lit(1)).limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def spread_if_few(df: DataFrame) -> DataFrame:
    """Before slow per-row Python: spreads the rows of an input with fewer files than cores.
    A large input has more, and is left where it is read."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df
