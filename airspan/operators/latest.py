"""Newest reading per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airspan.operators.fields import with_ids
from airspan.schemas import TABLE_POLLUTANTS


def latest_per_station(
    m: DataFrame, station_ids: Sequence[int] | None = None, columns: Sequence[str] = TABLE_POLLUTANTS
) -> DataFrame:
    """A value that is null in the newest row stays null.

    One scan and one hash aggregate whose buffers are fixed-width, so each task sends one row
    per station to the shuffle, however many readings a station has.
    """
    picks = [F.max_by(c, "ts").alias(c) for c in columns]
    return with_ids(m, station_ids).groupBy("station_id").agg(F.max("ts").alias("ts"), *picks)
