"""Dates, wall times and zones as column expressions."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

from airspan.functions.numbers import strip_blanks
from airspan.schemas import DATE_FORMAT, HOME_ZONE, MINUTE_FORMAT


def hour_of_text(c: Column) -> Column:
    """Hour number of ``HH:mm``; null when it is not a whole number."""
    return F.split(c, ":").getItem(0).try_cast("int")


def date_of_text(c: Column) -> Column:
    return F.try_to_timestamp(strip_blanks(c), F.lit(DATE_FORMAT)).cast("date")


def reading_time(date_text: Column, time_text: Column, strict: bool = False) -> Column:
    """Wall time of a reading; a bad text is null, or an error when ``strict``."""
    text = F.concat(strip_blanks(date_text), F.lit(" "), strip_blanks(time_text))
    parse = F.to_timestamp if strict else F.try_to_timestamp
    fmt = MINUTE_FORMAT if strict else F.lit(MINUTE_FORMAT)
    return parse(text, fmt).cast("timestamp_ntz")


def hour_bucket(ts: Column) -> Column:
    """Start of the hour. Stays a wall time, whatever the session zone."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def day_bucket(ts: Column) -> Column:
    return F.to_date(ts)


def weekday(ts: Column) -> Column:
    """0 is Monday."""
    return F.weekday(ts)


def weekend_flag(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def pick_zone(name: str | None) -> str:
    """A known zone name as it is; an unknown one gives the home zone."""
    try:
        return ZoneInfo(name).key if name else HOME_ZONE
    except Exception:
        return HOME_ZONE


def parse_bound(text: str | datetime | None) -> datetime | None:
    """ISO bound -> home wall time in whole seconds. Without a zone it is a home wall time already."""
    if text is None or text == "":
        return None
    when = text if isinstance(text, datetime) else datetime.fromisoformat(text.replace("Z", "+00:00"))
    if when.tzinfo is not None:
        when = when.astimezone(ZoneInfo(HOME_ZONE)).replace(tzinfo=None)
    return when.replace(microsecond=0)


def ntz_literal(when: datetime) -> Column:
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def wall_time_in(ts: Column, zone: str) -> Column:
    """Home wall time as the wall time of another zone."""
    home = ts.cast("timestamp_ntz")
    if zone == HOME_ZONE:
        return home
    return F.from_utc_timestamp(_utc(home), zone).cast("timestamp_ntz")


def _utc(home: Column) -> Column:
    """The instant of a home wall time, shown in UTC. With a constant zone name these functions
    look the zone up once, not once per row; they ask for a session in UTC."""
    return F.to_utc_timestamp(home.cast("timestamp"), HOME_ZONE)


def _two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def iso_time(ts: Column, zone: str | None = None) -> Column:
    """Home wall time (or date) as ISO text with the offset of the target zone."""
    zone = pick_zone(zone)
    home = ts.cast("timestamp_ntz")
    local = wall_time_in(home, zone)
    text = local.cast("string")
    clock = F.translate(F.substring(text, 1, 19), " ", "T")
    fraction = F.when(F.length(text) > 19, F.rpad(F.substring(text, 20, 7), 7, "0")).otherwise("")
    gap = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(_utc(home))
    size = F.abs(gap)
    sign = F.when(gap < 0, "-").otherwise("+")
    seconds = F.pmod(size, F.lit(60))
    return F.concat(
        clock, fraction, sign, _two_digits(F.floor(size / 3600)), F.lit(":"),
        _two_digits(F.pmod(F.floor(size / 60), F.lit(60))),
        F.when(seconds == 0, "").otherwise(F.concat(F.lit(":"), _two_digits(seconds))))
