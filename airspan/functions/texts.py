"""Names and sentences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airspan.functions.numbers import strip_blanks

# Accent- and case-insensitive comparison of names, and the alert sentences.
NAME_COLLATION = "UNICODE_CI_AI"
SENTENCE_FULL = "%s alcanzó %s en %s."
SENTENCE_NO_STATION = "%s alcanzó %s."
SENTENCE_RULE_AND_STATION = "La regla %s se activó en %s."
SENTENCE_RULE = "La regla %s se activó."
SENTENCE_BARE = "Se registró un evento de alerta."


def folded(c: Column) -> Column:
    """Compare ignoring accents and case. Names are stored plain and folded at query time."""
    return F.collate(c, NAME_COLLATION)


def station_name(c: Column) -> Column:
    return strip_blanks(F.coalesce(c, F.lit("")))


def target_label(c: Column) -> Column:
    """``PM2_5_next_hour`` -> ``PM 2.5``."""
    base = F.replace(c, F.lit("_next_hour"), F.lit(""))
    return F.replace(F.replace(base, F.lit("PM2_5"), F.lit("PM 2.5")), F.lit("PM10"), F.lit("PM 10"))


def _fixed_places(size: Column, places: int) -> Column:
    """Rounds the exact binary value half up, so 12.35 (stored just below) gives 12.3.

    ``size`` is split into two short halves; products of those with a small integer carry no
    rounding error, which makes the comparison with each midpoint exact.
    """
    scale = 10 ** places
    spread = size * 134217729.0
    high = spread - (spread - size)
    low = size - high
    floor = F.floor(size * scale).cast("double") - 1.0
    steps = floor
    for k in (1, 3, 5):
        reached = (high * (2.0 * scale) - (floor * 2.0 + k)) + low * (2.0 * scale) >= 0
        steps = steps + F.when(reached, 1.0).otherwise(0.0)
    return F.format_string(f"%.{places}f", steps / scale)


def value_text(c: Column) -> Column:
    """Reading as text: no decimals from 100 up, one from 10 up, two below."""
    size = F.abs(c)
    body = (
        F.when(size >= 100, _fixed_places(size, 0))
        .when(size >= 10, _fixed_places(size, 1))
        .otherwise(_fixed_places(size, 2))
    )
    return F.when(c < 0, F.concat(F.lit("-"), body)).when(c.isNotNull(), body)


def alert_sentence(pollutant: Column, value: Column, station: Column, rule: Column) -> Column:
    """One line about an event, with what is known of it."""
    what, how_much = F.upper(F.nullif(pollutant, F.lit(""))), value_text(value)
    where, which = F.nullif(station, F.lit("")), F.nullif(rule, F.lit(""))
    measured = what.isNotNull() & how_much.isNotNull()
    return (
        F.when(measured & where.isNotNull(), F.format_string(SENTENCE_FULL, what, how_much, where))
        .when(measured, F.format_string(SENTENCE_NO_STATION, what, how_much))
        .when(which.isNotNull() & where.isNotNull(),
              F.format_string(SENTENCE_RULE_AND_STATION, which, where))
        .when(which.isNotNull(), F.format_string(SENTENCE_RULE, which))
        .otherwise(SENTENCE_BARE)
    )
