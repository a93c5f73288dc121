"""Number text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as blank at either end of a text, as a number, and as a comma between
# thousands: one between a digit and three digits, which a dot or the end follows.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LIKELY_NUMBER = r"[0-9]|(?i)inf"
NUMBER_OR_INFINITE = r"(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?inf(inity)?$"
LONE_COMMA = r"^([^,.]*),([^,.]*)$"
THOUSANDS_COMMA = r"(?<=\d),(?=\d{3}(\.|$))"
ALL_DOTS_BUT_LAST = r"[.](?=[^.]*[.])"


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def strip_quotes(c: Column) -> Column:
    """Trim, then drop both kinds of quote."""
    return F.translate(strip_blanks(c), "\"'", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_blanks(c), F.lit(""))


def drop_thousands(c: Column) -> Column:
    """``1,929.70`` -> ``1929.70``."""
    return F.regexp_replace(c, THOUSANDS_COMMA, "")


def merge_dots(c: Column, compat: bool = False) -> Column:
    """``2.723.37`` -> ``2723.37``; ``compat`` loses the part before the last dot (``2.37``)."""
    if not compat:
        return F.regexp_replace(c, ALL_DOTS_BUT_LAST, "")
    parts = F.split(c, "[.]", -1)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "")
    return F.when(F.size(parts) >= 3, F.concat(head, F.lit("."), F.element_at(parts, -1))).otherwise(c)


def decimal_comma(c: Column) -> Column:
    """A single comma in a text without dots is a decimal point."""
    return F.regexp_replace(c, LONE_COMMA, "$1.$2")


def to_number(c: Column) -> Column:
    """Double, or null where the text is no number (``nan`` included)."""
    # Only texts with a digit are cast: a cast that fails throws inside, which costs far more.
    matched = F.regexp_extract(strip_blanks(c), NUMBER_OR_INFINITE, 0)
    return F.when(c.rlike(LIKELY_NUMBER), matched.try_cast("double"))


def clean_number(c: Column, compat: bool = False) -> Column:
    """The whole chain, each step named once so that its code stays small enough to compile."""
    mended = decimal_comma(merge_dots(drop_thousands(strip_quotes(c)), compat))
    matched = F.regexp_extract(strip_blanks(mended), NUMBER_OR_INFINITE, 0)
    return F.when(c.rlike(LIKELY_NUMBER), matched.try_cast("double"))


def commas_to_dots_if_digits(c: Column) -> Column:
    """Intake rule A: every comma becomes a dot when only digits, dots and dashes surround it."""
    rest = F.translate(c, ",.-", "")
    return F.when(c.contains(",") & rest.rlike("^[0-9]+$"), F.translate(c, ",", ".")).otherwise(c)


def commas_to_dots_if_number(c: Column) -> Column:
    """Intake rule B: commas become dots only when the result is a number."""
    dotted = F.translate(c, ",", ".")
    return F.when(c.contains(",") & to_number(dotted).isNotNull(), dotted).otherwise(c)


def negative_to_null(c: Column) -> Column:
    return F.when(c >= 0, c)


def unit_ratio(value: Column, low: Column, high: Column) -> Column:
    """Position of a value between two bounds, held in 0..1; 0 when the bounds coincide."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.when(value.isNull(), F.lit(None)).when(high <= low, F.lit(0.0)).otherwise(inside)
