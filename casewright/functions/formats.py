"""Display formats as column expressions: escaped text, grouped numbers, percentages, month names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shown for a missing number (a fixed value).
MISSING = "—"


def escaped(text: Column) -> Column:
    """Text safe inside HTML and its quoted attributes."""
    text = text.cast("string")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands; null is a dash."""
    return F.coalesce(F.format_number(number, 0), F.lit(MISSING))


def percent(number: Column, digits: int = 1) -> Column:
    """Fixed digits and a percent sign, without grouping; halves that a double holds exactly go away from zero; null is a dash."""
    x = number.cast("double")
    half = (F.floor(x * 2 ** (digits + 1)) == x * 2 ** (digits + 1)) & (F.pmod(F.abs(x) * 2 * 10**digits, F.lit(2.0)) == 1)
    pattern = "0." + "0" * digits if digits else "0"
    shown = F.call_function("format_number", F.when(half, F.round(x, digits)).otherwise(x), F.lit(pattern))
    return F.coalesce(F.concat(shown, F.lit("%")), F.lit(MISSING))


def month_label(month: Column) -> Column:
    """2024-03 as March 2024; anything else as it is."""
    first = F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd"))
    return F.when(month.rlike(r"^\d{4}-\d{2}$") & first.isNotNull(), F.date_format(first, "MMMM yyyy")).otherwise(month)
