"""Object ids as text, and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(c: Column, width: int) -> Column:
    """Zeros to the left up to a width; longer ids stay whole."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def canonical(c: Column, width: int = 7) -> Column:
    """Padded, with a dash for each underscore."""
    return F.translate(padded(c, width), "_", "-")


def display(c: Column) -> Column:
    """The inverse of canonical(): no leading zeros, an underscore for each dash."""
    return F.translate(F.ltrim(c, F.lit("0")), "-", "_")


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
