"""Key cleaning and guarded numeric conversions used across tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest second value whose milliseconds still fit a signed 64-bit integer with room to double.
MAX_SECONDS = 4.0e15


def clean_key(column: Column) -> Column:
    """A reference as it is compared: spaces trimmed, upper case; null stays null."""
    return F.upper(F.trim(column))


def is_finite(column: Column) -> Column:
    """True if neither null, NaN nor infinite; never null."""
    value = column.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def whole_ms(column: Column) -> Column:
    """floor(seconds * 1000 + 0.5) as bigint; null where not finite or beyond 64 bits."""
    value = column.cast("double")
    return F.when(
        is_finite(value) & (F.abs(value) <= MAX_SECONDS), F.floor(value * 1000 + 0.5).cast("bigint")
    )
