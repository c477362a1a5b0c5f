"""Column helpers with the engine's NaN and null rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN = float("nan")


def valid_depth(d: Column) -> Column:
    """Finite and positive; null is not valid."""
    return F.coalesce(~F.isnan(d) & (d > 0) & (d < float("inf")), F.lit(False))


def or_nan(c: Column) -> Column:
    """An aggregate that is NaN, not null, over nothing."""
    return F.coalesce(c, F.lit(NAN))


def ratio(top: Column, bottom: Column) -> Column:
    """NaN for a zero, NaN or null denominator."""
    return F.when(bottom.isNull() | F.isnan(bottom.cast("double")) | (bottom == 0), NAN).otherwise(top.cast("double") / bottom)


def shown(c: Column, places: int) -> Column:
    """Fixed decimals, N/A for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(F.format_string(f"%.{places}f", c))
