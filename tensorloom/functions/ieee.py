"""Floating-point helpers that hold in ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest normal number of the 32-bit floats.
FLOAT_MIN_NORMAL = 1.17549435e-38


def divide(x: Column, y: Column) -> Column:
    """x / y as in IEEE 754: infinities and NaN instead of an error. The sign of a zero divisor is ignored."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when((x == 0) | F.isnan(x), nan).when(x > 0, inf).otherwise(-inf)
    return F.when(y == 0, by_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def significant(v: Column, epsilon: float) -> Column:
    """NaN, infinite, or normal and at least ``epsilon`` in size; with 0, everything but zero."""
    if epsilon == 0:
        return (v != 0) | F.isnan(v)
    return F.isnan(v) | (F.abs(v) >= F.lit(max(epsilon, FLOAT_MIN_NORMAL)))


def bytes_string(size: int) -> str:
    """A byte count for people, as in 1.50 KiB."""
    value, units = float(size), ["Bytes", "KiB", "MiB", "GiB", "TiB", "PiB"]
    while value >= 1024 and len(units) > 1:
        value, units = value / 1024, units[1:]
    return f"{value:.0f} {units[0]}" if units[0] == "Bytes" else f"{value:.2f} {units[0]}"
