"""Rounding and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUDGE = 1e-9


def half_up(value: Column, digits: int) -> Column:
    """Round half up; the nudge keeps binary noise in a sum or ratio from flipping an exact tie."""
    return F.round(value.cast("double") + F.lit(_NUDGE), digits)


def percent(part: Column, whole: Column, *, digits: int = 1, empty: float | None = None) -> Column:
    """``part / whole × 100``; ``empty`` (default null: not known) when there is nothing to divide by."""
    ratio = half_up(part.cast("double") / whole.cast("double") * 100, digits)
    return F.when(whole > 0, ratio).otherwise(F.lit(empty).cast("double"))
