"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """x inside [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """The line through (x0, y0) and (x1, y1) at x, which is kept between x0 and x1."""
    return F.lit(y0) + (clamp(x, min(x0, x1), max(x0, x1)) - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0)
