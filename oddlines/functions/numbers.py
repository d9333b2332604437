"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round to ``digits`` decimals the same way in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(value * scale + 0.5) / scale
