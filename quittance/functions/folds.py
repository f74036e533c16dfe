"""Confidence algebra on whole thousandths, so that every engine rounds alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or_step(m: Column, c: Column) -> Column:
    """m + round((1 - m) c, 3)."""
    return m + F.floor(((1000 - m) * c + 500) / 1000).cast("bigint")


def noisy_or(values: Column, start: int = 0) -> Column:
    """m <- m + round((1 - m) c, 3) over an ordered array of thousandths."""
    return F.aggregate(values, F.lit(start).cast("bigint"), noisy_or_step)


def product(values: Column) -> Column:
    """m <- round(m c, 3) over an ordered array of thousandths."""
    return F.aggregate(values, F.lit(1000).cast("bigint"), lambda m, c: F.floor((m * c + 500) / 1000).cast("bigint"))
