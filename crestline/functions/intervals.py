"""Interval column functions; ranges are half-open, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, round_half_up


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the shorter length; 0 for an empty interval."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter <= 0, F.lit(0.0)).otherwise(overlap_ms(a0, a1, b0, b1) / shorter)


def window_start(peak: Column, duration: Column, width: int, share: float) -> Column:
    """Start of a window of width that lays share of it before the peak, kept inside the source."""
    return clamp(round_half_up(peak - width * share).cast("long"), 0, F.greatest(F.lit(0), duration - width)).cast("long")


def relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(~known, "unknown").when(a1 <= b0, "before").when(b1 <= a0, "after").otherwise("overlap")


def centred_range(start: Column, end: Column, duration: Column, least: int = 30_000, most: int = 60_000) -> tuple[Column, Column]:
    """The range with least..most length around its centre, inside the source."""
    length = clamp(end - start, least, most)
    begin = clamp(round_half_up((start + end) / 2 - length / 2).cast("long"), 0, F.greatest(F.lit(0), duration - length))
    return begin.cast("long"), F.least(duration, begin + length).cast("long")
