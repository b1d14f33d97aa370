"""Event counts of fractions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.events import bin_of, fraction


def fraction_counts(stream: DataFrame, time: str, extent: int, fractions: int, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """(window, f, n): events of each fraction of a stream with columns ``time`` (a timestamp) and ``t``.

    Windows default to one over all; events later than ``late`` behind the newest may be left out, which is what
    lets the state of closed windows go.
    """
    timed = stream.withWatermark(time, late).withColumn("f", fraction(F.col("t"), extent, fractions))
    keys = [F.window(time, window)] if window else []
    return timed.groupBy(*keys, "f").agg(F.count("*").alias("n"))


def count_images(stream: DataFrame, extent: int, fractions: int, height: int, width: int, bin_y: int = 1, bin_x: int = 1) -> DataFrame:
    """(f, y, x, n): the count images of a stream's fractions so far, without zeros (for the complete or update mode)."""
    binned = stream.select(fraction(F.col("t"), extent, fractions).alias("f"), bin_of(F.col("y"), 1, bin_y, height).alias("y"), bin_of(F.col("x"), 1, bin_x, width).alias("x"))
    return binned.groupBy("f", "y", "x").agg(F.count("*").alias("n"))
