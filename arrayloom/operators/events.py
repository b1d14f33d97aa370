"""Detector events: fractions of an acquisition's time, binning, counting, movies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(a: Column, b: int) -> Column:
    """The whole part of a / b for a >= 0, in integers."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def fraction(t: Column, extent: int, count: int) -> Column:
    """The fraction of a time: the largest i with floor(i * extent / count) <= t."""
    check_fractions(extent, count)
    return whole((t + 1) * F.lit(count).cast("bigint") - 1, extent)


def check_fractions(extent: int, count: int) -> None:
    if not 1 <= count <= min(extent, (1 << 32) - 1):
        raise ValueError("there must be at least one fraction and no more than time quanta")


def fraction_begin(i: Column, extent: int, count: int) -> Column:
    """The first time of fraction i."""
    return whole(i * F.lit(extent).cast("bigint"), count)


def bin_of(position: Column, subdivision: int, factor: int, pixels: int) -> Column:
    """The bin of a position; ``factor`` pixels make one, and must divide the pixels."""
    if factor < 1 or pixels % factor:
        raise ValueError("a bin's pixels must divide the image's")
    return whole(position, subdivision * factor)


def count_events(events: DataFrame, by: list[str], extents: dict[str, int]) -> DataFrame:
    """Events of each cell (columns ``by``); a coordinate outside its extent raises an error."""
    ok = F.lit(True)
    for name, n in extents.items():
        ok = ok & (F.col(name) >= 0) & (F.col(name) < n)
    checked = events.where(F.when(ok, True).otherwise(F.raise_error(F.lit("event out of range")).cast("boolean")))
    return checked.groupBy(*by).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, extents: dict[str, int]) -> DataFrame:
    """Counts of all cells, zeros included."""
    grid = counts.sparkSession.range(1).select()
    for name, n in extents.items():
        grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name))
    return grid.join(counts, list(extents), "left").select(*extents, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def movie(events: DataFrame, time_extent: int, fractions: int, height: int, width: int, bin_y: int = 1, bin_x: int = 1) -> DataFrame:
    """(f, y, x, n): a dense image of event counts for each fraction of ``events(t, y, x)``."""
    binned = events.select(fraction(F.col("t"), time_extent, fractions).alias("f"), bin_of(F.col("y"), 1, bin_y, height).alias("y"), bin_of(F.col("x"), 1, bin_x, width).alias("x"))
    extents = {"f": fractions, "y": height // bin_y, "x": width // bin_x}
    return dense(count_events(binned, ["f", "y", "x"], extents), extents)


def between(events: DataFrame, begin: int, end: int, extent: int) -> DataFrame:
    """Events of the stretch [begin, end) of time quanta."""
    if begin > end:
        raise ValueError("a stretch can't end before it begins")
    if begin < 0 or end > extent:
        raise IndexError("the stretch reaches out of the acquisition")
    return events.where((F.col("t") >= begin) & (F.col("t") < end))
