"""Batch and patch reads as joins, with their bounds checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.plans.lineage import unused


def read_batch(locations: DataFrame, stack: DataFrame, strict: bool = True) -> DataFrame:
    """``locations(slot, key, idx)`` with the columns of ``stack(key, idx, ...)``, a row for each slot.

    Duplicates are read each. With ``strict`` an unmatched location raises when the rows are computed.
    """
    mark = unused("found", locations, stack)
    found = locations.join(stack.withColumn(mark, F.lit(True)), ["key", "idx"], "left")
    if strict:
        message = F.concat(F.lit("no such image: "), F.col("key"), F.lit(" "), F.col("idx").cast("string"))
        found = found.where(F.when(F.col(mark).isNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    return found.drop(mark)


def check_batch(locations: DataFrame) -> DataFrame:
    """One row: how many locations are indexed and how many whole; a batch must not have both."""
    return locations.agg(F.count("idx").alias("indexed"), (F.count("*") - F.count("idx")).alias("whole"))


def read_patches(centres: DataFrame, rows: DataFrame, extents: tuple[int, int], fill: float = 0.0) -> DataFrame:
    """``centres(slot, key, y, x)`` with their patches: slot, row (0 to H-1), values (W numbers, padded with ``fill``), inside.

    ``rows(key, y, line)`` holds an image as one array a line. The centre lands at extent // 2. A place's patch is H
    equi-joins on (key, y), one for each line; the W values are cut out of the line.
    """
    height, width = extents
    boxes = read_boxes(centres, rows, {"y": height, "x": width}, fill)
    return boxes.select("slot", F.col("y_at").alias("row"), "values", "inside")


def read_boxes(centres: DataFrame, rows: DataFrame, extents: dict[str, int], fill: float = 0.0) -> DataFrame:
    """Boxes of any rank: ``centres(slot, key, <axes>)`` with a row for each line of their box.

    ``extents`` names the axes and the box, the slowest first; ``rows(key, <all axes but the last>, line)`` holds the
    image's lines. The row has the line's place in the box (``<axis>_at``), its values, padded with ``fill``, and how many
    of them lie inside the image. Centres at one place share their box until the last join.
    """
    return _of_slots(centres, boxes_at(centres, rows, extents, fill), list(extents))


def _of_slots(centres: DataFrame, places: DataFrame, axes: list[str]) -> DataFrame:
    """Rows of places as rows of the centres' slots; a place that is null is one, too."""
    at = ["key", *axes]
    own = centres.select("slot", *[F.col(a).alias(f"own_{a}") for a in at])
    return own.join(places, reduce(and_, [F.col(f"own_{a}").eqNullSafe(F.col(a)) for a in at])).select("slot", *[c for c in places.columns if c not in at])


def boxes_at(centres: DataFrame, rows: DataFrame, extents: dict[str, int], fill: float = 0.0) -> DataFrame:
    """The boxes of ``read_boxes`` for each place that has a centre: key and axes in place of the slot.

    A box is one equi-join for each of its lines. A line meets each place at most once for each line of a box, so how many
    rows a line meets is bounded by its length, not by the centres.
    """
    *lead, last = extents
    need = centres.select("key", *extents).distinct()
    for a in lead:
        need = need.withColumn(f"{a}_at", F.explode(F.sequence(F.lit(0), F.lit(extents[a] - 1)))).withColumn(f"{a}_line", F.col(a) + F.col(f"{a}_at") - extents[a] // 2)
    known = rows.select("key", *[F.col(a).alias(f"{a}_line") for a in lead], "line")
    met = need.join(known, ["key", *[f"{a}_line" for a in lead]], "left")
    left = F.col(last) - extents[last] // 2
    return met.select("key", *extents, *[f"{a}_at" for a in lead], patch_line(F.col("line"), left, extents[last], fill).alias("values"), _inside(F.col("line"), left, extents[last]).alias("inside"))


def over_boxes(centres: DataFrame, rows: DataFrame, extents: dict[str, int], *folds: Column, fill: float = 0.0) -> DataFrame:
    """``slot`` and the aggregates ``folds`` of each centre's box (of ``values`` and ``inside`` of its lines), made once for a place."""
    return _of_slots(centres, boxes_at(centres, rows, extents, fill).groupBy("key", *extents).agg(*folds), list(extents))


def patch_line(line: Column, left: Column, width: int, fill: float) -> Column:
    """``width`` values of a line from ``left`` on; places outside, and a line that is missing, hold ``fill``."""
    lead = F.least(F.greatest(-left, F.lit(0)), F.lit(width)).cast("int")
    held = _inside(line, left, width)
    pad = F.lit(fill).cast("double")
    body = F.when(held > 0, F.slice(line, F.greatest(left, F.lit(0)).cast("int") + 1, held)).otherwise(F.array().cast("array<float>"))
    return F.concat(F.array_repeat(pad, lead), body.cast("array<double>"), F.array_repeat(pad, F.lit(width) - lead - held))


def _inside(line: Column, left: Column, width: int) -> Column:
    size = F.coalesce(F.size(line), F.lit(0))
    return F.when(size > 0, F.greatest(F.least(left + width, size) - F.greatest(left, F.lit(0)), F.lit(0))).otherwise(F.lit(0)).cast("int")


def read_multi(rows: DataFrame, stack: DataFrame, locations: str, value: str) -> DataFrame:
    """``rows(row, locations ARRAY<struct<key,idx>>)`` with an array of the located values, in order."""
    each = rows.select("row", F.posexplode(locations).alias("k", "at")).select("row", "k", "at.key", "at.idx")
    met = each.join(stack.select("key", "idx", value), ["key", "idx"], "left")
    return met.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value]).alias("values"))


def overlay(wanted: DataFrame, held: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Wanted rows from the cache where it holds them, else from the source, with ``cached`` saying which."""
    from_cache = wanted.join(held, on).withColumn("cached", F.lit(True))
    missing = wanted.join(held.select(*on), on, "left_anti")
    return from_cache.unionByName(missing.join(source, on).withColumn("cached", F.lit(False)))


def bounds(locations: DataFrame, images: DataFrame) -> DataFrame:
    """Per file and kind of access the greatest index asked for, and whether the file has it: key, indexed, most, valid."""
    asked = locations.groupBy("key", F.col("idx").isNotNull().alias("indexed")).agg(F.max("idx").alias("most"))
    return asked.join(images.select("key", "extents"), "key", "left").select("key", "indexed", "most", F.coalesce(F.when(F.col("indexed"), F.col("most") < F.get("extents", 0)).otherwise(F.col("extents").isNotNull()), F.lit(False)).alias("valid"))


def merge_one(many: DataFrame, one: DataFrame, on: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Many-to-one merge: the joined rows, the rows of ``many`` that ``one`` doesn't know, the keys it has twice."""
    twice = one.groupBy(on).count().where("count > 1").select(on)
    return many.join(one, on), many.join(one.select(on).distinct(), on, "left_anti"), twice


def fill_missing(grid: DataFrame, stored: DataFrame, on: list[str], value: str, fill: Column) -> DataFrame:
    """Every cell of the grid with its stored value, else the fill value."""
    held = unused("held", grid, stored)
    return grid.join(stored.select(*on, F.col(value).alias(held)), on, "left").withColumn(value, F.coalesce(held, fill)).drop(held)


def violations(regions: DataFrame, axes: list[str]) -> DataFrame:
    """Regions that aren't inside their file or array on some axis.

    For each axis ``a`` the columns are a_off, a_len, a_size (file) and a_at, a_room (array).
    """
    return regions.where(outside(axes))


def outside(axes: list[str]) -> Column:
    bad = F.lit(False)
    for a in axes:
        c = lambda s, a=a: F.col(f"{a}_{s}")
        bad = bad | (c("off") < 0) | (c("off") + c("len") > c("size")) | (c("at") < 0) | (c("at") + c("len") > c("room"))
    return bad


def strict(regions: DataFrame, axes: list[str]) -> DataFrame:
    """The regions as they are; one that isn't inside its file and array raises an error when the rows are computed."""
    missing = [f"{a}_{s}" for a in axes for s in ("off", "len", "size", "at", "room") if f"{a}_{s}" not in regions.columns]
    if missing:
        raise ValueError(f"regions of another rank: {missing}")
    return regions.where(F.when(outside(axes), F.raise_error(F.lit("a region outside its file or array")).cast("boolean")).otherwise(True))


def sanitize(regions: DataFrame, axes: list[str], by: Callable[[DataFrame, list[str]], DataFrame] = strict) -> DataFrame:
    """Regions as a sanitizer leaves them: ``strict``, ``clip`` or any function of regions and axes that keeps the columns."""
    out = by(regions, axes)
    if set(regions.columns) - set(out.columns):
        raise ValueError("a sanitizer must keep the regions' columns")
    return out


def clip(regions: DataFrame, axes: list[str]) -> DataFrame:
    """Regions cut to their file and array: off, at and len of each axis; those with nothing left are dropped.

    What lies before the file's (or the array's) begin moves the other side's offset, too.
    """
    for a in axes:
        c = lambda s, a=a: F.col(f"{a}_{s}")
        shift = F.greatest(-c("off"), -c("at"), F.lit(0))
        regions = regions.withColumns({f"{a}_off": c("off") + shift, f"{a}_at": c("at") + shift, f"{a}_len": F.least(c("len") - shift, c("size") - c("off") - shift, c("room") - c("at") - shift)}).where(c("len") > 0)
    return regions


def take(dataset: DataFrame, request: DataFrame, row: str = "row") -> DataFrame:
    """``dataset`` rows in the order of ``request(pos, row)``; duplicates are given each."""
    return request.join(dataset, row)


def normalise_rows(request: DataFrame, size: Column | int) -> DataFrame:
    """``request(pos, row)`` with negative rows counted from the end; rows out of range raise an error."""
    n = size if isinstance(size, Column) else F.lit(size)
    inside = (F.col("row") >= -n) & (F.col("row") < n)
    return request.withColumn("row", F.when(inside, F.when(F.col("row") < 0, F.col("row") + n).otherwise(F.col("row"))).otherwise(F.raise_error(F.lit("row out of range")).cast("bigint")))
