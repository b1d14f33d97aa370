"""Image locations: a key and an index into a stack, null for the whole file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_location(text: Column) -> Column:
    """struct<key, idx, valid> of ``<1-based index>@<key>`` or ``<key>``; idx counts from 0, null for the whole file.

    The first @ splits. Empty texts, empty, zero, non-digit or overflowing indices and empty keys are invalid
    (key and idx null); null stays invalid.
    """
    at = F.instr(text, "@")
    index, key = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    number = F.when(F.regexp_like(index, F.lit("^[0-9]+$")), index.try_cast("bigint"))
    plain = F.struct(text.alias("key"), F.lit(None).cast("bigint").alias("idx"), F.lit(True).alias("valid"))
    indexed = F.struct(key.alias("key"), (number - 1).alias("idx"), F.lit(True).alias("valid"))
    invalid = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("idx"), F.lit(False).alias("valid"))
    return F.when((at == 0) & (F.length(text) > 0), plain).when((at > 0) & (number > 0) & (F.length(key) > 0), indexed).otherwise(invalid)


def format_location(key: Column, idx: Column) -> Column:
    """The inverse of ``parse_location``."""
    return F.when(idx.isNull(), key).otherwise(F.concat((idx + 1).cast("string"), F.lit("@"), key))


def resolve_key(key: Column, root: str | None) -> Column:
    """A relative key behind ``root``."""
    return key if root is None else F.when(key.startswith("/"), key).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), key))


def make_location(key: Column, idx: Column, root: str | None = None) -> Column:
    """struct<key, idx> from a path (one leading > is dropped) and an index from 0."""
    return F.struct(resolve_key(F.regexp_replace(key, "^>", ""), root).alias("key"), idx.cast("bigint").alias("idx"))


def group_locations(locations: DataFrame) -> DataFrame:
    """(key, whole, indices): per key the sorted distinct indices, none if any location names the whole file."""
    groups = locations.groupBy("key").agg(F.bool_or(F.col("idx").isNull()).alias("whole"), F.sort_array(F.collect_set("idx")).alias("indices"))
    return groups.withColumn("indices", F.when(F.col("whole"), F.array().cast("array<bigint>")).otherwise(F.col("indices")))


def location_order() -> list[Column]:
    """By key, then index; whole files last."""
    return [F.col("key").asc(), F.col("idx").asc_nulls_last()]


def core_extents(extents: Column, core_rank: Column) -> Column:
    """The trailing ``core_rank`` extents: those of one image or volume."""
    return F.slice(extents, F.size(extents) - core_rank + 1, core_rank)
