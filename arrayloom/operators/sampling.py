"""Epochs over a dataset: seeded order, shards, batches, padding, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.plans.lineage import numbered, unused


def order_key(row: Column, seed: int, epoch: int) -> Column:
    """The key by which an epoch's rows are shuffled: an md5 of seed, epoch and row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), row.cast("string")).cast("binary"))


def epoch_order(rows: DataFrame, seed: int | None, epoch: int = 0, row: str = "row") -> DataFrame:
    """``rows`` with the place (``pos``) of each in an epoch; in their own order without a seed."""
    if seed is None:
        return numbered(rows, [F.col(row)])
    key = unused("key", rows)
    return numbered(rows.withColumn(key, order_key(F.col(row), seed, epoch)), [F.col(key), F.col(row)]).drop(key)


def exact_order(size: int, seed: int, epoch: int) -> np.ndarray:
    """NumPy's permutation of an epoch, for callers that need that very order; it is made on the driver."""
    return np.random.default_rng([seed, epoch]).permutation(size)


def shard(ordered: DataFrame, size: int, shards: int) -> DataFrame:
    """Rows (``pos``) dealt to shards in turn, the first ones again until all are alike: shard, at."""
    if shards < 1:
        raise ValueError("there must be a shard")
    padded = -(-size // shards) * shards
    again = F.when(F.col("pos") + size < padded, F.sequence(F.col("pos"), F.lit(padded - 1).cast("bigint"), F.lit(max(size, 1)).cast("bigint"))).otherwise(F.array("pos"))
    name = unused("p", ordered)
    each, p = ordered.withColumn(name, F.explode(again)), F.col(name)
    return each.withColumn("shard", F.pmod(p, F.lit(shards).cast("bigint"))).withColumn("at", F.call_function("div", p, F.lit(shards).cast("bigint"))).drop(name)


def batches(ordered: DataFrame, size: int, batch_size: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """Rows with their batch and their place in it; with ``drop_last`` without a last batch that isn't full."""
    if batch_size < 1:
        raise ValueError("a batch must hold a row")
    n = F.lit(batch_size).cast("bigint")
    out = ordered.withColumn("batch", F.call_function("div", F.col(pos), n)).withColumn("item", F.pmod(F.col(pos), n))
    return out.where(F.col("batch") < size // batch_size) if drop_last else out


def pad_last(ordered: DataFrame, size: int, batch_size: int, pos: str = "pos") -> DataFrame:
    """Batches of which the last is filled by repeating its own rows in turn, not ``valid`` then."""
    rest = size % batch_size
    out = batches(ordered, size, batch_size, pos=pos)
    if not rest:
        return out.withColumn("valid", F.lit(True))
    last = F.col("batch") == size // batch_size
    items = F.when(last, F.sequence(F.col("item"), F.lit(batch_size - 1).cast("bigint"), F.lit(rest).cast("bigint"))).otherwise(F.array("item"))
    return out.withColumn("item", F.explode(items)).withColumn("valid", ~last | (F.col("item") < rest))


def split(rows: DataFrame, size: int, share: float, seed: int, row: str = "row") -> DataFrame:
    """Rows with ``validation``: the first max(1, round(share * size)) of a seeded order."""
    return epoch_order(rows, seed, 0, row).withColumn("validation", F.col("pos") < max(1, round(share * size)))


def encode_classes(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``code``: the place of their label among the sorted distinct ones."""
    codes = numbered(rows.select(label).distinct(), [F.col(label)], "code")
    return rows.join(codes, label)


def normalise(values: Column, floor: float = 1e-6) -> Column:
    """An image's values less their mean, over their sample deviation (``floor`` at least)."""
    wide = F.transform(values, lambda x: x.cast("double"))
    n = F.size(wide)
    stats = F.transform(F.array(wide), lambda v: F.struct(v.alias("v"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).alias("mean")))

    def apply(s: Column) -> Column:
        squares = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"]))
        return F.transform(F.transform(F.array(s), lambda t: F.struct(t["v"].alias("v"), t["mean"].alias("mean"), F.greatest(F.sqrt(squares / (n - 1)), F.lit(floor)).alias("d"))), lambda t: F.transform(t["v"], lambda x: (x - t["mean"]) / t["d"]))

    return F.get(F.flatten(F.transform(stats, apply)), 0)
