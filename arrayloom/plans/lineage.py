"""Cutting lineage, and numbering and folding ordered rows without sending them, or those of one key, to one task."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if (known := sc._jsc.sc().getCheckpointDir()).isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and re.match(r"local($|\[)", sc.master):
            folder = tempfile.mkdtemp(prefix="arrayloom")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, str, str]:
    """``df`` range-partitioned and sorted, written once so that later passes see the same rows; the columns of its partition and row number."""
    part, row = unused("part", df), unused("row_in_part", df)
    out = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    low = F.lit((1 << 33) - 1).cast("bigint")
    return out.withColumns({part: F.shiftright(row, 33).cast("int"), row: F.col(row).bitwiseAND(low)}), part, row


def _with_earlier(df: DataFrame, part: str, amounts: DataFrame, name: str) -> DataFrame:
    """``df`` with the sum of ``amounts(part, n)`` over the partitions before a row's; a row for each partition comes to the driver and goes out again."""
    found, total = [], 0
    for p, n in sorted(map(tuple, amounts.collect())):
        found.append((p, total))
        total += int(n)
    table = df.sparkSession.createDataFrame(found, f"`{part}` int, `{name}` long")
    return df.join(F.broadcast(table), part)


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with the place of each row (from 0) in a total order.

    A row's place is its place in its partition plus the rows of earlier partitions; only the counts of
    partitions come to the driver.
    """
    rows, part, row = placed(df, order)
    before = unused("before", rows)
    out = _with_earlier(rows, part, rows.groupBy(part).agg(F.count("*")), before)
    return out.select(*[c for c in df.columns if c != name], (F.col(row) + F.col(before)).alias(name))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` (an integer) over all rows up to each in a total order, made as ``numbered``."""
    rows, part, row = placed(df, order)
    before, inside = unused("before", rows), unused("inside", rows)
    rows = rows.withColumn(inside, F.sum(value).over(Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)))
    out = _with_earlier(rows, part, rows.groupBy(part).agg(F.coalesce(F.sum(value), F.lit(0))), before)
    return out.select(*[c for c in df.columns if c != name], (F.col(inside) + F.col(before)).alias(name))


def running_by(rows: DataFrame, part: str, row: str, key: str, value: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, inclusive: bool = False) -> DataFrame:
    """``rows`` (as ``placed`` by key and an order) with the fold of ``value`` over the rows of the same key before each.

    Each partition folds its own rows; what a key has in earlier partitions is folded from one row for each
    partition and key, so a key that most rows have is in no single task. ``join`` puts both together (either may be null).
    """
    own, carried = unused("own", rows), unused("carried", rows)
    last = 0 if inclusive else -1
    inside = rows.withColumn(own, fold(value).over(Window.partitionBy(part, key).orderBy(row).rowsBetween(Window.unboundedPreceding, last)))
    sums = rows.groupBy(part, key).agg(fold(value).alias(carried))
    earlier = sums.withColumn(carried, fold(F.col(carried)).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).where(F.col(carried).isNotNull())
    return inside.join(earlier, [part, key], "left").withColumn(name, join(F.col(own), F.col(carried))).drop(own, carried)


def add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint"))
