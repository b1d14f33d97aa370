"""Planning of transfers: merging ranges, runs, budgets, chunks and pages."""

from __future__ import annotations

from itertools import accumulate, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.plans.lineage import add, placed, running_by, running_sum


def div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a.cast("bigint"), b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def merge_ranges(ranges: DataFrame, tolerance: int, tie: str) -> DataFrame:
    """(key, begin, end, parts): ranges of a file joined where the next begins within ``tolerance`` of the end so far.

    A file's ranges are spread over the tasks, however many they are.
    """
    rows, part, row = placed(ranges.select("key", "begin", "end", F.col(tie).alias("tie")), [F.col("key"), F.col("begin"), F.col("tie")])
    rows = running_by(rows, part, row, "key", F.col("end"), F.max, F.greatest, "before")
    opens = rows.withColumn("opens", (F.col("before").isNull() | (F.col("begin") > F.col("before") + tolerance)).cast("bigint"))
    runs = running_by(opens, part, row, "key", F.col("opens"), F.sum, add, "run", inclusive=True)
    return runs.groupBy("key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("run")


def budgeted_ranges(ranges: DataFrame, tolerance: int, budget: int, grid: int = 1, size: int = (1 << 63) - 1) -> DataFrame:
    """``merge_ranges`` under a byte budget: a join that makes a range larger than both the budget and what it was is not made.

    Begins are aligned down to ``grid``, ends cut at the file's ``size``. The rule depends on the order, so it is a
    fold over a file's ranges, streamed from sorted partitions: only the open range of a file is held.
    """
    own = ranges.select("key", F.col("begin").cast("bigint"), F.col("end").cast("bigint"))

    def fold(batches):
        import pyarrow as pa

        kind, open_ = None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for key, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, end = begin - begin % grid, min(end, size)
                if open_ is not None and open_[0] == key and begin <= open_[2] + tolerance:
                    longer = max(end, open_[2])
                    if longer - open_[1] <= max(budget, open_[2] - open_[1]):
                        open_ = (key, open_[1], longer, open_[3] + 1)
                        continue
                done += [] if open_ is None else [open_]
                open_ = (key, begin, end, 1)
            yield rows(pa, kind, done)
        if open_ is not None:
            yield rows(pa, kind, [open_])

    def rows(pa, kind, found):
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "begin", "end", "parts"])

    kind = own.schema["key"].dataType.simpleString()
    return own.repartition("key").sortWithinPartitions("key", "begin", "end").mapInArrow(fold, f"key {kind}, begin long, end long, parts long")


def steps(sizes: list[int], budget: int) -> list[list[int]]:
    """Consecutive ranges (their places) in steps of at most ``budget`` bytes; a larger one stands alone."""
    out: list[list[int]] = []
    held = 0
    for k, n in enumerate(sizes):
        if not out or held + n > budget and held:
            out.append([])
            held = 0
        out[-1].append(k)
        held += n
    return out


def region_split(extents: list[int], strides: list[int], item: int, cap: int, budget: int) -> list[int]:
    """Axes that are split into single positions: those slower than the last one still worth bridging.

    From the fastest stride on, an axis is gathered while its stride is no more than the span so far, or the gap
    is at most ``cap`` and the joined span at most ``budget``.
    """
    fastest = sorted(range(len(extents)), key=strides.__getitem__)
    spans = list(accumulate(((extents[a] - 1) * strides[a] for a in fastest), initial=item))  # bytes from the first to the last value over the axes so far
    gaps = [strides[a] - spans[k] if extents[a] > 1 else 0 for k, a in enumerate(fastest)]
    apart = [gap > 0 and (gap > cap or spans[k + 1] > budget) for k, gap in enumerate(gaps)]
    return sorted(fastest[apart.index(True) :]) if any(apart) else []


def write_runs(extents: list[int], strides: list[int], item: int) -> tuple[int, list[int]]:
    """Bytes of a run and the offsets of all runs: the fastest axes that follow closely make one run."""
    run, axes = item, sorted(range(len(extents)), key=lambda a: strides[a])
    while axes and (strides[axes[0]] == run or extents[axes[0]] == 1):
        run *= extents[axes.pop(0)]
    return run, sorted(sum(i * strides[a] for i, a in zip(places, axes, strict=True)) for places in product(*(range(extents[a]) for a in axes)))


def linear_offset(places: Column, strides: Column) -> Column:
    """The sum of place times stride over the axes."""
    return F.aggregate(F.zip_with(places, strides, lambda p, s: p.cast("bigint") * s.cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)


def number_regions(regions: DataFrame, key: str = "key", slot: str = "slot") -> DataFrame:
    """Regions grouped by file, in the order of their slots: ``place`` in the file's plan."""
    rows, part, row = placed(regions.drop("place"), [F.col(key), F.col(slot)])
    return running_by(rows, part, row, key, F.lit(1).cast("bigint"), F.sum, add, "place").drop(part, row)


def runs(held: DataFrame, length: int, key: str, order: str) -> DataFrame:
    """Held positions of each file in runs of ``length``."""
    return number_regions(held, key, order).withColumn("run", div(F.col("place"), length)).drop("place")


def fit_budget(sizes: DataFrame, budget: int, order: list[Column], size: str) -> DataFrame:
    """The leading rows whose sizes fit the budget together; the first that doesn't fit ends them."""
    return running_sum(sizes, order, size, "used").where(F.col("used") <= budget)


def evict(files: DataFrame, budget: int, need: int, last_used: str, path: str, size: str) -> DataFrame:
    """Files to remove, least recently used (then by path) first, until those kept and ``need`` fit the budget."""
    total = files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    over = int(total) + need - budget
    gone = running_sum(files, [F.col(last_used), F.col(path)], size, "freed")
    return gone.where((F.col("freed") - F.col(size) < over) & F.lit(over > 0))


def chunks(regions: DataFrame, axes: dict[str, int]) -> DataFrame:
    """Regions (a_off, a_len) cut at a grid of chunks: per axis the chunk and the piece's offset in it and length."""
    for a, c in axes.items():
        off, size = F.col(f"{a}_off").cast("bigint"), F.col(f"{a}_len").cast("bigint")
        at = F.col(f"{a}_chunk")
        regions = regions.where(size > 0).withColumn(f"{a}_chunk", F.explode(F.sequence(div(off, c), div(off + size - 1, c))))
        regions = regions.withColumns({f"{a}_in": F.greatest(off - at * c, F.lit(0)), f"{a}_part": F.least(off + size, (at + 1) * c) - F.greatest(off, at * c)})
    return regions


def shard_entry(chunk: list[Column], per_shard: list[int]) -> tuple[list[Column], Column]:
    """The shard of a chunk and the chunk's entry in the shard's index (row-major)."""
    entry = F.lit(0).cast("bigint")
    for c, n in zip(chunk, per_shard, strict=True):
        entry = entry * n + F.pmod(c.cast("bigint"), F.lit(n).cast("bigint"))
    return [div(c, n) for c, n in zip(chunk, per_shard, strict=True)], entry


def chunk_key(chunk: list[Column], encoding: str = "default", separator: str | None = None) -> Column:
    """The store key of a chunk: ``c/0/1`` (default) or ``0.1`` (v2); without axes ``c`` or ``0``."""
    if encoding not in ("default", "v2"):
        raise ValueError(f"unknown chunk key encoding: {encoding}")
    sep = separator or ("/" if encoding == "default" else ".")
    places = [c.cast("string") for c in chunk]
    return F.concat_ws(sep, F.lit("c"), *places) if encoding == "default" else F.concat_ws(sep, *places) if places else F.lit("0")


def core_rank(written: Column, space_axes: Column, scaled: Column, named: Column, rank: Column) -> Column:
    """How many trailing axes make one image: as written, else by the space axes, names or rank.

    ``space_axes``: trailing axes of type space (null without such metadata; 3 at most count). ``scaled``: whether the
    first of three never scales while others do, which makes a stack of images. ``named``: trailing axes named z, y, x.
    """
    spatial = F.when(space_axes > 0, F.least(space_axes, F.lit(3)))
    return F.coalesce(written, F.when(scaled & (spatial == 3), F.lit(2)).otherwise(spatial), named, F.least(rank, F.lit(3)))
