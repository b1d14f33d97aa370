"""Whole programs as Spark jobs over files on mounted paths: conversion, fractionating detector events, cutting out particles."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions.types import numerical_type, numpy_type
from arrayloom.operators.reads import read_patches
from arrayloom.plans.lineage import add, placed, running_by, shared_folder
from arrayloom.sources.image import cast
from arrayloom.sources.mrc import BLOCK, END, packed_blocks
from arrayloom.sources.registry import copied, open_image
from arrayloom.sources.spark import BATCH_PIXELS, RANGES, STACK, Piece, plain, put_together, read_stack, read_timeline, several, tensor, timelines, write_stacks

#: Bytes that a task packs at most.
ZIPPED = 4 << 20


def mounted(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as a plain path: executors must have it mounted."""
    folder = shared_folder(spark)
    path = re.sub(r"^file:/*", "/", folder)
    if "://" in path:
        raise ValueError(f"{folder} isn't a mounted path")
    path = f"{path}/{name}"
    os.makedirs(path, exist_ok=True)
    return path


def plain_path(key: str):
    """A column of paths without the scheme of files on mounted paths."""
    return F.regexp_replace(key, "^file:/*", "/")


def renamed(key: str, folder: str, extension: str):
    """A column of paths in ``folder`` with the names of ``key``, but for the extension."""
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(F.substring_index(key, "/", -1), r"\.[^.]*$", ""), F.lit(extension))


def convert(spark: SparkSession, paths: list[str], folder: str, extension: str, dtype: str | None = None) -> DataFrame:
    """Each file written again as ``folder/<name><extension>``, with elements of ``dtype``: key and images of each."""
    images = read_stack(spark, paths, dtype)
    return write_stacks(images.withColumn("key", renamed("key", folder, extension)))


def zipped(spark: SparkSession, paths: list[str]) -> list[str]:
    """Each file (on a mounted path) as ``<path>.gz``, whose members tell their lengths: tasks pack ranges of bytes, readers enter at any block."""
    known, job = [os.path.abspath(plain(p)) for p in paths], f".{uuid.uuid4().hex[:12]}"
    step = ZIPPED // BLOCK * BLOCK
    parts = [(k, at) for k, path in enumerate(known) for at in range(0, max(os.path.getsize(path), 1), step)]

    def pack(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                k, at = parts[n]
                with open(known[k], "rb") as f:
                    f.seek(at)
                    raw = packed_blocks(f.read(step))
                beside = f"{known[k]}{job}.{uuid.uuid4().hex}"
                with open(beside, "wb") as out:
                    out.write(raw)
                yield pa.RecordBatch.from_pylist([{"file": k, "at": at, "beside": beside}])

    def join(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        path = known[rows[0]["file"]]
        os.replace(copied(path, b"", [r["beside"] for r in rows], [END]), f"{path}.gz")
        return pa.table({"file": pa.array([rows[0]["file"]], pa.int64()), "pieces": [[r["beside"] for r in rows]]})

    packed = spark.range(0, len(parts), 1, min(max(len(parts), 1), RANGES)).mapInArrow(pack, "file bigint, at bigint, beside string")
    for r in packed.groupBy("file").applyInArrow(join, "file bigint, pieces array<string>").toLocalIterator():
        for piece in r.pieces:
            os.remove(piece)
    return [f"{path}.gz" for path in known]


def render(counts: DataFrame, extents: DataFrame, dtype: str = "uint32") -> DataFrame:
    """Counts (key, f, y, x, n) as images of a stack, a row for each of ``extents(key, f, height, width)``, zeros elsewhere.

    A group is at most as large as its image.
    """
    kind = numpy_type(numerical_type(dtype))

    def one(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        image = np.zeros((rows[0]["height"], rows[0]["width"]), np.int64)
        for r in rows:
            if r["n"] is not None:
                image[r["y"], r["x"]] = r["n"]
        if kind.kind in "ui" and image.max(initial=0) > np.iinfo(kind).max:
            raise OverflowError("more events in a bin than the type holds")
        return pa.Table.from_pylist([tensor(rows[0]["key"], rows[0]["f"], cast(image, kind), dtype)], schema=pa.schema([("key", pa.string()), ("idx", pa.int64()), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("data", pa.binary())]))

    return extents.join(counts, ["key", "f"], "left").select("key", "f", "height", "width", "y", "x", "n").groupBy("key", "f").applyInArrow(one, STACK)


def fractionate(spark: SparkSession, paths: list[str], fractions: int, binning: int = 1) -> DataFrame:
    """The timelines' events as a stack of count images for each file, one for each fraction of its frames."""
    if fractions < 1 or binning < 1:
        raise ValueError("there must be a fraction, and a bin must hold a pixel")
    known = timelines(spark, paths)
    ok = (F.col("frames") >= fractions) & (F.col("height") % binning == 0) & (F.col("width") % binning == 0)
    known = known.where(F.when(ok, True).otherwise(F.raise_error(F.lit("more fractions than frames, or bins that don't divide an image")).cast("boolean")))
    div = lambda a, b: F.call_function("div", a, b)
    met = read_timeline(spark, paths).join(F.broadcast(known), "key")  # a row for each file that was named
    binned = met.select("key", div((F.col("t") + 1) * fractions - 1, F.col("frames")).alias("f"), div(div(F.col("y"), F.col("quanta_y")), F.lit(binning)).alias("y"), div(div(F.col("x"), F.col("quanta_x")), F.lit(binning)).alias("x"))
    counts = binned.groupBy("key", "f", "y", "x").agg(F.count("*").alias("n"))
    extents = known.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(fractions - 1).cast("bigint"))).alias("f"), div(F.col("height"), F.lit(binning)).alias("height"), div(F.col("width"), F.lit(binning)).alias("width"))
    return render(counts, extents)


def fractionate_files(spark: SparkSession, paths: list[str], folder: str, fractions: int, binning: int = 1, extension: str = ".tif") -> DataFrame:
    """``fractionate`` written to ``folder/<name><extension>``: key and images of each file."""
    return write_stacks(fractionate(spark, paths, fractions, binning).withColumn("key", renamed("key", folder, extension)))


def lines(stack: DataFrame) -> DataFrame:
    """(key, y, line): the lines of images of rank 2, as doubles."""

    def run(batches):
        for batch in batches:
            for first, images, _ in several(batch):
                n, height, width = images.shape
                step = max(1, BATCH_PIXELS // max(width, 1))
                for k in range(n):
                    key = batch.column(0)[first + k]
                    for top in range(0, height, step):
                        part = images[k, top : top + step].astype(np.float64)
                        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                        yield pa.RecordBatch.from_arrays([pa.repeat(key, len(part)), pa.array(np.arange(top, top + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], names=["key", "y", "line"])

    return stack.select("key", "shape", "dtype", "data").mapInArrow(run, "key string, y bigint, line array<double>")


def assembled(patches: DataFrame, dtype: str = "float32") -> DataFrame:
    """Images of ``patches(key, idx, row, values)``, each put together from its lines."""
    whole = patches.groupBy("key", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "values"))), lambda s: s["values"]).alias("image"))
    kind = numpy_type(numerical_type(dtype))

    def run(batches):
        for batch in batches:
            rows = [tensor(r["key"], r["idx"], cast(np.array(r["image"], np.float64), kind), dtype) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("idx", pa.int64()), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("data", pa.binary())]))

    return whole.mapInArrow(run, STACK)


def extract_particles(spark: SparkSession, particles: DataFrame, paths: list[str], folder: str, box: tuple[int, int], fill: float = 0.0, extension: str = ".mrcs") -> DataFrame:
    """Boxes of images around ``particles(slot, key, y, x)``, written as a stack for each image: slot, key, idx, location.

    Centres are cut to whole pixels and land at half the box; what lies outside an image holds ``fill``. The boxes of an
    image are numbered by slot; ``location`` is ``<number from 1>@<path of the stack>``.

    Particles are sorted by image and slot once; their boxes are cut out of mapped files as they stream by and written
    as pieces of the stacks, so neither an image's lines nor its boxes are dealt out or held. Images that aren't on
    mounted paths are joined by their lines.
    """
    centres = particles.select("slot", plain_path("key").alias("key"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    rows, part, row = placed(centres, [F.col("key"), F.col("slot")])
    numbers = running_by(rows, part, row, "key", F.lit(1).cast("bigint"), F.sum, add, "idx").drop(part, row)
    out = renamed("key", folder, extension)
    if all(re.match(r"(file:)?/", p) and os.path.isfile(plain(p)) for p in paths):
        own = rows.select(out.alias("out"), "key", F.col(part).cast("bigint").alias("part"), "y", "x")
        put_together(own, cut_out(frozenset(plain(p) for p in paths), box, fill))
    else:
        patches = read_patches(centres, lines(read_stack(spark, paths)).withColumn("key", plain_path("key")), box, fill)
        write_stacks(assembled(patches.join(numbers.select("slot", out.alias("key"), "idx"), "slot").select("key", "idx", "row", "values")))
    return numbers.select("slot", out.alias("key"), "idx").select("slot", "key", "idx", F.concat((F.col("idx") + 1).cast("string"), F.lit("@"), F.col("key")).alias("location"))


def cut_out(known: frozenset[str], box: tuple[int, int], fill: float) -> Callable:
    """Pieces of stacks from batches (out, key, part, y, x): the boxes around the rows' places in images of rank 2 among ``known``."""

    def image_of(path: str) -> np.ndarray:
        if path not in known:  # all of it is outside
            return np.zeros((0, 0), np.float32)
        f = open_image(path)
        if f.count > 1 or f.core_rank != 2:
            raise ValueError(f"{path} isn't one image of rank 2")
        return f.read(0 if f.count else None)

    def run(batches):
        path, image = None, None
        for batch in batches:
            keys = batch.column(1).dictionary_encode()
            codes = keys.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
            top, left = (batch.column(k).to_numpy() - n // 2 for k, n in zip((3, 4), box, strict=True))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if path != (now := keys.dictionary[int(codes[a])].as_py()):
                    path, image = now, image_of(now)
                step = max(1, BATCH_PIXELS // max(box[0] * box[1], 1))
                for k in range(int(a), int(b), step):
                    end = min(k + step, int(b))
                    yield Piece(batch.column(0)[k].as_py(), (batch.column(2)[k].as_py(), 0), boxes_of(image, top[k:end], left[k:end], box, fill), "float32")

    return run


def boxes_of(image: np.ndarray, top: np.ndarray, left: np.ndarray, box: tuple[int, int], fill: float) -> np.ndarray:
    """The boxes with their first pixel at (top, left), as float32; ``fill`` outside of the image."""
    y, x = top[:, None] + np.arange(box[0]), left[:, None] + np.arange(box[1])
    inside = ((y >= 0) & (y < image.shape[0]))[:, :, None] & ((x >= 0) & (x < image.shape[1]))[:, None, :]
    out = np.full(inside.shape, fill, np.float64)
    if image.size:
        y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
        np.copyto(out, image[y[:, :, None], x[:, None, :]], where=inside)
    return cast(out, np.dtype(np.float32))
