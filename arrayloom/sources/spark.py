"""The formats as DataFrames.

Files on mounted paths are mapped and read by ranges, others whole with Spark's ``binaryFile``, so any store that Spark
reads will do; ``spark.read.format("arrayloom")`` reads files and ZARR directories from mounted paths, in partitions of a file and a
range of its images; files are mapped, so planning reads headers and a task the bytes of its images. Images are rows (key, idx, shape, dtype, data): little-endian values in C order.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from arrayloom.functions.types import numerical_type, numpy_type
from arrayloom.plans.lineage import cut
from arrayloom.sources import tiff
from arrayloom.sources.image import cast, little
from arrayloom.sources.registry import open_image, open_timeline, write_image, write_pieces

IMAGES = "key string, format string, extents array<bigint>, core_rank int, dtype string"
STACK = "key string, idx bigint, shape array<bigint>, dtype string, data binary"
EVENTS = "key string, t bigint, y bigint, x bigint"


#: Images and bytes that a task reads of a file, tasks, and bytes and pixels of a batch that it gives on, at most.
RANGE_IMAGES, RANGE_BYTES, RANGES, BATCH_BYTES, BATCH_PIXELS = 1 << 15, 32 << 20, 10_000, 4 << 20, 1 << 19


def plain(key: str) -> str:
    """A path without the scheme of files on mounted paths."""
    return re.sub(r"^file:/*", "/", key)


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files by any store that Spark reads."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _by_files(spark: SparkSession, paths: list[str], opener: Callable, plan: Callable, read: Callable, schema: str) -> DataFrame:
    """``read(key, opened, *part)`` of each part that ``plan(opened)`` lists for a file.

    Files on mounted paths are mapped and each part is a task's (up to RANGES tasks), planned by a job of its own; what
    Spark alone can read is read whole, a file in a task.
    """
    if not paths or not all(re.match(r"(file:)?/", p) and os.path.isfile(plain(p)) for p in paths):

        def whole(batches):
            for batch in batches:
                for key, data in _rows(batch):
                    f = opener(key, data)
                    for part in plan(f):
                        yield from read(key, f, *part)

        return _files(spark, paths).mapInArrow(whole, schema)
    known = [os.path.abspath(plain(p)) for p in paths]

    def parts(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = [(k, *part) for part in plan(opener(known[k]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, names=["file", "begin", "end"])

    planned = spark.range(0, len(known), 1, min(len(known), RANGES)).mapInArrow(parts, "file bigint, begin bigint, end bigint")
    every = sorted(tuple(r) for r in planned.collect())  # a row for each range

    def ranges(batches):
        held = (None, None)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file, *part = every[k]
                if held[0] != file:
                    held = (file, opener(known[file]))
                yield from read(f"file:{known[file]}", held[1], *part)

    # an RDD's size isn't known to the planner; that of spark.range is, so that it would broadcast what is read by so few rows
    numbers = spark.sparkContext.parallelize(range(len(every)), min(max(len(every), 1), RANGES)).map(lambda k: (k,))
    return spark.createDataFrame(numbers, "part bigint").mapInArrow(ranges, schema)


def describe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file: key, format, extents, core_rank, dtype."""

    def one(key, f, *_):
        yield pa.RecordBatch.from_pylist([{"key": key, "format": f.format, "extents": list(f.extents), "core_rank": f.core_rank, "dtype": f.dtype}], schema=pa.schema([("key", pa.string()), ("format", pa.string()), ("extents", pa.list_(pa.int64())), ("core_rank", pa.int32()), ("dtype", pa.string())]))

    return _by_files(spark, paths, open_image, lambda f: [(0, 0)], one, IMAGES)


_STACK = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("data", pa.binary())])


def tensor(key: str, idx: int | None, array: np.ndarray, dtype: str) -> dict:
    return {"key": key, "idx": idx, "shape": list(array.shape), "dtype": dtype, "data": little(array).tobytes()}


def tensors(key: str, begin: int | None, images: np.ndarray, dtype: str) -> pa.RecordBatch:
    """Rows of images along a leading axis, numbered from ``begin``; under 2 GB."""
    n, shape = len(images), images.shape[1:]
    raw = little(images)
    step = raw.nbytes // n
    numbers = pa.nulls(n, pa.int64()) if begin is None else pa.array(np.arange(begin, begin + n))
    shapes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(shape)), pa.array(np.tile(np.array(shape, np.int64), n)))
    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * step), pa.py_buffer(raw.tobytes())])
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key), n), numbers, shapes, pa.repeat(pa.scalar(dtype), n), data], schema=_STACK)


def several(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, str]]:
    """The images of a batch with columns shape, dtype and data: the first row, the images and their type of each run of equal shape and type."""
    shapes, dtypes, data = (batch.column(batch.schema.get_field_index(n)) for n in ("shape", "dtype", "data"))
    n = batch.num_rows
    if not n:
        return
    ranks = pc.list_value_length(shapes).to_numpy()
    if (ranks == ranks[0]).all():
        each = shapes.flatten().to_numpy().reshape(n, ranks[0])
        new = (each[1:] != each[:-1]).any(axis=1)
    else:
        each = [tuple(s) for s in shapes.to_pylist()]
        new = np.array([a != b for a, b in zip(each[1:], each[:-1], strict=True)])
    codes = dtypes.dictionary_encode().indices.to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(new | (codes[1:] != codes[:-1])) + 1, [n]])
    offsets = np.frombuffer(data.buffers()[1], np.int32, n + 1, data.offset * 4)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        shape, dtype = tuple(int(x) for x in each[a]), dtypes[a].as_py()
        kind = numpy_type(dtype)
        size = int(np.prod(shape, dtype=np.int64)) * (b - a)
        if int(offsets[b] - offsets[a]) != size * kind.itemsize:
            raise ValueError("images whose bytes don't fit their shapes")
        yield a, (np.frombuffer(data.buffers()[2], kind, size, int(offsets[a])) if size else np.zeros(0, kind)).reshape(b - a, *shape), dtype


def read_stack(spark: SparkSession, paths: list[str], dtype: str | None = None) -> DataFrame:
    """A row for each image of each file (idx null for a file of one), converted to ``dtype`` if given.

    A stack on a mounted path is read by ranges of its images, so its size is no task's; but for a gzip file whose
    members don't tell their lengths: one task inflates it, and holds a few MB of it.
    """
    wanted = numerical_type(dtype) if dtype else None

    def bytes_of(f) -> int:
        return max(1, int(np.prod(f.core, dtype=np.int64)) * numpy_type(f.dtype).itemsize)

    def plan(f):
        if not f.count:
            return [(0, 0)] if len(f.extents) == f.core_rank else []
        step = f.count if f.single_pass else max(1, min(RANGE_IMAGES, RANGE_BYTES // bytes_of(f)))
        return [(k, min(k + step, f.count)) for k in range(0, f.count, step)]

    def read(key, f, begin, end):
        step = max(1, BATCH_BYTES // bytes_of(f))
        for k in range(begin, max(end, begin + 1), step):
            images = f.reads(k, min(k + step, end)) if end > begin else f.read(None)[None]
            yield tensors(key, k if end > begin else None, cast(images, numpy_type(wanted)) if wanted else images, wanted or f.dtype)

    return _by_files(spark, paths, open_image, plan, read, STACK)


def read_timeline(spark: SparkSession, paths: list[str], begin: int = 0, end: int | None = None) -> DataFrame:
    """Events (key, t, y, x) of the frames [begin, end) of each file; frames without events have no rows."""

    def plan(line):
        stop = len(line.pages) if end is None else end
        if not 0 <= begin <= stop <= len(line.pages):
            raise IndexError("the stretch reaches out of the acquisition")
        return [(t, min(t + 64, stop)) for t in range(begin, stop, 64)]

    def read(key, line, first, stop):
        for t in range(first, stop):
            at = line.frame(t).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(np.full(len(at), t)), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["key", "t", "y", "x"])

    return _by_files(spark, paths, open_timeline, plan, read, EVENTS)


def timelines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each timeline: key, frames, height and width in pixels, positions to a pixel along both."""

    def one(key, line, *_):
        yield pa.RecordBatch.from_pylist([{"key": key, "frames": len(line.pages), "height": line.height, "width": line.width, "quanta_y": 1 << line.v, "quanta_x": 1 << line.h}])

    return _by_files(spark, paths, open_timeline, lambda line: [(0, 0)], one, "key string, frames bigint, height bigint, width bigint, quanta_y bigint, quanta_x bigint")


def pixels(stack: DataFrame) -> DataFrame:
    """(key, idx, y, x, value) of a stack of images."""

    def run(batches):
        for batch in batches:
            for first, images, _ in several(batch):
                n, height, width = images.shape
                step, lines = max(1, BATCH_PIXELS // max(height * width, 1)), max(1, BATCH_PIXELS // max(width, 1))
                for k in range(0, n, step):
                    for top in range(0, height, lines):
                        part = images[k : k + step, top : top + lines]
                        each, (rows, _) = part[0].size, part[0].shape
                        own = batch.slice(first + k, len(part))
                        at = pa.array(np.repeat(np.arange(len(part)), each))
                        y, x = np.repeat(np.arange(top, top + rows, dtype=np.int64), width), np.tile(np.arange(width, dtype=np.int64), rows)
                        yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.array(np.tile(y, len(part))), pa.array(np.tile(x, len(part))), pa.array(part.ravel().astype(np.float64))], names=["key", "idx", "y", "x", "value"])

    return stack.select("key", "idx", "shape", "dtype", "data").mapInArrow(run, "key string, idx bigint, y bigint, x bigint, value double")


def values(stack: DataFrame) -> DataFrame:
    """(key, idx, values) of a stack: a row for each image, its values in C order as doubles."""

    def run(batches):
        for batch in batches:
            for first, images, _ in several(batch):
                n = len(images)
                step = max(1, BATCH_PIXELS // max(images[0].size, 1))
                for k in range(0, n, step):
                    part = images[k : k + step].astype(np.float64)
                    own = batch.slice(first + k, len(part))
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part[0].size)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], names=["key", "idx", "values"])

    return stack.select("key", "idx", "shape", "dtype", "data").mapInArrow(run, "key string, idx bigint, values array<double>")


def write_stacks(stack: DataFrame, core_rank: int | None = None) -> DataFrame:
    """Write each key's images, ordered by idx, to the file of that name (a mounted path), at once; key and images of each file.

    ``core_rank``: trailing axes of one image; by default all that the rows' images have.

    The tasks of a range of (key, idx) write pieces as their rows stream by; a file is put together by copying its pieces
    and renamed into place, so a task that is run again leaves one file.
    """

    def decoded(batches):
        for batch in batches:
            keys, idx = batch.column(0).dictionary_encode(), batch.column(1)
            codes = keys.indices.to_numpy()
            for first, images, dtype in several(batch):
                own = codes[first : first + len(images)]
                starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    yield Piece(keys.dictionary[int(own[a])].as_py(), (idx[first + a].as_py(), 0), images[a:b], dtype, idx[first + a].as_py() is None)

    order = [F.col("key"), F.col("idx").asc_nulls_last()]
    rows = stack.select("key", "idx", "shape", "dtype", "data").repartitionByRange(*order).sortWithinPartitions(*order)
    return put_together(rows, decoded, core_rank)


def write_lines(lines: DataFrame, dtype: str = "float32") -> DataFrame:
    """``lines(key, idx, row, values)``, the lines of images of rank 2, written as ``write_stacks`` writes images, none of them held whole."""
    kind = numpy_type(numerical_type(dtype))

    def decoded(batches):
        for batch in batches:
            keys, idx, row, held = (batch.column(k) for k in range(4))
            keys = keys.dictionary_encode()
            number, missing = pc.fill_null(idx, 0).to_numpy(zero_copy_only=False), pc.is_null(idx).to_numpy(zero_copy_only=False)
            codes, sizes = keys.indices.to_numpy(), pc.list_value_length(held).to_numpy()
            every, at = cast(held.flatten().to_numpy(zero_copy_only=False), kind), np.concatenate([[0], np.cumsum(sizes)])
            new = (codes[1:] != codes[:-1]) | (sizes[1:] != sizes[:-1])
            image = (codes[1:] != codes[:-1]) | (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(codes)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                begins = np.concatenate([[a], np.flatnonzero(image[a : b - 1]) + a + 1, [b]])
                yield Piece(keys.dictionary[int(codes[a])].as_py(), (idx[a].as_py(), row[a].as_py()), every[at[a] : at[b]].reshape(b - a, -1), dtype, bool(missing[a]), idx[b - 1].as_py(), np.diff(begins))

    order = [F.col("key"), F.col("idx").asc_nulls_last(), F.col("row")]
    rows = lines.select("key", "idx", "row", F.col("values").cast("array<double>")).repartitionByRange(*order).sortWithinPartitions(*order)
    return put_together(rows, decoded, None)


@dataclass
class Piece:
    """Images (or lines: then ``heights`` has how many lie in each image) of one file, behind each other, and the place of the first."""

    key: str
    first: tuple
    array: np.ndarray
    dtype: str
    single: bool = False
    last: int | None = None
    heights: np.ndarray | None = None


PIECES = "key string, first bigint, then bigint, last bigint, path string, images bigint, shape array<bigint>, dtype string, single boolean, heights array<bigint>, strips array<bigint>"


def put_together(rows: DataFrame, decoded: Callable, core_rank: int | None = None) -> DataFrame:
    """The files whose pieces ``decoded`` makes of the batches of each partition, in the order of their places; key and images of each file.

    The files are there when it returns. A piece lies beside its file until then.
    """
    job = f"_staged-{uuid.uuid4().hex[:12]}"

    def write(batches):
        out, held, n, heights, strips = None, None, 0, [], []

        def done():
            out.close()
            return pa.RecordBatch.from_pylist([{"key": held.key, "first": held.first[0], "then": held.first[1], "last": last, "path": out.name, "images": n, "shape": list(held.array.shape[1:]), "dtype": held.dtype, "single": held.single, "heights": np.concatenate(heights).tolist() if heights else None, "strips": strips or None}], schema=PIECE)

        for piece in decoded(batches):
            if held is not None and piece.key == held.key and (piece.array.shape[1:], piece.dtype, piece.heights is None) != (held.array.shape[1:], held.dtype, held.heights is None):
                raise ValueError(f"{piece.key}: images of several shapes or types")
            if held is None or piece.key != held.key:
                if held is not None:
                    yield done()
                folder = f"{os.path.dirname(plain(piece.key))}/{job}"
                os.makedirs(folder, exist_ok=True)
                out, held, n, heights, strips = open(f"{folder}/{uuid.uuid4().hex}", "wb"), piece, 0, [], []
            elif piece.heights is not None and piece.first[0] == last:  # an image goes on
                heights[-1][-1] += piece.heights[0]
                piece.heights = piece.heights[1:]
            last = piece.last
            n += len(piece.array)
            heights += [] if piece.heights is None or not len(piece.heights) else [piece.heights.copy()]
            if piece.heights is None and piece.array.dtype.kind in "ui" and piece.array.ndim == 3 and plain(piece.key).lower().endswith((".tif", ".tiff")) and piece.array.size:
                for raw in tiff.packed(piece.array):
                    out.write(raw)
                    strips.append(len(raw))
            else:
                out.write(little(piece.array).data)
        if held is not None:
            yield done()

    def join(group: pa.Table) -> pa.Table:
        pieces = sorted(group.to_pylist(), key=lambda r: (r["first"] is None, r["first"], r["then"]))
        if len({(tuple(r["shape"]), r["dtype"]) for r in pieces}) > 1:
            raise ValueError(f"{pieces[0]['key']}: images of several shapes or types")
        key, shape, dtype, n = pieces[0]["key"], tuple(pieces[0]["shape"]), numpy_type(pieces[0]["dtype"]), sum(r["images"] for r in pieces)
        if pieces[0]["heights"]:
            heights, last = [], ()
            for r in pieces:
                own = list(r["heights"])
                if heights and (last == r["first"]):
                    heights[-1] += own.pop(0)
                heights += own
                last = r["last"]
            if len(set(heights)) > 1:
                raise ValueError(f"{key}: images of several shapes")
            n, shape = len(heights), (heights[0], *shape)
        whole = shape if n == 1 and pieces[-1]["single"] else (n, *shape)
        packed = [s for r in pieces for s in r["strips"]] if pieces[0]["strips"] else None
        write_pieces(plain(key), whole, dtype, core_rank or len(shape), [r["path"] for r in pieces], packed)
        return pa.table({"key": [key], "images": pa.array([n], pa.int64())})

    made = cut(rows.mapInArrow(write, PIECES).groupBy("key").applyInArrow(join, "key string, images bigint"))
    for r in made.select(F.regexp_replace("key", "[^/]*$", "").alias("folder")).distinct().toLocalIterator():
        shutil.rmtree(f"{plain(r.folder)}{job}", ignore_errors=True)
    return made


PIECE = pa.schema([("key", pa.string()), ("first", pa.int64()), ("then", pa.int64()), ("last", pa.int64()), ("path", pa.string()), ("images", pa.int64()), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("single", pa.bool_()), ("heights", pa.list_(pa.int64())), ("strips", pa.list_(pa.int64()))])


class _Range(InputPartition):
    def __init__(self, path: str, begin: int | None, end: int | None):
        self.path, self.begin, self.end = path, begin, end


#: Readers that a Python worker keeps open.
opened = lru_cache(maxsize=64)(open_image)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        import glob

        self.paths = sorted(glob.glob(options["path"])) or [options["path"]]
        self.images = int(options.get("images_per_partition", 1024))
        self.dtype = numerical_type(options["dtype"]) if options.get("dtype") else None
        self.begin, self.end = int(options.get("idx_begin", 0)), options.get("idx_end")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            n = open_image(path).count
            stop = min(n, int(self.end)) if self.end is not None else n
            out += [_Range(path, k, min(k + self.images, stop)) for k in range(self.begin, stop, self.images)] if n else [_Range(path, None, None)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        f = opened(partition.path)
        for k in [None] if partition.begin is None else range(partition.begin, partition.end):
            array = f.read(k)
            array = cast(array, numpy_type(self.dtype)) if self.dtype else array
            yield tuple(tensor(partition.path, k, array, self.dtype or f.dtype).values())


@dataclass
class _Written(WriterCommitMessage):
    """A task's file: where it lies, and what it shall be called."""

    staged: str | None = None
    name: str | None = None


class _Writer(DataSourceWriter):
    """One file a task, ``path/part-<task>-<job><extension>``: written to a folder of the job, renamed into place once all have ended.

    Appending leaves earlier files; overwriting removes them once the new ones are written. A job that fails leaves nothing.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.extension, self.core_rank = options["path"].rstrip("/"), options.get("extension", ".mrcs"), int(options.get("core_rank", 2))
        self.job, self.overwrite = uuid.uuid4().hex[:12], overwrite
        self.staging = f"{self.folder}/_staged-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        found = sorted(rows, key=lambda r: (r.key, r.idx is None, r.idx or 0))
        if not found:
            return _Written()
        os.makedirs(self.staging, exist_ok=True)
        stack = np.stack([np.frombuffer(r.data, numpy_type(r.dtype)).reshape(r.shape) for r in found])
        context = TaskContext.get()
        staged = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}{self.extension}"
        write_image(staged, stack, self.core_rank)
        return _Written(staged, f"part-{context.partitionId():05d}-{self.job}{self.extension}")

    def commit(self, messages: list) -> None:
        os.makedirs(self.folder, exist_ok=True)
        before = [n for n in os.listdir(self.folder) if n.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.staged:
                os.replace(m.staged, f"{self.folder}/{m.name}")
        for name in before:
            path = f"{self.folder}/{name}"
            shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class ImageSource(DataSource):
    """``spark.read.format("arrayloom")``; options: dtype, idx_begin, idx_end, images_per_partition, extension, core_rank."""

    @classmethod
    def name(cls) -> str:
        return "arrayloom"

    def schema(self) -> str:
        return STACK

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _EventReader(DataSourceReader):
    def __init__(self, options: dict):
        import glob

        self.paths, self.frames = sorted(glob.glob(options["path"])) or [options["path"]], int(options.get("frames_per_partition", 64))
        self.begin, self.end = int(options.get("begin", 0)), options.get("end")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            n = len(open_timeline(path).pages)
            stop = n if self.end is None else int(self.end)
            if not 0 <= self.begin <= stop <= n:
                raise IndexError("the stretch reaches out of the acquisition")
            out += [_Range(path, t, min(t + self.frames, stop)) for t in range(self.begin, stop, self.frames)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        line = open_timeline(partition.path)
        for t in range(partition.begin, partition.end):
            at = line.frame(t).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(at), pa.string()), pa.array(np.full(len(at), t)), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["key", "t", "y", "x"])


class EventSource(DataSource):
    """``spark.read.format("arrayloom_events")``: timelines on mounted paths, in partitions of a file and a range of its frames.

    Options: begin and end (the stretch of frames that is read at all), frames_per_partition.
    """

    @classmethod
    def name(cls) -> str:
        return "arrayloom_events"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _EventReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)
    spark.dataSource.register(EventSource)


