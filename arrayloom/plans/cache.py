"""A materialised cache of image slots in a shared folder: runs of held indices as Parquet, fingerprints, a size budget."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.functions.locations import group_locations
from arrayloom.operators.planning import fit_budget, number_regions

VERSION = 1
# FNV-1a of 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(run_length: int, files: list[tuple[str, str, list[int], list[int]]]) -> str:
    """Of what a cache holds: run length, and per file (ascending) its key, type, extents and held indices."""
    return f"{fnv1a(json.dumps([VERSION, run_length, sorted(files)], separators=(',', ':')).encode()):016x}"


def held(locations: DataFrame, images: DataFrame, slot_bytes: str, max_size: int | None, run_length: int) -> DataFrame:
    """(key, idx, run): the indices a cache holds. Files come in ascending order, of each its leading indices, as far as they fit.

    ``images(key, <slot_bytes>, n)`` gives the bytes of a slot and the number of slots; a location of the whole file
    asks for all. Nothing to hold is an error.
    """
    if run_length < 1:
        raise ValueError("a run must hold an index")
    asked = group_locations(locations).join(images, "key")
    every = F.when(F.col("whole"), F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.col("indices"))
    slots = asked.select("key", F.explode(every).alias("idx"), F.col(slot_bytes).alias("size"))
    fitted = slots if max_size is None else fit_budget(slots, max_size, [F.col("key"), F.col("idx")], "size")
    if fitted.isEmpty():
        raise ValueError("there is nothing to hold")
    numbered = number_regions(fitted, "key", "idx")
    return numbered.select("key", "idx", F.call_function("div", F.col("place").cast("bigint"), F.lit(run_length).cast("bigint")).alias("run"))


class Scratch:
    """A cache folder: one Parquet table of (key, idx, run, mtime, ...) for each fingerprint.

    Whole runs are stored, with their file's modification time; a run whose file has another one since, or none
    that is known, is read again. Every fill writes a table of its own; readers take the newest that is complete, and the
    one before it stays until the fill after, so nobody's table goes while it is read. Fills and evictions of one folder
    wait for one another. Over the budget the tables read longest ago go first.
    """

    def __init__(self, spark: SparkSession, folder: str, print_: str, budget: int | None = None, patience: float = 600):
        self.spark, self.folder, self.print, self.budget, self.patience = spark, folder.rstrip("/"), print_, budget, patience
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @contextmanager
    def _alone(self) -> Iterator[None]:
        """A file that only one can create; one that its owner left behind gives way after ``patience`` seconds."""
        lock, began = self._path(f"{self.folder}/_lock"), time.time()
        self._fs.mkdirs(self._path(self.folder))
        while not self._fs.createNewFile(lock):
            if time.time() - began > self.patience:
                self._fs.delete(lock, False)
            time.sleep(0.2)
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def _tables(self, print_: str | None = None) -> list[tuple[str, int, int]]:
        """(path, when last read, bytes) of the complete tables, in the order of their writing."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = []
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.endswith("-scratch") and (print_ is None or name.startswith(f"{print_}.")) and self._fs.exists(self._path(s.getPath(), "_SUCCESS")):
                times = [self._fs.getFileStatus(p).getModificationTime() for p in (self._path(s.getPath(), "_SUCCESS"), self._path(s.getPath(), "_used")) if self._fs.exists(p)]
                found.append((name.split(".")[1], s.getPath().toString(), max(times), self._fs.getContentSummary(s.getPath()).getLength()))
        return [t[1:] for t in sorted(found)]

    def rows(self) -> DataFrame | None:
        """The newest table, marked as read."""
        tables = self._tables(self.print)
        if not tables:
            return None
        self._fs.create(self._path(f"{tables[-1][0]}/_used"), True).close()
        return self.spark.read.parquet(tables[-1][0])

    def fresh(self, files: DataFrame) -> DataFrame | None:
        """Held rows of ``files(key, mtime)`` that haven't changed."""
        rows = self.rows()
        return None if rows is None else rows.join(files.select("key", "mtime"), ["key", "mtime"])

    def store(self, wanted: DataFrame, source: DataFrame, files: DataFrame) -> DataFrame:
        """Fill the cache with the rows of ``wanted(key, idx, run)``: those still fresh, and the source's for the rest."""
        with self._alone():
            old = self.fresh(files)
            new = wanted if old is None else wanted.join(old.select("key", "run").distinct(), ["key", "run"], "left_anti")
            loaded = new.join(source, ["key", "idx"]).join(files.select("key", "mtime"), "key")
            rows = loaded if old is None else loaded.unionByName(old.join(wanted.select("key", "idx"), ["key", "idx"], "left_semi").select(*loaded.columns))
            before = self._tables(self.print)
            rows.write.parquet(f"{self.folder}/{self.print}.{int(time.time() * 1000):013d}.{uuid.uuid4().hex[:8]}-scratch")
            for path, *_ in before[:-1]:
                self._fs.delete(self._path(path), True)
            self._evict()
        return self.rows()

    def evict(self) -> list[str]:
        """Remove other tables, read longest ago first, until all fit the budget."""
        with self._alone():
            return self._evict()

    def _evict(self) -> list[str]:
        if self.budget is None:
            return []
        tables, gone = self._tables(), []
        total = sum(t[2] for t in tables)
        for path, _, size in sorted(tables, key=lambda t: (t[1], t[0])):
            if total <= self.budget:
                break
            if f"/{self.print}." not in path:
                self._fs.delete(self._path(path), True)
                total -= size
                gone.append(path)
        return gone
