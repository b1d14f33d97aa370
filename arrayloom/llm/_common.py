"""What the text operators share: shipping the package, reading tables, cutting lineage, slicing batches."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.plans import lineage
from arrayloom.plans.lineage import cut, shared_folder

#: Rows of one Arrow batch and text bytes handled at once in a Python worker.
ARROW_ROWS = 512
SLICE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and keep Arrow batches small (long texts).

    The session's limit on an Arrow batch's rows is lowered to ``ARROW_ROWS`` where it is higher, as it holds when a
    frame is run, not when it is made; it stays so.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_arrayloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="arrayloom")
    path = os.path.join(os.path.realpath(folder), "arrayloom_workers.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._arrayloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read again column by column, and by executors that come later."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For queries run once: their shuffle files go as they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Rows up to which a written table is read as one partition: its aggregates and joins then need no exchange.
SMALL_ROWS = 50_000


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows; the partitions follow that number, one for a small table."""
    out = cut(df)
    n = out.count()
    parts = max(1, -(-n // SMALL_ROWS))
    return (out.coalesce(parts) if parts < out.rdd.getNumPartitions() else out), n


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about ``limit``; every range has one row at least."""
    start = total = 0
    end = 0
    for end, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, end
            start, total = end, 0
        total += n + 1
    if total:
        yield start, end + 1


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def utf8_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column, null as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def with_arrays(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with further columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    return lineage.unused(name, df)


def label_sample(labels: DataFrame, rows: int, label: str, id_col: str = "doc_id") -> DataFrame:
    """A bounded training sample of labelled ids: the ``rows`` smallest by a hash of the id.

    Rows with a null id or label are left out; of repeated ids one row stays.
    """
    clean = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return clean.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(rows)
