"""The corpus pipeline: documents are rated, lines and documents deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents`` (and any others, as they are); the last returns a
row for each packed piece. A null text is an empty one; empty texts go only where the classifier rejects them; rows with a
null id are rated and packed, else kept as they are; repeated rows are judged alike, and all copies of an id's text stay
or go together; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrayloom.llm import decontaminate, line_dedup, packing, quality, setsketch
from arrayloom.llm._common import table
from arrayloom.llm.queries import piece_model
from arrayloom.plans.lineage import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place has, exactly or within two edits; emptied ones go."""
    return line_dedup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    return setsketch.keep_first(docs, words=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into training sequences."""
    return packing.pack(packing.text_items(docs, piece_model()))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
