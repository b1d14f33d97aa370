"""Quality by ordinal cumulative-link regression over hashed text.

One weight vector over hashed byte trigrams and a few text statistics gives a latent score; ordered
thresholds turn it into P(grade <= k) = logistic(threshold_k - score). The expected grade ranks documents,
the tail probability P(grade >= k) selects them. The regression is fitted on a bounded sample of the labelled
rows (``rows``); scoring is one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from arrayloom.llm._common import label_sample, prepare, slices, unused, utf8_of, with_arrays

BUCKETS = 4096
STATS = 7
#: Labelled rows that a fit uses at most.
TRAIN_ROWS = 4000
#: Documents with a lower probability of the tail grade are rejected.
KEEP_AT = 0.5


def trigrams(data: bytes) -> np.ndarray:
    """A hash bucket for each byte trigram."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.intp)


def statistics(text: bytes) -> list[float]:
    """Length, shares of distinct words, distinct lines, capitals and marks, word length, words said again at once."""
    words = text.split()
    n = len(words) or 1
    size = len(text) or 1
    lines = text.split(b"\n")
    capitals = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    marks = size - len(text.translate(None, b"*#$%&!|<>{}[]=~^\\/@_")) if text else 0
    return [np.log1p(size), len(set(words)) / n, len(set(lines)) / len(lines), capitals / size, marks / size, min(size / n, 40.0) / 10, min(1.0, 4 * sum(map(eq, words, words[1:])) / n)]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights over buckets and statistics, thresholds between the grades, and the grades in order."""

    buckets: np.ndarray
    stats: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        sums = np.zeros(len(texts))
        if len(joined) >= 3:
            running = np.concatenate([[0.0], np.cumsum(self.buckets[trigrams(joined)])])
            begins, lasts = ends - [len(t) for t in texts], np.maximum(ends - 2, 0)
            many = lasts > begins
            sums[many] = (running[lasts[many]] - running[begins[many]]) / (lasts - begins)[many]
        return sums + np.array([statistics(t) for t in texts]).reshape(-1, STATS) @ self.stats

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """A column for each grade."""
        below = logistic(self.thresholds[None, :] - scores[:, None])
        return np.diff(below, axis=1, prepend=0.0, append=1.0)

    def rate(self, texts: list[bytes], tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= tail) of each text."""
        p = self.probabilities(self.scores(texts))
        grades = np.array(self.grades, float)
        return p @ grades, np.clip(p[:, grades >= tail].sum(axis=1), 0.0, 1.0)


def fit_ordinal(z: np.ndarray, y: np.ndarray, steps: int = 500, penalty: float = 3e-3) -> Ordinal:
    """Maximum penalised likelihood by Adam over standardised columns; deterministic.

    ``z`` has the bucket columns, then the statistics (float32); it is standardised in place.
    """
    grades, width = sorted(set(y.tolist())), z.shape[1] - STATS
    mean = z.mean(axis=0)
    z -= mean
    spread = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z))
    # a rare trigram's spread is near 0; its weight would jump, so the spread has a floor
    spread = np.maximum(spread, np.concatenate([np.full(width, 2e-4), np.full(STATS, 1e-2)]).astype(np.float32))
    z /= spread
    k = np.searchsorted(grades, y)
    gaps = len(grades) - 1
    share = np.cumsum(np.bincount(k, minlength=len(grades)))[:-1] / len(k)
    first = np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    params = np.concatenate([np.zeros(z.shape[1]), theta])
    shrink = np.concatenate([np.full(width, penalty), np.full(STATS, penalty / 100)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, t = params[: z.shape[1]], params[z.shape[1] :]
        cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        s = z @ w.astype(np.float32)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = logistic(edges[k + 1] - s), logistic(edges[k] - s)
        lower[k == 0], upper[k == gaps] = 0.0, 1.0
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad_s = (du - dl) / len(k)
        grad_cut = np.bincount(k, -du, gaps + 1)[:gaps] + np.bincount(k, dl, gaps + 1)[1:]
        tail = np.cumsum((grad_cut / len(k))[::-1])[::-1]
        grad = np.concatenate([z.T @ grad_s.astype(np.float32) + shrink * w, tail[:1], tail[1:] * np.exp(t[1:])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, t = params[: z.shape[1]] / spread, params[z.shape[1] :]
    cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])) + float(mean @ w)
    return Ordinal(w[:width].copy(), w[width:].copy(), cuts, grades)


def neutral(grades: list[int]) -> Ordinal:
    """For no labels or one grade only: every document gets that grade (1 if there is none)."""
    return Ordinal(np.zeros(BUCKETS), np.zeros(STATS), np.array([]), grades or [1])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8_of(batch.column(2))
        rows = []
        for t in texts:
            counts = np.bincount(trigrams(t), minlength=BUCKETS) / (len(t) - 2) if len(t) >= 3 else np.zeros(BUCKETS)
            rows.append(counts.astype(np.float16).tobytes() + np.array(statistics(t), np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where: str = "true") -> Ordinal:
    """Fit on at most ``rows`` labelled documents (those whose ids have the smallest hashes); whole texts.

    An id that is given repeatedly is one document with its smallest text, a null text the empty one.
    """
    prepare(docs.sparkSession)
    sample = label_sample(labels.where(where), rows, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = sample.join(texts, "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    found = some.mapInArrow(_featurise, "doc_id long, label int, x binary").toArrow()  # ``rows`` rows of some 8 KB
    order = found.select(["doc_id", "label"]).append_column("at", pa.array(np.arange(found.num_rows))).to_pandas().sort_values("doc_id")
    labels_found, half = order["label"].to_numpy(), 2 * BUCKETS
    if len(set(labels_found.tolist())) < 2:
        return neutral([int(g) for g in set(labels_found.tolist())])
    z = np.empty((len(order), BUCKETS + STATS), np.float32)
    rows_found = found.column("x")
    for k, at in enumerate(order["at"].tolist()):
        row = rows_found[at].as_py()
        z[k, :BUCKETS], z[k, BUCKETS:] = np.frombuffer(row[:half], np.float16), np.frombuffer(row[half:], np.float32)
    del found, rows_found
    pa.default_memory_pool().release_unused()
    return fit_ordinal(z, labels_found)


def rate(docs: DataFrame, model: Ordinal, tail: int | None = None, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail_probability (P(grade >= ``tail``, by default the highest)).

    A null text is rated as the empty one; all rows and columns stay. If ``docs`` has columns of these
    names already, the new ones get a leading underscore (see ``unused``).
    """
    prepare(docs.sparkSession)
    tail = model.grades[-1] if tail is None else tail
    names = [unused(docs, "expected_grade"), unused(docs, "tail_probability")]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_of(batch.column(at))
            for a, b in slices(map(len, texts)):
                grade, probability = model.rate(texts[a:b], tail)
                yield with_arrays(batch.slice(a, b - a), names, [pa.array(grade), pa.array(probability)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def quality_scores(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, expected_grade, tail_probability, keep for every row of ``docs(doc_id, text)``.

    Ties need no rule (each row is rated for itself); repeated rows are rated each; an empty table gives no
    rows; without labels, or with one grade only, every document is kept.
    """
    model = train(docs, labels, rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = rate(own, model)
    return rated.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), (F.col("tail_probability") >= keep_at).alias("keep"))


def keep_good(docs: DataFrame, model: Ordinal, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose tail probability reaches ``keep_at``."""
    columns = docs.columns
    rated = rate(docs, model)
    return rated.where(F.col(rated.columns[-1]) >= keep_at).select(*[F.col(f"`{c}`") for c in columns])
