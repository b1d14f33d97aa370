"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are compared by the three-byte subsequences they share; one that spans s places weighs DECAY**s, and
spans are at most SPAN. Inserted or skipped characters therefore lessen a similarity but don't end it. The
kernel is normalised. A few landmark strings give the Nystroem map z(u) = K_LL^(-1/2) k_L(u); a linear support
vector machine (squared hinge) on z is f(u) = beta . k_L(u) + b. As each k(l, u) is a product of subsequence
weights, f(u) is one sum over u's own subsequences of a table made once, over u's norm.

The machine is trained on labelled sentences, each a bag of windows (its words, with a blank at both ends; letters
written apart are joined, long words cut into overlapping strings). Every distinct window of a sentence has the
label of its sentence, so a window that both kinds have pulls both ways and what only toxic ones have pulls up. All
windows of the labelled sentences take part, however rare. Landmarks are windows of these sentences, those whose
two counts differ most by a test of two shares: three quarters of them more common in toxic ones, the rest in others.

A sentence's score is a logistic of its highest f and of how many of its windows lie above some levels of f, fitted
on the same sentences. Scoring is one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, prepare, slices, utf8_of

DECAY, SPAN = 0.75, 7
#: Classes of bytes: blanks, letters, digits and 27 classes for the bytes of other letters.
CLASSES = 64
#: Bytes of a window; longer words are cut into overlapping windows of that size.
WINDOW = 32
#: The labelled rows that are learned from: so many, and so many bytes of text, at most; half of both for either label.
TRAIN_ROWS, TRAIN_BYTES = 6000, 6 << 20
LANDMARKS, PENALTY = 256, 1e-5
#: Values of f above which a sentence's windows are counted.
LEVELS = (0.0, 0.2, 0.3, 0.5)
CACHE = 1 << 20
TOXIC_AT = 0.7

_CLASS = np.array([1 + b - 97 if 97 <= b <= 122 else 27 + b - 48 if 48 <= b <= 57 else 0 if b == 32 else 37 + b % 27 for b in range(256)], np.int64)
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_MARKS = string.punctuation.encode()
_LETTER = rb"(?:[a-z0-9]|[\xc2-\xf4][\x80-\xbf]{1,3})"
_APART = re.compile(rb"(?<!\S)(?:" + _LETTER + rb"\s){2,}" + _LETTER + rb"(?!\S)")


def strings_of(text: bytes) -> list[bytes]:
    """A text's strings: lower-cased words without ASCII marks; runs of three or more single letters are joined."""
    plain = text.translate(_LOWER, _MARKS)
    return _APART.sub(lambda m: b"".join(m[0].split()), plain).split()


def cut_up(word: bytes) -> list[bytes]:
    """The windows of a word, with a blank where it begins and ends."""
    word = b" " + word + b" "
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def windows(text: bytes) -> set[bytes]:
    return {w for s in set(strings_of(text)) for w in cut_up(s)}


@cache
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (three columns) and weights of all subsequences of a string of ``size`` bytes."""
    found = [(i, i + j, i + k) for i in range(size) for j, k in combinations(range(1, min(SPAN, size - i)), 2)]
    places = np.array(found, np.int64).reshape(-1, 3)
    return places, DECAY ** (places[:, 2] - places[:, 0] + 1).astype(np.float64)


def subsequences(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the distinct subsequences of each string; those under three bytes have none."""
    rows, codes, weights = [], [], []
    sizes = np.array([len(s) for s in strings])
    for size in sorted({int(n) for n in sizes if n >= 3}):
        at = np.flatnonzero(sizes == size)
        places, weight = _places(size)
        letters = _CLASS[np.frombuffer(b"".join([strings[i] for i in at]), np.uint8).reshape(-1, size)]
        a, b, c = letters[:, places[:, 0]], letters[:, places[:, 1]], letters[:, places[:, 2]]
        codes.append(((a * CLASSES + b) * CLASSES + c).ravel())
        rows.append(np.repeat(at, len(weight)))
        weights.append(np.tile(weight, len(at)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate(rows) * CLASSES**3 + np.concatenate(codes)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] // CLASSES**3, key[first] % CLASSES**3, np.add.reduceat(np.concatenate(weights)[order], first)


def features(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``subsequences`` with the weights of each row scaled to norm 1."""
    row, code, weight = subsequences(strings)
    norm = np.sqrt(np.bincount(row, weight**2, len(strings)))
    return row, code, weight / norm[row] if len(row) else weight


def kernel(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The normalised kernel of each string of ``a`` with each of ``b`` (0 for strings of under three bytes)."""
    other, code, weight = features(b)
    codes, at = np.unique(code, return_inverse=True)
    known = np.full(CLASSES**3, len(codes))  # codes of no string of b share the last, empty row
    known[codes] = np.arange(len(codes))
    table = np.zeros((len(codes) + 1, len(b)))
    table[at, other] = weight
    out = np.zeros((len(a), len(b)))
    for k in range(0, len(a), 512):
        row, code, weight = features(a[k : k + 512])
        some = known[code] < len(codes)
        row, code, weight = row[some], known[code[some]], weight[some]
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[k + row[first]] = np.add.reduceat(table[code] * weight[:, None], first)
    return out


@dataclass
class Machine:
    """Table over subsequences and bias of f, and the logistic over a text's ``evidence``."""

    table: np.ndarray
    bias: float
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(LEVELS)))

    def values(self, strings: list[bytes]) -> np.ndarray:
        row, code, weight = subsequences(strings)
        norm = np.sqrt(np.bincount(row, weight**2, len(strings)))
        return np.bincount(row, weight * self.table[code], len(strings)) / np.maximum(norm, 1e-12) + self.bias

    def evidence(self, texts: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        """For each text the highest f, the log of 1 + the distinct strings above each level, and 1; of no string f is the bias."""
        bags = [set(strings_of(t)) for t in texts]
        new = list(set().union(*bags).difference(known)) if bags else []
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(set().union(*bags))
        parts = [cut_up(s) for s in new]
        for a in range(0, len(parts), 4096):
            some = parts[a : a + 4096]
            values = self.values([p for ps in some for p in ps])
            best = np.maximum.reduceat(values, np.cumsum([0, *[len(ps) for ps in some[:-1]]]))
            known.update(zip(new[a : a + 4096], best.tolist(), strict=True))
        out = np.zeros((len(texts), 2 + len(LEVELS)))
        out[:, 0], out[:, -1] = self.bias, 1
        for k, bag in enumerate(bags):
            if bag:
                found = np.fromiter(map(known.__getitem__, bag), float, len(bag))
                out[k, 0] = found.max()
                if out[k, 0] > LEVELS[0]:
                    found = found[found > LEVELS[0]]
                    out[k, 1:-1] = [np.log1p(np.count_nonzero(found > level)) for level in LEVELS]
        return out

    def scores(self, texts: list[bytes], known: dict[bytes, float]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts, known) @ self.logistic, -30, 30)))


@dataclass
class Nystroem:
    """The map z(u) = K_LL^(-1/2) k_L(u) of some landmarks."""

    marks: list[bytes]

    def __post_init__(self):
        values, vectors = np.linalg.eigh(kernel(self.marks, self.marks))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-9))

    def map(self, strings: list[bytes]) -> np.ndarray:
        """z of each string, with a 1 behind it."""
        out = np.ones((len(strings), len(self.marks) + 1), np.float32)
        for k in range(0, len(strings), 8192):
            out[k : k + 8192, :-1] = kernel(strings[k : k + 8192], self.marks) @ self.root
        return out

    def machine(self, w: np.ndarray) -> Machine:
        row, code, share = features(self.marks)
        return Machine(np.bincount(code, share * (self.root @ w[:-1])[row], CLASSES**3), float(w[-1]))


def fit_hinge(z: np.ndarray, toxic: np.ndarray, clean: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The w that makes sum(toxic * max(0, 1 - f)**2 + clean * max(0, 1 + f)**2) / 2 + penalty * |w|**2 / 2 least, f = z w.

    Row k of z counts toxic[k] times as positive and clean[k] times as negative; both are scaled to a sum of 1. The
    last column of z, that of the bias, isn't penalised.
    """
    up, down = toxic / max(toxic.sum(), 1e-12), clean / max(clean.sum(), 1e-12)
    w = np.zeros(z.shape[1])
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-8
    for _ in range(50):  # Newton steps; the active set settles after a few
        left, right = np.diag(shrink), np.zeros(len(w))
        for k in range(0, len(z), 8192):
            part = z[k : k + 8192].astype(float)
            f = part @ w
            a, b = up[k : k + 8192] * (f < 1), down[k : k + 8192] * (f > -1)
            left = left + (part * (a + b)[:, None]).T @ part
            right += part.T @ (a - b)
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def telling(strings: list[bytes], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, n: int) -> list[bytes]:
    """The n strings whose shares in toxic and clean sentences differ most (in standard errors), three quarters of them to toxic; ties by the string."""
    share = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    apart = (toxic / n_toxic - clean / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    order = sorted(range(len(strings)), key=lambda k: (-apart[k], strings[k]))
    return [strings[k] for k in dict.fromkeys(order[: n - n // 4] + order[::-1][: n // 4])]


def learn(texts: list[bytes], labels: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """A machine for labelled sentences (1 toxic, 0 clean), of both kinds."""
    bags = [sorted(windows(t)) for t in texts]
    strings = sorted(set().union(*bags))
    if not strings:
        return Machine(np.zeros(CLASSES**3), 0.0)
    at = {s: k for k, s in enumerate(strings)}
    member = np.fromiter((at[s] for b in bags for s in b), np.int64, sum(map(len, bags)))
    of_toxic = np.repeat(labels, [len(b) for b in bags]) > 0
    toxic, clean = (np.bincount(member[x], minlength=len(strings)).astype(float) for x in (of_toxic, ~of_toxic))
    nystroem = Nystroem(telling(strings, toxic, clean, int((labels > 0).sum()), int((labels <= 0).sum()), landmarks))
    machine = nystroem.machine(fit_hinge(nystroem.map(strings), toxic, clean))
    machine.logistic = fit_logistic(machine.evidence(texts, {}), labels)
    return machine


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps, both labels weighing the same."""
    w, weight = np.zeros(x.shape[1]), np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (weight * (p - (y > 0))) + 1e-4 * w)
    return w


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, label, text of the rows learned from, one for each id: never those held out, and bounded for either label.

    Of each label they are the first ``rows / 2`` ids in the order of a hash, as far as their texts sum to ``size / 2``
    bytes. An id that labels both ways is toxic; of an id's texts the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("double") > 0).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit("train"), "doc_id")
    some = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(rows // 2) for k in (0, 1)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    before = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # of ``rows`` rows
    summed = cut(texts).withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(before))
    return summed.where(F.col("bytes") <= size // 2).drop("bytes")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Machine | None:
    """Fit on the ``labelled`` rows; None without texts of both labels."""
    prepare(docs.sparkSession)
    found = sorted(labelled(docs, labels, rows, size).select("doc_id", "label", "text").collect())
    y = np.array([r.label for r in found])
    if not len(y) or y.min() == y.max():
        return None
    return learn([r.text.encode() for r in found], y)


_KNOWN: dict[bytes, dict[bytes, float]] = {}


def _scoring(machine: Machine, name: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _KNOWN:  # values of strings outlive a task, not a model
            _KNOWN.clear()
            _KNOWN[name] = {}
        for batch in batches:
            texts = utf8_of(batch.column(1))
            for a, b in slices(map(len, texts)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(machine.scores(texts[a:b], _KNOWN[name]))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, at: float = TOXIC_AT, size: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``.

    A null text is scored as the empty one; a null id is not held out; repeated rows are scored each; an
    empty table gives no rows. Without labelled texts of both kinds every score is 0.5.
    """
    machine = train(docs, labels, rows, size)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if machine is None:
        scored = own.select("doc_id", F.lit(0.5).alias("score"))
    else:
        name = machine.table.tobytes()[:4096] + machine.logistic.tobytes()
        scored = own.mapInArrow(_scoring(machine, name), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
