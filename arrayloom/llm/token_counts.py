"""Token counts by overlap resynchronisation.

A text is cut where no vocabulary piece can reach across (a *stable* boundary): BPE only ever joins
symbols whose concatenation is a piece, so if no piece holds the character pair (x, y) side by side, no
symbol spans a boundary between x and y, and the encodings of both sides are independent.

Huge texts are encoded as overlapping chunks with offsets. Two neighbours are spliced at a position in
their overlap where both have a token boundary (of whole words, where words are independent) and the
character pair is stable; where there is none, the
overlap is widened (to the end of the text if need be). Shorter texts are summed over their words, which
the same proof makes independent, each word being encoded once per worker.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import prepare, slices, texts_of, with_arrays

#: Characters of a chunk and of the overlap tried first.
CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
#: Words kept with their counts in each worker.
CACHE_WORDS = 1 << 20
META = "▁"


class Counter:
    """Counts tokens of whole texts as ``sentencepiece`` encodes them by default."""

    def __init__(self, model: bytes, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        import sentencepiece

        if not 0 < overlap < chunk:
            raise ValueError("the overlap must be positive and shorter than the chunk")
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        probe = "Aé ﬁ ①  b "  # a normaliser would change it
        kept = self.sp.decode(self.sp.encode(probe)) == probe
        self.by_words = kept and not any(pair[1] == META and pair[0] != META for pair in self.joined)
        self.leads = np.array([self.sp.id_to_piece(i).startswith(META) for i in range(self.sp.get_piece_size())])
        self.words = {"": 0}
        self.widened = 0

    def stable(self, text: str, at: int) -> bool:
        """No piece can span the boundary before character ``at``."""
        return text[at - 1 : at + 1].replace(" ", META) not in self.joined

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) > self.chunk:
            return self._spliced(text)
        return sum(self._words(text.split(" "))) if self._plain(text, 0) else len(self.sp.encode(text))

    def _plain(self, text: str, begin: int) -> bool:
        """Each word is encoded with the one space before it; other spaces are pieces of their own."""
        return self.by_words and "  " not in text and META not in text and text[-1] != " " and (begin > 0 or text[0] != " ")

    def _words(self, words: list[str]) -> list[int]:
        """Tokens of each word with the space before it; new words are encoded in one go and told apart by that space."""
        known = self.words
        new = list(set(words).difference(known))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            known[""] = 0
            new = list(set(words).difference(known))
        if new:
            ids = np.array(self.sp.encode(" ".join(new)), np.intp)
            firsts = np.flatnonzero(self.leads[ids])
            known.update(zip(new, np.diff(firsts, append=len(ids)).tolist(), strict=True))
        return list(map(known.__getitem__, words))

    def _encode(self, text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
        """text[begin:end] encoded for itself: ends of words or tokens, as places in the text, and tokens of each."""
        part = text[begin:end]
        if self._plain(part, begin):
            words = part.split(" ")
            ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n, initial=begin - 1))
            return ends[1:], self._words(words)
        ends = [begin + last for _, last in self.sp.encode(part, return_type="offset_mapping")["offsets"]]
        return ends, [1] * len(ends)

    def _spliced(self, text: str) -> int:
        size, total, done = len(text), 0, -1  # what ends at or before ``done`` is counted
        begin, end, overlap = 0, min(len(text), self.chunk), self.overlap
        left, counts = self._encode(text, begin, end)
        while end < size:
            start, stop = max(begin, end - overlap), min(size, end + self.chunk - self.overlap)
            right, right_counts = self._encode(text, start, stop)
            least = max(done, start)
            common = set(right[: bisect_left(right, end)])
            at = next((p for p in reversed(left) if least < p < end and p in common and self.stable(text, p)), None)
            if at is not None:
                total += sum(counts[bisect_right(left, done) : bisect_right(left, at)])
                done, begin, end, left, counts, overlap = at, start, stop, right, right_counts, self.overlap
                continue
            self.widened += 1
            if start > begin and start > done:
                overlap *= 2
            else:  # no stable boundary in all of the left chunk: it grows
                end = min(size, 2 * end - begin)
                left, counts = self._encode(text, begin, end)
        return total + sum(counts[bisect_right(left, done) :])


def counting(model: bytes, chunk: int, overlap: int, text: str):
    """The function for ``mapInArrow``; the counter is made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model, chunk, overlap)
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text)))
            for a, b in slices(map(len, texts)):
                yield with_arrays(batch.slice(a, b - a), ["n_tokens"], [pa.array([counter.count(t) for t in texts[a:b]], pa.int64())])

    return run


_COUNTERS: dict[tuple, Counter] = {}


def _counter(model: bytes, chunk: int, overlap: int) -> Counter:
    key = (hash(model), chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(model, chunk, overlap)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs(doc_id, text)``.

    A null text counts as empty (0 bytes, 0 tokens), a null id stays null, repeated rows are counted each,
    an empty table gives no rows, other columns are ignored whatever their names. One narrow pass: no shuffle.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = own.mapInArrow(counting(model, chunk, overlap, "text"), "doc_id long, text string, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
