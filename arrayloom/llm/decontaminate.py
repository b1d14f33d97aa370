"""Benchmark decontamination by spaced-seed hashing.

A mask names the places of a window that are hashed; the others are ignored, so a substitution there does
not hide the overlap. Hashes of all masked windows of the benchmark are joined with those of the training
texts; each hit fixes an alignment of one item with one text, along which words are compared. An overlap is
a stretch of that alignment that is long and similar enough; the masks leave a hit in every such stretch.

A benchmark of up to ``INDEX_BYTES`` of text is one index that goes to every worker: one narrow pass over the
texts. A larger one is joined: its hashes set the bits of a filter of fixed size, one pass over the texts gives
the hashes that pass it, a shuffle join with the benchmark's hashes gives the pairs of text and item to look at,
and each is verified by itself. Nothing that grows with the benchmark is then sent to a worker or the driver.

Alignments are gathered in a bitmap over ranges of the text and verified as arrays, both in pieces of bounded
size, so a text that repeats one word a million times takes work in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, prepare, slices, texts_of, unused
from arrayloom.llm.words import plain, window_hashes, word_hashes

#: Hashed places of each window. In 13 to 25 words any fifth may differ and leaves one of them whole somewhere (tested over
#: all placements); of a longer stretch one of two halves agrees as well as the whole, so it has one of these within.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 7), (0, 1, 2, 4, 5))
#: The same for items of 5 to 12 words; those of fewer words must agree in all, so their window is the item.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Words of an overlap (fewer if the item is shorter) and the share that must agree: a word that agrees gains 1, another loses 4.
LEAST_WORDS, LEAST_SIMILARITY, LOSS = 13, 0.8, 4
#: Benchmark text that goes to the workers as an index (some 25 times as many bytes), and bits of the filter beyond.
INDEX_BYTES, FILTER_BITS = 1 << 20, 22
#: Array elements handled at once, and alignments marked at once.
PIECE, MARKED = 1 << 20, 1 << 24


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks whose windows find an item of n words."""
    return MASKS if n >= LEAST_WORDS else SHORT_MASKS if n >= 5 else (tuple(range(n)),) if n else ()


def seeds_of(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash for each window of the mask."""
    return window_hashes(words, list(mask), sum(1 << p for p in mask))


#: Masks of any item.
ALL_MASKS = (*MASKS, *SHORT_MASKS, *(tuple(range(n)) for n in range(1, 5)))


@dataclass
class Index:
    """Masked-window hashes of some items, sorted, with the item and place of each."""

    ids: list
    words: list[np.ndarray]
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[tuple]) -> Index:
        lists = [(i, word_hashes([plain(t or "")])[0]) for i, t in items]
        lists = [(i, w) for i, w in lists if len(w)]
        words = [w for _, w in lists]
        seeds = []
        for mask in ALL_MASKS:
            found = [(seeds_of(w, mask), k) for k, w in enumerate(words) if mask in masks_for(len(w))]
            if not found:
                continue
            hashes = np.concatenate([h for h, _ in found])
            owner = np.concatenate([np.full(len(h), k, np.int32) for h, k in found])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in found])
            order = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << FILTER_BITS if len(hashes) > 4096 else 1 << 16, bool)
            known[bit_of(hashes, known)] = True
            seeds.append((mask, hashes[order], owner[order], place[order], known))
        return cls([i for i, _ in lists], words, seeds)

    def windows(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(seed table, starts of windows with a hash of it, first entry, entries), the starts in order."""
        out = []
        for k, (mask, hashes, _, _, known) in enumerate(self.seeds):
            own = seeds_of(words, mask)
            at = np.flatnonzero(known[bit_of(own, known)])
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            hit = high > low
            if hit.any():
                out.append((k, at[hit], low[hit], (high - low)[hit]))
        return out

    def alignments(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places of its first word in ``words``) for all windows with a hash of the index."""
        windows = self.windows(words)
        if not windows:
            return
        items = np.unique(np.concatenate([_values(self.seeds[k][2], low, n) for k, _, low, n in windows]))
        slot = np.zeros(len(self.words), np.int64)
        slot[items] = np.arange(len(items))
        longest = max(len(self.words[k]) for k in items.tolist())
        reach = max(1024, MARKED // len(items) - longest)
        starts = np.unique(np.concatenate([at // reach for _, at, _, _ in windows])) * reach
        for begin in starts.tolist():
            marks = np.zeros((len(items), reach + longest), bool)
            for k, at, low, n in windows:
                a, b = np.searchsorted(at, [begin, begin + reach])
                cuts = a + np.searchsorted(np.cumsum(n[a:b]), np.arange(PIECE, int(n[a:b].sum()), PIECE))
                for c, d in zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True):
                    entry = _spread(low[c:d], n[c:d])
                    marks[slot[self.seeds[k][2][entry]], np.repeat(at[c:d] - begin + longest, n[c:d]) - self.seeds[k][3][entry]] = True
            for row, item in enumerate(items.tolist()):
                if len(found := np.flatnonzero(marks[row])):
                    yield item, found + (begin - longest)


def bit_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - len(known).bit_length())).astype(np.intp)


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The entries low, low + 1, ... (n of each) behind one another."""
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _values(owner: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distinct owners of entry ranges; equal ranges are looked at once."""
    first = np.unique(low, return_index=True)[1]
    return np.unique(owner[_spread(low[first], n[first])])


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of gains (1, -LOSS, or less where nothing may be): found, begin and end of its best stretch.

    Of all stretches of ``least`` places or more it is that of the greatest sum, which must not be negative; the
    first of equals, by its end, then by its begin.
    """
    total = np.zeros((len(same), same.shape[1] + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    lowest = np.minimum.accumulate(total[:, : total.shape[1] - least], axis=1)
    gain = total[:, least:] - lowest
    end = gain.argmax(axis=1)
    rows = np.arange(len(same))
    begin = (total[:, : lowest.shape[1]] == lowest[rows, end][:, None]).argmax(axis=1)
    return gain[rows, end] >= 0, begin, end + least


def _rated(own: np.ndarray, words: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows (text, agreeing, words, -first word in the text, -first word in the item) for the overlaps along some alignments."""
    size, least = len(own), min(LEAST_WORDS, len(own))
    # an alignment over a border of texts puts the item on each of them
    low = np.searchsorted(starts, np.maximum(places, 0), "right") - 1
    high = np.minimum(np.searchsorted(starts, places + size - 1, "right") - 1, len(starts) - 2)
    n = np.maximum(high - low + 1, 0)
    text, places = _spread(low, n), np.repeat(places, n)
    at = places[:, None] + np.arange(size)
    inside = (at >= starts[text][:, None]) & (at < starts[text + 1][:, None])
    same = (words[np.clip(at, 0, len(words) - 1)] == own) & inside
    found, begin, end = stretches(np.where(inside, np.where(same, 1, -LOSS), -(size + 1) * LOSS).astype(np.int32), least)
    total = np.zeros((len(same), size + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    rows = np.arange(len(same))
    return np.stack([text, total[rows, end] - total[rows, begin], end - begin, starts[text] - places - begin, -begin], axis=1)[found]


def overlaps(index: Index, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, first word in the text, words, agreeing words, first word in the item), the best of each pair."""
    best: dict[tuple[int, int], tuple] = {}
    for item, places in index.alignments(words):
        own = index.words[item]
        step = max(1, PIECE // len(own))
        for k in range(0, len(places), step):
            rows = _rated(own, words, starts, places[k : k + step])
            if len(rows):
                order = np.lexsort(rows.T[::-1])
                last = np.flatnonzero(np.append(rows[order][1:, 0] != rows[order][:-1, 0], True))
                for text, *row in rows[order][last].tolist():
                    best[text, item] = max(best.get((text, item), tuple(row)), tuple(row))
    return [(text, item, -p, size, agree, -q) for (text, item), (agree, size, p, q) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, words long, agreeing long"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in schema.split(", ")])


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for a, b in slices(map(len, texts)):
                words, starts = word_hashes([plain(t) for t in texts[a:b]])
                rows = [(ids[a + text], index.ids[item], p, q, size, agree) for text, item, p, size, agree, q in overlaps(index, words, starts)]
                if rows:
                    yield _batch(SCHEMA, rows)

    return run


def _seeding(masks_of: Callable[[int], tuple], filters: dict[int, bytes] | None):
    """Over (key, text): (key, seed) for the distinct window hashes of each text; of those that pass the filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if filters is not None:
            known = np.zeros(1 << (FILTER_BITS + 3), bool)
            for bucket, bits in filters.items():
                known[(bucket - 1) * 32768 : bucket * 32768] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = word_hashes([plain(text)])[0]
                own = [seeds_of(words, m) for m in masks_of(len(words))]
                if known is not None:
                    own = [h[known[bit_of(h, known)]] for h in own]
                found = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
                for k in range(0, len(found), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found[k : k + PIECE]), pa.int64()), pa.array(found[k : k + PIECE].view(np.int64))], names=["key", "seed"])

    return run


@lru_cache(256)
def _index_of(text: str) -> Index:
    return Index.build([(0, text)])


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (doc_id, text, item_id, item): the overlap of each pair, if there is one."""
    for batch in batches:
        rows = []
        for doc_id, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words, starts = word_hashes([plain(text)])
            rows += [(doc_id, item_id, p, q, size, agree) for _, _, p, size, agree, q in overlaps(_index_of(item), words, starts)]
        if rows:
            yield _batch(SCHEMA, rows)


def _joined(own: DataFrame, items: DataFrame) -> DataFrame:
    """The overlaps by a join of hashes; texts and items go by 64-bit hashes of what they say, so equal ones are looked at once."""
    keyed = items.select(F.xxhash64("text").alias("item"), "item_id", "text")
    distinct = keyed.groupBy("item").agg(F.first("text").alias("text"))
    tests = cut(distinct.mapInArrow(_seeding(masks_for, None), "key long, seed long").withColumnRenamed("key", "item"))
    bits = F.shiftrightunsigned("seed", 64 - FILTER_BITS - 3)
    # bits are numbered from 1 there: at most 2 ** (FILTER_BITS + 3) of them, 4 MB
    filters = tests.groupBy(F.call_function("bitmap_bucket_number", bits + 1).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", bits + 1)).alias("bits"))
    sent = {r.bucket: bytes(r.bits) for r in filters.collect()}
    hashed = own.select("doc_id", F.xxhash64("text").alias("key"), "text").where("text is not null")
    seen = hashed.select("key", "text").mapInArrow(_seeding(lambda n: ALL_MASKS, sent), "key long, seed long")
    pairs = cut(seen.join(tests, "seed").select("key", "item").distinct())
    some = hashed.join(pairs.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "doc_id", "text")
    looked = some.join(pairs, "key").join(keyed.withColumnRenamed("text", "item_text"), "item")
    return looked.select("doc_id", "text", "item_id", "item_text").mapInArrow(_verifying, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The best overlap of every text with every item: doc_id, item_id, doc_word, item_word, words, agreeing, similarity.

    Words are lower-cased and lose ASCII punctuation; places count words from 0. An overlap has 13 words (as many
    as the item, if that has fewer) or more, of which four fifths agree. Null or empty texts and items have no words
    and overlap with nothing. Rows with a null id take part (a null id is given out); repeated rows of ``docs`` give
    repeated results, those of ``benchmark`` count once; texts of any length are read whole; empty tables give no
    rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    if size <= index_bytes:
        found = own.mapInArrow(_scan(Index.build([(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()])), SCHEMA)
    else:
        found = _joined(own, items)
    return found.withColumn("similarity", F.col("agreeing") / F.col("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that overlap with no item; rows with a null id stay."""
    name = unused(docs, "dirty_id")
    dirty = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).where(f"{name} is not null").distinct()
    return docs.join(dirty, docs["doc_id"] == dirty[name], "left_anti")
