"""Conflict-constrained best-fit packing of texts into training sequences.

Texts, longest first, go to the open bin with the least room that holds them and has neither a text of
their source nor one of their duplicate cluster. Bins are ordered by room; each carries a bitmap of its sources
and clusters. A tree over the room keeps, for each range, the bits that all its bins have: a range is passed
over if the text conflicts with one of those, else the successor search goes on inside it until the tightest
compatible bin is found, so the bin is exactly the best one.

Items are dealt by a hash to partitions of about ``BLOCK`` items and packed in blocks of at most so many; a
block's open bins are its only state. A source or cluster with a third of all rows is spread over all blocks.
Bins never span blocks: at most the last bins of a block stay half empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, prepare

CAPACITY, BLOCK = 2048, 16_384


class Bins:
    """Open bins by room, with the bits that all bins of a range of rooms have."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.bits: list[int] = []  # of each bin
        self.used: list[int] = []
        self.leaves: dict[int, dict[int, None]] = {}
        #: -1 (all bits) for a range without bins; bits of bins that have left may be missing: only less is passed over
        self.shared = [-1] * (2 * self.width)
        self.capacity = capacity

    def _set(self, room: int, value: int) -> None:
        k, tree = room + self.width, self.shared
        tree[k] = value
        while k > 1:
            k >>= 1
            both = tree[2 * k] & tree[2 * k + 1]
            if tree[k] == both:
                break
            tree[k] = both

    def find(self, size: int, bits: int) -> int | None:
        """The compatible bin with the least room of at least ``size``; of equals the one that came there first."""
        tree, width = self.shared, self.width
        stack = []
        low, high = size + width, 2 * width  # ranges that cover the rooms from size on, left to right
        right = []
        while low < high:
            if low & 1:
                stack.append(low)
                low += 1
            if high & 1:
                high -= 1
                right.append(high)
            low, high = low >> 1, high >> 1
        stack = (stack + right[::-1])[::-1]
        while stack:
            k = stack.pop()
            if tree[k] & bits or tree[k] == -1:
                continue
            if k < width:
                stack += (2 * k + 1, 2 * k)
                continue
            for b in self.leaves.get(k - width, ()):
                if not self.bits[b] & bits:
                    return b
        return None

    def put(self, size: int, bits: int) -> tuple[int, int]:
        """The bin of an item and where it begins there."""
        b = self.find(size, bits)
        if b is None:
            b = len(self.bits)
            self.bits.append(0)
            self.used.append(0)
        else:
            room = self.capacity - self.used[b]
            del self.leaves[room][b]
            if not self.leaves[room]:
                self._set(room, -1)
        start = self.used[b]
        self.used[b] += size
        self.bits[b] |= bits
        room = self.capacity - self.used[b]
        if room:
            self.leaves.setdefault(room, {})[b] = None
            self._set(room, self.shared[room + self.width] & self.bits[b])
        return b, start


def pack_block(items: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, piece, tokens, bin, start) for items (id, size, source, cluster); a long item's full pieces fill bins."""
    out, parts = [], []
    for k, (_, size, source, cluster) in enumerate(items):
        full, rest = divmod(size, capacity)
        parts += [(capacity, k, p, source, cluster) for p in range(full)]
        if rest:
            parts.append((rest, k, full, source, cluster))
    order = lambda x: (x is None, x)
    parts.sort(key=lambda p: (-p[0], order(items[p[1]][0]), p[2], order(items[p[1]][3]), order(p[3])))
    holders: dict = {}
    for _, _, _, source, cluster in parts:
        for key in (("source", source), ("cluster", cluster)):
            holders[key] = holders.get(key, 0) + (key[1] is not None)
    # who is alone in a block conflicts with nobody
    bit = {key: 1 << i for i, key in enumerate(k for k, n in holders.items() if n > 1)}
    bins = Bins(capacity)
    for size, k, piece, source, cluster in parts:
        b, start = bins.put(size, bit.get(("source", source), 0) | bit.get(("cluster", cluster), 0))
        out.append((k, piece, size, b, start))
    return out


SCHEMA = "doc_id long, source string, cluster long, piece int, piece_tokens int, bin_id long, bin_start int"


def _packing(capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, bins, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal bins, held
            rows = pack_block([(r[0], r[1], r[2], r[3]) for r in held], capacity)
            ids = [(partition << 36) + bins + b for *_, b, _ in rows]
            columns = [[held[k][0] for k, *_ in rows], [held[k][2] for k, *_ in rows], [held[k][3] for k, *_ in rows], [p for _, p, *_ in rows], [n for _, _, n, *_ in rows], ids, [s for *_, s in rows]]
            bins += 1 + max((b for *_, b, _ in rows), default=-1)
            held = []
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= block:
                    yield flush()
        if held:
            yield flush()

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Bins for ``items(doc_id, size, source, cluster)``: a row for each piece with its bin and place.

    An item takes ``size`` places and is cut into pieces of ``capacity`` (the last may be shorter). A null
    source or cluster conflicts with nothing; pieces of one item share its cluster, so they never share a
    bin unless that is null. Null or negative sizes are 0: such items get no piece. Null ids and repeated
    rows are items of their own; equal sizes go by id, piece, cluster and source. No items give no rows.
    """
    prepare(items.sparkSession)
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0))
    own = cut(items.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster")))
    shards = max(1, -(-own.count() // block))
    dealt = own.repartition(shards, F.xxhash64("doc_id", "size", "cluster", "source")).sortWithinPartitions("doc_id", "size", "cluster", "source")
    return dealt.mapInArrow(_packing(capacity, block), SCHEMA)


def text_items(docs: DataFrame, model: bytes) -> DataFrame:
    """Items of ``docs(doc_id, text, source)``: tokens and a separator each; the cluster is that of equal words.

    Texts are one cluster if they are the same but for case and white space; null and empty texts have none.
    """
    from arrayloom.llm.token_counts import CHUNK_CHARS, OVERLAP_CHARS, counting

    prepare(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    words = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    own = own.withColumn("cluster", F.when(F.length(words) > 0, F.xxhash64(words)))
    counted = own.mapInArrow(counting(model, CHUNK_CHARS, OVERLAP_CHARS, "text"), "doc_id long, text string, source string, cluster long, n_tokens long")
    return counted.select("doc_id", (F.col("n_tokens") + 1).alias("size"), "source", "cluster")
