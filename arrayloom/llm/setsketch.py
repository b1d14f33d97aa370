"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles becomes registers K_i = clip(floor(1 - log_b(x_i)), 0, q + 1), where x_i is
the minimum over the set of exponentially distributed hashes: exponentially spaced, truncated minima. Registers
of a union are the maxima of the registers, and two sets agree in a register about as often as their Jaccard
similarity J. Registers are banded; sets that share a band are candidates, their J is estimated by maximum
likelihood from how many registers are greater, less and equal, and what may reach the threshold is verified
on the full sets.

Only distinct sets ("classes") are compared. Inside a shared band no pairs are spread out: first each class
meets the smallest class of each of its bands, and what is linked is contracted. The classes of bands that
still hold several components are dealt to blocks of bounded size, each two of which meet in one task (blocks
of one component don't meet): with their registers first, by the estimate, then, of those that it leaves open,
with their full sets. Only links between components come out.

Classes and shingles are 64-bit hashes: of N distinct sets about N**2 / 2**65 pairs are taken for one another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, prepare, slices, utf8_of
from arrayloom.llm.components import components
from arrayloom.llm.words import LOWER, mix, odd_multipliers, window_hashes, word_hashes

BASE_B, RATE_A, LIMIT_Q = 1.001, 20.0, (1 << 16) - 2
ROWS = 4
#: Classes of a block.
BLOCK = 256
#: Chance that two sets at the threshold share no band.
MISS = 1e-7
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 6.0


@dataclass(frozen=True)
class Sketch:
    """Words of a shingle, the threshold in hundredths, and what follows from them."""

    words: int = 3
    percent: int = 85

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def registers(self) -> int:
        return ROWS * self.bands

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - MARGIN * math.sqrt(t * (1 - t) / self.registers)


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``words`` make one shingle."""
    hashes, starts = word_hashes([t.translate(LOWER) for t in texts])
    windows = window_hashes(hashes, list(range(words)), words)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= words:
            found = np.sort(windows[a : b - words + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            out.append(window_hashes(hashes[a:b], list(range(b - a)), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of m registers for each set; those of the empty set are 0."""
    out = np.zeros((len(sets), m), np.uint16)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    joined = np.concatenate([sets[k] for k in some])
    starts = np.cumsum([0, *[len(sets[k]) for k in some[:-1]]])
    least = np.empty((len(some), m), np.uint64)
    for i, multiplier in enumerate(odd_multipliers(m, 8)):
        least[:, i] = np.minimum.reduceat(joined * multiplier, starts)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE_A
    out[some] = np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / math.log(BASE_B)), 0, LIMIT_Q + 1).astype(np.uint16)
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    parts = rows.reshape(len(rows), bands, ROWS).astype(np.uint64) + np.uint64(1)
    keys = (parts * odd_multipliers(ROWS, 4)).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(keys)).view(np.int64)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """An order-free hash of each set."""
    sums = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return mix(sums + np.array([len(s) for s in sets], np.uint64)).view(np.int64)


def likeliest(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The J in [0, min(n_a / n_b, n_b / n_a)] under which the counts of registers are likeliest (sizes known)."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(n_a / n_b, n_b / n_a)
    p = lambda x: -np.log(np.maximum(1 - x * (BASE_B - 1) / BASE_B, 1e-12)) / math.log(BASE_B)

    def gain(j: np.ndarray) -> np.ndarray:
        more, fewer = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        same = np.maximum(1 - more - fewer, 1e-12)
        return greater * np.log(np.maximum(more, 1e-12)) + less * np.log(np.maximum(fewer, 1e-12)) + equal * np.log(same)

    low, high = np.zeros_like(top), top.copy()
    for _ in range(40):  # the likelihood is concave: ternary search
        third = (high - low) / 3
        left = gain(low + third) < gain(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _sketching(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_of(batch.column(1))
            for a, b in slices(map(len, texts)):
                sets = shingles(texts[a:b], sketch.words)
                n = np.array([len(s) for s in sets], np.int64)
                keys = band_keys(registers(sets, sketch.registers), sketch.bands)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, sketch.bands, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(class_ids(sets), mask=n == 0), lists], names=["doc_id", "n", "cls", "bands"])

    return run


def _gathering(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_of(batch.column(1))
            for a, b in slices(map(len, texts)):
                sets = shingles(texts[a:b], sketch.words)
                rows = registers(sets, sketch.registers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(class_ids(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["want", "cls", "n", "sketch", "members"],
                )

    return run


def _estimating(sketch: Sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, sketch.registers) for k in (4, 5))
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (6, 7))
            greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
            j = likeliest(greater, less, sketch.registers - greater - less, n_a, n_b)
            yield batch.filter(pa.array(j >= sketch.least_estimate)).select(["a", "b", "u", "v"])

    return run


def _verifying(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, sketch: Sketch) -> DataFrame:
    """The components (u, v) of those ``pairs(a, b, u, v)`` over the threshold: by estimate first, then on the full sets."""
    side = lambda s, *c: sets.select(F.col("cls").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in c])
    near = pairs.join(side("a", "sketch", "n"), "a").join(side("b", "sketch", "n"), "b").where(f"100 * least(n_a, n_b) >= {sketch.percent} * greatest(n_a, n_b)")
    near = near.select("a", "b", "u", "v", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(_estimating(sketch), "a long, b long, u long, v long")
    full = near.join(side("a", "members"), "a").join(side("b", "members"), "b").select("u", "v", "members_a", "members_b")
    return full.mapInArrow(_verifying(sketch.percent), "u long, v long")


def _contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of classes after joining the components that ``links(u, v)`` connect."""
    moved = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return cut(labels.join(moved, "root", "left").select("cls", F.coalesce("to", "root").alias("root")))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys that hold several components, with their component."""
    known = members.join(labels, "cls")
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return known.join(mixed, "key")


def _stars(members: DataFrame) -> DataFrame:
    """Each of ``members(key, cls, root)`` with the key's smallest class, unless they are in one component."""
    centre = members.groupBy("key").agg(F.min("cls").alias("b"))
    centre = members.select("key", F.col("cls").alias("b"), F.col("root").alias("v")).join(centre, ["key", "b"])
    return members.select("key", F.col("cls").alias("a"), F.col("root").alias("u")).join(centre, "key").where("u <> v").select("a", "b", "u", "v").distinct()


def block_links(roots: list[int], sets: list[np.ndarray], percent: int) -> set[tuple[int, int]]:
    """(root, root) of all linked sets of different components, of one block."""
    if len(set(roots)) < 2:
        return set()
    n = np.array([len(s) for s in sets])
    codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), n)
    shared = counts[codes] > 1  # what only one set has is in no intersection
    codes, owner = codes[shared], owner[shared]
    # a set that shares too little with all others links with none
    able = np.flatnonzero(100 * np.bincount(owner, minlength=len(sets)) >= percent * n)
    out, root, marked = set(), np.array(roots), np.zeros(len(counts), bool)
    for i in able.tolist():
        own = codes[owner == i]
        marked[own] = True
        both = np.bincount(owner, marked[codes], len(sets))
        marked[own] = False
        linked = (100 * both >= percent * (n + n[i] - both)) & (root != root[i])
        out |= {(max(roots[i], r), min(roots[i], r)) for r in set(root[linked].tolist())}
    return out


def _runs(work: Callable[[int, list], pa.RecordBatch | None]):
    """Over rows sorted by ``pair``: ``work(pair, rows)`` for each run of rows of one pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != pair and rows:
                    out = work(pair, rows)
                    if out is not None:
                        yield out
                    rows = []
                pair = p
                rows.append(row)
        out = work(pair, rows) if rows else None
        if out is not None:
            yield out

    return run


def may_link(roots: np.ndarray, sketches: np.ndarray, n: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Which classes of a block may link with one of another component, by the estimate of each two of them.

    Registers of two sets are equal at least as often as the sets are similar, so few equal ones rule a pair out
    before its likelihood is asked for.
    """
    least = sketch.least_estimate * sketch.registers
    out = np.zeros(len(roots), bool)
    for k in range(len(roots)):
        size = 100 * np.minimum(n, n[k]) >= sketch.percent * np.maximum(n, n[k])
        some = np.flatnonzero(size & (roots != roots[k]))
        some = some[some > k]
        equal = (sketches[some] == sketches[k]).sum(axis=1)
        some, equal = some[equal >= least], equal[equal >= least]
        if len(some):
            greater = (sketches[some] < sketches[k]).sum(axis=1)
            j = likeliest(greater, sketch.registers - equal - greater, equal, np.full(len(some), float(n[k])), n[some].astype(float))
            found = some[j >= sketch.least_estimate]
            out[found] = True
            out[k] |= len(found) > 0
    return out


def _ruling_out(sketch: Sketch):
    def work(pair: int, rows: list) -> pa.RecordBatch | None:
        cls, roots, sketches, n = zip(*rows, strict=True)
        able = may_link(np.array(roots), np.frombuffer(b"".join(sketches), np.uint16).reshape(len(rows), -1), np.array(n), sketch)
        kept = np.flatnonzero(able)
        return pa.RecordBatch.from_arrays([pa.array([pair] * len(kept), pa.int64()), pa.array([cls[k] for k in kept], pa.int64()), pa.array([roots[k] for k in kept], pa.int64())], names=["pair", "cls", "root"]) if len(kept) else None

    return _runs(work)


def _blocking(percent: int):
    def work(pair: int, rows: list) -> pa.RecordBatch:
        found = sorted(block_links([r for r, _ in rows], [np.frombuffer(m, np.uint64) for _, m in rows], percent))
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return _runs(work)


def _meet_in_blocks(members: DataFrame, sets: DataFrame, sketch: Sketch, block: int = BLOCK) -> DataFrame:
    """(u, v): links between different components among the classes of ``members(key, cls, root)``.

    Components that share a key form a group; only classes of one group can link. A group's classes are dealt
    to blocks of about ``block``, those of a large component to blocks of their own, and each two blocks meet
    in one task, but for blocks of the same component. They meet with their registers first; only classes whose
    estimate with one of another component leaves a link open meet again with their full sets.
    """
    centre = members.groupBy("key").agg(F.min("root").alias("v"))
    groups = components(members.select("key", F.col("root").alias("u")).join(centre, "key").select("u", "v"))
    classes = members.select("cls", "root").distinct().join(groups.select(F.col("node").alias("root"), F.col("root").alias("g")), "root", "left")
    classes = cut(classes.select("cls", "root", F.coalesce("g", "root").alias("g")))
    sizes = classes.groupBy("g", "root").agg(F.count("*").alias("n")).withColumn("large", 2 * F.col("n") > block)
    pools = sizes.where("not large").groupBy("g").agg(F.sum("n").alias("pool"))
    dealt = classes.join(sizes, ["g", "root"]).join(pools, "g", "left")
    parts = lambda n: F.ceil(F.col(n) / block)
    dealt = dealt.select("cls", "root", "g", F.when(F.col("large"), F.col("root")).alias("own"), F.when(F.col("large"), F.pmod(F.xxhash64("cls"), parts("n"))).otherwise(F.pmod(F.xxhash64("root"), parts("pool"))).alias("part"))
    dealt = cut(dealt.withColumn("block", F.xxhash64("g", F.coalesce("own", F.lit(0)), F.col("own").isNull(), "part")))
    blocks = dealt.select("g", "own", "block").distinct()
    two = blocks.alias("x").join(blocks.alias("y"), F.expr("x.g = y.g and x.block <= y.block and not coalesce(x.own = y.own, false)"))
    two = two.select(F.xxhash64("x.block", "y.block").alias("pair"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    rows = dealt.select("cls", "root", "block").join(two, "block").join(sets.select("cls", "sketch", "n"), "cls").select("pair", "cls", "root", "sketch", "n")
    open_ = cut(rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(_ruling_out(sketch), "pair long, cls long, root long"))
    full = open_.join(sets.select("cls", "members"), "cls").select("pair", "root", "members")
    return full.repartition("pair").sortWithinPartitions("pair").mapInArrow(_blocking(sketch.percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Texts link if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles (ASCII
    capitals folded, words split at white space). component_id is the smallest doc_id that links reach.
    Null or empty texts have no shingles and are their own component. Rows with a null id keep their row with
    a null component and are kept. Repeated ids are rows of their own, each in the component of its text. An
    empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    sketch = Sketch(words, percent)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = cut(own.mapInArrow(_sketching(sketch), "doc_id long, n long, cls long, bands array<long>"))
    named = drawn.where("doc_id is not null and cls is not null")
    banded = named.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    members = cut(banded.join(shared, "key").distinct())
    candidates = members.select("cls").distinct()
    first = named.groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    wanted = first.join(candidates, "cls").select(F.col("first_id").alias("want"), F.col("cls").alias("want_cls"))
    texts = own.join(wanted.select(F.col("want").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    gathered = texts.mapInArrow(_gathering(sketch), "want long, cls long, n long, sketch binary, members binary")
    # an id that is given twice may bring a text of another class
    sets = cut(gathered.join(wanted, (gathered["want"] == wanted["want"]) & (gathered["cls"] == wanted["want_cls"]), "left_semi").drop("want").dropDuplicates(["cls"]))
    alone = members.select("key", "cls", F.col("cls").alias("root"))
    labels = _contract(sets.select("cls", F.col("cls").alias("root")), _links(_stars(alone), sets, sketch))
    still_open = cut(_open(members, labels).select("key", "cls", "root"))
    if not still_open.isEmpty():
        labels = _contract(labels, _meet_in_blocks(still_open, sets, sketch))
    smallest = labels.join(first, "cls").groupBy("root").agg(F.min("first_id").alias("component_id"))
    wide = labels.join(smallest, "root").select("cls", "component_id")
    found = first.join(wide, "cls", "left").select("cls", F.coalesce("component_id", "first_id").alias("component_id"))
    out = drawn.select("doc_id", "n", "cls").join(found, "cls", "left")
    component: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are the first of their group.

    Rows with an id that is given repeatedly stay if one of them is kept; rows with a null id stay.
    """
    rated = near_duplicates(docs, words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = rated.where("not kept").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
