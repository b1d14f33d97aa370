"""Exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments, each indexed by its value. If two codes differ in at most m * (r + 1) - 1
bits, some segment differs in at most r. So looking up all segment values within radius r finds every code up to
that distance: the radius grows until the k-th best distance found, each counted exactly, is covered.

The index is one table of all codes, a row for each segment and value, and the lookup an equi-join with it. In
the round of radius r a query asks for the values exactly r bits away; a code comes out in the round of its closest
segment and for the first of those that are as close, so once in all, and only if it is no further than the k-th
found so far. Queries whose k-th distance is covered leave; the others go on. Values that very many codes share are
dealt to parts, each of which is asked. Equal codes are one entry with its k smallest ids, so a vector that a third
of all rows share is one entry.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm._common import cut, cut_counted

BITS, TOP = 64, 10
#: Distinct codes from which segments of 16 and of 32 bits are looked up: about one code a value then.
MORE_FROM = {16: 1 << 12, 32: 1 << 24}
#: Codes of a segment's value that are looked up at once.
PART = 50_000


def sign_code(vector: Column) -> Column:
    """A 64-bit code: bit i is set if element i is positive; elements after the 64th are folded onto the first."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % BITS).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))


def masks(width: int, radius: int) -> Column:
    """All values of ``width`` bits of which ``radius`` are set, as a constant array."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), radius))), ",").cast("array<bigint>")


def segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _segments(code: Column, width: int) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("s"), segment(code, s, width).alias("value")) for s in range(BITS // width)])


def _first_met(q: Column, code: Column, s: Column, radius: int, width: int) -> Column:
    """Whether segment s is the first of those in which the codes are closest, and they differ there in ``radius`` bits."""
    apart = [F.bit_count(segment(q.bitwiseXOR(code), k, width)) for k in range(BITS // width)]
    return reduce(lambda x, y: x & y, (F.when(s > k, n > radius).when(s < k, n >= radius).otherwise(True) for k, n in enumerate(apart)))


def _closest(found: DataFrame, need: int) -> DataFrame:
    """Of each query the entries that may hold the ``need`` rows of least distance, ties by id: ``need`` entries at most."""
    kept = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("d", "least"))).where(F.col("nth") <= need)
    before = F.sum("n").over(Window.partitionBy("q").orderBy("d").rangeBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < need).drop("nth", "before")


def closest_codes(codes: DataFrame, queries: DataFrame, need: int, width: int, part: int = PART) -> DataFrame:
    """(q, code, least, n, d): for each of ``queries(q)`` the ``codes(code, least, n)`` that hold its ``need`` closest rows."""
    m = BITS // width
    index = codes.select("code", "least", "n", F.explode(_segments(F.col("code"), width)).alias("at")).select("code", "least", "n", "at.s", "at.value")
    sizes = index.groupBy("s", "value").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    hot, many = cut_counted(sizes.where("parts > 1"))
    one = lambda df: df.join(hot, ["s", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))) if many else df.withColumn("parts", F.lit(1))
    index = cut(one(index).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")).drop("parts"))
    waiting, best = cut(queries.select("q", F.lit(BITS).alias("bound"))), None
    for radius in range(width + 1):
        asked = waiting.select("q", "bound", F.explode(_segments(F.col("q"), width)).alias("at")).select("q", "bound", "at.s", F.col("at.value").alias("own"))
        asked = one(asked.withColumn("mask", F.explode(masks(width, radius))).select("q", "bound", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        d = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        met = asked.join(index, ["s", "value", "part"]).where((d <= F.col("bound")) & _first_met(F.col("q"), F.col("code"), F.col("s"), radius, width))
        found = met.select("q", "code", "least", "n", d.alias("d"))
        best = cut(_closest(found if best is None else best.unionByName(found), need))
        sure = F.sum(F.when(F.col("d") < m * (radius + 1), F.col("n")).otherwise(0))
        state = best.groupBy("q").agg(sure.alias("sure"), F.sum("n").alias("found"), F.max("d").alias("most"))
        open_ = waiting.select("q").join(state, "q", "left").where(F.coalesce("sure", F.lit(0)) < need)
        waiting = cut(open_.select("q", F.when(F.col("found") >= need, F.col("most")).otherwise(BITS).alias("bound")))
        if waiting.isEmpty():
            break
    return best


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, width: int | None = None, part: int = PART) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows of least distance to each query, ties by id.

    Both frames have (id, code). Every row is searched, a query's own too. Rows with a null id or code are
    left out, as are such queries; repeated rows are ranked each, repeated queries once. Fewer than k rows
    are all returned; no rows or no queries give none. ``width``: bits of a segment (a divisor of 64; by default
    from the number of codes).
    """
    if k < 1 or width is not None and BITS % width:
        raise ValueError("k must be positive, and a width a divisor of 64")
    known = rows.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).where("id is not null and code is not null")
    asked = cut(queries.select(F.col("id").cast("long").alias("query_id"), F.col("code").cast("long").alias("q")).where("query_id is not null and q is not null").distinct())
    # at most k ids of a code matter; the limit works before the shuffle, too
    entries = cut(known.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("nth") <= k))
    codes, n = cut_counted(entries.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    # k rows there may not be: the search ends when all are found
    need = min(k, int(codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    best = closest_codes(codes, asked.select("q").distinct(), max(need, 1), width or max([8, *(w for w, least in MORE_FROM.items() if n > least)]), part)
    found = best.join(entries.select("code", "id"), "code")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k)
    return asked.join(top, "q").select("query_id", "rank", F.col("id").alias("neighbor_id"), F.col("d").alias("distance"))
