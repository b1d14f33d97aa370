"""Best fit against trying every bin; the constraints over Spark's blocks."""

import random
from collections import defaultdict

from arrayloom.llm.packing import Bins, pack, pack_block, text_items
from arrayloom.llm.queries import piece_model
from arrayloom.llm.token_counts import Counter


def plain(items, capacity):
    parts = []
    for k, (_, size, source, cluster) in enumerate(items):
        parts += [(min(capacity, size - p), k, p // capacity, source, cluster) for p in range(0, size, capacity)]
    order = lambda x: (x is None, x)
    parts.sort(key=lambda p: (-p[0], order(items[p[1]][0]), p[2], order(items[p[1]][3]), order(p[3])))
    bins, out, came = [], [], 0
    for size, k, piece, source, cluster in parts:
        fits = [b for b in bins if b["room"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            b = min(fits, key=lambda b: (b["room"], b["came"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "n": len(bins)}
            bins.append(b)
        out.append((k, piece, size, b["n"], capacity - b["room"]))
        came += 1
        b["room"] -= size
        b["came"] = came
        b["s"].add(source)
        b["c"].add(cluster)
    return out


def items(n, seed):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "a", "b", "c", "d", None])
    return [(k // 2, rng.choice([0, 1, 5, 40, 50, 60, 99, 100, 101, 250]) if k % 3 else rng.randint(1, 100), source(), rng.choice([7, None, k, rng.randint(0, 20)])) for k in range(n)]


def test_against_trying_every_bin():
    for seed in range(20):
        block = items(150, seed)
        assert pack_block(block, 100) == plain(block, 100)
    assert pack_block([], 100) == []


def test_bin_search_passes_over_conflicts():
    bins = Bins(10)
    assert bins.put(6, 1) == (0, 0) and bins.put(6, 1) == (1, 0)
    assert bins.put(4, 1) == (2, 0) and bins.put(4, 2) == (0, 6) and bins.put(6, 2) == (2, 4)


def test_over_blocks(spark):
    rows = items(700, 9) + [(None, 30, "a", 1), (900, None, "a", 2), (900, -4, None, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, size long, source string, cluster long, bin_id int")
    got = pack(df, capacity=100, block=64).collect()
    assert sum(r.piece_tokens for r in got) == sum(max(0, r[1] or 0) for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        assert all(a.bin_start + a.piece_tokens == b.bin_start for a, b in zip(held, held[1:]))
        assert held[0].bin_start == 0 and held[-1].bin_start + held[-1].piece_tokens <= 100
        for name in ("source", "cluster"):
            some = [r[name] for r in held if r[name] is not None]
            assert len(some) == len(set(some))
    assert pack(df.where("false")).count() == 0


def test_items_of_odd_texts(spark):
    long = "some words " * 40_000
    rows = [(1, None, "a", 5), (2, "", "a", 5), (3, "Some  words", None, 5), (4, "some words\n", "b", 5), (5, long, "b", 5), (None, " \t", "c", 5), (5, long, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    counter = Counter(piece_model())
    found = text_items(docs, piece_model())
    got = sorted(((r.doc_id, r["size"]) for r in found.collect()), key=str)
    assert got == sorted(((d, counter.count(t or "") + 1) for d, t, *_ in rows), key=str)
    clusters = {r.doc_id: r.cluster for r in found.collect()}
    assert clusters[3] == clusters[4] is not None and clusters[1] is clusters[2] is clusters[None] is None
    pieces = pack(found).collect()
    assert sum(r.piece_tokens for r in pieces) == sum(n for _, n in got) and max(r.piece_tokens for r in pieces) == 2048
    assert text_items(docs.where("false"), piece_model()).count() == 0
