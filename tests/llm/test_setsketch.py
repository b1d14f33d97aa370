"""Groups against comparing all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from arrayloom.llm import setsketch as S
from arrayloom.llm.components import components


def word_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, words=3, percent=85):
    sets = [word_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(zip(sets, rows, strict=True)):
        for j in range(i):
            b = sets[j]
            if a and b and x[0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None, d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "Ab", "ß"]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.randint(40, 120))] for _ in range(12)]
    for d in range(n):
        words = list(rng.choice(bases if rng.random() < 0.8 else bases[:1]))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(50)], [words[k], "more"]])
        rows.append((3 * d + 7, rng.choice([" ", "  ", "\n"]).join(words)))
    return [*rows, (1, ""), (2, None), (None, rows[0][1]), (4, "One two"), (5, "one  TWO"), (5, rows[3][1]), (6, "x"), (6, "x"), (9, " \t\n")]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, words, percent):
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, 0, "a") for d, t in rows], "doc_id long, text string, n long, cls string")
    got = sorted(map(tuple, S.near_duplicates(docs, words, percent).collect()), key=str)
    want = brute(rows, words, percent)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 100
    if words == 5:  # many blocks a group
        meet = S._meet_in_blocks
        S._meet_in_blocks = lambda m, s, k: meet(m, s, k, block=4)
        try:
            assert sorted(map(tuple, S.near_duplicates(docs, words, percent).collect()), key=str) == want
        finally:
            S._meet_in_blocks = meet
    kept = S.keep_first(docs, words, percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _, keep in want if keep}


def test_chain_of_links_and_empty(spark):
    words = [f"t{k}" for k in range(100)]
    rows = [(d, " ".join(words[2 * d : 2 * d + 60])) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.near_duplicates(docs).collect()), key=str) == brute(rows)
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {0}
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(70, 60), (60, 70), (3, 3), (None, 1)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(1, 51)} | {(70, 60)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:])
    m = 1024
    x, y, both = S.registers([a, b, np.sort(pool)], m)
    assert (np.maximum(x, y) == both).all()
    j = S.likeliest(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([2000.0]), np.array([2500.0]))
    assert abs(j[0] - 0.5) < 0.06


def test_estimate_leaves_all_links_open():
    rng = np.random.default_rng(3)
    sketch, base = S.Sketch(), rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) > share], rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)])) for share in rng.uniform(0, 0.2, 60)]
    sets += [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(40)]
    roots, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    open_ = S.may_link(roots, S.registers(sets, sketch.registers), n, sketch)
    linked = {k for pair in S.block_links(list(range(len(sets))), sets, 85) for k in pair}
    assert len(linked) > 20 and all(open_[k] for k in linked) and not open_[60:].any()
    assert not S.may_link(np.zeros(len(sets)), S.registers(sets, sketch.registers), n, sketch).any()


def test_very_long_texts(spark):
    words = [f"w{k % 50_021}x{k % 977}" for k in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9])), (3, " ".join(words[::-1])), (4, "again " * 100_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3][1] == 3 and got[4] == (1, 4) and got[1][0] > 100_000
