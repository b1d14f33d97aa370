"""Top-k against comparing every query with every row."""

import random

import pytest

from arrayloom.llm.hamming_topk import hamming_top_k, sign_code


def brute(rows, queries, k):
    out = []
    for q, c in set(queries):
        if q is None or c is None:
            continue
        near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for i, d in rows if i is not None and d is not None)[:k]
        out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def codes(n, seed):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice([rng.getrandbits(64), *bases])
        for _ in range(rng.randint(0, 9)):
            c ^= 1 << rng.randrange(64)
        rows.append((i, signed(c)))
    return rows + [(n + j, signed(bases[0])) for j in range(40)] + [(3, signed(bases[1])), (3, signed(bases[1]))]


@pytest.mark.parametrize("width,k,part", [(None, 5, 50_000), (16, 10, 3), (32, 1, 50_000)])
def test_against_all_rows(spark, width, k, part):
    rows = codes(250, 1)
    queries = [r for r in rows if r[0] % 40 == 0]
    odd = [(None, 5), (7000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "id long, code long, d int")
    q = spark.createDataFrame(queries + odd + queries[:1], "id long, code long")
    assert sorted(map(tuple, hamming_top_k(df, q, k, width, part).collect())) == brute(rows, queries, k)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, 0), (2, -1)], "id long, code long")
    assert sorted(map(tuple, hamming_top_k(df, df, 5).collect())) == [(1, 1, 1, 0), (1, 2, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64)]
    none = df.where("false")
    assert hamming_top_k(none, df).count() == 0 and hamming_top_k(df, none).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, 2.0],), (None,), ([],), ([0.0] * 63 + [1.0],)], "e array<float>")
    assert [r[0] for r in df.select(sign_code(df.e)).collect()] == [9, None, 0, -(1 << 63)]
