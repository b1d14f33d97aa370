"""The scan against a scanner in plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

from arrayloom.llm.secret_scan import ALLOW, CLASSES, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    added = []
    for rank, c in enumerate(CLASSES, 3):
        for m in re.finditer(c.candidates, text):
            if any(re.search(p, m[0]) for p in ALLOW) or any(b[0] < m.end() and m.start() < b[2] for b in base):
                continue
            v = m[0].lower() if rank == 3 else m[0]
            ends = []
            for i in range(c.window, len(v) + 1):
                n = Counter(v[i - c.window : i]).values()
                if -sum(k / c.window * math.log2(k / c.window) for k in n) >= c.least - 1e-9:
                    ends.append(i)
            if ends:
                added.append((m.start() + ends[0] - c.window, rank, m.start() + ends[-1], c.kind))
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    count = Counter(s[3] for s in base)
    return (count["assign"], count["access"], count["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added))


def run(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    return {r.doc_id: tuple(r)[1:] for r in got}


def test_against_plain_python(spark):
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    token = lambda k, a=alphabet: "".join(rng.choice(a) for _ in range(k))
    texts = [None, "", "a", "token=abc", "secret:token:abcdefghi", "TOKEN = 'abcdef' é😀 password:\"zzzzzz\" x", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 20, "AKIA12", "f" * 23, "f" * 24 + "é" + "0" * 30]
    texts += ["passwordtokensecret==abcdef1", "apikey : api_key=aaaaaaa", "é" * 50 + token(40), token(64, "0123456789ABCDEF"), "123e4567-e89b-12d3-a456-426614174000", "a" * 5000, token(300) + "a" * 100 + token(90)]
    for _ in range(60):
        words = [rng.choice(["é", "token", "=", ": ", '"', " ", "\n", "AKIA", "the", token(rng.choice([5, 24, 30, 60])), token(rng.choice([20, 24, 40]), "0123456789abcdef"), "EXAMPLE"]) for _ in range(rng.randint(1, 25))]
        texts.append("".join(words))
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, t)
    assert sum(g[-1] for g in got.values()) > 10


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "token=abcdef"), (1, None), (1, None)], "doc_id long, text string")
    got = sorted(map(tuple, secret_scan(df).collect()), key=str)
    assert len(got) == 3 and [r[1] for r in got].count(1) == 1
    assert secret_scan(df.where("false")).count() == 0
