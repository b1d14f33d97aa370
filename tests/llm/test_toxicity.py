"""The kernel against its definition; the classifier on held-out texts with altered insults."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

from arrayloom.llm import toxicity as X


def plain_kernel(a, b):
    def weights(s):
        out = {}
        for i, j, k in combinations(range(len(s)), 3):
            if k - i < X.SPAN:
                key = tuple(int(X._CLASS[s[p]]) for p in (i, j, k))
                out[key] = out.get(key, 0) + X.DECAY ** (k - i + 1)
        return out

    dot = lambda u, v: sum(w * v.get(c, 0) for c, w in u.items())
    u, v = weights(a), weights(b)
    return dot(u, v) / (dot(u, u) * dot(v, v)) ** 0.5 if u and v else 0.0


def test_kernel():
    strings = [b"idiot", b"idixot", b"ab", b"", b"stupid", "é".encode() * 4, b"aaaaaaaa", b"a1b2c3"]
    want = [[plain_kernel(a, b) for b in strings] for a in strings]
    assert np.allclose(X.kernel(strings, strings), want)


def test_strings():
    assert X.strings_of(b"You i-d-i-o-t, s t u p i d X y!") == [b"you", b"idiot", b"stupidxy"]
    assert X.strings_of("\u00e9 \u00e9 \u00ef a \u00e9t\u00e9".encode()) == ["\u00e9\u00e9\u00efa".encode(), "\u00e9t\u00e9".encode()]
    assert X.strings_of(b"") == [] and X.windows(b" !") == set()
    long = X.windows(b"x" * 100)
    assert X.windows(b"a") == {b" a "} and all(len(w) <= X.WINDOW for w in long) and any(w[:1] == b" " for w in long) and any(w[-1:] == b" " for w in long)


def exact_machine(strings, toxic, clean, penalty):
    """The kernel machine f(u) = sum(a_i k(s_i, u)) + b over all strings, its loss made least by plain gradient steps on (K^(1/2) a, b)."""
    k = np.array([[plain_kernel(a, b) for b in strings] for a in strings])
    values, vectors = np.linalg.eigh(k)
    z = np.hstack([vectors * np.sqrt(np.maximum(values, 0)), np.ones((len(k), 1))])
    up, down, w = toxic / toxic.sum(), clean / clean.sum(), np.zeros(len(k) + 1)
    shrink = np.r_[np.full(len(k), penalty), 1e-8]
    step = 1 / np.linalg.eigvalsh((z * (up + down)[:, None]).T @ z + np.diag(shrink)).max()
    last = w
    for n in range(60_000):
        ahead = w + n / (n + 3) * (w - last)
        f = z @ ahead
        last, w = w, ahead - step * (z.T @ (down * np.maximum(0, 1 + f) - up * np.maximum(0, 1 - f)) + shrink * ahead)
    return z @ w


def test_nystroem_against_the_exact_machine():
    rng = random.Random(3)
    strings = sorted({b" " + "".join(rng.choice("abcdeio") for _ in range(rng.randint(2, 7))).encode() + b" " for _ in range(60)})
    toxic, clean = (np.array([float(rng.randint(0, 4)) for _ in strings]) for _ in range(2))
    exact = exact_machine(strings, toxic, clean, 1e-2)
    fit = lambda marks: (lambda m: m.machine(X.fit_hinge(m.map(strings), toxic, clean, 1e-2)).values(strings))(X.Nystroem(marks))
    assert np.abs(fit(strings) - exact).max() < 2e-3 * np.abs(exact).max()
    fewer = fit(X.telling(strings, toxic, clean, 60, 60, 40))
    assert np.corrcoef(fewer, exact)[0, 1] > 0.9


def test_held_out_rows_of_the_tables():
    """Held-out labelled texts of the table: ranking and decisions."""
    read = lambda name: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet").to_pylist()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in read("documents")}
    rows = sorted((r["doc_id"], r["toxic"]) for r in read("labels") if r["toxic"] is not None)
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    fit, test = [r for r in rows if not held(r[0])], [r for r in rows if held(r[0])]
    fit = [r for r in fit if r[1]] + [r for r in fit if not r[1]][:800]
    machine = X.learn([texts[d] for d, _ in fit], np.array([t for _, t in fit]), 128)
    scores, y = machine.scores([texts[d] for d, _ in test], {}), np.array([t for _, t in test]) > 0
    auc = (scores[y][:, None] > scores[~y][None, :]).mean() + (scores[y][:, None] == scores[~y][None, :]).mean() / 2
    assert auc > 0.96 and (scores[~y] >= X.TOXIC_AT).mean() < 0.04 and (scores[y] >= X.TOXIC_AT).mean() > 0.8


def corpus(n=900):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(2):
                bad = rng.choice(["gormwit", "fozzplug", "blackhard"])
                if rng.random() < 0.3:
                    k = rng.randrange(1, len(bad) - 1)
                    bad = bad[:k] + rng.choice("x*-") + bad[k:]
                words.insert(rng.randint(0, len(words)), bad)
        rows.append((d, " ".join(words), int(toxic), 1.0))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, None, 0, 0.0), (5000, "", 0, 0.0), (5000, "", 0, 0.0), (5001, "w" * 5000 + " gormwit", 0, 0.0)], "doc_id long, text string, predicted int, score double")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = X.toxicity_scores(docs, known).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in rows)
    held = [(by[d].predicted, t) for d, _, t, _ in rows if by[d].held_out]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert by[5001].predicted == 1 and by[5000].predicted == 0 and by[None].predicted == 0
    # labels of held-out rows have no say
    flipped = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in X.toxicity_scores(docs, flipped).collect()}
    assert all(abs(again[d] - by[d].score) < 1e-9 for d, *_ in rows)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r)[2:] for r in X.toxicity_scores(docs, none).collect()] == [(0.5, 0)]
    assert X.toxicity_scores(docs.where("false"), none).count() == 0


def test_sample_is_bounded(spark):
    """Repeated ids give one text, and both bounds hold for either label."""
    docs = spark.createDataFrame([(d, "t" * 100 + str(k), "x") for d in range(60) for k in range(3)], "doc_id long, text string, bytes string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)] + [(0, 1), (2, None)], "doc_id long, toxic int")
    got = X.labelled(docs, labels, rows=20, size=10_000).collect()
    assert len(got) == len({r.doc_id for r in got}) == 20 and all(r.text == "t" * 100 + "0" for r in got)
    assert {r.doc_id: r.label for r in X.labelled(docs, labels, rows=200, size=100_000).collect()}.get(0, 1) == 1
    assert len(X.labelled(docs, labels, rows=200, size=1010).collect()) == 10
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
