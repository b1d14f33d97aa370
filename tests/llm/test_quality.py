"""Ordered grades are learnt and told apart on held-out texts."""

import random

import numpy as np
import pyarrow.parquet as pq

from arrayloom.llm import quality as Q


def corpus(n=600):
    rng = random.Random(2)
    words = [["lorem", "ipsum", "dolor"], ["amet", "sit", "elit"], ["sed", "do", "eius"]]
    rows, labels = [], []
    for d in range(n):
        grade = d % 3
        rows.append((d, " ".join(rng.choice(words[grade] if rng.random() < 0.7 else sum(words, [])) for _ in range(rng.randint(10, 40))), 0.5))
        if d < 450:
            labels.append((d, grade))
    return rows, labels


def test_three_grades(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, None, 0.0), (9000, "", 0.0), (9000, "", 0.0)], "doc_id long, text string, tail_probability double")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 0)], "doc_id long, quality int")
    model = Q.train(docs, known)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in Q.quality_scores(docs, known).collect()}
    held = [(got[d].expected_grade, d % 3) for d, *_ in rows[450:]]
    means = [np.mean([e for e, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.3
    assert sum(round(e) == g for e, g in held) > 0.75 * len(held)
    assert all(0 <= r.tail_probability <= 1 for r in got.values())
    kept = Q.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and 100 < kept.count() < 350


def test_trigram_scores_are_means():
    model = Q.Ordinal(np.arange(Q.BUCKETS, dtype=float), np.zeros(Q.STATS), np.array([0.0]), [0, 1])
    texts = [b"abcdef", b"", b"ab", "é und ü".encode(), b"abc"]
    want = [model.buckets[Q.trigrams(t)].mean() if len(t) >= 3 else 0.0 for t in texts]
    assert np.allclose(model.scores(texts), want)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.keep for r in Q.quality_scores(docs, none).collect()] == [True]
    assert Q.quality_scores(docs.where("false"), none).count() == 0


def test_repeated_ids_and_very_long_texts(spark):
    """An id that is given a thousand times is learned from once; a text of a megabyte is rated whole."""
    rows, labels = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "zzz")] * 1000, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id long, quality int")
    plain = Q.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), known)
    assert np.allclose(Q.train(docs, known).thresholds, plain.thresholds)
    long = spark.createDataFrame([(1, rows[0][1]), (2, (rows[0][1] + " ") * 20_000), (3, (rows[2][1] + " ") * 20_000)], "doc_id long, text string")
    got = [r.expected_grade for r in Q.rate(long, plain).orderBy("doc_id").collect()]
    assert len(got) == 3 and got[2] != got[1]


def test_held_out_rows_of_the_tables(spark):
    """Labelled texts that the fit didn't see: good documents stay, bad ones go."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = Q.train(docs, labels, 2000, "doc_id % 2 = 0")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    test = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["doc_id"] % 2]
    _, tail = model.rate([texts[d] for d, _ in test], model.grades[-1])
    good = np.array([q for _, q in test]) > 0
    assert (tail[good][:, None] > tail[~good][None, :]).mean() > 0.98
    assert (tail[good] < Q.KEEP_AT).mean() < 0.01 and (tail[~good] < Q.KEEP_AT).mean() > 0.8
