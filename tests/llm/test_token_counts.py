"""Counts against the library's own, over whole texts."""

import random

import sentencepiece

from arrayloom.llm.queries import piece_model
from arrayloom.llm.token_counts import Counter, token_counts

PARTS = ["a", "the", "ing", " ", "  ", "\n", "é", "▁", "x1", "😀", "0", "ener", "</s>", "\x00"]


def text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_splices_widen():
    model = piece_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng, widened = random.Random(0), 0
    for by_words in (True, False):
        for chunk, overlap in ((20, 3), (50, 8), (64, 16)):
            counter = Counter(model, chunk, overlap)
            counter.by_words = counter.by_words and by_words
            for _ in range(60):
                t = text(rng, rng.randint(0, 200))
                assert counter.count(t) == len(sp.encode(t)), t
            widened += counter.widened
    assert widened > 0
    blob = "a" * 40_000 + " the " * 9000
    assert Counter(model).count(blob) == len(sp.encode(blob))


def test_operator(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, rng.choice([0, 3, 50, 30_000])), 1) for i in range(30)] + [(None, "the", 0), (7, None, 0), (7, None, 0)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), piece_model(), limit=40).collect()
    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    want = sorted(((d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 40) for d, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), piece_model()).count() == 0
