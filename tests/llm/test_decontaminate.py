"""Spaced-seed overlaps against comparing every alignment of every item with every text."""

import itertools
import random
import time
import tracemalloc

from arrayloom.llm.decontaminate import Index, contaminated, decontaminate, masks_for, overlaps
from arrayloom.llm.words import plain, word_hashes


def agrees(text, item):
    """Whether any alignment has any stretch of min(13, item length) words or more of which four fifths agree."""
    a, b = ([w.strip(".!\n") for w in t.lower().split()] for t in (text, item))
    least = min(13, len(b))
    for place in range(-len(b) + 1, len(a)):
        low, high = max(0, -place), min(len(b), len(a) - place)
        same = [a[place + k] == b[k] for k in range(low, high)]
        if b and 5 * sum(same) >= 4 * least:
            if any(5 * sum(same[x:y]) >= 4 * (y - x) for x in range(len(same)) for y in range(x + least, len(same) + 1)):
                return True
    return False


def brute(texts, items):
    """By hashed words, each alignment and each stretch of it."""
    out = set()
    words = lambda t: word_hashes([plain(t or "")])[0]
    known = [(d, words(t)) for d, t in texts]
    for i, item in items:
        b = words(item)
        least = min(13, len(b))
        for d, a in known:
            for place in range(-len(b) + 1, len(a)) if len(b) else ():
                low, high = max(place, 0), min(place + len(b), len(a))
                total = [0, *(5 * (a[low:high] == b[low - place : high - place]).astype(int) - 4).cumsum().tolist()]
                if any(total[y] >= min(total[: y - least + 1]) for y in range(least, len(total))):
                    out.add((d, i))
                    break
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(1, 40)))) for k in range(25)] + [(90, None), (91, "")]
    texts = []
    for d in range(150):
        words = say(rng.randint(0, 60))
        if d % 3 == 0:
            part = items[rng.randrange(25)][1].split()
            for _ in range(len(part) // 6):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append((d, " ".join(words).capitalize() + rng.choice(["", ".", "!\n"])))
    return [*texts, (500, None), (501, "")], items


def test_against_all_alignments(spark):
    texts, items = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 30
    assert all(r.agreeing >= 0.8 * r.words for r in got)
    joined = contaminated(docs, bench, index_bytes=0).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, got))
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in want}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k l m n"), (None, None), (3, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m n"), (None, "q r s t u v")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()] == [(None, 7)]
    assert decontaminate(docs, bench).count() == 3
    assert contaminated(docs.where("false"), bench).count() == 0
    assert contaminated(docs, bench.where("false")).count() == 0
    for k in (0, 1 << 20):
        assert contaminated(docs.where("false"), bench, index_bytes=k).count() == 0
        assert contaminated(docs, bench.where("false"), index_bytes=k).count() == 0
        assert [(r.doc_id, r.item_id) for r in contaminated(docs, bench.union(bench), index_bytes=k).collect()] == [(None, 7)]
    assert overlaps(Index.build([]), *word_hashes([b"a b c"])) == []


def test_any_fifth_of_the_words_leaves_a_seed():
    """All placements in up to 25 words; a longer stretch has one of two halves that agrees as well as the whole."""
    for n in range(1, 26):
        places = [sum(1 << p + o for o in m) for m in masks_for(n) for p in range(n - m[-1])]
        for gone in itertools.combinations(range(n), n // 5):
            bits = sum(1 << p for p in gone)
            assert any(not bits & p for p in places), (n, gone)


def test_any_placement_is_found():
    """Overlaps of 13 to 40 words with a fifth changed at random, the places of 15 words that leave least among them."""
    rng = random.Random(4)
    for n in range(13, 41):
        for gone in [*(rng.sample(range(n), n // 5) for _ in range(20)), *([(3, 7, 11), (2, 6, 10), (4, 7, 10)] if n == 15 else [])]:
            item = [f"a{k}" for k in range(n)]
            text = " ".join("other" if k in gone else w for k, w in enumerate(item))
            assert overlaps(Index.build([(1, " ".join(item))]), *word_hashes([text.encode()])), (n, gone)


def test_repetitive_texts_take_little():
    """A megabyte of one word against items of that word: work in proportion to the text, in pieces of bounded size."""
    index = Index.build([(1, "word " * 60), (2, "word " * 80), (3, "other " * 30)])
    words, starts = word_hashes([b"word " * 200_000, b"word other " * 20])
    tracemalloc.start()
    began = time.process_time()
    found = overlaps(index, words, starts)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, i, size) for t, i, _, size, _, _ in found] == [(0, 0, 60), (0, 1, 80)]
    assert took < 30 and peak < 250 << 20, (took, peak)


def test_short_items():
    index = Index.build([(1, "yes"), (2, "two words"), (3, "a b c d"), (4, "a b c d e")])
    said = lambda t: [i for _, i, *_ in overlaps(index, *word_hashes([plain(t)]))]
    assert said("Yes, two words.") == [0, 1] and said("two other words") == [] and said("x a b c d f") == [2, 3] and said("a b x d f") == []


def test_against_all_windows(spark):
    texts, items = corpus()
    rng = random.Random(8)
    # 13 words with up to two changed anywhere, 5 to 12 with a fifth changed, an exact copy before a weak tail
    for k in range(60):
        item = [f"i{k}x{n}" for n in range(rng.choice([5, 8, 12, 13, 16, 20, 73]))]
        part = list(item)
        if len(part) == 73:
            part[13:] = [w if n % 4 else "other" for n, w in enumerate(part[13:])]
        else:
            for n in rng.sample(range(len(part)), len(part) // 5 + (k % 4 == 0)):
                part[n] = "other"
        items.append((1000 + k, " ".join(item)))
        texts.append((1000 + k, " ".join(["before", *part, "after"])))
    texts = [(d, t) for d, t in texts if d < 60 or d >= 1000]
    want = {(d, i) for i, item in items for d, t in texts if t and agrees(t, item or "")}
    got = contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 50
    assert all(5 * r.agreeing >= 4 * r.words for r in got)
