"""The segment join against comparing all pairs of lines."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arrayloom.llm import line_dedup
from arrayloom.llm.line_dedup import distinct_lines, drop_lines, line_report, link_counts, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def changed(rng, line, most):
    out = list(line)
    for _ in range(rng.randint(0, most)):
        k = rng.randint(0, len(out))
        out[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["é"]])
    return "".join(out)


def corpus(seed=2):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcé ") for _ in range(rng.choice([5, 19, 20, 21, 22, 23, 30, 45]))) for _ in range(40)] + ["same " * 20, "short"]
    docs = [(d, "\n".join(changed(rng, rng.choice(bases), 4) for _ in range(rng.randint(1, 8)))) for d in range(120)]
    return [*docs, (200, None), (201, ""), (202, docs[0][1]), (None, docs[0][1]), (203, "\n\n"), (203, docs[1][1]), (203, docs[1][1])]


def brute(rows, edits=2, chars=10):
    places = {(d, t or "", k): line.strip(" \t\r\x0b\x0c") for d, t in rows for k, line in enumerate((t or "").split("\n"))}
    first = {}
    for (d, _, k), line in places.items():
        if d is not None and line:
            first[line] = min(first.get(line, (d, k)), (d, k))
    letters = {line: Counter(line) for line in first}

    def near_to(a, b):
        # an edit takes one letter and puts one, so few pairs are worth a distance
        return a != b and abs(len(a) - len(b)) <= edits and ((letters[a] - letters[b]) + (letters[b] - letters[a])).total() <= 2 * edits and distance(a, b) <= min(edits, min(len(a), len(b)) // chars)

    by_size = {}
    for line in first:
        by_size.setdefault(len(line), []).append(line)
    links = {line: [o for n in range(len(line) - edits, len(line) + edits + 1) for o in by_size.get(n, ()) if near_to(o, line)] for line in first}
    out = {}
    for (d, t, k), line in places.items():
        again = line in first and d is not None and (d, k) > first[line]
        near = line in first and d is not None and any(first[o] < first[line] for o in links[line])
        row = out.setdefault((d, t), [0, 0, 0, 0, 0, []])
        row[0] += 1
        row[1] += again
        row[2] += near and not again
        row[3] += len(links[line]) if line in first and d is not None else 0
        if not (again or near):
            row[4] += 1
            row[5].append(k)
    return out, links


def test_distance(spark):
    rng = random.Random(1)
    rows = [(a, changed(rng, a, 4)) for a in ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(400))]
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select("a", "b", within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert all(r.w == (distance(r.a, r.b) <= edits) for r in got)
    # differences far apart: the band is given up early, or kept to the end
    long = ["".join(rng.choice("abcd") for _ in range(70)) for _ in range(12)]
    far = [(a, b) for a in long for b in ("x" + a[1:] + "y", a[:-1], "xy" + a[2:30] + a[31:], a[1:] + "z", a[:40] + "qqq" + a[40:], long[0])]
    df = spark.createDataFrame(far, "a string, b string")
    for r in df.select("a", "b", within(F.col("a"), F.col("b"), 2).alias("w")).collect():
        assert r.w == (distance(r.a, r.b) <= 2), (r.a, r.b)


@pytest.mark.parametrize(("edits", "chars", "block"), [(2, 10, 128), (3, 6, 5)])
def test_against_all_pairs(spark, edits, chars, block):
    rows = corpus(edits)
    docs = spark.createDataFrame([(d, t, 9, "k") for d, t in rows], "doc_id long, text string, line_no int, gone_id string")
    want, links = brute(rows, edits, chars)
    own = distinct_lines(docs)
    names = {r.cls: r.line for r in own.collect()}
    got = {names[r.cls]: r.n_links for r in link_counts(own, edits, chars, block).collect()}
    assert got == {line: len(many) for line, many in links.items() if many} and sum(got.values()) > 50
    report = sorted((tuple(r) for r in line_report(docs, edits, chars).collect()), key=str)
    assert report == sorted(((d, *row) for (d, _), row in want.items()), key=str)
    dropped = drop_lines(docs, edits, chars)
    texts = sorted(((r.doc_id, r.text) for r in dropped.collect()), key=str)
    expect = sorted(((d, t if t is None or len(want[d, t][5]) == want[d, t][0] else "\n".join(t.split("\n")[k] for k in want[d, t][5])) for d, t in rows if want[d, t or ""][5] and (len(want[d, t or ""][5]) == want[d, t or ""][0] or any(t.split("\n")[k].strip() for k in want[d, t or ""][5]))), key=str)
    assert texts == expect
    assert dropped.columns == docs.columns


def test_large_group(spark):
    """A group of lines that are all near one another: a row for each line, not for each pair, and all links counted."""
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    lines = [base[:k] + c + base[k + 1 :] for k in range(0, 30) for c in "579"]
    docs = spark.createDataFrame([(d, line) for d, line in enumerate(lines)], "doc_id long, text string")
    own = distinct_lines(docs)
    names = {r.cls: r.line for r in own.collect()}
    got = {names[r.cls]: r.n_links for r in link_counts(own, block=16).collect()}
    some = sorted(set(lines))
    assert got == {a: sum(a != b and distance(a, b) <= 2 for b in some) for a in some}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert line_report(docs).count() == 0 and drop_lines(docs).count() == 0


def test_short_lines(spark):
    rows = [(1, "And ornd.\nfirst line of some length\n\nx"), (2, "And ornd.\n\nfirst line of some length"), (3, "other line of some length\n And ornd. \nAnd ornb.\nAnd ornb. two\nAnd ornc. two"), (4, "\n\n"), (5, "x\nx"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_again, r.n_near, r.n_links, r.lines_kept) for r in line_report(docs).collect()}
    # repeats of any length go; 'And ornb.' is too short for an edit, 'And ornc. two' long enough for one; empty lines stay
    assert got == {1: (0, 0, 0, [0, 1, 2, 3]), 2: (2, 0, 0, [1]), 3: (1, 1, 2, [0, 2, 3]), 4: (0, 0, 0, [0, 1, 2]), 5: (2, 0, 0, []), None: (0, 0, 0, [0])}
    texts = {r.doc_id: r.text for r in drop_lines(docs).collect()}
    assert texts == {1: rows[0][1], 3: "other line of some length\nAnd ornb.\nAnd ornb. two", 4: "\n\n", None: "x"}


def test_lines_of_one_to_nineteen_characters(spark):
    rng = random.Random(9)
    bases = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 20) for _ in range(3)]
    rows = [(d, "\n".join(changed(rng, rng.choice(bases), 2) for _ in range(4))) for d in range(60)]
    want = brute(rows)[0]
    report = sorted((tuple(r) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert report == sorted(((d, *row) for (d, _), row in want.items()), key=str)


def test_very_long_lines(spark):
    long = "word " * 60_000
    rows = [(1, long + "end"), (2, long + "enx\nshort"), (3, "a\n" * 20_000)]
    got = {r.doc_id: (r.n_lines, r.n_again, r.n_near) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 0, 1), 3: (20_001, 19_999, 0)}


def shuffled_mb(spark):
    """MB that the session's stages have written for shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() / 1e6 for s in (stages.apply(k) for k in range(stages.size()))}


def test_many_shared_marks(spark, monkeypatch):
    """Too many shared marks for a broadcast: the same links, and not every line is shuffled at each of its marks."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(4_000)]
    lines += [line[:150] + "#" + line[150:] for line in lines[:300]]
    own = distinct_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    want = sorted(map(tuple, link_counts(own).collect()))
    assert len(want) == 600
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_mb(spark)
        assert sorted(map(tuple, link_counts(own).collect())) == want
        moved = sum(mb for stage, mb in shuffled_mb(spark).items() if stage not in before)
        assert moved < 4  # 7.1 with all lines at all marks
        # a filter that is too small lets everything pass, and changes no result
        monkeypatch.setattr(line_dedup, "WORDS", 1, raising=False)
        assert sorted(map(tuple, link_counts(own).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shuffle_files_go_before_the_end(spark):
    """The shuffle that the distinct lines came by is not kept beside those that follow."""
    rng = random.Random(6)
    rows = [(d, "\n".join("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(5))) for d in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {f.getPath(): f.length() for f in (found.apply(k) for k in range(found.size())) if f.getName().startswith("shuffle_")}

    before, cleans = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    own = distinct_lines(docs)
    for _ in range(50):
        left = sum(n for path, n in files().items() if path not in before)
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000 and own.count() == 5_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == cleans


def test_near_copies_of_all_lines(spark, monkeypatch):
    """Lines that all have near copies share most marks: no stage moves more than about the lines' own characters."""
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(3_000)]
    lines += [line[:k] + "#" + line[k + 1 :] for line in lines for k in (rng.randrange(300),)]
    own = distinct_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    monkeypatch.setattr(line_dedup, "PASS_CHARS", 1, raising=False)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_mb(spark)
        firsts = {r.cls: int(r["first"]) >> 31 for r in own.collect()}
        got = {firsts[r.cls]: (r.n_links, int(r.earliest) >> 31) for r in link_counts(own).collect()}
        assert got == {k: (1, (k + 3_000) % 6_000) for k in range(6_000)}
        assert max(mb for stage, mb in shuffled_mb(spark).items() if stage not in before) < 1.3 * 1.8  # 1.8 MB of lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_passes_over_parts(spark, monkeypatch):
    """The parts of a frequent mark meet in different passes: each link counts once, in one of them."""
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    lines = [base[:k] + c + base[k + 1 :] for k in range(0, 24) for c in "5"]
    own = distinct_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    names = {r.cls: r.line for r in own.collect()}
    want = {a: sum(a != b and distance(a, b) <= 2 for b in lines) for a in lines}
    monkeypatch.setattr(line_dedup, "_passes", lambda *_: 2)
    assert {names[r.cls]: r.n_links for r in link_counts(own, block=8).collect()} == want
