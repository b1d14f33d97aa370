"""Each stage held against what its operator is tested to do, on its own input."""

import corpus_pipeline as P
from arrayloom.llm.token_counts import Counter
from arrayloom.llm.queries import piece_model
from tests.llm.test_decontaminate import brute as brute_overlaps
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_setsketch import brute as brute_groups


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            assert set(seen[-1]) <= set(seen[-2])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rejected = set(seen[0]) - set(seen[1])
    assert sum(labels.get(d) == 1 for d in rejected) <= 0.02 * len(seen[0])
    bad = {d for d, q in labels.items() if q == 0 and d in seen[0]}
    assert len(rejected & bad) >= 0.8 * len(bad)
    lines = brute_lines(sorted(seen[1].items()))[0]
    left = {d: "\n".join(t.split("\n")[k] for k in lines[d, t or ""][5]) if t else t for d, t in seen[1].items()}
    some = lambda d: lines[d, seen[1][d] or ""]
    assert seen[2] == {d: t for d, t in left.items() if some(d)[4] == some(d)[0] or (t or "").strip()} and seen[2] != seen[1]
    want = {d for d, _, _, kept in brute_groups(sorted(seen[2].items()), 5, 80) if kept}
    assert set(seen[3]) == want
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dirty = {d for d, _ in brute_overlaps(sorted(seen[3].items()), bench)}
    assert set(seen[4]) == set(seen[3]) - dirty
    counter, tokens = Counter(piece_model()), {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.piece_tokens
    assert tokens == {d: counter.count(t or "") + 1 for d, t in seen[4].items()}
    bins = {}
    for r in docs.collect():
        bins.setdefault(r.bin_id, []).append(r)
    for held in bins.values():
        assert sum(r.piece_tokens for r in held) <= 2048
        for name in ("source", "cluster"):
            some_of = [r[name] for r in held if r[name] is not None]
            assert len(some_of) == len(set(some_of))


def test_stages_on_odd_rows(spark, sf_dir):
    """Null ids and texts, repeated rows, empty texts and columns with the stages' own names: nothing crashes, and null ids stay."""
    text = "first line of a text that has some words\nsecond line of it\n"
    rows = [(None, text, "en", "s", 3, "x"), (1, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, text, "en", "s", 5, "x"), (2, text, "en", "s", 5, "x"), (3, "word " * 50_000, "en", None, 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone_id string")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        if name not in ("best-fit packing", "quality classifier"):
            assert out.where("doc_id is null").count() == 1, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        out.count()


def test_run_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
