"""The ``opN_<name>`` queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.llm._common import table


def piece_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer file's bytes (some 0.5 MB, sent to the workers with the task)."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.pii import replace_personal_data

    return replace_personal_data(table(spark, sf_dir, "documents"), key="surrogates of the public test tables")


def op3_multi_index_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.hamming_topk import hamming_top_k, sign_code

    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return hamming_top_k(codes, codes.where(F.col("id") % 100 == 0), k=10)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op5_segment_edit_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), edits=2)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), piece_model(), limit=4096)


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_conflict_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.packing import pack, text_items

    return pack(text_items(table(spark, sf_dir, "documents"), piece_model()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arrayloom.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
    "op2_surrogate_pii": op2_surrogate_pii,
    "op3_multi_index_hamming_topk": op3_multi_index_hamming_topk,
    "op4_secret_scan": op4_secret_scan,
    "op5_segment_edit_line_dedup": op5_segment_edit_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_string_kernel_toxicity": op7_string_kernel_toxicity,
    "op8_setsketch_near_dedup": op8_setsketch_near_dedup,
    "op9_conflict_best_fit_packing": op9_conflict_best_fit_packing,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op3_multi_index_hamming_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
        pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
                   CAST(len(list_filter(list_zip(q.s, v.s), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
            FROM v AS q, v WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank,
                   neighbor_id, distance FROM pairs)
        SELECT * FROM ranked WHERE rank <= 10""",
    "op8_setsketch_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l FROM w),
        s AS (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM l),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id < y.doc_id
            GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
        edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(doc_id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM reach AS r JOIN edges AS e ON e.a = r.doc_id)
        SELECT l.doc_id, CAST(len(l.l) AS BIGINT) AS n_shingles, m.component_id, l.doc_id = m.component_id AS kept
        FROM l JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) AS m USING (doc_id)""",
}
