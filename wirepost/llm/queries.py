"""The registered queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, lines, middle, quality, simhash, spelling, substrings, suffixes, templates, topk, warc
from .shared import doc_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "similarity")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_digests(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return drawn.select(doc_id(), F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digests(table(spark, sf_dir, "documents"))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_suffixes": op4_suffixes,
    "op5_simhash": op5_simhash,
    "op6_lines": op6_lines,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_substrings": op10_substrings,
    "op11_middle": op11_middle,
    "op12_spelling": op12_spelling,
    "op13_html": op13_html,
}

ORACLES: dict[str, str] = {
    "op6_lines": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
        w AS (
            SELECT doc_id, pos, line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS w
            FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
        later AS (
            SELECT doc_id, pos
            FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM w WHERE w IS NOT NULL)
            WHERE n > 1),
        covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM later)
        SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
        GROUP BY l.doc_id""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op11_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
            FROM documents),
        k AS (
            SELECT doc_id, text, t, len(t) AS n,
                   CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(t) + 1) AS k1,
                   CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(t) + 1) AS k2,
                   CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 50 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM d),
        p AS (
            SELECT *, array_to_string(t[1:least(k1, k2)], '') AS pre, array_to_string(t[least(k1, k2) + 1:greatest(k1, k2)], '') AS mid,
                   array_to_string(t[greatest(k1, k2) + 1:], '') AS suf
            FROM k)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
