"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import with_package
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language_id import identify
from .near_dup import near_duplicates
from .packing import pack
from .pii import BASE, find_spans
from .quality import LONG_FIELDS, judge
from .sentencepiece_fst import encode_rows
from .toxicity import held_out, learn, score
from .url_filters import filter_urls, rule_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = exact_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_rows(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *LONG_FIELDS, "base_failed", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_spans(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_near_duplicates, op3_url_filters, op4_sentencepiece, op5_toxicity, op6_html_text, op7_quality_rules, op8_packing, op9_pii, op10_language_id, pipeline)}


SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_url_filters": """
        WITH cut AS (
            SELECT page_id, coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
                   coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        low AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS nth
            FROM (SELECT DISTINCT page_id, host, path FROM low), rules
            WHERE (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT low.page_id, low.host, low.path, fits.rule, coalesce(fits.rule_verdict, 'allow') AS verdict
        FROM low LEFT JOIN fits ON fits.nth = 1 AND low.page_id = fits.page_id AND low.host = fits.host AND low.path = fits.path""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
