"""One query for each training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, collocations, url_filter
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .lm_score import lm_scores
from .main_text import extract_main_text
from .packing import pack
from .secrets import find_secrets
from .simhash_dedup import simhash_components
from .token_blocks import read_token_blocks, write_token_blocks
from .token_counts import count_tokens
from .toxicity import toxicity


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_blocks(write_token_blocks(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_token_blocks": op2_token_blocks,
    "op3_secrets": op3_secrets,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_main_text": op5_main_text,
    "op6_decontamination": op6_decontamination,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_url_filter": op11_url_filter,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
            FROM documents)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256
        FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS place,
                     first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY h) AS group_size
              FROM d)""",
    "op11_url_filter": url_filter.SQL,
    "op12_centroid_clustering": centroids.SQL,
    "op13_collocations": collocations.SQL,
}
