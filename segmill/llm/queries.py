"""Registered queries of the corpus operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann
from .byte_bpe import op13
from .common import table
from .exact_dedup import exact_dedup
from .katz import op9
from .langid import op10
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .packing import op4
from .sentencepiece_unigram import op1
from .site_style import main_text
from .token_align import op11
from .toxicity import op3
from .whitening import op12


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op5(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def queries() -> dict:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_nearest": op5_nearest,
        "op6_line_dedup": op6_line_dedup,
        "op7_minhash": op7_minhash,
        "op8_html_text": op8_html_text,
        "op9_katz": op9_katz,
        "op10_language_id": op10_language_id,
        "op11_alignment": op11_alignment,
        "op12_whitening": op12_whitening,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_nearest": ann.ORACLE,
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
            SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
            FROM d JOIN g USING (text)
        """,
    }
