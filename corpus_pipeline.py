"""The corpus pipeline: language ID, toxicity, exact dedup, near-dedup and packing, one after another over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but the last return
the columns of ``documents``.  A caller may write each stage's result and reread it, as :func:`run` does.

Null and empty texts have no letter, so the first stage takes them out; texts are taken whole, however long.  Rows that repeat an id and its text
stay together or go together.  A row without an id goes at the dedup stages, as nothing can keep it.  Ties: of equal texts the largest id
stays, of near copies the least; a toxicity of exactly one half goes.  Further columns are left out.  Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segmill.llm.common import Scratch
from segmill.llm.exact_dedup import exact_dedup
from segmill.llm.langid import keep_identified
from segmill.llm.minhash import near_duplicates
from segmill.llm.packing import pack
from segmill.llm.toxicity import keep_harmless

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.4  # of a document's likeliest language; below it, or without a letter, the document goes


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return keep_identified(docs.select(*COLUMNS), LEAST_SCORE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go; the model learns from the labelled ones among those still there."""
    return keep_harmless(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    kept = exact_dedup(docs, keep="largest").where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the least id stays."""
    kept = near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language_id), ("toxicity", toxicity), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies), ("best-fit packing", packing)]
ORACLE_SQL = None  # the models and the packing are beyond SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes through a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{k}")
    return docs
