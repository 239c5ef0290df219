"""Cleaning of a training corpus in five stages: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; run() writes each stage's result as a table and reads it
again. The first four keep the columns of documents. SQL can express neither the secrets' offsets nor the tokenizer, so
there is no SQL twin; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import decontamination, neardup, packing, quality, secrets
from quotemill.llm.common import table, written
from quotemill.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.

    Null and empty texts have too few words and go. Rows that agree in id, text and language stay or go together, null ids too;
    other columns of any name stay as they are. An empty table gives an empty table.
    """
    ship(spark)
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id, null only if all are; of repeated rows one.

    All null and empty texts are one class. Other columns of any name stay as they are. An empty table gives an empty table.
    """
    ship(spark)
    return neardup.first_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an item of one word counts only where it is the whole document.

    Null texts hold none and stay. Repeated rows stay or go together; other columns stay as they are. An empty table gives an empty table.
    """
    ship(spark)
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mask; all documents stay, n_chars, where docs has it, follows the text.

    Null texts stay null, with a null n_chars. Overlapping secrets get one mask; repeated rows are masked alike and stay. Other columns
    of any name stay as they are. An empty table gives an empty table.
    """
    ship(spark)
    found, _ = secrets.scan_versions(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), "text"))
    clean = secrets.masked(docs, found)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids in sequences of 2048 tokens.

    Null and empty texts are pieces of the end's id alone; null ids and repeated rows are documents of their own. An empty table gives no rows.
    """
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
