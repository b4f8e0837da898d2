"""Training-corpus pipeline: quality, shared lines, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` writes each stage's result as Parquet into the
cluster's shared folder and reads it again, so a lost executor costs at most one stage's tasks.

Defined cases: each stage's operator states its own; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, line_dedup, quality, simhash
from quarry.llm.common import Scratch, bounded_batches, read_table
from quarry.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, learned from the labelled rows among them, rejects."""
    labels = quality.training_labels(read_table(spark, sf_dir, "labels"), "quality", 4, 2)
    return quality.keep_good(docs, labels)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share from all but one of them; ``n_chars`` follows the text."""
    clean = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group."""
    return simhash.dedup_near(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their digest, and the digest of the text they decode to."""
    coded = bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), digests=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_copies", near_copy_stage),
          ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: A fitted classifier decides which rows go on, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    scratch.keep()
    for _, stage in STAGES[:-1]:
        docs = scratch.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
