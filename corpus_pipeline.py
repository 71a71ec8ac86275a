"""A corpus pipeline of five stages; each is an operator of foliant.llm on what the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, language_id, line_dedup, packing, simhash
from foliant.llm.shared import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the classifier learns from docs themselves.

    Null texts, texts without a letter and texts far from all languages go. Repeated rows and null ids are rows
    like others. Without any labelled row nothing can be told and nothing is left.
    """
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more share.

    A null text stays null; one that loses all its lines becomes empty; n_chars follows the text where lines went.
    A repeated row counts as a document of its own; empty lines are never shared lines.
    """
    out = line_dedup.drop_shared_lines(docs)
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text")), "n_chars": F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("long"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Null and blank texts are copies of each other. Rows of one id stay or go together.
    """
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay. A row goes by its own text, whatever its id; an empty benchmark takes nothing away.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in sequences of at most 1024 tokens.

    A null or empty text is its end token alone; repeated rows are documents of their own.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        docs = settle(lambda: stage(spark, before, sf_dir), name)  # noqa: B023  called at once
    return docs
