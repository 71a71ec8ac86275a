"""The registered queries of these operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html_text, language_id, line_dedup, packing, pii, simhash, suffix_dedup, warc
from .sql import DECONTAMINATE, LINE_DEDUP


#: The key of the registered query only; production runs bring their own.
PII_KEY = "example key"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(_read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), width=50)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=3, radius=3)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann": op9_ann,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL = {
    "op6_line_dedup": LINE_DEDUP,
    "op8_decontaminate": DECONTAMINATE,
}
