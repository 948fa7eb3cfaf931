"""The queries op1_ to op10_ and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op1_fingerprints, op2_simhash, op3_chat, op4_language, op5_urls, op6_tokens, op7_substrings, op8_licences, op9_decontamination, op10_mixing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprints.fingerprints_and_classes(_table(spark, sf_dir, "documents"))


def op2_simhash_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return op3_chat.digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op4_language_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language.predictions(_table(spark, sf_dir, "documents"))


def op5_urls_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_urls.verdicts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_tokens_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substrings_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_substrings.digests(_table(spark, sf_dir, "documents"))


def op8_licences_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licences.scan(_table(spark, sf_dir, "documents"))


def op9_decontamination_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("mark")


def op10_mixing_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints_,
    "op2_simhash": op2_simhash_,
    "op3_chat": op3_chat_,
    "op4_language": op4_language_,
    "op5_urls": op5_urls_,
    "op6_tokens": op6_tokens_,
    "op7_substrings": op7_substrings_,
    "op8_licences": op8_licences_,
    "op9_decontamination": op9_decontamination_,
    "op10_mixing": op10_mixing_,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat": op3_chat.SQL,
    "op5_urls": op5_urls.SQL,
    "op7_substrings": op7_substrings.SQL,
    "op8_licences": op8_licences.SQL,
    "op9_decontamination": op9_decontamination.SQL,
    "op10_mixing": op10_mixing.SQL,
}
