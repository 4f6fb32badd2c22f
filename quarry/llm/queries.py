"""One query for each operator of this subpackage, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat_format, embedding_neardup, language_id, mixing, piece_codec, secret_scan, sharding, simhash_neardup, topk_search, url_filter
from quarry.llm.common import read_table

PIECE_MODEL = os.environ.get("QUARRY_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.duplicates(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(read_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(read_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.windows(read_table(spark, sf_dir, "conversations"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embedding_neardup, op2_url_filter, op3_simhash_neardup, op4_language_id, op5_mixing, op6_sharding, op7_topk_search, op8_secret_scan, op9_chat_format, op10_sentencepiece)
}

ORACLES: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op7_topk_search": topk_search.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op9_chat_format": chat_format.ORACLE_SQL,
}
