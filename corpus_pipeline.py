"""The corpus pipeline: the stages that turn raw documents into token ids.

Each stage works on all that the one before it kept. Language identification, near-duplicate removal, secret redaction and mixing return the
columns of ``documents``; the last stage returns ``doc_id``, the piece ids and whether they decode to the text, of every row it gets.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import language_id, mixing, piece_codec, secret_scan, simhash_neardup
from quarry.shared import materialize

#: The SentencePiece model; a path that all executors can read.
PIECE_MODEL = os.environ.get("QUARRY_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, ``lang`` set to it; the others go.

    A null or empty text, or one without a letter or that fits no label, goes; a null ``doc_id`` stays. Repeated rows are judged alike. Of labels that tie the first counts.
    Texts are scored whole. Columns of any name pass through. No row, or no label to learn from, gives no row.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Rows of one ``doc_id`` stay or go together; a null ``doc_id``, and a null or empty text, always stays. Texts are compared whole. Columns of any name pass
    through. No row gives no row.
    """
    return simhash_neardup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and ``n_chars`` follows.

    A null or empty text stays as it is. Texts are scanned whole; spans that overlap are replaced as one. Repeated rows are treated alike. Columns of any name pass through.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budget of their (domain, language, source), a row for each epoch that uses one.

    A null or empty text has no tokens and is never used; a null name counts as ``unknown``. Rows of one ``doc_id`` enter an epoch together; ties of the seeded order go by
    ``doc_id``, null first. Texts are counted whole. Columns of any name pass through. No row gives no row.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, round_trip) of every row; nulls stay null, empty texts have no ids, repeated rows are encoded each, texts of any length whole. No row gives no row."""
    return piece_codec.encode(docs, PIECE_MODEL)


STAGES = [
    ("language identification", identify_language),
    ("SimHash near-duplicates", drop_near_duplicates),
    ("secret redaction", redact_secrets),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: SQL expresses neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage returns is written to the shared folder once and read by the next, so no stage runs again for a later one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
