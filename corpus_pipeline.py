"""From raw documents to a selected, deduplicated, decontaminated, redacted and tokenised corpus.

Every stage takes the rows its predecessor kept, with the columns of
``documents``, and all but the last return these columns. Rows are named by
their id, null or not, and their text, so rows that share an id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from oddlines.llm import bpe, leaks, quality, secrets, setjoin
from oddlines.llm.common import table
from oddlines.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards rows labelled good; those that it rejects go."""
    drawn = quality.resample(docs, quality.good_ids(table(spark, sf_dir, "labels")))
    return drawn.select(*docs.columns)


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: links of 0.8 over five-word shingles."""
    return setjoin.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a mark in place of each secret; ``n_chars`` follows the text."""
    found = secrets.find_secrets(docs, secrets.infer(docs))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return secrets.redact(found).withColumn("n_chars", length).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, their number and digests."""
    encoded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select(*docs.columns, "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", keep_one_of_a_group),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # no stage can be told in SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
