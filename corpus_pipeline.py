"""A corpus from raw documents to token ids: five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as the docs of
the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthmark.llm import exact_dedup, mixing, quality, sentencepiece_codec, shingles
from hearthmark.llm.common import fresh_folder, table
from hearthmark.llm.queries import PIECE_MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts fail them."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, the longest original, then the smallest id."""
    return exact_dedup.drop_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their 5-word shingles), the one with the smallest id.

    Copies are proposed by op2's search (SimHash, vantage-point trees) and by MinHash bands, and compared in full.
    """
    return shingles.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding. One row for each row that comes in."""
    return sentencepiece_codec.encoded(docs, PIECE_MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

# SentencePiece encoding and components of near copies are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table ``documents``; stage results go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
