"""The registered queries, one per operator, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthmark.llm import (exact_dedup, fill_middle, html_text, licenses, mixing, pii, quality, sentencepiece_codec, simhash, substring_dedup, token_files, url_rules,
                            vector_codes)
from hearthmark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Folder of the tokenizer files on every machine; see the package public_tokenizers.
TOKENIZERS = os.environ.get("HEARTHMARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def query(name: str, sql: str | None = None, source: str = "documents"):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(table(spark, folder, source))
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_substring_dedup")
def op1(documents: DataFrame) -> DataFrame:
    return substring_dedup.removed(documents)


@query("op2_simhash_neardup")
def op2(documents: DataFrame) -> DataFrame:
    return simhash.classes(documents)


@query("op3_license_scan", licenses.oracle_sql())
def op3(documents: DataFrame) -> DataFrame:
    return licenses.scanned(documents)


@query("op4_source_mix", mixing.oracle_sql())
def op4(documents: DataFrame) -> DataFrame:
    return mixing.mix(documents)


@query("op5_quality_rules", quality.oracle_sql())
def op5(documents: DataFrame) -> DataFrame:
    return quality.report(documents)


@query("op6_token_files")
def op6(documents: DataFrame) -> DataFrame:
    return token_files.round_trip(documents, BYTE_BPE)


@query("op7_exact_dedup", exact_dedup.oracle_sql())
def op7(documents: DataFrame) -> DataFrame:
    return exact_dedup.classes(documents)


@query("op8_pii")
def op8(documents: DataFrame) -> DataFrame:
    return pii.marked(documents)


@query("op9_html_text", source="pages")
def op9(pages: DataFrame) -> DataFrame:
    return html_text.extracted(pages)


@query("op10_sentencepiece")
def op10(documents: DataFrame) -> DataFrame:
    return sentencepiece_codec.encoded(documents, PIECE_MODEL)


@query("op11_url_rules", url_rules.oracle_sql(), source="pages")
def op11(pages: DataFrame) -> DataFrame:
    return url_rules.judged(pages, url_rules.rules_table(pages.sparkSession))


@query("op12_vector_codes", vector_codes.oracle_sql(), source="embeddings")
def op12(embeddings: DataFrame) -> DataFrame:
    return vector_codes.compressed(embeddings)


@query("op13_fill_middle", fill_middle.oracle_sql())
def op13(documents: DataFrame) -> DataFrame:
    return fill_middle.report(documents)
