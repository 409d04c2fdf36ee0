"""Small helpers of the operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.session import cut_lineage, held, shared_folder

# Characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

__all__ = ["BLANKS", "WORD", "count_words", "cut_lineage", "fresh_folder", "held", "kept_once", "kept_rows", "map_batches", "split_words", "table", "text_mark", "text_or_empty"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def split_words(text: Column) -> Column:
    """Array of the words of a text, unchanged."""
    return F.array_remove(F.split(text, f"{BLANKS}+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, slice_bytes: int | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; a batch holds a bounded number of rows and is all that is in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from slices(batch, fn, slice_bytes or SLICE_BYTES)
    return df.mapInArrow(run, schema)


# Text handled at a time in a worker: rows of a batch are cut into groups of about so many bytes.
SLICE_BYTES = int(os.environ.get("HEARTHMARK_SLICE_BYTES", 8 << 20))


def slices(batch: pa.RecordBatch, fn: Callable[[pa.RecordBatch], pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield fn(batch.slice(at, rows))


def kept_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``ids``, all columns as they are; a null id matches a null id."""
    wanted = ids.select(F.col("doc_id").alias("__kept_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__kept_id"]), "left_semi")


def text_mark(text: str | Column = "text") -> Column:
    """Tells rows of one id apart that hold different texts."""
    return F.xxhash64(text_or_empty(text))


def kept_once(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``winners`` (doc_id, mark, copies), all columns as they are; a null id matches a null id.

    ``winners``: written, no repeats; ``copies`` tells how many rows have that id and mark. Only those rows are reduced that
    repeat both, and on the map side first.
    """
    w = winners.select(F.col("doc_id").alias("__kept_id"), F.col("mark").alias("__kept_mark"), F.col("copies").alias("__copies"))

    def hits(only: DataFrame, how: str) -> DataFrame:
        return docs.join(only, docs["doc_id"].eqNullSafe(only["__kept_id"]) & (text_mark(docs["text"]) == only["__kept_mark"]), how)
    if w.where("__copies > 1").isEmpty():
        return hits(w, "left_semi")
    repeated = hits(w.where("__copies > 1"), "inner").dropDuplicates(["__kept_id", "__kept_mark"]).select(*[docs[c] for c in docs.columns])
    return hits(w.where("__copies = 1"), "left_semi").union(repeated)
