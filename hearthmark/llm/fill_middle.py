"""Fill-in-the-middle: a text is cut into units and written as prefix, suffix and middle, in one of two orders.

The pieces are cut by a pipeline of ``pyarrow.compute`` steps over a batch, without a loop over units: texts are split
into lists of units, the lists are flattened with the number of their row, units get their ordinal, each role (prefix,
middle, suffix) keeps its units, lists are built again and their units joined.

Where to cut and which form to take follows from the digest of the id alone, so reruns and repeated ids agree. A document
is worked on by itself: nothing is shuffled.

Defined results: a null text is an empty one, and an empty text stays plain. A null id takes the place of an empty one in
the digest. A text that holds one of the marks stays plain, so that every output can be read back. Repeated rows are rows
of their own, an empty table gives no rows, and extra columns are not read. A batch is cut into groups of rows of about
SLICE_BYTES; a longer text is a group of its own and takes some twenty times its size in a worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import map_batches, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM = 90      # of 100: documents from here on stay plain
SPM_BELOW = 20       # of 100: the others that put the suffix first
UNIT = "[A-Za-z]+|[^A-Za-z]"
SLICE_BYTES = 2 << 20

# A unit in UTF-8: letters, another ASCII character, or the lead byte of a character and the bytes that follow it.
_UNIT_BYTES = rb"([A-Za-z]+|[\x00-@\[-`{-\x7F]|[\xC0-\xFF][\x80-\xBF]*)"
_END = b"\xff"       # a byte that no UTF-8 text holds

PIECES_SCHEMA = "doc_id long, n long, form string, prefix string, middle string, suffix string, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def unit_lists(texts: pa.Array) -> pa.ListArray:
    """The units of each text as lists of binaries."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=_UNIT_BYTES, replacement=rb"\1" + _END)
    return pc.split_pattern(marked, pattern=_END)   # with an empty string after the last unit


def _joined(units: pa.Array, rows: np.ndarray, count: int) -> pa.Array:
    """The units of each of ``count`` rows as one string; ``rows`` is sorted."""
    starts = np.searchsorted(rows, np.arange(count + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), units), b"").cast(pa.string())


def _rearranged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, text, first and second draw, whether the row may be cut, whether its suffix goes first -> PIECES_SCHEMA."""
    doc_id, text, one, two, cut, spm = batch.columns
    lists = unit_lists(text)
    units, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    n = length - 1
    ordinal = np.arange(len(parent)) - np.repeat(np.cumsum(length) - length, length)
    a, b = one.to_numpy(zero_copy_only=False) % (n + 1), two.to_numpy(zero_copy_only=False) % (n + 1)
    first, last = np.minimum(a, b)[parent], np.maximum(a, b)[parent]
    pieces = []
    for role in (ordinal < first, (ordinal >= first) & (ordinal < last), ordinal >= last):
        pieces.append(_joined(pc.filter(units, pa.array(role)), parent[role], batch.num_rows))
    prefix, middle, suffix = pieces
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    turned = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    none = pa.scalar(None, pa.string())
    form = pc.if_else(cut, pc.if_else(spm, "spm", "psm"), "plain")
    output = pc.if_else(cut, pc.if_else(spm, turned, psm), text)
    held = [pc.if_else(cut, piece, none) for piece in (prefix, middle, suffix)]
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n), form, *held, output], ["doc_id", "n", "form", "prefix", "middle", "suffix", "output"])


def rearranged(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), its three pieces (null if plain) and the output text."""
    text = text_or_empty("text")
    one, two, three, four = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (three % 100 >= PLAIN_FROM)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), one.alias("one"), two.alias("two"), (~plain).alias("cut"),
                       (four % 100 < SPM_BELOW).alias("spm"))
    return map_batches(rows, _rearranged, PIECES_SCHEMA, SLICE_BYTES)


def restored(output: Column, form: Column) -> Column:
    """The text again. Pieces hold no mark, and no mark can arise where a piece meets a mark."""
    cut = F.split(output, "<[PSM]>", -1)     # nothing, then the three pieces in the order of the form
    return F.when(form == "psm", F.concat(cut[1], cut[3], cut[2])).when(form == "spm", F.concat(cut[2], cut[3], cut[1])).otherwise(output)


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Digests of output and restored text of every document."""
    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)
    return rearranged(docs, seed).select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql(source: str = "documents", seed: int = SEED) -> str:
    return f"""
    WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {source}),
    drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
        CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}')
        OR contains(t, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM pieces"""
