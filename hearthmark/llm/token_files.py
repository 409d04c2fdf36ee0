"""Token ids as flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

Documents are range-partitioned and sorted by id; every partition writes three files of its own:

    <stem>.tokens    ids, little-endian unsigned, 2 bytes each if all ids fit, else 4
    <stem>.offsets   n + 1 little-endian 64-bit integers: document k has the tokens offsets[k] to offsets[k + 1]
    <stem>.docs      n little-endian 64-bit document ids (a null id is the smallest integer)

The manifest (a table of one row per partition) names the files that count, so a task that ran twice does no harm:
its other files are not in it. Bases of partitions are prefix sums over the manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import SLICE_BYTES, cut_lineage, fresh_folder, text_or_empty
from hearthmark.llm.piecewise import MARK, MarkedEncoder

END_ID = 2
PIECES = 800_000   # kept in a worker: some 160 MB
NULL_ID = np.iinfo(np.int64).min
MANIFEST = "part int, stem string, n_docs long, n_tokens long"

_ENCODERS: dict[str, MarkedEncoder] = {}


def byte_level_encoder(path: str) -> MarkedEncoder:
    """Encoder for a byte-level BPE file of the tokenizers library; one for each worker and file.

    Its pre-tokenizer never joins what precedes a blank to that blank if the next character is not white space, so texts
    are cut there. Texts that hold the name of an added token, or the sign that marks cuts, are encoded whole.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        names = [t.content for t in tok.get_added_tokens_decoder().values()]
        added = re.compile("|".join(map(re.escape, [MARK, *names])))
        odd = re.compile(r" (?:\s|$)")
        before_word = re.compile(r" (?=\S)")
        mark = MARK + " "

        def marked(text: str) -> str | None:
            if added.search(text):
                return None
            return before_word.sub(mark, text) if odd.search(text) else text.replace(" ", mark)   # the latter is quicker

        # A piece is a word or little more: the library's two steps, without the offsets and masks of a full encoding. The
        # first one leaves a blank and letters as they are, in the alphabet of bytes, and parts them from the signs that end a piece.
        split, tokenize = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelling = [chr(b) if b in printed else "" for b in range(256)]
        for k, b in enumerate(b for b in range(256) if b not in printed):
            spelling[b] = chr(256 + k)
        blank = spelling[32]

        dtype = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        code = np.dtype(dtype).char   # the same letter in the array module; both are little-endian where Spark runs

        def packed(parts: list[str]) -> bytes:
            return array(code, [t.id for part in parts for t in tokenize(part)]).tobytes()

        @lru_cache(maxsize=10_000)
        def of_signs(run: str) -> bytes:
            return packed([part for part, _ in split(run)])

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                word = piece.rstrip(punctuation)
                if word != piece and word[word[:1] == " ":].isalpha():
                    ids = self[word] + of_signs(piece[len(word):])
                elif piece.isalpha() and piece.isascii():
                    ids = packed([piece])
                elif piece[:1] == " " and piece[1:].isalpha():
                    ids = packed([blank + piece[1:] if piece.isascii() else "".join([spelling[b] for b in piece.encode()])])
                else:
                    ids = packed([part for part, _ in split(piece)])
                self[piece] = ids
                return ids

        def encode_whole(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

        _ENCODERS[path] = MarkedEncoder(encode_whole, marked, dtype, Known, PIECES)
    return _ENCODERS[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a path as Spark writes it (a URI, or a local path)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files and return the manifest, which is read back from the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = byte_level_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        stem = f"{part:05d}-{uuid.uuid4().hex}"
        store, root = _open(folder)
        lengths, ids = [], []
        with store.open_output_stream(f"{root}/{stem}.tokens") as out:
            for batch in batches:
                rows = max(1, min(batch.num_rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, rows):
                    some = batch.slice(at, rows)
                    packed = encoder.encode(some.column(1).to_pylist())
                    out.write(b"".join(x + end for x in packed))
                    lengths.append(np.fromiter(map(len, packed), np.int64, len(packed)) // encoder.dtype.itemsize + 1)
                    ids.append(np.asarray(some.column(0).fill_null(NULL_ID)))
        if not lengths:
            store.delete_file(f"{root}/{stem}.tokens")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        for kind, values in (("offsets", offsets), ("docs", np.concatenate(ids))):
            with store.open_output_stream(f"{root}/{stem}.{kind}") as out:
                out.write(values.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([stem]), pa.array([len(offsets) - 1]), pa.array([int(offsets[-1])])],
                                         ["part", "stem", "n_docs", "n_tokens"])

    store, root = _open(folder)
    store.create_dir(root)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return cut_lineage(d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST))


def mapped(folder: str, stem: str, kind: str, dtype: str) -> np.ndarray:
    """A file as an array; memory-mapped where the folder is one of this machine's paths."""
    store, root = _open(folder)
    path = f"{root}/{stem}.{kind}"
    if isinstance(store, fs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer(), dtype)
    return np.frombuffer(store.open_input_file(path).read_buffer(), dtype)


def read(manifest: DataFrame, folder: str, dtype: str) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens before it), n_tokens, ids_crc32 of its 32-bit ids."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, offsets, ids = (mapped(folder, row["stem"], k, t) for k, t in (("tokens", dtype), ("offsets", "<i8"), ("docs", "<i8")))
                crc = np.fromiter((zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NULL_ID), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crc)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row is one file, so rows are dealt out however small they are
    n = max(1, manifest.rdd.getNumPartitions())
    return parts.select("stem", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents and read them back.

    Null text: only the end id. Null ids come first. Rows of one id stand in order of their texts. An empty table writes
    no files and reads no rows.
    """
    folder = fresh_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, end_id), folder, byte_level_encoder(tokenizer).dtype.str)
