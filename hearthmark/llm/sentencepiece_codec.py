"""SentencePiece models on the tokenizers library: encoding and decoding, checked against the original library.

The model file is a protobuf message; the few fields that matter are read here. From them the normaliser, the marker of
word starts, the vocabulary (merges of a BPE model by score, or unigram scores) and the byte fallback are rebuilt.

Every distinct piece of text that a worker meets is encoded by both libraries in multithreaded batches. Where they
should disagree the original's ids are used and the document is marked, so results are SentencePiece's in any case.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearthmark.llm.common import map_batches, text_or_empty
from hearthmark.llm.piecewise import PieceEncoder

MARK = "▁"
THREADS = "2"   # of the tokenizers library in a worker; two tasks share an executor's cores
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)   # piece types of the format


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    mark_blanks: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of each field of a protobuf message: int, float (32 bits) or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif wire == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def read_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            m.pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            m.kind, m.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze_blanks, m.mark_blanks = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return m


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to make a piece from two pieces, best score first."""
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in usable.items():
        halves = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
        found += [(-model.pieces[i][1], i, usable[a], usable[b], a, b) for a, b in halves if a in usable and b in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, models, normalizers
    names = [p for p, _, _ in model.pieces]
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(names)}, merges(model), unk_token=None if unknown is None else names[unknown],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}: only unigram and BPE models are read")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.mark_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tok = Tokenizer(core)
    tok.normalizer = normalizers.Sequence(steps)
    return tok


class Codec:
    """Encoder and decoder of one model file in a worker."""

    def __init__(self, path: str, check: bool = True):
        with open(path, "rb") as f:
            self.model = read_model(f.read())
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        self.tokenizer = build(self.model)
        self.original = None
        if check:
            import sentencepiece
            self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.differ: set[str] = set()
        kinds = np.array([kind for _, _, kind in self.model.pieces])
        self.is_byte = kinds == BYTE
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL
                        else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        # pieces never reach over the start of a word, so texts may be cut there, unless the model squeezes or maps characters
        inner = re.compile(f"[^{MARK}]{MARK}")
        m = self.model
        self.cuts = m.mark_blanks and m.dummy_prefix and not m.squeeze_blanks and not m.charsmap and not any(
            inner.search(p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))
        self.encoder = PieceEncoder(self._encode_new, self._cut, "<i4")
        self._runs = re.compile(" *[^ ]+| +")

    def _cut(self, text: str) -> list[str] | None:
        """Pieces without the blank that the model puts (or finds) in front of each."""
        if not text:
            return []
        if not self.cuts or MARK in text or text.endswith(" "):
            return None
        pieces = text.split(" ")
        if "" in pieces:
            return [p[1:] for p in self._runs.findall(" " + text)]
        return pieces

    def _encode_new(self, pieces: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        if self.original is not None:
            wanted = self.original.encode(pieces, num_threads=1)
            for k, (a, b) in enumerate(zip(ids, wanted)):
                if a != b:
                    self.differ.add(pieces[k])
                    ids[k] = b
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<i4") for x in self.encoder.encode(texts)]

    def agrees(self, text: str) -> bool:
        """Whether both libraries gave the same ids for all pieces of a text that was encoded."""
        return not self.differ or self.differ.isdisjoint(self._cut(text) or [text])

    def decode(self, ids: np.ndarray) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


# Text encoded at a time in a worker: all of its words, and the encodings of those not met before, are held at once.
SLICE = 1 << 20
SCHEMA = "doc_id long, token_ids array<int>, n_tokens long, n_byte_tokens long, ids_crc32 long, agrees boolean, round_trip boolean"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, token_ids, n_tokens, n_byte_tokens (spelled by bytes), ids_crc32 of the little-endian 32-bit
    ids, agrees (both libraries alike), round_trip (decoding gives the text).

    Null and empty texts have no tokens and decode to an empty text. Rows that repeat get equal results.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = batch.column(1).to_pylist()
        ids = c.encode(texts)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lists, pa.array(sizes), pa.array([int(c.is_byte[x].sum()) for x in ids], pa.int64()),
             pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([c.agrees(t) for t in texts]),
             pa.array([c.decode(x) == t for x, t in zip(ids, texts)])],
            ["doc_id", "token_ids", "n_tokens", "n_byte_tokens", "ids_crc32", "agrees", "round_trip"])
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return map_batches(d, run, SCHEMA, SLICE)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, token_ids): doc_id, text. Null ids give a null text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return map_batches(tokens.select("doc_id", "token_ids"), run, "doc_id long, text string", SLICE)
