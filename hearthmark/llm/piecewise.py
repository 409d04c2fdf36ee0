"""Encoding by pieces: a text is cut where no token can reach across, and each distinct piece is encoded once.

Words repeat, so a worker keeps the ids of the pieces it has seen (at most ``limit``, then it starts anew; only time
depends on it). The ids of a text are the ids of its pieces in order, exactly those of the whole text.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\0"   # where a text is cut

CACHE_PIECES = 300_000


class PieceEncoder:
    """``encode_new(pieces)`` gives the ids of texts or pieces; ``cut(text)`` a list of pieces, or None to take the text as it is."""

    def __init__(self, encode_new: Callable[[list[str]], list[list[int]]], cut: Callable[[str], list[str] | None], dtype: str, limit: int = CACHE_PIECES):
        self.encode_new, self.cut, self.dtype, self.limit = encode_new, cut, np.dtype(dtype), limit
        self.code = self.dtype.char   # the same letter in the array module; both are little-endian where Spark runs
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for piece, ids in zip(pieces, self.encode_new(pieces)):
            self.known[piece] = array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed integers of ``dtype``."""
        if len(self.known) > self.limit:
            self.known = {}
        cut = [self.cut(t) for t in texts]
        whole = [t for t, pieces in zip(texts, cut) if pieces is None]
        new = {p for pieces in cut if pieces is not None for p in pieces}
        new.difference_update(self.known)
        if new:
            self._learn(list(new))
        of_whole = iter(self.encode_new(whole) if whole else ())
        get = self.known.__getitem__
        return [np.array(next(of_whole), self.dtype).tobytes() if pieces is None else b"".join(map(get, pieces)) for pieces in cut]


class MarkedEncoder:
    """``encode_new(texts)`` gives the ids of whole texts; ``marked(text)`` the text with MARK at each cut, or None to take it as it is.

    ``memory`` is a kind of dict that makes the packed ids of a piece it lacks by itself. Pieces are told apart and put back
    in order as arrays, so a piece is looked up once for all texts of a call, however often it stands there. Where there are
    more than ``limit`` pieces, those of the last texts are kept.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[list[int]]], marked: Callable[[str], str | None], dtype: str, memory: type[dict], limit: int = CACHE_PIECES):
        self.encode_new, self.marked, self.dtype, self.memory, self.limit = encode_new, marked, np.dtype(dtype), memory, limit
        self.known: dict[str, bytes] = memory()
        self.last: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed integers of ``dtype``."""
        if len(self.known) > self.limit:
            self.known = self.memory(self.last)
        marked = [self.marked(t) for t in texts]
        whole = [t for t, m in zip(texts, marked) if m is None]
        of_whole, of_cut = iter(self.encode_new(whole) if whole else ()), iter(self._pieces([m for m in marked if m is not None]))
        return [np.array(next(of_whole), self.dtype).tobytes() if m is None else next(of_cut) for m in marked]

    def _pieces(self, marked: list[str]) -> list[bytes]:
        if not marked:
            return []
        pieces = pc.split_pattern(pa.array([MARK.join(marked)], pa.large_string()), MARK).values.dictionary_encode()
        names = pieces.dictionary.to_pylist()
        distinct = [self.known[p] for p in names]
        self.last = dict(zip(names, distinct))
        held = np.frombuffer(b"".join(distinct), self.dtype)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // self.dtype.itemsize
        index = pieces.indices.to_numpy()
        of_piece = sizes[index]
        ends = np.cumsum(of_piece)
        from_start = (np.cumsum(sizes) - sizes)[index] - (ends - of_piece)
        ids = held[np.arange(ends[-1]) + np.repeat(from_start, of_piece)]
        last = np.cumsum([m.count(MARK) + 1 for m in marked]) - 1
        return [part.tobytes() for part in np.split(ids, ends[last[:-1]])]
