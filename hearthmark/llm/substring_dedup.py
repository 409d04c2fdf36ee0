"""Substring dedup: suffix automata over shards of repeated passages, streamed for matching statistics.

1.  Words are hashed. Every window of WINDOW words is owned by its *anchor*, the smallest hash of SEED_WORDS consecutive
    words in it, so equal windows have equal anchors wherever they stand. A *passage* is a run of consecutive windows with
    one anchor; only anchors with two passages or more can hold a repeat, which leaves little of a corpus.
2.  The reference of a shard are the distinct passages of its anchors, each with its number of copies, as sequences of
    hashes of GRAM words. A suffix automaton per anchor counts the copies of each substring; streaming a passage through
    it gives the matching statistics, and a window is repeated if its whole length is matched by a state that occurs
    twice. Copies of a passage were added up before, so a passage that fills a third of the corpus is one row here.
    Anchors with very many different passages are split further, by the hash of each window.
3.  The answers go to the documents as ranges of windows; their words are removed as maximal spans.

An automaton is handed to the task of its shard only; its size is bounded by MAX_PASSAGES.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import cut_lineage, map_batches, text_or_empty

WINDOW = 35
SEED_WORDS = 10
MAX_PASSAGES = 512     # distinct passages of an anchor in one automaton; beyond, its windows are dealt out by hash
SHARDS_PER_PARTITION = 8
SLICE = 2 << 20        # bytes of text hashed at once in a worker
NULL_ID = -(1 << 63)
SPLITS = 4_096         # shards of such an anchor
_BASE = 0xD6E8FEB86659FD93
_MIX = 0x9E3779B97F4A7C15


# --- hashes of words and runs of words ---

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text; no step is per word.

    A hash is a polynomial of the bytes of a word (bytes count from 1, so that none is lost), stirred at the end.
    """
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.cumsum([len(r) + 1 for r in raw])
    sizes = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), sizes
    spans = np.diff(starts, append=len(data))
    local = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    powers = np.cumprod(np.full(spans.max(), _BASE, np.uint64))
    terms = (data[starts[0]:].astype(np.uint64) + np.uint64(1)) * powers[local]
    terms[blank[starts[0]:]] = 0
    x = np.add.reduceat(terms, starts - starts[0]) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32)), sizes


def run_hashes(a: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` values, by doubling."""
    done, done_len, block, block_len = None, 0, a, 1
    while True:
        if length & block_len:
            if done is None:
                done, done_len = block, block_len
            else:
                n = max(0, len(a) - done_len - block_len + 1)
                done = done[:n] * np.uint64(pow(_BASE, block_len, 1 << 64)) + block[done_len:done_len + n]
                done_len += block_len
        if done_len == length:
            break
        n = max(0, len(block) - block_len)
        block = block[:n] * np.uint64(pow(_BASE, block_len, 1 << 64)) + block[block_len:block_len + n]
        block_len *= 2
    x = done * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


_PLACE = (1 << 32) - 1   # bits of a value that give way to its place


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in each run of ``width``, the last one of equals, by doubling.

    Values are compared by their upper 32 bits; the choice depends on nothing but the run itself.
    """
    least = (values | np.uint64(_PLACE)) - np.arange(len(values), dtype=np.uint64)
    size = 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    return (np.uint64(_PLACE) - (least & np.uint64(_PLACE))).astype(np.int64)


def gram_words(window: int) -> int:
    """Words of a token of the automata: windows are a few tokens long."""
    return max(1, window - 3)


def passages(texts: list[str], window: int, with_tokens: bool):
    """Passages of all texts: row of the text, anchor hash, first window, number of windows, and the tokens they span."""
    flat, sizes = word_hashes(texts)
    starts = np.cumsum(sizes) - sizes
    seed = min(SEED_WORDS, window)
    if len(flat) < window:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none, (np.empty(0, np.uint64), none, 0)
    seeds = run_hashes(flat, seed)
    owner = last_minimum(seeds, window - seed + 1)
    row = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - window + 1))
    per = np.maximum(0, sizes - window + 1)
    first = np.repeat(np.cumsum(per) - per, per)
    local = np.arange(len(row)) - first
    at = starts[row] + local
    mine = owner[at]
    new = np.ones(len(row), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(row)))
    spans = ()
    if with_tokens:
        gram = gram_words(window)
        grams = run_hashes(flat, gram)
        extra = window - gram
        spans = (grams, at[heads], extra)
    return row[heads], seeds[mine[heads]], local[heads], counts, spans


# --- suffix automaton ---

class SuffixAutomaton:
    """Of several sequences with weights; ``count`` of a state is how often its substrings occur, weights included."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length), self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, token: int) -> int:
        """The state that p reaches by token, made as short as p asks for."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for token in sequence:
            if token in self.next[last]:
                last = self._split(last, token)
            else:
                state, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = state
                    p = self.link[p]
                self.link[state] = self._split(p, token) if p >= 0 else 0
                last = state
            self.count[last] += weight

    def close(self) -> None:
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list[int], length: int) -> list[bool]:
        """For each run of ``length`` tokens: whether it occurs twice or more in all that was added."""
        state = matched = 0
        out = []
        for k, token in enumerate(sequence):
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if token in self.next[state]:
                state, matched = self.next[state][token], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= length:
                state = self.link[state]
                matched = self.length[state]
            if k >= length - 1:
                out.append(matched >= length and self.count[state] > 1)
        return out


def repeats(sequences: list[list[int]], weights: list[int], length: int) -> list[list[bool]]:
    """Whether each run of ``length`` tokens of each sequence occurs twice or more among all, weights counted."""
    if len(sequences) == 1 and weights[0] > 1:
        return [[True] * (len(sequences[0]) - length + 1)]   # one passage and its copies: everything is matched in full
    automaton = SuffixAutomaton()
    for s, w in zip(sequences, weights):
        automaton.add(s, w)
    automaton.close()
    return [automaton.repeated(s, length) for s in sequences]


# --- Spark side ---

KEYS = ["doc_id", "text_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id (NULL_ID if null) and text, so that ids may repeat."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       text_or_empty("text").alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, anchor, *_ = passages(batch.column(2).to_pylist(), window, False)
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), _signed(anchor)], [*KEYS, "anchor"])
    return map_batches(docs.select(*KEYS, "text"), run, "doc_id long, text_hash long, anchor long", SLICE)


def _passages(chosen: DataFrame, window: int) -> DataFrame:
    """Passages of ``chosen`` (keys, text, anchors) that have one of the document's ``anchors``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, anchor, lo, n, (grams, at, extra) = passages(batch.column(2).to_pylist(), window, True)
        lists = batch.column(3)
        owners = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        wanted = np.asarray(lists.values)[lists.offsets[0].as_py():lists.offsets[-1].as_py()]
        both = np.rec.fromarrays([row, anchor.view(np.int64)])
        keep = np.flatnonzero(np.isin(both, np.rec.fromarrays([owners, wanted]))) if len(row) else np.empty(0, np.int64)
        data = [grams[a:a + c + extra].tobytes() for a, c in zip(at[keep].tolist(), n[keep].tolist())]
        pick = pa.array(row[keep])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pick), batch.column(1).take(pick), _signed(anchor[keep]), pa.array(lo[keep].astype(np.int32)),
             pa.array(data, pa.binary())],
            [*KEYS, "anchor", "lo", "tokens"])
    return map_batches(chosen.select(*KEYS, "text", "anchors"), run, "doc_id long, text_hash long, anchor long, lo int, tokens binary", SLICE)


def _shards(distinct: DataFrame, length: int, most: int) -> DataFrame:
    """Rows (anchor, split, passage, first window, tokens, copies): whole passages, or single windows of crowded anchors."""
    # the sum keeps the columns of both uses of ``distinct`` alike, so that it is shuffled once
    sizes = distinct.groupBy("anchor").agg(F.count("tokens").alias("n"), F.sum("copies").alias("copies"))
    crowded = sizes.where((F.col("n") > most) & (F.col("copies") > most)).select(F.col("anchor").alias("crowded"))
    d = distinct.join(crowded, F.col("anchor") == F.col("crowded"), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            if r["crowded"] is None:
                out.append((r["anchor"], 0, r["passage"], 0, r["tokens"], r["copies"]))
                continue
            for k in range(len(r["tokens"]) // 8 - length + 1):
                one = r["tokens"][8 * k:8 * (k + length)]
                out.append((r["anchor"], xxhash.xxh64_intdigest(one) % SPLITS, r["passage"], k, one, r["copies"]))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                                          ["anchor", "split", "passage", "first", "tokens", "copies"])
    return map_batches(d, run, "anchor long, split int, passage binary, first int, tokens binary, copies long")


def _answers(rows: DataFrame, length: int) -> DataFrame:
    """Rows (passage, first window, one byte a window: 1 if repeated) with a repeat; a shard holds many anchors, one after the other."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("anchor", "ascending"), ("split", "ascending")])
        keys = np.rec.fromarrays([t["anchor"].to_numpy(), t["split"].to_numpy()])
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), t.num_rows] if t.num_rows else [0]
        tokens, copies = t["tokens"].to_pylist(), t["copies"].to_pylist()
        flags = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            sequences = [np.frombuffer(x, np.uint64).tolist() for x in tokens[a:b]]
            flags += map(bytes, repeats(sequences, copies[a:b], length))
        keep = pa.array([b"\1" in f for f in flags], pa.bool_())
        return pa.table({"passage": t["passage"], "first": t["first"], "flags": pa.array(flags, pa.binary())}).filter(keep)
    shards = SHARDS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("anchor", "split"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(run, "passage binary, first int, flags binary")


def covered(n_words: int, ranges: list[tuple[int, bytes]], window: int) -> np.ndarray:
    """Words that lie in a window whose flag is set; ``ranges``: (first window, flags)."""
    hit = np.zeros(n_words + 1, np.int64)
    for first, flags in ranges:
        hit[first:first + len(flags)] |= np.frombuffer(flags, np.uint8)
    open_windows = np.cumsum(hit)
    open_windows[window:] -= np.cumsum(hit)[:-window]
    return open_windows[:-1] > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, most: int = MAX_PASSAGES) -> DataFrame:
    """(doc_id, text_hash, ranges of (first window, flags)) of documents with a window that also starts elsewhere.

    ``docs`` is the result of ``_keyed``.
    """
    anchors = _anchors(docs, window)
    # written first: as a plain scan its side of the join is dealt out anew, and the planner can split a crowded anchor
    often = cut_lineage(anchors.groupBy("anchor").count().where("count > 1").select("anchor"))
    mine = cut_lineage(anchors.join(often, "anchor", "left_semi").groupBy(*KEYS).agg(F.collect_set("anchor").alias("anchors")))
    chosen = _beside(docs, mine, "inner")
    found = _passages(chosen, window)
    length = window - gram_words(window) + 1
    name = F.unhex(F.md5("tokens")).alias("passage")
    distinct = found.groupBy("anchor", "tokens").agg(F.count("*").alias("copies")).select("*", name)
    answers = _answers(_shards(distinct, length, most), length).withColumnRenamed("passage", "of")
    hits = found.select(*KEYS, "lo", name).join(answers, F.col("passage") == F.col("of"))
    return hits.groupBy(*KEYS).agg(F.collect_list(F.struct((F.col("lo") + F.col("first")).alias("first"), "flags")).alias("ranges"))


def _beside(docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Join on the keys; the texts are dealt out once for all such joins, and stream past the small side."""
    return docs.join(small.hint("shuffle_hash"), KEYS, how)


def removed(docs: DataFrame, window: int = WINDOW, most: int = MAX_PASSAGES, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space), and kept_text if asked for.

    A word goes if it lies in a window of ``window`` words whose sequence also starts anywhere else, in the same document
    or in another; all windows are judged on the input. Null and empty texts have no words; texts shorter than a window
    stay whole. Repeated rows are copies of each other and lose what they share.
    """
    d = _keyed(docs)
    joined = _beside(d, repeated_windows(d, window, most), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, gone, shas, texts = [], [], [], []
        lists = batch.column(2)
        first, flags = (lists.values.field(k).to_pylist() for k in (0, 1))
        bounds = lists.offsets.to_pylist()
        for text, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:]):
            words = text.encode().split()
            kept = words
            if a < b:
                mask = covered(len(words), list(zip(first[a:b], flags[a:b])), window)
                kept = [w for w, m in zip(words, mask.tolist()) if not m]
            line = b" ".join(kept)
            sizes.append(len(words)), gone.append(len(words) - len(kept)), shas.append(hashlib.sha256(line).hexdigest())
            if with_text:
                texts.append(line.decode())
        ids = np.asarray(batch.column(0))
        out = [pa.array(ids, mask=ids == NULL_ID), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas)]
        return pa.RecordBatch.from_arrays(out + [pa.array(texts)] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_batches(joined.select("doc_id", "text", "ranges"), run, schema)

