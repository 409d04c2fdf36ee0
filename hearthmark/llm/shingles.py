"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash bands for candidates, exact comparison of the sets.

1.  A document is the set of hashes of its runs of SHINGLE words. Documents with one set are one node.
2.  Nodes whose SimHash fingerprints are at most CLOSE bits apart are found as in op2, by ``simhash.near_links`` (vantage-point
    trees), over shingles of this module. Trees do not reach all pairs that are LEAST alike (some ten bits apart), so keys of
    MinHash bands find the rest: BANDS keys of ROWS minima each: two sets of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS,
    which is 0.998 at 0.8. Keys that one node alone has are dropped before anything is written.
3.  Then every node is compared with the smallest of the nodes that it shares a key with. What is linked by then is one
    component. Then, in buckets that still hold several components, every node is compared with FEW nodes of other components,
    and in those that are open after that with LEADERS, which is all of them in all but crowded buckets. From one step to the
    next goes one pair for each node of a component, not its links. Nodes are paired only if their odd sketches allow it: bit k of
    a sketch tells whether an odd number of hashes fall on k, so the sketches of two sets differ in no more bits than the sets
    in hashes, and sets that differ in more than (1 - LEAST) / (1 + LEAST) of all their hashes are not alike.
4.  In crowded buckets that are still open, a node more than a fifth of whose shingles no other node there has cannot have
    a near copy, and is left out; this holds without exception, and leaves few. The others are compared with all nodes of
    other components, by their sketches and by what they share with any other. So no pair of a bucket is left out but those
    that are linked already or cannot be alike. What is left to be compared in full is about as much as is alike; sketches of
    a crowded bucket that is still open meet each other all the same. Sets of over a thousand shingles fill their sketches.
5.  A link holds if the sets, read in full, are at least LEAST alike. Sets of one node are sent to a part of the pairs of
    another once, and its partners stream past. Components are those of ``simhash.components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import fresh_folder, kept_once, map_batches, text_mark, text_or_empty
from hearthmark.llm.simhash import components, fingerprint, near_links
from hearthmark.llm.substring_dedup import run_hashes, word_hashes

SHINGLE = 5
LEAST = 0.8     # similarity of a link
BANDS = 16
ROWS = 5
CLOSE = 7       # differing bits of fingerprints that are compared in full; up to 7 the trees visit as many shards as with 4
SKETCH = 512    # bits of an odd sketch
PARTS = [f"sketch_{k}" for k in range(SKETCH // 64)]
FEW = 2         # nodes of a bucket that all others of it are compared with first; most that are alike are one component then
LEADERS = 32    # nodes of a bucket that all others of it are compared with before any are compared with all
PARTNERS = 4_096  # pairs of one node in one sorted run
CHUNK = 2_048   # shingles hashed at once
SLICE = 2 << 20  # bytes of text hashed at once in a worker
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the word runs of each text (A-Z lower-cased); a shorter text is one run, an empty one has the run 0."""
    flat, sizes = word_hashes([(t or "").encode().lower().decode() for t in texts])
    runs = run_hashes(flat, shingle) if len(flat) >= shingle else flat[:0]
    out, at = [], 0
    for n in sizes.tolist():
        if n >= shingle:
            out.append(np.unique(runs[at:at + n - shingle + 1]))
        else:
            out.append(run_hashes(flat[at:at + n], n) if n else np.zeros(1, np.uint64))
        at += n
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One key per band of a set."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for k in range(0, len(held), CHUNK):
        least = np.minimum(least, (held[k:k + CHUNK, None] * _FACTORS + _ADDED).min(axis=0))
    mixed = np.ascontiguousarray(least.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh64_intdigest(m.tobytes(), k) for k, m in enumerate(mixed)], np.uint64)


def odd_sketch(held: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs: bit k is set if an odd number of hashes fall on k."""
    odd = np.bincount((held >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _long(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def nodes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark (of the text), node (hash of the set), size, keys and sketch (of the set), fp (SimHash of the text) of every document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sets = shingle_sets(texts, shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _long(xxhash.xxh64_intdigest(s.tobytes()) for s in sets), pa.array([len(s) for s in sets], pa.int32()),
                                           pa.array([band_keys(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                                           pa.array([odd_sketch(s).tolist() for s in sets], pa.list_(pa.int64())), _long(fingerprint(t, shingle) for t in texts)],
                                          ["doc_id", "mark", "node", "size", "keys", "sketch", "fp"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), text_mark().alias("mark")), run,
                       "doc_id long, mark long, node long, size int, keys array<long>, sketch array<long>, fp long", SLICE)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once and held once."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, held (its sorted hashes as bytes) of the nodes in ``wanted`` (node, doc_id of one document of it)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(0).to_pylist(), shingle)
        return pa.RecordBatch.from_arrays([_long(xxhash.xxh64_intdigest(s.tobytes()) for s in sets), pa.array([s.tobytes() for s in sets], pa.binary())],
                                          ["node", "held"])
    w = wanted.select(F.col("doc_id").alias("__of"))
    d = docs.select(F.col("doc_id").cast("long").alias("__id"), text_or_empty("text").alias("text"))
    found = map_batches(d.join(w, F.col("__id").eqNullSafe(F.col("__of")), "left_semi").select("text"), run, "node long, held binary", SLICE)
    # ids may repeat with other texts
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """b, part, a, held in order of b, part and a: first the set of b (a is null), then those of its partners."""
        of, own = None, None
        for batch in batches:
            found = []
            for b, a, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                one = np.frombuffer(held.as_buffer(), np.uint64)
                if a is None:
                    of, own = b, one.copy()
                elif of == b and similarity(own, one) >= least - 1e-9:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
    return run


def verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of ``pairs`` (a, b; no repeats), those at least ``least`` alike. ``first``: node, doc_id of one document of each."""
    pairs = _written(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = _written(sets_of(docs, first.join(wanted, "node", "left_semi"), shingle), "sets")
    # a node with many partners has them in several parts
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    partners = dealt.join(held.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "held")
    heads = parts.join(held.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "held")
    rows = heads.union(partners).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return _written(rows.mapInArrow(_alike(least), "a long, b long"), "links")


def _pairs(one: str, other: str) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _size_fits(x: str, y: str, least: float) -> Column:
    """Sets of other sizes cannot be alike, whatever they hold."""
    return F.least(x, y) >= (least - 1e-9) * F.greatest(x, y)


def _may_link(one: str, other: str, least: float) -> Column:
    """Sketches of sets that are alike differ in no more bits than the sets in hashes."""
    bits = sum((F.bit_count(F.col(f"{one}.{p}").bitwiseXOR(F.col(f"{other}.{p}"))) for p in PARTS), F.lit(0))
    return bits <= (1 - least) / (1 + least) * (F.col(f"{one}.size") + F.col(f"{other}.size")) + 1e-6


def close_fingerprints(distinct: DataFrame) -> DataFrame:
    """Pairs (a > b) of nodes that connect all those whose fingerprints are at most CLOSE bits apart: op2's search."""
    fps = _written(distinct.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = near_links(fps.select("fp"), CLOSE)
    one, other = fps.select(F.col("fp").alias("a"), F.col("node").alias("x")), fps.select(F.col("fp").alias("b"), F.col("node").alias("y"))
    apart = near.join(one, "a").join(other, "b").select(*_pairs("x", "y"))
    alike = distinct.select("fp", "node").join(fps.select("fp", F.col("node").alias("least")), "fp").where("node <> least").select(*_pairs("node", "least"))
    return apart.union(alike)


def shared_keys(distinct: DataFrame) -> DataFrame:
    """key, node, size, sketch, head (smallest node of the bucket) of the keys that several nodes have."""
    rows = distinct.select("node", "size", *[F.get("sketch", F.lit(k)).alias(p) for k, p in enumerate(PARTS)], F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1").select("key", "head")
    return _written(rows.join(heads, "key").select("key", "node", "size", *PARTS, "head"), "keys")


def _open_buckets(rows: DataFrame, near: DataFrame, more_than: int) -> tuple[DataFrame, DataFrame]:
    """key, node, size, sketch, root of the buckets of over ``more_than`` nodes that hold several components; and the components
    as pairs (a > b) of a node and its root, one for each node but the root, however many links there are."""
    root = components(near).select("node", "root")
    named = _written(rows.select("key", "node", "size", *PARTS).join(root, "node", "left").select("key", "node", "size", *PARTS, F.coalesce("root", "node").alias("root")), "named")
    buckets = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where(f"low < high AND n > {more_than}")
    return _written(named.join(buckets.select("key"), "key", "left_semi"), "open"), root.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _other_components(named: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Pairs (a > b) of a node and one of ``others`` in one bucket, but of different components, that may be alike."""
    fits = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _size_fits("x.size", "y.size", least) & _may_link("x", "y", least)
    if "most" in others.columns:
        fits &= F.least("x.most", "y.most") >= least / (1 + least) * (F.col("x.size") + F.col("y.size")) - 1e-6
    pairs = named.alias("x").join(others.alias("y"), fits)
    return pairs.select(*_pairs("x.node", "y.node")).distinct()


def _leaders(named: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` nodes of each bucket: one of each component before the second of any."""
    nth = named.selectExpr("*", "row_number() OVER (PARTITION BY key, root ORDER BY xxhash64(node, key), node) AS nth").where(f"nth <= {most}")
    return nth.selectExpr("*", "row_number() OVER (PARTITION BY key ORDER BY nth, xxhash64(node, key), node) AS place").where(f"place <= {most}")


def may_be_alike(docs: DataFrame, wanted: DataFrame, first: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of the nodes ``wanted`` (node, size), those that share at least ``least`` of their shingles with any of the others; most: so many."""
    held = sets_of(docs, first.join(wanted, "node", "left_semi"), shingle)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(h) // 8 for h in batch.column(1).to_pylist()]
        flat = np.concatenate([np.frombuffer(h.as_buffer(), np.int64) for h in batch.column(1)] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(flat)], ["node", "shingle"])
    alone = map_batches(held, split, "node long, shingle long", SLICE).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    most = wanted.join(own, "node", "left").withColumn("most", F.col("size") - F.coalesce("own", F.lit(0)))
    return most.where(F.col("most") >= (least - 1e-9) * F.col("size")).select("node", "most")


def links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Pairs (a > b) that connect the nodes of near copies: links, and nodes with the smallest of their component. ``distinct``: node, doc_id, size, keys, sketch, fp; no node twice."""
    first = distinct.select("node", "doc_id")
    near = verified(docs, close_fingerprints(distinct).distinct(), first, shingle, least)
    rows = shared_keys(distinct)
    near = near.union(verified(docs, rows.where("node > head").groupBy(F.col("node").alias("a")).agg(F.min("head").alias("b")), first, shingle, least))
    for most in (FEW, LEADERS):
        rows, near = _open_buckets(rows, near, 1)
        near = near.union(verified(docs, _other_components(rows, _leaders(rows, most), least), first, shingle, least))
    crowded, near = _open_buckets(rows, near, LEADERS)
    able = _written(may_be_alike(docs, crowded.select("node", "size").distinct(), first, shingle, least), "able")
    rest = crowded.join(able, "node")
    return near.union(verified(docs, _other_components(rest, rest, least), first, shingle, least)).distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Per document: doc_id and component_id, the smallest doc_id reachable over links; a null doc_id counts as the largest.

    An empty table gives no rows; rows that repeat an id with another text are documents of their own.
    """
    d, root = _rooted(docs, shingle, least)
    return d.join(root.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def _rooted(docs: DataFrame, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, mark, root of every document; and node, root, doc_id (the smallest of the node)."""
    d = _written(nodes(docs, shingle), "nodes")
    distinct = d.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
                                   F.min("fp").alias("fp"))
    root = components(links(docs, distinct, shingle, least))
    named = _written(d.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    return d.select("doc_id", "mark", "node").join(named.select("node", "root"), "node"), named


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One document of each component, with the columns it came with: the smallest id, and of its texts and rows any one."""
    d, _ = _rooted(docs, shingle, least)
    rows = d.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("copies"))
    # a null id counts as the largest
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "copies")).alias("best"))
    return kept_once(docs, _written(best.select("best.doc_id", "best.mark", "best.copies"), "winners"))
