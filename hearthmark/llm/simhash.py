"""SimHash near-dedup: fingerprints, vantage-point trees over Hamming distance, connected components.

Two fingerprints that differ in at most ``bits`` places agree up to bits // VIEWS places in one of VIEWS equal cuts
(pigeonhole), and Hamming distance on a cut is a metric. For every cut a vantage-point tree, fitted on a bounded sample,
parts all fingerprints into shards: a node holds a vantage value and a radius, near values go left, far ones right. A
fingerprint belongs to one shard of each tree and visits every other shard that the triangle inequality cannot rule
out, that is those whose border it lies close to. Inside a shard a second tree prunes again; what is left is compared
in full on all 64 bits.

Work is on distinct fingerprints only, so exact copies never meet. A shard larger than BLOCK rows is cut into blocks,
and each pair of blocks is a task of its own. A shard returns a spanning forest of its links, not the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import cut_lineage, kept_rows, map_batches

SHINGLE = 4
BITS = 4          # most differing bits of a link
VIEWS = 4
SAMPLE = 16_384   # fingerprints on which the trees are fitted, at most
SHARD = 262_144   # owners of a shard aimed at; the trees get deeper only as the input asks for it, as each level adds visits
LEAST_SHARDS = 16
MAX_DEPTH = 12    # of the trees that deal out shards
BLOCK = 1 << 20   # rows of a block
LEAF = 64         # owners of a leaf inside a shard
TILE = 1_024      # rows compared with as many at once
SEED = 42


# --- fingerprints ---

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text (A-Z lower-cased), repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1:].tolist())]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        ones += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits in a long) of every document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


# --- vantage-point trees ---

class VantageTree:
    """Tree over distinct values. Leaves are numbered from the left; a tree of one leaf has no nodes."""

    def __init__(self, values: np.ndarray, leaf: int, depth: int = MAX_DEPTH):
        self.vantage, self.radius, self.kids, self.leaves = [], [], [], 0
        self._grow(np.unique(values), leaf, depth)

    def _grow(self, values: np.ndarray, leaf: int, depth: int) -> int:
        if len(values) > max(1, leaf) and depth:
            # the value farthest from the first parts best: its distances are spread widest
            vantage = values[np.argmax(np.bitwise_count(values ^ values[0]))]
            d = np.bitwise_count(values ^ vantage)
            radius = int(np.median(d))
            near = d <= radius
            if near.all():
                radius, near = radius - 1, d < radius
            if near.any() and not near.all():
                at = len(self.kids)
                self.vantage.append(vantage), self.radius.append(radius), self.kids.append(())
                self.kids[at] = (self._grow(values[near], leaf, depth - 1), self._grow(values[~near], leaf, depth - 1))
                return at
        self.leaves += 1
        return -self.leaves

    def reach(self, values: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of a value, leaf): all leaves that may hold a value within ``slack``; 0: the leaf it belongs to."""
        if not self.kids:
            return np.arange(len(values)), np.zeros(len(values), np.int64)
        found, todo = [], [(0, np.arange(len(values)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                found.append((rows, np.full(len(rows), -node - 1)))
                continue
            d = np.bitwise_count(values[rows] ^ self.vantage[node]).astype(np.int64)
            left, right = self.kids[node]
            todo += [(left, rows[d - slack <= self.radius[node]]), (right, rows[d + slack > self.radius[node]])]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def cut_of(fps: np.ndarray, view: int, views: int) -> np.ndarray:
    width = 64 // views
    return (fps >> np.uint64(view * width)) & np.uint64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def route(trees: list[VantageTree], bits: int, blocks: dict[int, int], fps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (shard, pair of blocks, fp, is an owner, block) of fingerprints; ``blocks`` has the shards that are cut."""
    views, base, parts = len(trees), 0, []
    for view, tree in enumerate(trees):
        cut = cut_of(fps, view, views)
        mine = np.empty(len(fps), np.int64)
        rows, leaf = tree.reach(cut, 0)
        mine[rows] = leaf
        rows, leaf = tree.reach(cut, bits // views)
        later = leaf >= mine[rows]   # of two shards that see each other's rows the later one compares them
        rows, leaf = rows[later], leaf[later]
        parts.append((base + leaf, rows, leaf == mine[rows]))
        base += tree.leaves
    shard, rows, own = (np.concatenate(x) for x in zip(*parts))
    n = np.array([blocks.get(int(s), 1) for s in np.unique(shard)])[np.unique(shard, return_inverse=True)[1]]
    block = (_spread(fps[rows]) % n.astype(np.uint64)).astype(np.int64)
    # a row of block b meets every block once: pair (min, max); owners go along both sides, visitors meet all owner blocks
    again = np.repeat(np.arange(len(rows)), n)
    other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.minimum(block[again], other), np.maximum(block[again], other)
    return shard[again], low * 65_536 + high, fps[rows[again]], own[again], block[again]


def links_within(fps: np.ndarray, own: np.ndarray, block: np.ndarray, pair: int, bits: int, view: int, views: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one task: each linked fingerprint and the smallest of its tree.

    In a task of two blocks only rows of different blocks are compared, as rows of one block meet in their own task.
    """
    order = np.argsort(fps, kind="stable")
    fps, own, block = fps[order], own[order], block[order]
    low, high = divmod(pair, 65_536)
    label = np.arange(len(fps))
    owners = np.flatnonzero(own)
    if not len(owners):
        return fps[:0], fps[:0]
    cut = cut_of(fps, view, views)
    tree = VantageTree(cut[owners], LEAF, 64)
    sits = np.empty(len(owners), np.int64)
    rows, leaf = tree.reach(cut[owners], 0)
    sits[rows] = leaf
    rows, leaf = tree.reach(cut, bits // views)
    by_leaf, of_leaf = np.argsort(leaf, kind="stable"), np.argsort(sits, kind="stable")
    bounds, held = np.searchsorted(leaf[by_leaf], np.arange(tree.leaves + 1)), np.searchsorted(sits[of_leaf], np.arange(tree.leaves + 1))
    for k in range(tree.leaves):
        members, guests = owners[of_leaf[held[k]:held[k + 1]]], rows[by_leaf[bounds[k]:bounds[k + 1]]]
        for at in range(0, len(members), TILE):
            for to in range(0, len(guests), TILE):
                some, others = members[at:at + TILE], guests[to:to + TILE]
                i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= bits)
                a, b = some[i], others[j]
                new = (a != b) & ((low == high) | (block[a] != block[b]))
                join(label, a[new], b[new])
    settle(label)
    linked = label != np.arange(len(fps))
    return fps[linked], fps[label[linked]]


def settle(label: np.ndarray) -> None:
    """Point every row at the root of its tree."""
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return
        label[:] = up


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of each a and b; roots are the smallest rows."""
    while len(a):
        settle(label)
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


# --- Spark side ---

def near_links(distinct: DataFrame, bits: int = BITS, views: int = VIEWS) -> DataFrame:
    """Spanning links (a > b as longs) that connect all fingerprints at most ``bits`` apart. ``distinct``: fp, no repeats."""
    spark = distinct.sparkSession
    total = distinct.count()
    # the only rows that reach the driver: a bounded sample, evenly by hash
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    sample = np.array([r.fp for r in picked.collect()], np.int64).view(np.uint64)
    shards = max(LEAST_SHARDS, 1 << int(np.ceil(np.log2(max(1, total / SHARD)))))
    trees = [VantageTree(cut_of(sample, v, views), max(1, len(sample) // shards)) for v in range(views)]

    def routed(blocks: dict[int, int]) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            shard, pair, fp, own, block = route(trees, bits, blocks, np.asarray(batch.column(0)).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(pair), pa.array(fp.view(np.int64)),
                                               pa.array(own), pa.array(block.astype(np.int32))], ["shard", "pair", "fp", "own", "block"])
        return distinct.mapInArrow(lambda batches: map(run, batches), "shard int, pair long, fp long, own boolean, block int")

    # one number per shard (at most views * 2 ** MAX_DEPTH) goes to the driver
    sizes = routed({}).groupBy("shard").count().collect()
    blocks = {r["shard"]: -(-r["count"] // BLOCK) for r in sizes if r["count"] > BLOCK}
    first = np.cumsum([t.leaves for t in trees])

    def search(t: pa.Table) -> pa.Table:
        shard, pair = t["shard"][0].as_py(), t["pair"][0].as_py()
        fps = t["fp"].to_numpy().view(np.uint64)
        linked, root = links_within(fps, t["own"].to_numpy(), t["block"].to_numpy(), pair, bits, int(np.searchsorted(first, shard, side="right")), views)
        return pa.table({"a": linked.view(np.int64), "b": root.view(np.int64)})

    found = routed(blocks).groupBy("shard", "pair").applyInArrow(search, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node with a link, by alternating large and small stars.

    Each round is two aggregates and two joins; the number of rounds grows with the logarithm of the longest chain.
    Stars of any size are fine: a star is rows, never a group in memory.
    """
    edges = cut_lineage(links)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(least, F.col("a") == F.col("node"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("node", "m"))
        edges = cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        seen = now


def classes(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, views: int = VIEWS) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links), component_size.

    Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and so a component.
    A null doc_id counts as the largest id. An empty table gives an empty result.
    """
    d = cut_lineage(fingerprints(docs, shingle))
    distinct = cut_lineage(d.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    root = components(near_links(distinct.select("fp"), bits, views))
    named = distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = cut_lineage(named)
    total = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_size")).withColumnRenamed("root", "of_root")
    comp = named.join(total, F.col("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_id", "component_size")
    out = d.join(comp, F.col("fp") == F.col("of_fp"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, views: int = VIEWS) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns it came with."""
    first = classes(docs, shingle, bits, views).select(F.col("component_id").alias("doc_id")).distinct()
    return kept_rows(docs, first)
