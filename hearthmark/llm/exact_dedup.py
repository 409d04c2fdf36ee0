"""Exact dedup against a minimal perfect hash over the distinct digests of earlier documents.

The index is cut into buckets by digest prefix. Each bucket holds a minimal perfect hash (levels of bit arrays: a key
sits in the first level where no other key shares its bit) and one slot per key: the full digest, the locator of the
document that stays and the size of the group. New digests are looked up by bucket; a slot answers only if its digest
agrees byte for byte. Digests that are no members are grouped among themselves.

Rows meet only after they were aggregated per digest, so a group of copies of any size is one row of a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.llm.common import BLANKS, cut_lineage, held, kept_once, text_mark, text_or_empty

BUCKET_KEYS = 20_000   # keys of a bucket on average; digests are even, so this bounds the memory of a task
LOAD = 2               # bits per key of a level
MAX_LEVELS = 64
TURNS = 1_024           # parts of a group of copies


# --- the hash of one bucket (numpy only) ---

def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest, past the prefix that chose the bucket."""
    return digests[:, 8:16].copy().view("<u8").ravel(), digests[:, 16:24].copy().view("<u8").ravel()


def _position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + np.uint64(2 * level + 1) * b
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) % np.uint64(size)


def build(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit array of each level, and for every slot the row of its key. ``digests``: distinct, (n, 32) bytes."""
    a, b = _halves(digests)
    rest, levels, slots = np.arange(len(digests)), [], []
    while len(rest):
        if len(levels) == MAX_LEVELS:
            raise ValueError("digests are not distinct")
        size = max(64, LOAD * len(rest))
        at = _position(a[rest], b[rest], len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        slots.append(rest[placed][np.argsort(at[placed])])
        levels.append(alone)
        rest = rest[~placed]
    return levels, np.concatenate(slots) if slots else rest


def find(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest if it is a key; any slot or -1 if not. The caller compares the digests."""
    a, b = _halves(digests)
    out, rest, base = np.full(len(digests), -1), np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        at = _position(a[rest], b[rest], k, len(bits)).astype(np.int64)
        rank = np.cumsum(bits) - 1 + base
        hit = bits[at]
        out[rest[hit]] = rank[at[hit]]
        rest, base = rest[~hit], base + int(bits.sum())
    return out


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


# --- Spark side ---

def normal_text(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), f"{BLANKS}+", "")


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest (32 bytes) of the text without blanks, n (code points of the original), mark (of the original)."""
    return docs.select("doc_id", F.unhex(F.sha2(normal_text("text"), 256)).alias("digest"), F.char_length(text_or_empty("text")).alias("n"), text_mark().alias("mark"))


GROUP = "digest binary, keep_id long, n int, size long"


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original, then the smallest id (null first), and the number of rows."""
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first")
    g = rows.groupBy("digest").agg(first, F.count("*").alias("size"))
    return g.select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.n")).alias("n"), "size")


def bucket_count(spark, keys: int) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // BUCKET_KEYS))


def _bucket(count: int) -> Column:
    """From the first 6 bytes of the digest."""
    return (F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % count).cast("int")


def index(history: DataFrame, buckets: int) -> DataFrame:
    """The hash of every bucket of ``history`` (rows of ``groups``): level bits, digests, locators by slot."""
    def one(t: pa.Table) -> pa.Table:
        digests = _bytes(t["digest"], 32)
        levels, slots = build(digests)
        return pa.table({
            "bucket": t["bucket"][:1], "widths": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
            "bits": pa.array([np.packbits(np.concatenate(levels)).tobytes()], pa.binary()),
            "digests": pa.array([digests[slots].tobytes()], pa.binary()),
            "keep_ids": pa.array([t["keep_id"].take(pa.array(slots)).to_pylist()], pa.list_(pa.int64())),
            "ns": pa.array([t["n"].take(pa.array(slots)).to_pylist()], pa.list_(pa.int32())),
            "sizes": pa.array([t["size"].take(pa.array(slots)).to_pylist()], pa.list_(pa.int64()))})
    schema = "bucket int, widths array<int>, bits binary, digests binary, keep_ids array<long>, ns array<int>, sizes array<long>"
    return history.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(one, schema)


def lookup(new: DataFrame, hashes: DataFrame, buckets: int) -> DataFrame:
    """Each row of ``new`` (rows of ``groups``) with what its slot holds: is_member, old_id, old_n, old_size."""
    schema = f"{GROUP}, is_member boolean, old_id long, old_n int, old_size long"

    def one(new: pa.Table, kept: pa.Table) -> pa.Table:
        member, slot = np.zeros(new.num_rows, bool), np.zeros(new.num_rows, np.int64)
        old = {k: pa.array([], t) for k, t in (("keep_ids", pa.int64()), ("ns", pa.int32()), ("sizes", pa.int64()))}
        if kept.num_rows and new.num_rows:
            row = kept.slice(0, 1)
            widths = row["widths"][0].as_py()
            bits = np.unpackbits(np.frombuffer(row["bits"][0].as_py(), np.uint8))[:sum(widths)].astype(bool)
            held = np.frombuffer(row["digests"][0].as_py(), np.uint8).reshape(-1, 32)
            digests = _bytes(new["digest"], 32)
            slot = find(np.split(bits, np.cumsum(widths)[:-1]), digests)
            member = (slot >= 0) & (held[slot] == digests).all(axis=1)
            old = {k: row[k][0].values for k in old}
        pick = pa.array(slot, mask=~member)
        return pa.table({**{c: new[c] for c in ("digest", "keep_id", "n", "size")}, "is_member": pa.array(member),
                         "old_id": old["keep_ids"].take(pick), "old_n": old["ns"].take(pick), "old_size": old["sizes"].take(pick)})

    left = new.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return left.cogroup(hashes.groupBy("bucket")).applyInArrow(one, schema)


def decided(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups over both sides (rows of ``digested``): digest, keep_id, size. Written.

    A member of the index joins the group of its slot, and the better of the two documents stays; digests of ``batch``
    that the index lacks form groups of their own; digests of ``history`` that nothing meets stay as they are.
    """
    new = groups(batch)
    with held(groups(history)) as old:
        buckets = bucket_count(old.sparkSession, max(old.count(), batch.count()))
        found = lookup(new, index(old, buckets), buckets)
        own = F.struct((-F.col("n")).alias("n"), F.col("keep_id").isNotNull().alias("known"), F.col("keep_id").alias("id"))
        theirs = F.struct((-F.col("old_n")).alias("n"), F.col("old_id").isNotNull().alias("known"), F.col("old_id").alias("id"))
        best = F.when(F.col("is_member"), F.least(own, theirs)).otherwise(own)
        joined = found.select("digest", best["id"].alias("keep_id"), (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("size"), F.lit(1).alias("met"))
        # a digest that was met comes twice, once from each side: the met row has the final answer
        both = joined.unionByName(old.select("digest", "keep_id", "size", F.lit(0).alias("met")))
        last = F.max_by(F.struct("keep_id", "size"), "met").alias("g")
        return cut_lineage(both.groupBy("digest").agg(last).select("digest", "g.keep_id", "g.size"))


def _judged(rows: DataFrame, history_share: float) -> DataFrame:
    """``rows`` (of ``digested``, evaluated once) with keep_id, size, mine (the row has the id that stays), turn (its part of the group), kept."""
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    border = 0 if span.lo is None else int(span.lo + (span.hi - span.lo + 1) * history_share)
    early = F.coalesce(F.col("doc_id") < border, F.lit(False))
    # written: as a plain scan its side of the join is dealt out anew, and the planner can split a crowded digest
    answer = decided(rows.where(early), rows.where(~early)).withColumnRenamed("digest", "of")
    out = rows.join(answer, F.col("digest") == F.col("of")).withColumn("mine", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # the rows of the id that stays are few and meet in one turn; a crowd of others is dealt out over many
    out = out.withColumn("turn", F.when(F.col("mine"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(TURNS))))
    nth = F.row_number().over(Window.partitionBy("digest", "turn").orderBy(F.desc("n"), F.asc("mark")))
    return out.withColumn("kept", F.col("mine") & (nth == 1))


def classes(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. The first ``history_share`` of the id range is the history.

    Texts are equal when they are so without blanks (null: empty). The longest original stays, then the smallest id; a
    null id comes before all others. Of rows that share the id of the row that stays one is kept, the longest. Very long
    texts are hashed whole by the engine. Empty table: no rows.
    """
    return _judged(cut_lineage(digested(docs)), history_share).select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """One document of each group, with the columns it came with, also where ids repeat."""
    copies = F.count("*").over(Window.partitionBy("digest", "turn", "mark"))
    with held(digested(docs)) as rows:
        winners = cut_lineage(_judged(rows, history_share).withColumn("copies", copies).where("kept").select("doc_id", "mark", "copies"))
    return kept_once(docs, winners)


def oracle_sql() -> str:
    return f"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{BLANKS}+', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g"""
