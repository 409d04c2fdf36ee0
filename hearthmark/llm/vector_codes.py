"""Compression of vectors to short codes: one codebook per part of the vector, searched by equal averages.

1.  A component becomes the integer floor(1024 * x). A vector is cut into PARTS consecutive parts; the codebook of a part
    starts as that part of the ENTRIES rows with the smallest ids. That is all that ever reaches the driver, besides the
    sums per entry and component of each round: ENTRIES times the dimension, whatever the number of rows.
2.  Search of the nearest entry: entries are sorted by the sum of their components. From the place of the vector's own sum
    the search walks outward, always to the side with the smaller gap of sums. As gap ** 2 / dimension is a lower bound of
    the squared distance, it ends when that strictly exceeds the best distance; so ties are still looked at, and the
    lowest index wins. All is integer arithmetic and exact.
3.  A round is one scan: every task adds up its vectors by entry, Spark adds up the tasks. No row is shuffled.

Defined results: rows whose vector is null, or holds a null, NaN or infinity, are left out. The dimension is that of the
row with the smallest id (a null id is the largest; equal ids are in order of their vectors); a row of another dimension
has a null code and error. A dimension that PARTS does not divide gives parts that differ by one. A vector without
components has the code of the first entries and error 0. Errors and sums beyond 64 bits fail the job and are never
wrong. Repeated rows are rows of their own, an empty table gives no rows, and extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm.common import cut_lineage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 4_096   # vectors searched at once in a worker

Codebooks = list[list[tuple[int, ...]]]   # part, entry, component


def edges(dimension: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin, and the end."""
    return [dimension * p // parts for p in range(parts + 1)]


def _whole(vector: Column) -> Column:
    """The vector has components, all of them finite; null for none."""
    x = vector.cast("array<double>")
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def kept_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that can be coded."""
    good = rows.where(F.col(vector).isNotNull()).where(F.coalesce(_whole(F.col(vector)), F.lit(False)))
    return good.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))


def first_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, Codebooks]:
    """Dimension, and the codebooks made of the rows with the smallest ids."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    if not first:
        return 0, [[] for _ in range(parts)]
    dimension = len(first[0].vector)
    at = edges(dimension, parts)
    whole = [[int(np.floor(SCALE * x)) for x in r.vector] for r in first if len(r.vector) == dimension]
    return dimension, [[tuple(v[at[p]:at[p + 1]]) for v in whole] for p in range(parts)]


class SumOrdered:
    """The entries of one codebook in order of their sums."""

    def __init__(self, entries: list[tuple[int, ...]]):
        self.width = len(entries[0])
        self.largest = max((abs(x) for e in entries for x in e), default=0)
        by_sum = sorted(range(len(entries)), key=lambda k: (sum(entries[k]), k))
        self.index = np.array(by_sum)
        self.rows = [entries[k] for k in by_sum]
        self.sums = [sum(e) for e in self.rows]

    def _kind(self, largest: int) -> type:
        """The narrowest type in which no distance, and no gap of sums squared, overflows."""
        far = self.width * (max(largest, self.largest) * 2) ** 2 * max(1, self.width)
        return np.int32 if far < 1 << 31 else np.int64 if far < 1 << 62 else object

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of each row of ``vectors`` (integers)."""
        if not self.width or not len(vectors):
            return np.full(len(vectors), self.index.min()), np.zeros(len(vectors), np.int64)
        kind = self._kind(int(np.abs(vectors).max()))
        x, book = vectors.astype(kind), np.array(self.rows, kind).reshape(len(self.rows), self.width)
        sums, own = np.array(self.sums, kind), x.sum(axis=1, dtype=kind)
        count, wide = len(sums), self.width
        above = np.searchsorted(sums, own) if kind is not object else np.array([_place(self.sums, s) for s in own])
        below = above - 1
        best = np.full(len(x), -1, kind)          # -1: nothing looked at so far
        found = np.full(len(x), count)
        open_rows = np.arange(len(x))
        while len(open_rows):
            hi, lo, mine = above[open_rows], below[open_rows], own[open_rows]
            gap_hi = np.where(hi < count, sums[np.minimum(hi, count - 1)] - mine, -1)
            gap_lo = np.where(lo >= 0, mine - sums[np.maximum(lo, 0)], -1)
            up = (gap_lo < 0) | ((gap_hi >= 0) & (gap_hi <= gap_lo))
            gap = np.where(up, gap_hi, gap_lo)
            least = best[open_rows]
            go = (gap >= 0) & ((least < 0) | (gap * gap <= least * wide))
            open_rows, up = open_rows[go], up[go]
            place = np.where(up, above[open_rows], below[open_rows])
            away = x[open_rows] - book[place]
            far = (away * away).sum(axis=1, dtype=kind)
            index = self.index[place]
            least, held = best[open_rows], found[open_rows]
            better = (least < 0) | (far < least) | ((far == least) & (index < held))
            best[open_rows[better]], found[open_rows[better]] = far[better], index[better]
            above[open_rows] += up
            below[open_rows] -= ~up
        return found, best


def _place(sums: list[int], value: int) -> int:
    return next((k for k, s in enumerate(sums) if s >= value), len(sums))


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); large ones as Python integers."""
    down = np.floor(flat * SCALE)
    if len(down) and np.abs(down).max() >= 2.0 ** 50:      # sums of a block must fit as well
        return np.array([int(v) for v in down], object)
    return down.astype(np.int64)


def _blocks(batch: pa.RecordBatch, dimension: int, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors (column ``at``) of the rows of the right dimension, a block at a time."""
    lists = batch.column(at)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(sizes == dimension)
    for k in range(0, len(fits), BLOCK):
        rows = fits[k:k + BLOCK]
        yield rows, whole_numbers(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)).reshape(len(rows), dimension)


def improved(kept: DataFrame, dimension: int, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry to the floor of the mean of its parts."""
    at = edges(dimension, len(books))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [SumOrdered(b) for b in books]
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for _, block in _blocks(batch, dimension, 0):
                for p, book in enumerate(search):
                    part = block[:, at[p]:at[p + 1]]
                    entry, _ = book.nearest(part)
                    order = np.argsort(entry, kind="stable")
                    named, start = np.unique(entry[order], return_index=True)
                    sums = np.add.reduceat(part[order], start, axis=0)
                    for e, n, total in zip(named.tolist(), np.diff([*start, len(order)]).tolist(), sums.tolist()):
                        old = held.get((p, e))
                        held[p, e] = [n, total] if old is None else [old[0] + n, [a + b for a, b in zip(old[1], total)]]
        rows = [(p, e, n, k, s) for (p, e), (n, total) in held.items() for k, s in enumerate(total)]
        for k in range(0, len(rows), 8_192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 8_192]), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                                             ["part", "entry", "n", "place", "total"])
    sums = kept.select("vector").mapInArrow(add_up, "part int, entry int, n long, place int, total long")
    new = [[list(e) for e in b] for b in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.part][r.entry][r.place] = r.total // r.n
    return [[tuple(e) for e in b] for b in new]


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, Codebooks]:
    dimension, books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books[0] else 0):
        books = improved(kept, dimension, books)
    return dimension, books


def coded(kept: DataFrame, dimension: int, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (index per part), error (squared distances summed over the parts)."""
    at = edges(dimension, len(books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [SumOrdered(b) for b in books] if books[0] else []
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for rows, block in _blocks(batch, dimension, 2):
                found = [book.nearest(block[:, at[p]:at[p + 1]]) for p, book in enumerate(search)]
                for k, row in enumerate(rows.tolist()):
                    codes[row] = [int(entry[k]) for entry, _ in found]
                    errors[row] = sum(int(far[k]) for _, far in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.list_(pa.int32())), pa.array(errors, pa.int64())],
                                             ["vec_id", "label", "codes", "error"])
    types = dict(kept.dtypes)
    return kept.select("vec_id", "label", "vector").mapInArrow(code, f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, vector (doubles) as the codebooks have it; null where there is no code."""
    made = F.lit(None)
    if books[0]:
        tables = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]).cast("array<double>") for e in b]) for b in books]
        made = F.concat(*[t[F.col("codes")[p]] for p, t in enumerate(tables)])
    return codes.select("vec_id", "label", F.when(F.col("codes").isNotNull(), made).cast("array<double>").alias("vector"))


def spelled(books: Codebooks) -> str:
    """All components by part, entry and place."""
    return ",".join(str(x) for b in books for e in b for x in e)


def compressed(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error (of all rows of the label), codebooks_sha256."""
    kept = kept_vectors(rows, vector)
    dimension, books = trained(kept)
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    out = cut_lineage(coded(kept, dimension, books).select("vec_id", "label", F.when(F.col("codes").isNotNull(), code).alias("code"), "error"))
    # a label may hold a third of all rows: it is added up before the shuffle, and its rows are not grouped
    per_label = out.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    both = out.join(per_label, F.col("label").eqNullSafe(F.col("__label")), "left")
    digest = hashlib.sha256(spelled(books).encode()).hexdigest()
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(source: str = "embeddings") -> str:
    """The same by brute force: every part against every entry."""
    ctes = [f"""kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS nth,
            list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM {source} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""parts AS MATERIALIZED (SELECT nth, p, v[len(v) * p // {PARTS} + 1 : len(v) * (p + 1) // {PARTS}] AS x FROM kept, range({PARTS}) t(p))""",
            f"b0 AS MATERIALIZED (SELECT p, nth - 1 AS e, x AS y FROM parts WHERE nth <= {ENTRIES})"]
    for k in range(ROUNDS + 1):
        ctes.append(f"""near{k} AS MATERIALIZED (SELECT nth, p, min(struct_pack(far := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
            FROM parts JOIN b{k} USING (p) GROUP BY nth, p)""")
        if k < ROUNDS:
            ctes.append(f"""used{k} AS (SELECT p, e, list(CAST(floor_mean AS BIGINT) ORDER BY i) AS y FROM (
                SELECT p, n.best.e AS e, i, CASE WHEN sum(x[i]) >= 0 THEN sum(x[i]) // count(*) ELSE -((-sum(x[i]) + count(*) - 1) // count(*)) END AS floor_mean
                FROM near{k} n JOIN parts USING (nth, p), range(1, len(x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY p, e)""")
            ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.y, b.y) AS y FROM b{k} b LEFT JOIN used{k} u USING (p, e))")
    ctes.append(f"""done AS (SELECT nth, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY nth)""")
    ctes.append(f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"""WITH {', '.join(ctes)}
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN done USING (nth), books"""
