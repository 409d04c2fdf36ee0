"""Windows and quantiles that stay distributed when one key holds most of the rows.

A plain window puts a whole key into one task.  The helpers here first cut every
key into ordered buckets, do the row work inside (key, bucket), and carry only one
row per bucket across bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.session import cut_lineage


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keys are kept once (from the left)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one that is greatest on ``order``.

    Hash aggregate with map-side combine, so a hot key sends one row per map task.
    """
    values = list(values) if values is not None else [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
            .select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values]))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  The rank filter sits directly on the window, so
    Spark cuts each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# Rows of a key up to which it stays whole in one task; larger keys are cut into splits of about so many rows.
SPLIT_ROWS = 1_000_000
# Split points up to which they are broadcast, and the most of one key (a power of two).
BROADCAST_POINTS = 65_536
MOST_SPLITS = 1 << 20


def split_points(df: DataFrame, keys: Sequence[str], ts: str, depth: int = SPLIT_ROWS) -> DataFrame | None:
    """(keys, ``_starts``): the instants at which a key of more than ``depth`` rows is cut; None if no key is that large.

    Rows are counted per key and, of large keys alone, per minute; a new split starts where the running count passes a
    multiple of ``depth``. So a split holds ``depth`` rows and at most one minute more, however they are spread over time.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(ts).alias("_t"))
    large = cut_lineage(v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > depth))
    if large.isEmpty():
        return None
    cells = null_safe_join(v, large, keys).groupBy(*keys, F.date_trunc("minute", "_t").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_n")
    starts = cells.withColumn("_split", F.floor(before / depth)).where("_split > 0").groupBy(*keys, "_split").agg(F.min("_c").alias("_start"))
    return cut_lineage(starts.groupBy(*keys).agg(F.sort_array(F.collect_list("_start")).alias("_starts")))


def in_splits(df: DataFrame, points: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """``df`` with ``_bucket``, the number of split points of the key that are not after the row; 0 for keys without."""
    few = points.agg(F.sum(F.size("_starts"))).first()[0] or 0
    j = null_safe_join(df, F.broadcast(points) if few <= BROADCAST_POINTS else points, keys, "left")
    at = F.when(F.col("_starts").isNotNull(), not_above(F.col("_starts"), MOST_SPLITS, F.col(ts))).otherwise(0)
    out = j.withColumn("_bucket", at).drop("_starts")
    # after a shuffled join a large key would stay where the join put it
    return out if few <= BROADCAST_POINTS else out.repartition(*keys, "_bucket")


def lagged(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], order: Sequence[str] = (),
           depth: int = SPLIT_ROWS, prefix: str = "prev_") -> DataFrame:
    """``lag`` of ``values`` per key in (ts, order) order; keys of more than ``depth`` rows are cut in time."""
    keys, order = list(keys), [ts, *order]
    points = split_points(df, keys, ts, depth)
    if points is None:
        last = F.lag(F.struct(*values)).over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_in", last).select(*df.columns, *[F.col("_in")[v].alias(f"{prefix}{v}") for v in values])
    b = in_splits(df, points, keys, ts)
    cell = [*keys, "_bucket"]
    inner = b.withColumn("_in", F.lag(F.struct(*values)).over(Window.partitionBy(*cell).orderBy(*order)))
    tails = b.groupBy(*cell).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_tail"))
    carry = tails.select(*cell, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")).where("_bucket > 0")
    out = null_safe_join(inner, carry, cell, "left")
    prev = F.coalesce(F.col("_in"), F.col("_carry"))
    return out.select(*df.columns, *[prev[v].alias(f"{prefix}{v}") for v in values])


def next_instant(df: DataFrame, keys: Sequence[str], ts: str, depth: int = SPLIT_ROWS, name: str = "_next") -> DataFrame:
    """``df`` beside the next instant of the key, cut like ``lagged``."""
    keys = list(keys)
    points = split_points(df, keys, ts, depth)
    if points is None:
        return df.withColumn(name, F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts)))
    b = in_splits(df, points, keys, ts)
    cell = [*keys, "_bucket"]
    inner = b.withColumn("_in", F.lead(ts).over(Window.partitionBy(*cell).orderBy(ts)))
    heads = b.groupBy(*cell).agg(F.min(ts).alias("_head"))
    carry = heads.select(*cell, F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    out = null_safe_join(inner, carry, cell, "left")
    return out.select(*df.columns, F.coalesce("_in", "_carry").alias(name))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, rank: str = "rank") -> DataFrame:
    """1-based position of each row inside its key.  ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    b = df.withColumn("_bucket", bucket)
    cell = [*keys, "_bucket"]
    inner = b.withColumn("_pos", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    before = (b.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
              .select(*cell, (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_before")))
    out = null_safe_join(inner, before, cell, "left")
    return out.select(*df.columns, (F.col("_pos") + F.col("_before")).alias(rank))


def asof_last(left: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, fact_at: str, value: str,
              order: Sequence[str] = (), depth: int = SPLIT_ROWS, name: str = "value_at") -> DataFrame:
    """``left`` beside the newest fact value at or before ``at`` per key.

    Facts and subjects are interleaved in time and scanned once, large keys in splits of time; nothing is paired up.
    """
    keys = list(keys)
    f = facts.select(*keys, F.col(fact_at).alias("_t"), F.struct(F.col(fact_at), *order, value).alias("_f"))
    s = left.select(*keys, F.col(at).alias("_t")).distinct()
    both = f.unionByName(s, allowMissingColumns=True)
    points = split_points(both, keys, "_t", depth)
    both = both.withColumn("_bucket", F.lit(0)) if points is None else in_splits(both, points, keys, "_t")
    cell = keys if points is None else [*keys, "_bucket"]
    # RANGE frame: facts at the very instant count as known
    w = Window.partitionBy(*cell).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("_in", F.max("_f").over(w)).where(F.col("_f").isNull()).drop("_f")
    if points is not None:
        tails = both.groupBy(*cell).agg(F.max("_f").alias("_tail"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = tails.select(*cell, F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
        known = null_safe_join(known, carry, cell, "left").withColumn("_in", F.coalesce("_in", "_carry"))
    known = known.select(*keys, F.col("_t").alias(at), F.col("_in")[value].alias(name))
    return null_safe_join(left, known, [*keys, at], "left")


# Sub-buckets per power of two in the first quantile pass.
QUANTILE_STEPS = 4096


def _value_bucket(v: Column) -> Column:
    """Order-preserving bucket of a double: sign, then logarithmic steps of the magnitude; NaN is above all."""
    top = 4096 * QUANTILE_STEPS
    mag = F.floor(F.log2(F.abs(v)) * QUANTILE_STEPS) + F.lit(1100 * QUANTILE_STEPS)
    endless = F.when(F.isnan(v), F.lit(2 * top)).when(v == float("inf"), F.lit(top)).when(v == float("-inf"), F.lit(-top))
    return endless.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, array: str | None = None) -> DataFrame:
    """Exact interpolated quantiles per key without gathering any key in one place.

    Rows are counted per (key, value) - a hash aggregate with map-side combine, the only pass over
    ``df`` - and these counts per value bucket.  The bucket counts tell which bucket holds each wanted
    rank; the ranks are walked inside one bucket of value counts.
    Keys whose values are all NULL are absent.  Result: keys, ``n`` and either one
    column per prob (``names``) or one array column (``array``).
    """
    const = not keys
    if const:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    keys = list(keys)
    v = (df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
         .withColumn("_b", _value_bucket(F.col("_v"))))
    per_key = Window.partitionBy(*keys)
    values = v.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = (values.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
              .withColumn("_total", F.sum("_n").over(per_key))
              .withColumn("_before", F.sum("_n").over(per_key.orderBy("_b")) - F.col("_n")))
    # rounding absorbs 0.95 * 100 = 94.99999999999999 and its kind
    pos = [F.round(F.lit(float(p)) * (F.col("_total") - 1), 9) for p in probs]
    want = F.array_distinct(F.concat(F.array(*[F.floor(p) for p in pos]), F.array(*[F.ceil(p) for p in pos])))
    hits = (counts
            .withColumn("_want", F.filter(want, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))))
            .where(F.size("_want") > 0).select(*keys, "_b", "_want", "_before", "_total"))
    picked = null_safe_join(values, hits, [*keys, "_b"])
    cell = Window.partitionBy(*keys, "_b")
    walk = (picked.withColumn("_hi", F.col("_before") + F.sum("_n").over(cell.orderBy("_v")))
            .withColumn("_mine", F.filter("_want", lambda r: (r >= F.col("_hi") - F.col("_n")) & (r < F.col("_hi"))))
            .where(F.size("_mine") > 0))
    # at most 2 * len(probs) entries per key
    found = (walk.select(*keys, "_total", "_v", F.explode("_mine").alias("_rank"))
             .groupBy(*keys).agg(F.first("_total").alias("_total"),
                                 F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m")))
    qs = []
    for p in pos:
        lo, hi = F.col("_m")[F.floor(p)], F.col("_m")[F.ceil(p)]
        qs.append(lo + (hi - lo) * (p - F.floor(p)))
    cols = [F.array(*qs).alias(array)] if array else [q.alias(n) for q, n in zip(qs, names)]
    out_keys = [] if const else keys
    return found.select(*out_keys, F.col("_total").alias("n"), *cols)


def not_above(ordered: Column, n: int, value: Column) -> Column:
    """How many of the ``n`` entries of an ascending array are not above the value: a search in halving steps."""
    steps = [1 << k for k in range(max(n, 1).bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(ordered, at + by - 1) <= value), at + by).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
