"""Set-based merges that replace row-at-a-time upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from hearthmark.operators.latest import latest_prices
from hearthmark.operators.market import ts
from hearthmark.operators.skew import SPLIT_ROWS, lagged, next_instant, null_safe_join

# Detail columns of a listing that a later NULL must not erase.
LISTING_DETAILS = (
    "address_full", "area_living", "area_kitchen", "balcony", "loggia", "renovation", "rooms_layout",
    "house_year", "house_material", "house_series", "house_has_elevator", "house_has_parking",
)
# Lot columns that a later NULL must not erase; the other listed ones are overwritten.
LOT_KEEP = ("address", "address_normalized", "lat", "lon", "area_total", "rooms", "floor", "total_floors")
LOT_OVERWRITE = ("source_url", "lot_number", "title", "description", "current_price", "auction_date", "status", "photos", "raw_data")


def last_rows(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key, the last along ``order``; equal ones, and batches without order, by the row's own values.

    Keys of the join that follows are the keys here, so this adds no shuffle to it.
    """
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    plain = [f.name for f in batch.schema if f.name in rest and f.name not in order and isinstance(f.dataType, AtomicType)]
    last = F.max_by(F.struct(*rest), F.struct(*order, *plain)) if order or plain else F.any_value(F.struct(*rest))
    return batch.groupBy(*keys).agg(last.alias("_last")).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in batch.columns])


def merge(current: DataFrame, batch: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (),
          keep: Sequence[str] = (), set_on_touch: Mapping[str, Column] | None = None,
          set_on_insert: Mapping[str, Column] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """New snapshot of ``current`` after ``batch``: one full outer join, one policy per column.

    overwrite: the batch value wins, NULL included; keep: the batch value wins unless NULL;
    set_on_touch: for rows in the batch; set_on_insert: only for keys new to the table.
    Columns under no policy keep the current value (the batch value on insert).
    A key that ``batch`` repeats counts once, with its last row along ``order``.
    """
    batch = last_rows(batch, keys, order)
    touch, insert = dict(set_on_touch or {}), dict(set_on_insert or {})
    c = current.select(*keys, F.struct(*[x for x in current.columns if x not in keys]).alias("_c"), F.lit(True).alias("_old"))
    b = batch.select(*keys, F.struct(*[x for x in batch.columns if x not in keys]).alias("_b"), F.lit(True).alias("_new"))
    j = c.join(b, list(keys), "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    given = set(batch.columns)
    out = []
    for name in current.columns:
        if name in keys:
            out.append(F.col(name))
            continue
        old, new = F.col("_c")[name], F.col("_b")[name] if name in given else F.lit(None)
        if name in touch:
            old_v, new_v = old, touch[name]
        elif name in overwrite and name in given:
            old_v, new_v = old, new
        elif name in keep:
            old_v, new_v = old, F.coalesce(new, old)
        else:
            old_v, new_v = old, F.when(has_old, old).otherwise(new)
        if name in insert:
            new_v = F.when(has_old, new_v).otherwise(insert[name])
        out.append(F.when(has_new, new_v).otherwise(old_v).alias(name))
    return j.select(*out)


def merge_listings(current: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Listing snapshot after a batch: core fields overwritten, details kept, life-cycle advanced."""
    own = {"id", "first_seen", "last_seen", "is_active"}
    core = [c for c in batch.columns if c not in own and c not in LISTING_DETAILS]
    now = ts(as_of)
    return merge(current, batch.drop("first_seen", "last_seen", "is_active"), ["id"], overwrite=core, keep=LISTING_DETAILS,
                 set_on_touch={"last_seen": now, "is_active": F.lit(True)}, set_on_insert={"first_seen": now})


def patch_details(current: DataFrame, patch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Fill columns from ``patch`` where it has a value; unknown ids are ignored, of repeated ids the last row counts."""
    patch = last_rows(patch, [key], order)
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, F.struct(*cols).alias("_p"))
    j = current.join(p, key, "left")
    return j.select(*[F.coalesce(F.col("_p")[c], F.col(c)).alias(c) if c in cols else F.col(c) for c in current.columns])


def overwrite_columns(current: DataFrame, patch: DataFrame, key: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Replace columns from ``patch`` for its ids, NULL included; of repeated ids the last row counts."""
    patch = last_rows(patch, [key], order)
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, F.struct(*cols).alias("_p"), F.lit(True).alias("_hit"))
    j = current.join(p, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col("_p")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in current.columns])


def apply_marks(listings: DataFrame, marks: DataFrame) -> DataFrame:
    """Latest manual mark per listing laid over the listing.

    ``marks``: id, marked_at, action in {error, clear_error, contacted, clear_risk}, comment.
    Marks of different kinds do not undo each other.
    """
    kinds = {"error": ["error", "clear_error"], "contact": ["contacted"], "risk": ["clear_risk"]}
    last = marks.groupBy("id").agg(
        *[F.max_by(F.when(F.col("action").isin(*acts), F.struct("action", "comment", "marked_at")),
                   F.when(F.col("action").isin(*acts), F.struct("marked_at", "action"))).alias(k) for k, acts in kinds.items()])
    j = listings.join(last, "id", "left")
    is_error = F.coalesce(F.col("error.action") == "error", F.lit(False))
    return (j.withColumn("is_error", is_error)
            .withColumn("error_comment", F.when(is_error, F.col("error.comment")))
            .withColumn("contacted", F.col("contact").isNotNull())
            .withColumn("risk_cleared", F.col("risk").isNotNull())
            .withColumn("marked_at", F.greatest("error.marked_at", "contact.marked_at", "risk.marked_at"))
            .drop("error", "contact", "risk"))


def append_price_changes(prices: DataFrame, batch: DataFrame, depth: int = SPLIT_ROWS) -> DataFrame:
    """Rows of ``batch`` to append: those whose price differs from the one before (in time) per id.

    Points at or before the newest stored instant of the id are ignored: facts only grow.
    """
    stored = latest_prices(prices)
    s = stored.select("id", F.col("seen_at").alias("_at"), F.col("price").alias("_price"))
    fresh = batch.select("id", "seen_at", "price").join(s, "id", "left").where(
        F.col("_at").isNull() | (F.col("seen_at") > F.col("_at")))
    seq = lagged(fresh, ["id"], "seen_at", ["price"], ["price"], depth)
    before = F.coalesce("prev_price", "_price")
    return seq.where(before.isNull() | (before != F.col("price"))).select("id", "seen_at", "price")


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` not stored yet, one per key (the first along ``order``)."""
    rest = [c for c in incoming.columns if c not in keys]
    one = (incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
           .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*incoming.columns))
    return one.join(existing.select(*keys), list(keys), "left_anti")


def upsert_snapshot(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces rows of ``existing`` with the same keys."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def retain(df: DataFrame, date_col: str, days: int, as_of: str, only: Column | None = None) -> DataFrame:
    """Drop rows older than ``days``; with ``only``, drop old rows of that kind alone."""
    young = F.col(date_col) >= F.date_sub(ts(as_of), days)
    return df.where(young if only is None else young | ~F.coalesce(only, F.lit(False)))


def deactivate(current: DataFrame, as_of: str) -> DataFrame:
    """Rows not seen on the day of ``as_of`` become inactive."""
    return current.withColumn("is_active", F.col("is_active") & (F.to_date("last_seen") >= F.to_date(ts(as_of))))


def mark_inactive(products: DataFrame, as_of: str, days: int = 7, seen: str = "last_seen_at") -> DataFrame:
    """Rows unseen for more than ``days`` become inactive."""
    return products.withColumn("is_active", F.col("is_active") & (F.col(seen) >= ts(as_of) - F.expr(f"INTERVAL {days} DAYS")))


def price_change_rollup(prices: DataFrame, depth: int = SPLIT_ROWS) -> DataFrame:
    """Initial and last price, number of changes and percent change per id."""
    steps = lagged(prices, ["id"], "seen_at", ["price"], (), depth)
    agg = steps.groupBy("id").agg(
        F.min_by("price", "seen_at").alias("initial_price"), F.max_by("price", "seen_at").alias("price"),
        F.count_if(F.col("prev_price") != F.col("price")).alias("price_change_count"))
    return agg.withColumn("price_change_pct", F.when(
        F.col("initial_price") > 0, (F.col("price") - F.col("initial_price")) / F.col("initial_price") * 100).otherwise(0.0))


def merge_lots(current: DataFrame, batch: DataFrame, platforms: DataFrame, as_of: str) -> DataFrame:
    """Auction lots after a batch; a lot without platform gets the first one of its source type."""
    default = platforms.groupBy("source_type").agg(F.min("id").alias("_default"))
    b = (batch.join(default, "source_type", "left")
         .withColumn("platform_id", F.coalesce("platform_id", "_default")).drop("_default"))
    return merge(current, b, ["platform_id", "external_id"], overwrite=LOT_OVERWRITE, keep=LOT_KEEP,
                 set_on_touch={"last_seen_at": ts(as_of)}, set_on_insert={"first_seen_at": ts(as_of)})


def derive_lot_columns(lots: DataFrame, as_of: str) -> DataFrame:
    """Columns derived from others: price per m2, map point, update time."""
    return (lots.withColumn("price_per_sqm", F.when(F.col("area_total") > 0, F.col("current_price") / F.col("area_total")))
            .withColumn("point", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lon", "lat")))
            .withColumn("updated_at", ts(as_of)))


def versioned_history(events: DataFrame, keys: Sequence[str], tracked: Sequence[str], at: str,
                      depth: int = SPLIT_ROWS) -> DataFrame:
    """Type-2 history: one row per run of equal tracked values, [valid_from, valid_to)."""
    # values are compared as they are, NULL like any other
    rows = events.select(*keys, at, *tracked).withColumn("_fp", F.struct(*tracked))
    first = lagged(rows, keys, at, ["_fp"], ["_fp"], depth)
    starts = first.where(F.col("prev__fp").isNull() | ~F.col("prev__fp").eqNullSafe(F.col("_fp"))).drop("prev__fp")
    nxt = next_instant(starts, keys, at, depth)
    return nxt.select(*keys, *tracked, F.col(at).alias("valid_from"), F.col("_next").alias("valid_to"),
                      F.col("_next").isNull().alias("is_current"))


def run_stats(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str],
              closed: Column | None = None) -> DataFrame:
    """Found / new / updated / closed counts from two snapshots.

    A row counts as updated if any ``compare`` column differs, as closed if it is missing
    from ``after`` or fulfils ``closed`` there but not before.
    """
    is_closed = F.lit(False) if closed is None else F.coalesce(closed, F.lit(False))
    b = before.select(*keys, F.struct(*compare).alias("_b"), is_closed.alias("_bc"), F.lit(True).alias("_in_b"))
    a = after.select(*keys, F.struct(*compare).alias("_a"), is_closed.alias("_ac"), F.lit(True).alias("_in_a"))
    j = b.join(a, list(keys), "full_outer")
    both = F.col("_in_b").isNotNull() & F.col("_in_a").isNotNull()
    return j.agg(F.count("_in_a").alias("lots_found"), F.count_if(F.col("_in_b").isNull()).alias("lots_new"),
                 F.count_if(both & ~F.col("_b").eqNullSafe(F.col("_a"))).alias("lots_updated"),
                 F.count_if(F.col("_in_a").isNull() | (both & F.col("_ac") & ~F.col("_bc"))).alias("lots_closed"))
