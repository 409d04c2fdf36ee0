"""Price movements along the append-only price facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.latest import first_rows
from hearthmark.operators.market import ts
from hearthmark.operators.skew import lagged


def price_drops(listings: DataFrame, prices: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Points of active listings at least ``threshold`` below the previous point."""
    steps = lagged(prices, ["id"], "seen_at", ["price"])
    change = (F.col("price") - F.col("prev_price")) / F.nullif("prev_price", F.lit(0.0))
    drops = steps.where(change <= -threshold).withColumn("change_percent", change * 100)
    active = listings.where("is_active").select("id", "url", "address", "rooms", "area_total")
    return active.join(drops, "id").withColumnRenamed("price", "current_price")


def price_timeline(offers: DataFrame) -> DataFrame:
    """Offers beside the previous price and the change in percent; NULL for the first."""
    steps = lagged(offers, ["product_id"], "collected_at", ["price_minor"])
    change = (F.col("price_minor") - F.col("prev_price_minor")) / F.nullif("prev_price_minor", F.lit(0)) * 100
    return steps.withColumn("price_change_percent", change)


def daily_drops(products: DataFrame, sources: DataFrame, offers: DataFrame, as_of: str,
                threshold_pct: float = 5.0) -> DataFrame:
    """Drops collected on the day of ``as_of`` or later, with product and source names."""
    names = products.where("is_active").select(F.col("id").alias("product_id"), "name", "brand", "source_id")
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return (price_timeline(offers)
            .where((F.col("price_change_percent") <= -threshold_pct) & (F.col("collected_at") >= F.to_date(ts(as_of))))
            .join(names, "product_id").join(src, "source_id"))


def dedupe_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key along ``order`` (newest first for duplicates of a URL)."""
    return first_rows(df, keys, order)


def with_group_count(df: DataFrame, keys: Sequence[str], name: str = "group_count") -> DataFrame:
    """Row count of the group beside each row: aggregate and join instead of a window,
    so that a hot group is counted map-side and its rows are not moved to one task."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(n, list(keys))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank inside small groups (comparables of one valuation: at most k rows)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_level(matches: DataFrame, key: str = "id") -> DataFrame:
    """Most granular match per listing, smallest district id on ties."""
    return (matches.groupBy(key).agg(F.max_by(F.struct("district_id", "level"), F.struct(F.col("level"), -F.col("district_id"))).alias("_m"))
            .select(key, "_m.district_id", "_m.level"))


def exposure_stats(listings: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Days on market (counted from the original of a repost), price change and change count.

    ``listings`` carries original_listing_id (NULL if not a repost); ``changes`` is the
    output of ``price_change_rollup``.
    """
    orig = listings.select(F.col("id").alias("original_listing_id"), F.col("first_seen").alias("_orig_seen"))
    j = listings.join(orig, "original_listing_id", "left").join(
        changes.select("id", F.col("initial_price").alias("_initial"), F.col("price").alias("_current"), "price_change_count"), "id", "left")
    start = F.coalesce("_orig_seen", "first_seen")
    initial = F.coalesce("initial_price", "_initial")
    current = F.coalesce("_current", "initial_price")
    pct = F.when(initial > 0, (current - initial) / initial * 100).otherwise(0.0)
    return j.select("id", F.datediff(ts(as_of), start).alias("days_on_market"), initial.alias("initial_price"),
                    current.alias("current_price"), pct.alias("price_change_pct"),
                    F.coalesce("price_change_count", F.lit(0)).alias("price_change_count"),
                    F.col("original_listing_id").isNotNull().alias("is_repost"))
