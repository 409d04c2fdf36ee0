"""Latest-value and as-of joins on append-only facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.skew import asof_last, latest_by, top_rows


def latest_prices(prices: DataFrame, since: Column | None = None, unique: bool = False) -> DataFrame:
    """Newest price per id.

    Of prices at one instant the higher wins. Pass ``unique=True`` where (id, seen_at) is a key of the facts:
    then plain ``max_by`` is deterministic and runs as a hash aggregate.
    """
    p = prices if since is None else prices.where(F.col("seen_at") >= since)
    if unique:
        return p.groupBy("id").agg(F.max_by("price", "seen_at").alias("price"), F.max("seen_at").alias("seen_at"))
    return latest_by(p, ["id"], ["seen_at", "price"], ["price", "seen_at"])


def with_latest_price(listings: DataFrame, prices: DataFrame, how: str = "inner",
                      since: Column | None = None) -> DataFrame:
    """Listings beside ``current_price`` and ``price_seen_at``.

    ``how='left'`` keeps listings without a price and falls back to ``initial_price``.
    """
    p = latest_prices(prices, since).select("id", F.col("price").alias("current_price"),
                                            F.col("seen_at").alias("price_seen_at"))
    out = listings.join(p, "id", how)
    if how == "left":
        out = out.withColumn("current_price", F.coalesce("current_price", "initial_price"))
    return out


def with_counts(left: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` beside the number of facts per key, zero where there is none."""
    n = facts.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_main_photo(listings: DataFrame, photos: DataFrame) -> DataFrame:
    """Listing beside the first photo flagged as main, by (photo_order, url)."""
    main = (photos.where("is_main").groupBy("listing_id")
            .agg(F.min_by("photo_url", F.struct("photo_order", "photo_url")).alias("main_photo_url")))
    return listings.join(main, listings.id == main.listing_id, "left").drop("listing_id")


def price_as_of(subjects: DataFrame, prices: DataFrame, at: str = "at") -> DataFrame:
    """Price in force at ``at`` for each (id, at) of ``subjects``; NULL before the first price."""
    return asof_last(subjects, prices, ["id"], at, "seen_at", "price", name="price_at")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first along ``order``."""
    return top_rows(df, keys, order, 1, "_rn").drop("_rn")
