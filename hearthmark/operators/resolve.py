"""Joins against address reference data and pasted links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.address import norm_address, pick
from hearthmark.operators.latest import with_latest_price


def resolve_addresses(listings: DataFrame, reference: DataFrame, min_length: int = 5) -> DataFrame:
    """Listings beside id, postal code and quality of the reference address with the same normal form.

    Several references with one normal form: the best quality, then the smallest id.
    """
    ref = reference.withColumn("_k", norm_address(F.col("address"))).groupBy("_k").agg(
        F.min_by(F.struct("address", "address_id", "postal_code", "address_quality_code"), F.struct("address_quality_code", "address_id")).alias("_r"))
    key = F.when(F.length(F.trim("address")) >= min_length, norm_address(F.col("address")))
    j = listings.withColumn("_k", key).join(ref, "_k", "left").drop("_k")
    return j.select(*listings.columns, F.col("_r.address").alias("resolved_address"), "_r.address_id", "_r.postal_code", "_r.address_quality_code")


def resolve_urls(links: DataFrame, listings: DataFrame, prices: DataFrame, id_pattern: str = r"/flat/(\d+)") -> DataFrame:
    """Listing behind each pasted link: by the id in it, else by the same URL; with the latest price."""
    priced = with_latest_price(listings, prices, "left").select("id", F.col("url").alias("listing_url"), "address", "area_total", "rooms", "current_price")
    rows = F.struct(*priced.columns)
    q = links.withColumn("_id", pick(F.col("link"), id_pattern).try_cast("long"))
    by_id = priced.select(F.col("id").alias("_id"), rows.alias("_by_id"))
    by_url = priced.groupBy(F.col("listing_url").alias("link")).agg(F.max_by(rows, "id").alias("_by_url"))
    j = q.join(by_id, "_id", "left").join(by_url, "link", "left").withColumn("_hit", F.coalesce("_by_id", "_by_url"))
    how = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_url").isNotNull(), "url")
    return j.select(*links.columns, "_hit.*", how.alias("matched_by"))
