"""Auction lots: search, dashboards and market comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.filters import all_of, page_with_total
from hearthmark.operators.market import exact_avg, ts
from hearthmark.operators.merge import upsert_snapshot
from hearthmark.operators.skew import top_rows

# Lot states in which a bid is still possible.
OPEN_STATES = ("announced", "active")


def is_open(status: str = "status") -> Column:
    return F.col(status).isin(*OPEN_STATES)


def with_comparison(lots: DataFrame, comparison: DataFrame) -> DataFrame:
    c = comparison.select(F.col("lot_id").alias("id"), "market_price_estimate", "discount_from_market", "comparables_count")
    return lots.join(c, "id", "left")


def active_lots(lots: DataFrame, platforms: DataFrame, comparison: DataFrame) -> DataFrame:
    """Open lots beside platform name and comparison."""
    p = platforms.select(F.col("id").alias("platform_id"), F.col("name").alias("platform_name"))
    return with_comparison(lots.where(is_open()), comparison).join(p, "platform_id", "left")


@dataclass(frozen=True)
class LotSearch:
    source: str | None = None
    status: str | None = None
    city: str | None = None
    min_discount: float | None = None
    sort: str = "date"
    page: int = 1
    per_page: int = 20


def search_lots(lots: DataFrame, comparison: DataFrame, spec: LotSearch) -> DataFrame:
    """A page of lots and the number of hits; status 'active' means any open state."""
    cond = []
    if spec.source:
        cond.append(F.col("source_type") == spec.source)
    if spec.status:
        cond.append(is_open() if spec.status == "active" else F.col("status") == spec.status)
    if spec.city:
        cond.append(F.col("city").ilike(f"%{spec.city}%"))
    if spec.min_discount:
        cond.append(F.col("discount_from_market") >= spec.min_discount)
    sort = {"price": [("current_price", True)], "discount": [("discount_from_market", False)]}.get(spec.sort, [("auction_date", True)])
    return page_with_total(with_comparison(lots, comparison).where(all_of(cond)), sort, spec.page, spec.per_page)


def lots_by_source(lots: DataFrame) -> DataFrame:
    return lots.groupBy("source_type", "status").agg(
        F.count(F.lit(1)).alias("lots"), exact_avg("current_price").alias("avg_price"),
        F.avg(F.col("current_price") / F.nullif("area_total", F.lit(0.0))).alias("avg_price_per_sqm"), F.avg("area_total").alias("avg_area"))


def lot_overview(lots: DataFrame, comparison: DataFrame, as_of: str) -> DataFrame:
    """Counters of lots, prices, discounts and lots due within a week, in one row."""
    rows = with_comparison(lots, comparison)
    o, d = is_open(), F.col("discount_from_market")
    soon = (F.col("auction_date") >= ts(as_of)) & (F.col("auction_date") <= ts(as_of) + F.expr("INTERVAL 7 DAYS"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_lots"), F.count_if(o).alias("active_lots"), F.count_if(F.col("status") == "completed").alias("completed_lots"),
        exact_avg(F.when(o, F.col("current_price"))).alias("avg_price"), F.avg(F.when(o, F.col("area_total"))).alias("avg_area"),
        F.avg(F.when(o, F.col("current_price") / F.nullif("area_total", F.lit(0.0)))).alias("avg_price_per_sqm"),
        F.count(F.when(o, d)).alias("with_comparison"), F.avg(F.when(o, d)).alias("avg_discount"),
        F.count_if(o & (d >= 20)).alias("discount_20_plus"), F.count_if(o & (d >= 30)).alias("discount_30_plus"),
        F.count_if(o & soon).alias("upcoming"))


def overview_by_source(lots: DataFrame) -> DataFrame:
    return lots.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_open()).alias("active"),
        exact_avg(F.when(is_open(), F.col("current_price"))).alias("avg_price"))


def best_deals(lots: DataFrame, comparison: DataFrame, min_discount: float = 10.0) -> DataFrame:
    return with_comparison(lots.where(is_open()), comparison).where(F.col("discount_from_market") > min_discount)


def city_lots(lots: DataFrame, city: str, kind: str = "apartment") -> DataFrame:
    return lots.where(is_open() & (F.col("city") == city) & (F.col("property_type") == kind))


def compare_with_market(lots: DataFrame, valuations: DataFrame) -> DataFrame:
    """Comparison row per lot with coordinates, area and price; the discount is taken on the market price.

    ``valuations``: subject_id, estimated_price, estimated_price_per_sqm, method_used, confidence, comparables_count.
    """
    ok = lots.where("lat IS NOT NULL AND lon IS NOT NULL AND area_total > 0 AND current_price > 0").select(
        F.col("id").alias("lot_id"), "current_price")
    v = valuations.where("estimated_price > 0").withColumnRenamed("subject_id", "lot_id")
    discount = (F.col("estimated_price") - F.col("current_price")) / F.col("estimated_price") * 100
    return ok.join(v, "lot_id").select(
        "lot_id", F.col("estimated_price").alias("market_price_estimate"), F.col("estimated_price_per_sqm").alias("market_price_per_sqm"),
        F.col("method_used").alias("estimation_method"), F.col("confidence").alias("estimation_confidence"),
        discount.alias("discount_from_market"), "comparables_count")


def merge_comparison(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One comparison per lot; the new one replaces the old."""
    return upsert_snapshot(existing, new, ["lot_id"])


def lot_price_history(history: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` recorded prices per lot."""
    return top_rows(history, ["lot_id"], [F.desc("recorded_at"), F.desc("price")], n)


def winning_bids(bids: DataFrame) -> DataFrame:
    """Highest bid per lot (the earliest of equal ones), the flagged winner, and the number of bids."""
    top = F.struct(F.col("bid_amount"), -F.unix_micros(F.col("bid_at").cast("timestamp")), F.col("bidder"))
    return bids.groupBy("lot_id").agg(
        F.max_by(F.struct("bidder", "bid_amount", "bid_at"), top).alias("_b"), F.count(F.lit(1)).alias("bids"),
        F.max_by("bidder", F.when(F.col("is_winner"), top)).alias("winner"),
    ).select("lot_id", "bids", "_b.bidder", "_b.bid_amount", "_b.bid_at", "winner")


def daily_scrape_stats(stats: DataFrame, platforms: DataFrame) -> DataFrame:
    p = platforms.select(F.col("id").alias("platform_id"), "source_type", F.col("name").alias("platform_name"))
    return stats.join(p, "platform_id")
