"""Valuation history: recording, summaries, refinement and adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.address import pick
from hearthmark.operators.filters import page_with_total
from hearthmark.operators.latest import with_latest_price
from hearthmark.operators.market import exact_avg, ts
from hearthmark.operators.nearest import per_subject
from hearthmark.operators.price_history import rank_within
from hearthmark.operators.skew import top_rows

UNKNOWN = "Unknown"
OTHER_STREETS = "Other addresses"


def record_valuations(valuations: DataFrame, comps: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append: valuations with their time, and comparables ranked by price per m2."""
    v = valuations.withColumnRenamed("subject_id", "valuation_id").withColumn("created_at", ts(as_of))
    c = comps.select(F.col("subject_id").alias("valuation_id"), F.col("c_id").alias("listing_id"), F.col("c_price").alias("price"), "price_per_sqm",
                     F.col("c_area_total").alias("area_total"), "distance_km", "similarity_score", "weight", *per_subject(comps)[1:])
    return v, rank_within(c, per_subject(c, "valuation_id"), [F.asc("price_per_sqm"), F.asc("listing_id")]).drop("_home")


def history_summary(history: DataFrame) -> DataFrame:
    """Addresses valued more than once: price range and days tracked."""
    secs = F.unix_timestamp(F.max("created_at").cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))
    return history.groupBy("address").agg(
        F.count(F.lit(1)).alias("valuation_count"), F.min("estimated_price").alias("min_price"), F.max("estimated_price").alias("max_price"),
        exact_avg("estimated_price").alias("avg_price"), F.min("created_at").alias("first_valuation"), F.max("created_at").alias("last_valuation"),
        (secs / 86400).alias("days_tracked")).where(F.col("valuation_count") > 1)


def history_discount(history: DataFrame) -> DataFrame:
    """History beside the percent between market and interest price."""
    pct = (F.col("estimated_price") - F.col("interest_price")) / F.nullif("estimated_price", F.lit(0.0)) * 100
    return history.withColumn("market_discount_percent", F.when((F.col("estimated_price") > 0) & F.col("interest_price").isNotNull(), pct))


def street_of(address: Column) -> Column:
    """Text before the first comma or digit."""
    s = F.trim(pick(address, r"^([^,\d]+)"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(OTHER_STREETS))


def history_buildings(history: DataFrame, search: str | None = None) -> DataFrame:
    """One row per normalized address with its street."""
    h = history.where(F.col("address") != UNKNOWN)
    if search:
        h = h.where(F.col("address").ilike(f"%{search}%"))
    g = h.groupBy(F.coalesce("address_normalized", "address").alias("address_key")).agg(
        F.max("address").alias("address"), F.count(F.lit(1)).alias("valuation_count"), F.max("created_at").alias("last_valuation"),
        F.max("estimated_price").alias("max_price"), F.min("estimated_price").alias("min_price"))
    return g.withColumn("street", street_of(F.col("address")))


def history_by_street(history: DataFrame, search: str | None = None) -> DataFrame:
    """Streets with their number of buildings and valuations, latest first when ordered."""
    return history_buildings(history, search).groupBy("street").agg(
        F.count(F.lit(1)).alias("buildings"), F.sum("valuation_count").alias("total_valuations"), F.max("last_valuation").alias("last_valuation"))


def history_search(history: DataFrame, search: str | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
    """Page of valuations, newest first, beside the number of hits."""
    h = history.where(F.col("address") != UNKNOWN)
    if search:
        h = h.where(F.col("address").ilike(f"%{search}%"))
    return page_with_total(h, [("created_at", False)], page, per_page, "valuation_id")


def refine(valuations: DataFrame, comps: DataFrame, exclusions: DataFrame, as_of: str, bottom: int = 3, bargain: float = 0.93) -> tuple[DataFrame, DataFrame]:
    """Valuations recomputed without the excluded comparables, and a log row per request.

    ``exclusions``: valuation_id, listing_id, reason.  With fewer than three comparables left
    the request is rejected and the valuation stays as it is.
    """
    # both tables are read once; a valuation has few comparables, so all of one meet in one task
    reason = exclusions.schema["reason"].dataType
    given = comps.select("valuation_id", "listing_id", "price_per_sqm", F.lit(None).cast(reason).alias("reason"), F.lit(False).alias("_x"))
    asked = exclusions.select("valuation_id", "listing_id", F.lit(None).cast(comps.schema["price_per_sqm"].dataType).alias("price_per_sqm"), "reason", F.lit(True).alias("_x"))
    both = given.unionByName(asked).repartition("valuation_id")
    hit = F.max("_x").over(Window.partitionBy("valuation_id", "listing_id")) & F.col("valuation_id").isNotNull() & F.col("listing_id").isNotNull()
    both = both.withColumn("_stays", ~F.col("_x") & ~hit)
    low = Window.partitionBy("valuation_id", "_stays").orderBy("price_per_sqm", "listing_id")
    both = both.withColumn("_low", F.when(F.col("_stays") & (F.row_number().over(low) <= bottom), F.col("price_per_sqm")))
    log = both.groupBy("valuation_id").agg(
        F.count_if("_x").alias("excluded"), F.min("reason").alias("reason"), F.count_if("_stays").alias("remaining"),
        (F.sum("_low") / bottom).alias("_psm")).where("excluded > 0")
    log = log.withColumn("accepted", F.col("remaining") >= 3)
    psm = F.when(F.col("accepted"), F.col("_psm") * bargain)
    log = log.join(valuations.select("valuation_id", "area_total", F.col("estimated_price").alias("original_price")), "valuation_id").select(
        "valuation_id", "excluded", "reason", "remaining", "accepted", "original_price", psm.alias("refined_price_per_sqm"),
        (psm * F.col("area_total")).alias("refined_price"), ts(as_of).alias("created_at"))
    p = log.where("accepted").select("valuation_id", "refined_price", "refined_price_per_sqm", F.col("reason").alias("refinement_reason"))
    out = (valuations.join(p, "valuation_id", "left")
           .withColumn("estimated_price", F.coalesce("refined_price", "estimated_price"))
           .withColumn("estimated_price_per_sqm", F.coalesce("refined_price_per_sqm", "estimated_price_per_sqm"))
           .withColumn("refinement_at", F.when(F.col("refined_price").isNotNull(), ts(as_of))).drop("refined_price", "refined_price_per_sqm"))
    return out, log


def listing_detail(listings: DataFrame, prices: DataFrame, n: int = 20) -> DataFrame:
    """Listings with the latest price and their newest ``n`` price points (newest first)."""
    last = (top_rows(prices, ["id"], [F.desc("seen_at"), F.desc("price")], n).groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "seen_at", "price"))).alias("price_history")))
    return with_latest_price(listings, prices, "left").join(last, "id", "left")


ADJUSTABLE = ("interest_price", "interest_price_per_sqm", "expected_profit", "profit_rate")


def apply_adjustments(history: DataFrame, adjustments: DataFrame, as_of: str) -> DataFrame:
    """Latest adjustment per valuation laid over it; the time is set only if the price was moved.

    ``adjustments``: valuation_id, requested_at, price_adjustment, note and the investment fields;
    zero investment values count as not given.
    """
    last = adjustments.groupBy("valuation_id").agg(F.max_by(F.struct("price_adjustment", "note", *ADJUSTABLE), F.struct("requested_at", "note")).alias("_a"))
    j = history.join(last, "valuation_id", "left")
    hit = F.col("_a").isNotNull()
    for c in ADJUSTABLE:
        j = j.withColumn(c, F.when(hit, F.nullif(F.col(f"_a.{c}"), F.lit(0.0))).otherwise(F.col(c)))
    moved = hit & (F.coalesce("_a.price_adjustment", F.lit(0.0)) != 0)
    return (j.withColumn("price_adjustment", F.when(hit, F.coalesce("_a.price_adjustment", F.lit(0.0))))
            .withColumn("adjustment_note", F.nullif("_a.note", F.lit(""))).withColumn("adjusted_at", F.when(moved, ts(as_of))).drop("_a"))


def report_list(reports: DataFrame, as_of: str, user: int | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
    """Page of unexpired reports, newest first."""
    r = reports.where(F.col("expires_at").isNull() | (F.col("expires_at") > ts(as_of)))
    if user is not None:
        r = r.where(F.col("user_id") == user)
    return page_with_total(r, [("created_at", False)], page, per_page, "report_id")


def valuations_of_address(history: DataFrame, key: str) -> DataFrame:
    """All valuations of one normalized address with the change to the one before.

    The window runs over a single address picked by the caller.
    """
    h = history.where(F.coalesce("address_normalized", "address") == key)
    before = F.lag("estimated_price").over(Window.partitionBy("address_normalized").orderBy("created_at", "valuation_id"))
    return h.withColumn("change", F.col("estimated_price") - before)
