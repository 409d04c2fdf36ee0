"""Change detection, good deals, alerts and analysis priorities (batch forms)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.latest import latest_prices
from hearthmark.operators.market import ppsm, ts
from hearthmark.operators.skew import exact_quantiles, null_safe_join


@dataclass(frozen=True)
class DealRules:
    min_sample: int = 5
    alert_new_pct: float = 15.0
    alert_drop_pct: float = 10.0


def deal_stats(listings: DataFrame, rules: DealRules = DealRules()) -> DataFrame:
    """Price level per district and room count over active, error-free rows.

    ``listings``: district, rooms, price, area_total, is_active, is_error.
    """
    rows = listings.where(F.col("is_active") & ~F.coalesce("is_error", F.lit(False)) & F.col("district").isNotNull() & (F.col("price") > 0))
    keys = ["district", "rooms"]
    agg = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample"), F.avg(ppsm(F.col("price"), F.col("area_total"))).alias("avg_price_per_sqm"))
           .where(F.col("sample") >= rules.min_sample))
    q = exact_quantiles(rows, keys, "price", [0.5, 0.25], ["median_price", "p25_price"]).drop("n")
    return null_safe_join(agg, q, keys)


def good_deals(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Offers beside ``is_good_deal`` and the discount on the median; zero or missing rooms never qualify.

    The statistics carry one row per district and room count; Spark broadcasts them when they are small.
    """
    j = offers.join(stats.select("district", "rooms", "median_price", "p25_price"), ["district", "rooms"], "left")
    good = (F.col("rooms") != 0) & (F.col("price") > 0) & (F.col("price") < F.col("p25_price"))
    return (j.withColumn("is_good_deal", F.coalesce(good, F.lit(False)))
            .withColumn("discount_pct", F.when(F.col("is_good_deal"), (1 - F.col("price") / F.col("median_price")) * 100)))


def classify_changes(existing: DataFrame, offers: DataFrame, stats: DataFrame, rules: DealRules = DealRules()) -> DataFrame:
    """Offers as NEW / PRICE_CHANGE / UNCHANGED against the stored price, with the alert decision."""
    known = existing.select("id", F.col("price").alias("old_price"), F.lit(True).alias("_known"))
    j = good_deals(offers, stats).join(known, "id", "left")
    change = F.when(F.col("_known").isNull(), "NEW").when(~F.col("old_price").eqNullSafe(F.col("price")), "PRICE_CHANGE").otherwise("UNCHANGED")
    drop = F.when(F.col("price") < F.col("old_price"), (1 - F.col("price") / F.col("old_price")) * 100)
    out = j.withColumn("change", change).withColumn("drop_pct", drop).drop("_known")
    new_alert = (F.col("change") == "NEW") & (F.col("discount_pct") >= rules.alert_new_pct)
    drop_alert = (F.col("change") == "PRICE_CHANGE") & F.col("is_good_deal") & (F.col("drop_pct") >= rules.alert_drop_pct)
    return out.withColumn("alert", F.coalesce(new_alert, F.lit(False)) | F.coalesce(drop_alert, F.lit(False)))


def pending_alerts(listings: DataFrame, prices: DataFrame, sent: DataFrame, as_of: str, minutes: int = 60, n: int = 10) -> DataFrame:
    """Risk-tagged listings first seen within the last minutes and not sent yet, newest first."""
    cut = ts(as_of) - F.expr(f"INTERVAL {minutes} MINUTES")
    fresh = listings.where(F.col("has_risk") & (F.col("first_seen") > cut) & (F.col("first_seen") <= ts(as_of)))
    due = fresh.join(sent.select("id"), "id", "left_anti")
    priced = due.join(latest_prices(prices).select("id", "price"), "id")
    return priced.orderBy(F.desc("first_seen"), "id").limit(n)


def ingest_counters(listings: DataFrame, as_of: str, cut_hour: int = 9) -> DataFrame:
    """Rows added today, in the last hour and before today's cut-off hour."""
    now, seen = ts(as_of), F.col("first_seen")
    day = F.date_trunc("day", now)
    return listings.where(seen <= now).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(seen >= day).alias("added_today"),
        F.count_if(seen > now - F.expr("INTERVAL 1 HOUR")).alias("added_last_hour"),
        F.count_if((seen < day + F.expr(f"INTERVAL {cut_hour} HOURS")) & F.col("is_active")).alias("active_at_cut_off"))


# --- analysis priorities ------------------------------------------------------------

@dataclass(frozen=True)
class PriorityRules:
    premium_price: float = 15_000_000
    dear_ppsm: float = 250_000
    cheap_ppsm: float = 150_000
    large_area: float = 100


def priority_score(price: Column, area: Column, age_days: Column, rules: PriorityRules = PriorityRules()) -> Column:
    """0-100: premium 30, dear 25 or cheap 20 per m2, new today 25 or this week 10, large 10."""
    p = F.when(area > 0, price / area).otherwise(0.0)
    score = (F.when(price > rules.premium_price, 30).otherwise(0)
             + F.when(p > rules.dear_ppsm, 25).when(p < rules.cheap_ppsm, 20).otherwise(0)
             + F.when(age_days < 1, 25).when(age_days < 7, 10).otherwise(0)
             + F.when(area > rules.large_area, 10).otherwise(0))
    return F.least(score, F.lit(100))


def select_for_analysis(listings: DataFrame, rated: DataFrame, strategy: str, as_of: str, rules: PriorityRules = PriorityRules()) -> DataFrame:
    """Unrated active listings chosen by strategy all / important / new / on_demand, with their score.

    ``listings`` carries current_price.
    """
    todo = listings.where("is_active").join(rated.select(F.col("listing_id").alias("id")).distinct(), "id", "left_anti")
    price, area = F.col("current_price"), F.col("area_total")
    age = F.datediff(ts(as_of), "first_seen")
    p = F.when(area > 0, price / area).otherwise(0.0)
    pick = {"all": F.lit(True), "on_demand": F.lit(False), "new": age < 1,
            "important": (price > rules.premium_price) | (p > rules.dear_ppsm) | (p < rules.cheap_ppsm) | (age < 1)}[strategy]
    return todo.where(pick).withColumn("priority_score", priority_score(price, area, age, rules))


def project_cost(selected: DataFrame, photos_per_listing: int = 1, cost_per_photo: float = 0.00425, seconds_per_photo: float = 2.0) -> DataFrame:
    n = F.count(F.lit(1))
    return selected.agg(n.alias("listings_count"), (n * photos_per_listing).alias("total_photos"),
                        (n * photos_per_listing * cost_per_photo).alias("total_cost_usd"),
                        (n * photos_per_listing * seconds_per_photo / 3600).alias("estimated_time_hours"))
