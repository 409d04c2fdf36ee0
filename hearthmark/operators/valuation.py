"""End-to-end valuation of a table of properties."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.parsing import parse_property_text
from hearthmark.operators import comparables as cmp
from hearthmark.operators import geography as geo
from hearthmark.operators import grid
from hearthmark.operators.investment import InvestParams, interest_price
from hearthmark.operators.segments import BUILDING_TYPES, height_class
from hearthmark.session import cut_lineage


@dataclass(frozen=True)
class MarketContext:
    """Tables a valuation draws on, at one instant."""

    listings: DataFrame
    prices: DataFrame
    districts: DataFrame
    aggregates: DataFrame
    segments: DataFrame
    deals: DataFrame
    as_of: str
    rules: cmp.CompRules = field(default_factory=cmp.CompRules)
    invest: InvestParams = field(default_factory=lambda: InvestParams(include_utilities=True))


def complete_subjects(subjects: DataFrame, ctx: MarketContext) -> DataFrame:
    """Fill missing district, floors, year and building type from polygons and neighbours."""
    s = subjects
    if "outline" in ctx.districts.columns:
        at = geo.assign_by_polygon(s.where("district_id IS NULL"), ctx.districts, "subject_id").select("subject_id", F.col("district_id").alias("_d"))
        s = s.join(at, "subject_id", "left").withColumn("district_id", F.coalesce("district_id", "_d")).drop("_d")
    gaps = s.where("total_floors IS NULL OR building_year IS NULL OR building_type IS NULL")
    info = geo.impute_building_info(gaps.select("subject_id", "lat", "lon"), ctx.listings).select(
        "subject_id", F.struct("total_floors", "building_year", "building_type").alias("_i"))
    given = F.col("building_type")
    s = s.join(info, "subject_id", "left").withColumn("building_type_source", F.when(given.isNotNull(), "manual").when(F.col("_i.building_type").isNotNull(), "auto"))
    s = s.withColumns({c: F.coalesce(c, f"_i.{c}") for c in ("total_floors", "building_year", "building_type")}).drop("_i")
    s = cut_lineage(s)
    near = geo.impute_building_type(s.where("building_type IS NULL").select("subject_id", "lat", "lon"), ctx.listings).select("subject_id", "detected_type")
    s = s.join(near, "subject_id", "left")
    s = s.withColumn("building_type_source", F.coalesce("building_type_source", F.when(F.col("detected_type").isNotNull(), "auto_nearby")))
    kind = F.lower(F.coalesce("building_type", "detected_type"))
    return s.withColumns({"building_type": F.when(kind.isin(*BUILDING_TYPES), kind).when(kind.isNotNull(), "other"),
                          "building_height": height_class(F.col("total_floors"))}).drop("detected_type")


def value_properties(subjects: DataFrame, ctx: MarketContext) -> DataFrame:
    """Buyer-side estimate, market price, nearby deals and interest price per subject.

    subjects: subject_id, lat, lon, district_id, area_total, rooms, floor, total_floors,
    building_type, building_year, exclude_id.
    """
    s = cut_lineage(complete_subjects(subjects, ctx))  # read by four branches below
    points = cmp.listing_points(ctx.listings, ctx.prices, ctx.as_of, ctx.rules)
    comps = cmp.comparables(s, points, ctx.as_of, ctx.rules)
    cells = grid.grid_estimate(s, ctx.aggregates, ctx.segments, ctx.listings, ctx.prices, ctx.as_of)
    v = cmp.hybrid_estimate(s, comps, cells)
    v = s.select("subject_id", "area_total", "district_id", "building_type", "building_type_source", "total_floors", "building_year").join(v, "subject_id")
    v = v.withColumn("market_price_per_sqm", F.col("comparables_median_psm")).withColumn("market_price", F.col("comparables_median_psm") * F.col("area_total"))
    near = geo.nearby_deals(s, ctx.deals, ctx.as_of, limit=15).groupBy("subject_id").agg(F.count(F.lit(1)).alias("deals_count"))
    v = v.join(near, "subject_id", "left").withColumn("deals_count", F.coalesce("deals_count", F.lit(0)))
    warn = (F.when(F.col("total_floors").isNull() & F.col("building_year").isNull(), "floors and year unknown")
            .when(F.col("total_floors").isNull(), "floors unknown").when(F.col("building_year").isNull(), "year unknown"))
    base = v.withColumn("building_info_warning", warn).drop("comparables_median_psm")
    # the investment reads the market price where there is one
    inv = base.withColumn("_market", F.col("market_price")).withColumn("market_price", F.coalesce("market_price", "estimated_price")).where("area_total > 0")
    inv = interest_price(inv.select("subject_id", "market_price", "area_total"), ctx.invest, "own").select(
        "subject_id", "interest_price", "interest_price_per_sqm", "expected_profit", F.col("profit_rate"), "monthly_profit_rate", "cost_breakdown", "reject_reason")
    return base.join(inv, "subject_id", "left")


def subjects_from_text(texts: DataFrame, listings: DataFrame) -> DataFrame:
    """Subjects from one-line descriptions: explicit values win over parsed ones, coordinates and
    missing building facts come from the latest listing of the same house.

    texts: subject_id, text and optional overrides o_area_total, o_rooms, o_floor, o_total_floors,
    o_building_type, o_building_year.  Rows without an area are dropped.
    """
    p = parse_property_text(F.col("text"))
    over = {"area_total": p["area"], "rooms": p["rooms"], "floor": p["floor"], "total_floors": p["total_floors"],
            "building_type": F.lit(None).cast("string"), "building_year": F.lit(None).cast("int")}
    cols = [F.coalesce(F.col(f"o_{k}"), v).alias(k) if f"o_{k}" in texts.columns else v.alias(k) for k, v in over.items()]
    s = texts.select("subject_id", p["address"].alias("address"), *cols).where("area_total > 0")
    from hearthmark.functions.address import street_house_key
    known = (listings.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_k", street_house_key(F.col("address"))).where("_k IS NOT NULL").groupBy("_k")
             .agg(F.max_by(F.struct("lat", "lon", "total_floors", "house_year", "building_type"), F.struct("last_seen", "id")).alias("_p")))
    j = s.withColumn("_k", street_house_key(F.col("address"))).join(known, "_k", "left")
    return j.select("subject_id", "address", "area_total", "rooms", "floor", F.coalesce("total_floors", "_p.total_floors").alias("total_floors"),
                    F.coalesce("building_type", "_p.building_type").alias("building_type"), F.coalesce("building_year", "_p.house_year").alias("building_year"),
                    F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), F.lit(None).cast("int").alias("district_id"), F.lit(None).cast("long").alias("exclude_id"))


def value_from_text(texts: DataFrame, ctx: MarketContext) -> DataFrame:
    return value_properties(subjects_from_text(texts, ctx.listings), ctx)
