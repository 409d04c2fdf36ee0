"""Valuation from district x segment aggregates with a fallback chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.latest import with_latest_price
from hearthmark.operators.market import ppsm, ts
from hearthmark.operators.segments import MAX_ROOMS
from hearthmark.operators.skew import exact_quantiles, latest_by

PRICE = ["avg_price_per_sqm", "median_price_per_sqm"]


@dataclass(frozen=True)
class GridRules:
    window_days: int = 30
    min_listings: int = 3
    global_days: int = 90


def subject_cell(subjects: DataFrame) -> DataFrame:
    """Subjects with the segment they are looked up under (defaults where unknown)."""
    return subjects.withColumns({
        "_type": F.coalesce("building_type", F.lit("other")), "_height": F.coalesce("building_height", F.lit("medium")),
        "_rooms": F.least(F.coalesce("rooms", F.lit(2)), F.lit(MAX_ROOMS)),
        "_district": F.when(F.col("district_id") != 0, F.col("district_id"))})


def recent(aggregates: DataFrame, as_of: str, rules: GridRules) -> DataFrame:
    return aggregates.where(F.col("date") >= F.date_sub(ts(as_of), rules.window_days))


def grid_exact(aggregates: DataFrame, segments: DataFrame, as_of: str, rules: GridRules = GridRules()) -> DataFrame:
    """Newest large-enough row per (district, segment)."""
    rows = recent(aggregates, as_of, rules).where(F.col("total_listings") >= rules.min_listings)
    last = latest_by(rows, ["district_id", "segment_id"], ["date"], [*PRICE, "total_listings", "confidence_score"])
    seg = segments.select("segment_id", F.col("building_type").alias("_type"), F.col("building_height").alias("_height"), F.col("rooms_count").alias("_rooms"))
    conf = F.when(F.coalesce(F.col("confidence_score"), F.lit(0)) != 0, F.col("confidence_score")).otherwise(50)
    return last.join(F.broadcast(seg), "segment_id").select(
        F.col("district_id").alias("_district"), "_type", "_height", "_rooms", *PRICE,
        F.col("total_listings").alias("sample_size"), conf.cast("long").alias("confidence"), "segment_id")


def _relaxed(aggregates: DataFrame, segments: DataFrame, as_of: str, keys: list[str], base: int, step: int, rules: GridRules) -> DataFrame:
    """Mean of the daily means over the window; the listings of all days add up."""
    seg = segments.select("segment_id", F.col("building_type").alias("_type"), F.col("building_height").alias("_height"), F.col("rooms_count").alias("_rooms"))
    rows = recent(aggregates, as_of, rules).withColumnRenamed("district_id", "_district").join(F.broadcast(seg), "segment_id")
    g = rows.groupBy("_district", *keys).agg(*[F.avg(c).alias(c) for c in PRICE], F.sum("total_listings").alias("sample_size"))
    g = g.where(F.col("sample_size") >= rules.min_listings)
    return g.withColumn("confidence", F.least(F.lit(100).cast("long"), F.expr(f"{base} + (sample_size div {step}) * 10"))).withColumn(
        "segment_id", F.lit(None).cast("int"))


def grid_relaxed_height(aggregates, segments, as_of, rules: GridRules = GridRules()) -> DataFrame:
    return _relaxed(aggregates, segments, as_of, ["_type", "_rooms"], 30, 5, rules)


def grid_relaxed_type(aggregates, segments, as_of, rules: GridRules = GridRules()) -> DataFrame:
    return _relaxed(aggregates, segments, as_of, ["_height", "_rooms"], 20, 10, rules)


def grid_district(aggregates, segments, as_of, rules: GridRules = GridRules()) -> DataFrame:
    return _relaxed(aggregates, segments, as_of, [], 10, 20, rules)


def grid_global(listings: DataFrame, prices: DataFrame, as_of: str, rules: GridRules = GridRules()) -> DataFrame:
    """One row: mean and median price per m2 of everything seen lately."""
    rows = with_latest_price(listings.where("area_total > 0").where(
        F.col("last_seen") >= F.date_sub(ts(as_of), rules.global_days)), prices, "left").where("current_price > 0")
    rows = rows.select(ppsm(F.col("current_price"), F.col("area_total")).alias("v"))
    head = rows.agg(F.avg("v").alias("avg_price_per_sqm"), F.count(F.lit(1)).alias("sample_size")).where("sample_size > 0")
    q = exact_quantiles(rows, [], "v", [0.5], ["median_price_per_sqm"]).drop("n")
    return head.withColumn("median_price_per_sqm", q.scalar()).select(*PRICE, "sample_size", F.lit(10).cast("long").alias("confidence"), F.lit(None).cast("int").alias("segment_id"))


OUT = [*PRICE, "sample_size", "confidence", "segment_id"]


def grid_estimate(subjects: DataFrame, aggregates: DataFrame, segments: DataFrame, listings: DataFrame, prices: DataFrame,
                  as_of: str, rules: GridRules = GridRules()) -> DataFrame:
    """First level with an answer: exact, relaxed height, relaxed type, district, global.

    The levels are aggregates by district and segment; Spark broadcasts those that are small.
    """
    levels = [("exact", grid_exact(aggregates, segments, as_of, rules), ["_district", "_type", "_height", "_rooms"]),
              ("relaxed_height", grid_relaxed_height(aggregates, segments, as_of, rules), ["_district", "_type", "_rooms"]),
              ("relaxed_type", grid_relaxed_type(aggregates, segments, as_of, rules), ["_district", "_height", "_rooms"]),
              ("district", grid_district(aggregates, segments, as_of, rules), ["_district"])]
    s = subject_cell(subjects)
    picks = []
    for name, df, keys in levels:
        s = s.join(df.select(*keys, F.struct(*OUT, F.lit(name).alias("fallback_level")).alias(name)), keys, "left")
        picks.append(F.col(name))
    world = grid_global(listings, prices, as_of, rules).select(F.struct(*OUT, F.lit("global").alias("fallback_level")).alias("g"))
    s = s.withColumn("_pick", F.coalesce(*picks, world.scalar())).where("_pick IS NOT NULL")
    return s.select("subject_id", *[F.col(f"_pick.{c}").alias(c) for c in [*OUT, "fallback_level"]])


@dataclass(frozen=True)
class GateRules:
    exact: int = 60
    relaxed: int = 40
    default_ppsm: float = 200_000.0
    spread_share: float = 0.15


def grid_estimate_gated(subjects: DataFrame, aggregates: DataFrame, segments: DataFrame, districts: DataFrame, as_of: str,
                        rules: GateRules = GateRules()) -> DataFrame:
    """Same-day fallback with confidence gates: exact, relaxed height, relaxed type, district x rooms,
    parent district x rooms, mean over the rooms class, default.  Range is +- one deviation."""
    seg = segments.select("segment_id", F.col("building_type").alias("_type"), F.col("building_height").alias("_height"), F.col("rooms_count").alias("_rooms"))
    day = (aggregates.where(F.col("date") == F.to_date(ts(as_of))).withColumnRenamed("district_id", "_district").join(F.broadcast(seg), "segment_id"))

    def level(keys: list[str], gate: int | None) -> DataFrame:
        g = day.groupBy("_district", *keys).agg(
            F.avg("median_price_per_sqm").alias("psm"), F.sum("total_listings").alias("sample_size"),
            F.round(F.avg("confidence_score")).cast("long").alias("confidence"), F.avg("price_stddev").alias("stddev"))
        return g if gate is None else g.where(F.col("confidence") >= gate)

    part = ["psm", "sample_size", "confidence", "stddev"]
    up = districts.select(F.col("district_id").alias("_district"), F.col("parent_district_id").alias("_parent"))
    s = subject_cell(subjects).join(up, "_district", "left")
    steps = [("exact", ["_type", "_height", "_rooms"], rules.exact), ("relaxed_height", ["_type", "_rooms"], rules.relaxed),
             ("relaxed_type", ["_height", "_rooms"], rules.relaxed), ("district_only", ["_rooms"], None)]
    picks = []
    for name, keys, gate in steps:
        lv = level(keys, gate).select("_district", *keys, F.struct(*part, F.lit(name).alias("strategy")).alias(name))
        s = s.join(lv, ["_district", *keys], "left")
        picks.append(F.col(name))
    above = level(["_rooms"], None).select(F.col("_district").alias("_parent"), "_rooms", F.struct(*part, F.lit("parent_district").alias("strategy")).alias("parent_district"))
    s = s.join(above, ["_parent", "_rooms"], "left")
    world = day.groupBy("_rooms").agg(F.avg("median_price_per_sqm").alias("_w"))
    s = s.join(F.broadcast(world), "_rooms", "left")  # one row per rooms class
    fallback = F.struct(F.coalesce("_w", F.lit(rules.default_ppsm)).alias("psm"), F.lit(0).cast("long").alias("sample_size"),
                        F.lit(10).cast("long").alias("confidence"), F.lit(None).cast("double").alias("stddev"), F.lit("global_average").alias("strategy"))
    p = s.withColumn("_p", F.when(F.col("_district").isNotNull(), F.coalesce(*picks, F.col("parent_district"), fallback)))
    p = p.where("_p IS NOT NULL")
    psm, area = F.col("_p.psm"), F.col("area_total")
    dev = F.when(F.coalesce(F.col("_p.stddev"), F.lit(0.0)) != 0, F.col("_p.stddev")).otherwise(psm * rules.spread_share)
    ranged = F.col("_p.strategy") != "global_average"
    return p.select("subject_id", (psm * area).alias("estimated_price"), psm.alias("price_per_sqm"), F.col("_p.confidence").alias("confidence"),
                    F.col("_p.strategy").alias("strategy"), F.col("_p.sample_size").alias("sample_size"),
                    F.when(ranged, (psm - dev) * area).alias("range_min"), F.when(ranged, (psm + dev) * area).alias("range_max"))
