"""Quick estimates: locality medians, room counts from area, renovation classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.geography import places, radius_pairs
from hearthmark.operators.market import in_localities

# Renovation class -> price coefficient.
RENOVATION_COEFS = {1: 0.85, 2: 1.00, 3: 1.10, 4: 1.20}


def renovation_coef(cls: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RENOVATION_COEFS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, cls.cast("int")), F.lit(1.0))


@dataclass(frozen=True)
class LocalityRules:
    newest: int = 20
    area_low: float = 0.7
    area_high: float = 1.3
    first_floor: float = 0.95
    last_floor: float = 0.97


def locality_estimate(subjects: DataFrame, listings: DataFrame, prices: DataFrame, localities: DataFrame, fallback: str,
                      rules: LocalityRules = LocalityRules()) -> DataFrame:
    """Upper-middle price per m2 of the newest comparable points of the locality, floor-adjusted.

    subjects: subject_id, locality, area_total, rooms, floor, total_floors.  ``localities``: locality,
    pattern (ILIKE, of the address).  Without a comparable the newest points of ``fallback`` are used.
    Per (locality, rooms, area) only the newest 20 points can matter, so the join sees those
    alone, and subjects enter it once per distinct (locality, rooms, area).
    """
    pts = (in_localities(listings.where("area_total > 0").select("id", "rooms", F.col("area_total").alias("c_area"), "last_seen", "address"), localities).drop("address")
           .join(prices.where("price > 0").select("id", "seen_at", "price"), "id")
           .withColumn("psm", F.col("price") / F.col("c_area")))
    newest = [F.desc("last_seen"), F.asc("id"), F.desc("seen_at"), F.asc("price")]
    order_key = F.struct(-F.unix_micros(F.col("last_seen").cast("timestamp")), F.col("id"), -F.unix_micros(F.col("seen_at").cast("timestamp")), F.col("price")).alias("_o")
    w = Window.partitionBy("locality", "rooms", "c_area").orderBy(*newest)
    short = pts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rules.newest).select("locality", "rooms", "c_area", "psm", order_key)
    width = 0.7  # log width of a bin, wider than ln(high / low)
    short = short.withColumn("_bin", F.floor(F.log("c_area") / width))
    asked = subjects.where("area_total > 0 AND rooms IS NOT NULL").select("locality", "rooms", "area_total").distinct()
    lo, hi = F.col("area_total") * rules.area_low, F.col("area_total") * rules.area_high
    asked = asked.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor(F.log(lo) / width), F.floor(F.log(hi) / width)))))
    pairs = asked.join(short, ["locality", "rooms", "_bin"]).where(F.col("c_area").between(lo, hi))
    w2 = Window.partitionBy("locality", "rooms", "area_total").orderBy("_o")
    top = pairs.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= rules.newest)
    middle = F.element_at(F.array_sort(F.collect_list("psm")), F.expr("CAST(count(1) div 2 + 1 AS INT)"))
    found = top.groupBy("locality", "rooms", "area_total").agg(
        middle.alias("_psm"), F.count(F.lit(1)).alias("_n"), F.min("psm").alias("_lo"), F.max("psm").alias("_hi"))
    # fallback locality: one group of the newest points, whatever rooms and area
    back = pts.where(F.col("locality") == fallback).orderBy(*newest).limit(rules.newest).agg(
        F.struct(middle.alias("_psm"), F.count(F.lit(1)).alias("_n"), F.min("psm").alias("_lo"), F.max("psm").alias("_hi")).alias("f"))
    j = subjects.join(found, ["locality", "rooms", "area_total"], "left").withColumn("_f", back.scalar())
    use_back = F.col("_n").isNull()
    v = {c: F.when(use_back, F.col(f"_f.{c}")).otherwise(F.col(c)) for c in ("_psm", "_n", "_lo", "_hi")}
    adj = F.when(F.col("floor") == 1, rules.first_floor).when(F.col("floor") == F.col("total_floors"), rules.last_floor).otherwise(1.0)
    a = F.col("area_total")
    return j.select("subject_id", (v["_psm"] * adj * a).alias("price"), (v["_psm"] * adj).alias("price_sqm"), v["_n"].alias("comparables"),
                    (v["_lo"] * a * 0.95).alias("min_price"), (v["_hi"] * a * 1.05).alias("max_price"), use_back.alias("used_fallback")).where("price IS NOT NULL")


# Fixed values: (upper area bound, rooms, confidence) without a building type, and when nothing similar is found.
AREA_LADDER = ((30, 1, 0.6), (45, 1, 0.7), (70, 2, 0.7), (90, 3, 0.7), (120, 4, 0.6), (None, 5, 0.5))
SHORT_LADDER = ((45, 1, 0.6), (70, 2, 0.6), (None, 3, 0.5))


def _ladder(area: Column, steps) -> Column:
    pairs = [(b, F.struct(F.lit(n).alias("rooms"), F.lit(c).alias("confidence"))) for b, n, c in steps]
    out = F
    for b, v in pairs[:-1]:
        out = out.when(area < b, v)
    return out.otherwise(pairs[-1][1])


def estimate_rooms(subjects: DataFrame, listings: DataFrame, area_tol: float = 10.0, radius_m: float | None = 5000.0, top: int = 3) -> DataFrame:
    """Most frequent room count among listings of the same type and similar area (near the subject
    if it has coordinates); confidence is its share of the three most frequent.

    Both sides are reduced to distinct profiles before they meet.
    subjects: subject_id, area_total, building_type, lat, lon.
    """
    typed = subjects.where("building_type IS NOT NULL")
    known = listings.where("rooms IS NOT NULL AND building_type IS NOT NULL AND area_total IS NOT NULL")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    keys = ["building_type", "area_total", "lat", "lon"]
    parts = []
    if radius_m is not None:
        spots = known.groupBy("lat", "lon", "building_type", "rooms", F.col("area_total").alias("area")).agg(F.count(F.lit(1)).alias("n"))
        asked = typed.where(located).select(*keys).distinct()
        near = radius_pairs(asked, spots, radius_m, on=["building_type"]).where(F.abs(F.col("c_area") - F.col("area_total")) <= area_tol)
        parts.append(near.groupBy(*keys, F.col("c_rooms").alias("r")).agg(F.sum("c_n").alias("cnt")))
        typed = typed.where(~F.coalesce(located, F.lit(False)))
    width = 2 * area_tol
    cells = known.groupBy("building_type", F.col("rooms").alias("r"), F.col("area_total").alias("c_area")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_bin", F.floor(F.col("c_area") / width))
    asked = typed.select(*keys).distinct().withColumn("_bin", F.explode(F.array_distinct(F.array(
        F.floor((F.col("area_total") - area_tol) / width), F.floor((F.col("area_total") + area_tol) / width)))))
    anywhere = asked.join(cells, ["building_type", "_bin"]).where(F.abs(F.col("c_area") - F.col("area_total")) <= area_tol)
    parts.append(anywhere.groupBy(*keys, "r").agg(F.sum("n").alias("cnt")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc("r"))
    best = (counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(*keys)
            .agg(F.min_by("r", "_r").alias("_rooms"), (F.max("cnt") / F.sum("cnt")).alias("_conf")))
    j = subjects.alias("s").join(best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_rooms", "_conf"),
                                 (F.col("s.building_type") == F.col("_building_type")) & (F.col("s.area_total") == F.col("_area_total"))
                                 & F.col("s.lat").eqNullSafe(F.col("_lat")) & F.col("s.lon").eqNullSafe(F.col("_lon")), "left")
    a = F.col("s.area_total")
    guess = F.when(F.col("s.building_type").isNull(), _ladder(a, AREA_LADDER)).otherwise(_ladder(a, SHORT_LADDER))
    return j.select("subject_id", F.coalesce("_rooms", guess["rooms"]).alias("rooms"), F.coalesce("_conf", guess["confidence"]).alias("confidence"))
