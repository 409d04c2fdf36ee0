"""Valuation by comparable listings and by registered deals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.latest import with_latest_price
from hearthmark.operators.market import ts
from hearthmark.operators.nearest import ALL_LANES, HAIR, LAST_CLASS, NO_LANE, Box, nearest, per_subject

SUBJECT = ["subject_id", "lat", "lon", "area_total", "rooms", "floor", "total_floors", "building_type", "building_year", "exclude_id"]


@dataclass(frozen=True)
class CompRules:
    k: int = 10
    max_age_days: int = 90
    deal_max_age_days: int = 365
    room_area_slack: float = 10.0
    deal_area_share: float = 0.2
    max_km: float = 10.0
    area_coef: float = 0.001
    ageing_per_30d: float = 0.01
    ageing_cap: float = 0.03
    box: Box = Box()


def _known(c: Column) -> Column:
    """Given and not zero: zero counts as unknown in all scoring rules."""
    return F.coalesce(c != 0, F.lit(False))


def age_days(at: Column, as_of: str) -> Column:
    """Whole days between an instant and ``as_of``."""
    return F.timestamp_diff("DAY", at.cast("timestamp"), ts(as_of).cast("timestamp"))


def listing_points(listings: DataFrame, prices: DataFrame, as_of: str, rules: CompRules = CompRules()) -> DataFrame:
    """Active, recently seen listings with coordinates, area and a price."""
    cut = ts(as_of) - F.expr(f"INTERVAL {rules.max_age_days} DAYS")
    ok = listings.where("is_active AND lat IS NOT NULL AND lon IS NOT NULL AND area_total > 0").where(F.col("last_seen") >= cut)
    p = with_latest_price(ok, prices, "left", since=cut).where("current_price > 0")
    return p.select("id", "lat", "lon", "area_total", "rooms", "floor", "total_floors", "building_type",
                    F.col("house_year").alias("building_year"), F.col("current_price").alias("price"),
                    F.coalesce("price_seen_at", "last_seen").alias("seen_at"))


def find_candidates(subjects: DataFrame, points: DataFrame, rules: CompRules = CompRules()) -> DataFrame:
    """The 3k nearest listings under the room rule: same count, one more if not much larger,
    one less if not much smaller; any if the subject's room count is unknown."""
    slack = rules.room_area_slack
    r, a, cr, ca = F.col("rooms"), F.col("area_total"), F.col("c_rooms"), F.col("c_area_total")
    rooms_ok = r.isNull() | (cr == r) | ((cr == r + 1) & (ca <= a + slack)) | ((cr == r - 1) & (ca >= a - slack))
    not_self = F.col("exclude_id").isNull() | (F.col("c_id") != F.col("exclude_id"))

    def sure(cls: Column, lo: Column, hi: Column) -> Column:
        return (r.isNull() | (cls == r) | ((cls == r + 1) & (hi <= a + slack))
                | ((cls >= 0) & (cls == r - 1) & (lo >= a - slack)))

    # lanes are room counts, the last one for all beyond; a subject without a count looks into all
    top = LAST_CLASS + 1
    lane = F.when(F.col("rooms") < 0, NO_LANE).otherwise(F.least(F.col("rooms").cast("int"), F.lit(top)))
    every = F.array(*[F.lit(k) for k in range(NO_LANE, top + 1)])
    near = F.array_distinct(F.transform(F.array(r - 1, r, r + 1), lambda k: F.when(k < 0, NO_LANE).otherwise(F.least(k.cast("int"), F.lit(top)))))
    # listings with the very rooms of the subject fit whatever their area
    own = F.when((F.col("rooms") == lane) & lane.between(0, LAST_CLASS), lane)
    subjects = subjects.where(_known(F.col("lat")) & _known(F.col("lon")))
    return nearest(subjects, points, 3 * rules.k, rooms_ok & not_self, sure, ["rooms", "area_total"], rules.box, F.col("rooms"),
                   lane=lane, lanes=F.when(r.isNull(), every).otherwise(near), free=(own, F.when(r.isNull(), ALL_LANES).otherwise(own)))


def same_class() -> Column:
    """Height and era of the candidate's building fit the subject's."""
    tf, cf, ty, cy = F.col("total_floors"), F.col("c_total_floors"), F.col("building_year"), F.col("c_building_year")
    floors_bad = (F.when(tf >= 9, cf <= 5).when(tf <= 5, cf >= 9).otherwise((cf <= 5) | (cf >= 17)))
    years_bad = F.when(ty >= 2000, cy < 1990).when(ty < 1990, cy >= 2000).otherwise(F.lit(False))
    return ~((_known(tf) & _known(cf) & floors_bad) | (_known(ty) & _known(cy) & years_bad))


def class_filter(candidates: DataFrame) -> DataFrame:
    """Keep same-class candidates; if fewer than three pass, refill with the nearest others up to five.

    All windows run over the at most 3k candidates of one subject.
    """
    per = Window.partitionBy(*per_subject(candidates))
    c = candidates.withColumn("_ok", same_class())
    so_far = per.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({"_n": F.count(F.lit(1)).over(per), "_pass": F.count_if(F.col("_ok")).over(per), "_rej": F.count_if(~F.col("_ok")).over(so_far)})
    few = F.col("_pass") < 3
    refill = ~F.col("_ok") & few & (F.col("_n") >= 3) & (F.col("_rej") <= 5 - F.col("_pass"))
    last_resort = (F.col("_pass") == 0) & (F.col("_n") < 3)
    return c.where(F.col("_ok") | refill | last_resort).withColumn("refilled", ~F.col("_ok")).drop("_ok", "_n", "_pass", "_rej")


def _area_ratio() -> Column:
    a, b = F.col("area_total"), F.col("c_area_total")
    return F.least(a, b) / F.greatest(a, b)


def similarity() -> Column:
    """0-100: building type 20, rooms 20, area 25, floor 15, distance 20."""
    d = F.col("distance_km")
    kind = F.when(F.col("building_type").isNull() | F.col("c_building_type").isNull(), 10.0).when(
        F.col("building_type") == F.col("c_building_type"), 20.0).otherwise(5.0)
    rooms = F.when(_known(F.col("rooms")) & _known(F.col("c_rooms")),
                   F.greatest(F.lit(0), 20 - F.abs(F.col("rooms") - F.col("c_rooms")) * 10)).otherwise(10)
    area = F.when((F.col("area_total") > 0) & (F.col("c_area_total") > 0), 25 * _area_ratio()).otherwise(10.0)
    floor = F.when(_known(F.col("floor")) & _known(F.col("c_floor")),
                   F.greatest(F.lit(0), 15 - F.abs(F.col("floor") - F.col("c_floor")) * 2)).otherwise(7)
    near = F.when(d <= 1, 20.0).when(d <= 3, 15.0).when(d <= 5, 10.0).otherwise(F.greatest(F.lit(0.0), 10 - (d - 5) * 2))
    return kind + rooms + area + floor + near


def corrected_ppsm(ppsm: Column, rules: CompRules) -> Column:
    """Price per m2 moved to the subject's area: larger flats are cheaper per m2."""
    diff = F.col("area_total") - F.col("c_area_total")
    return F.when(F.abs(diff) > 0.5, ppsm * (1 - rules.area_coef * diff)).otherwise(ppsm)


def score(candidates: DataFrame, as_of: str, rules: CompRules = CompRules()) -> DataFrame:
    """Similarity and corrected price per m2 of each candidate within reach."""
    age = age_days(F.col("c_seen_at"), as_of)
    stale = F.least(F.lit(rules.ageing_cap), age / 30 * rules.ageing_per_30d)
    return (candidates.where(F.col("distance_km") <= rules.max_km)
            .withColumn("similarity_score", similarity())
            .withColumn("price_per_sqm", corrected_ppsm(F.col("c_price") / F.col("c_area_total"), rules) * (1 - stale)))


def top_k_weights(scored: DataFrame, k: int) -> DataFrame:
    """The k most similar per subject with weights that add up to one."""
    order = [F.desc(F.round("similarity_score", 9)), F.asc("refilled"), F.asc("distance_km"), F.asc("c_id")]
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*per_subject(scored)).orderBy(*order))).where(F.col("rank") <= k)
    per = Window.partitionBy(*per_subject(scored))
    total = F.sum("similarity_score").over(per)
    return top.withColumn("weight", F.when(total == 0, 1.0 / F.count(F.lit(1)).over(per)).otherwise(F.col("similarity_score") / total))


def comparables(subjects: DataFrame, points: DataFrame, as_of: str, rules: CompRules = CompRules()) -> DataFrame:
    """Weighted comparable listings per subject."""
    return top_k_weights(score(class_filter(find_candidates(subjects, points, rules)), as_of, rules), rules.k)


def _confidence() -> Column:
    n, sim, dist = F.col("comparables_count"), F.col("avg_similarity"), F.col("avg_distance_km")
    raw = n / 10 * 20 + sim / 100 * 50 + 30 / (1 + dist)
    return F.least(F.lit(100), F.floor(F.round(raw, 9)).cast("int"))


def estimate(comps: DataFrame, *more: Column) -> DataFrame:
    """Weighted mean and median price and price per m2, and a confidence, per subject (k rows each)."""
    return comps.groupBy(*per_subject(comps)).agg(
        F.sum(F.col("c_price") * F.col("weight")).alias("avg_price"), F.percentile("c_price", 0.5).alias("median_price"),
        F.sum(F.col("price_per_sqm") * F.col("weight")).alias("avg_price_per_sqm"),
        F.percentile("price_per_sqm", 0.5).alias("median_price_per_sqm"), F.count(F.lit(1)).alias("comparables_count"),
        F.avg("similarity_score").alias("avg_similarity"), F.avg("distance_km").alias("avg_distance_km"),
        F.sum("weight").alias("total_weight"), *more).drop("_home").withColumn("confidence", _confidence())


# --- registered deals ---------------------------------------------------------------

def deal_points(deals: DataFrame, as_of: str, rules: CompRules = CompRules()) -> DataFrame:
    """Recent deals with place, area and price."""
    cut = ts(as_of) - F.expr(f"INTERVAL {rules.deal_max_age_days} DAYS")
    ok = deals.where("lat IS NOT NULL AND lon IS NOT NULL AND area > 0 AND deal_price > 0").where(F.col("deal_date") >= cut)
    return ok.select("id", "lat", "lon", F.col("area").alias("area_total"), "floor", F.col("year_build").alias("building_year"),
                     F.col("deal_price").alias("price"), "deal_date", "street")


# Deals of like area: steps of the logarithm, of which a subject's span meets one or two.
DEAL_LANE = 0.42


def deal_candidates(subjects: DataFrame, points: DataFrame, rules: CompRules = CompRules()) -> DataFrame:
    """The 3k nearest deals of similar area."""
    a, ca, share = F.col("area_total"), F.col("c_area_total"), rules.deal_area_share
    fits = ca.between(a * (1 - share), a * (1 + share))
    subjects = subjects.where(_known(F.col("lat")) & _known(F.col("lon")))
    def lane(area: Column) -> Column:
        return F.floor(F.log(area) / DEAL_LANE).cast("int")
    lanes = F.when(a > 0, F.sequence(lane(a * (1 - share) * (1 - HAIR)), lane(a * (1 + share) * (1 + HAIR)))).otherwise(F.array().cast("array<int>"))
    return nearest(subjects, points, 3 * rules.k, fits, lambda cls, lo, hi: (lo >= a * (1 - share)) & (hi <= a * (1 + share)),
                   ["area_total"], rules.box, lane=lane(F.col("area_total")), lanes=lanes)


def deal_class_filter(candidates: DataFrame, rules: CompRules = CompRules()) -> DataFrame:
    """Keep deals of the same era; if fewer than three would stay of three or more, keep all."""
    ty, cy = F.col("building_year"), F.col("c_building_year")
    bad = F.when(ty >= 2000, cy < 1990).when(ty < 1990, cy >= 2010).otherwise(F.lit(False))
    no_target = ~_known(F.col("total_floors")) & ~_known(ty)
    ok = (F.col("distance_km") <= rules.max_km) & ~(_known(ty) & _known(cy) & bad)
    per = Window.partitionBy(*per_subject(candidates))
    c = candidates.withColumn("_ok", ok).withColumns({
        "_n": F.count(F.lit(1)).over(per), "_pass": F.count_if(F.col("_ok")).over(per)})
    all_of_them = no_target | ((F.col("_pass") < 3) & (F.col("_n") >= 3)) | (F.col("_pass") == 0)
    return c.where(F.col("_ok") | all_of_them).drop("_ok", "_n", "_pass")


def deal_similarity() -> Column:
    """0-100: area 30, year 25, floor 15, distance 30."""
    d = F.col("distance_km")
    area = F.when((F.col("area_total") > 0) & (F.col("c_area_total") > 0), 30 * _area_ratio()).otherwise(15.0)
    dy = F.abs(F.col("building_year") - F.col("c_building_year"))
    year = F.when(_known(F.col("building_year")) & _known(F.col("c_building_year")),
                  F.when(dy <= 5, 25).when(dy <= 10, 20).when(dy <= 20, 10).otherwise(5)).otherwise(12)
    df = F.abs(F.col("floor") - F.col("c_floor"))
    floor = F.when(_known(F.col("floor")) & _known(F.col("c_floor")),
                   F.when(df == 0, 15).when(df <= 2, 12).when(df <= 5, 8).otherwise(5)).otherwise(7)
    near = (F.when(d <= 0.5, 30.0).when(d <= 1, 25.0).when(d <= 2, 20.0).when(d <= 3, 15.0).when(d <= 5, 10.0)
            .otherwise(F.greatest(F.lit(0.0), 10 - (d - 5) * 2)))
    return area + year + floor + near


def deal_comparables(subjects: DataFrame, points: DataFrame, rules: CompRules = CompRules()) -> DataFrame:
    """Weighted comparable deals per subject."""
    kept = deal_class_filter(deal_candidates(subjects, points, rules), rules).where(F.col("distance_km") <= rules.max_km)
    scored = (kept.withColumn("similarity_score", deal_similarity())
              .withColumn("price_per_sqm", corrected_ppsm(F.col("c_price") / F.col("c_area_total"), rules)).withColumn("refilled", F.lit(False)))
    return top_k_weights(scored, rules.k)


def deal_estimate(comps: DataFrame) -> DataFrame:
    return estimate(comps).drop("avg_price", "median_price")


# --- combining ----------------------------------------------------------------------

@dataclass(frozen=True)
class CombineRules:
    asking_factor: float = 0.93
    deal_weight: float = 1.5
    spread: float = 0.05


def combined_estimate(subjects: DataFrame, asks: DataFrame, deals: DataFrame, rules: CombineRules = CombineRules()) -> DataFrame:
    """Asking-price and deal medians in one market price; deals weigh more per comparable."""
    a = asks.select("subject_id", (F.col("median_price_per_sqm") * rules.asking_factor).alias("ask_psm"), F.col("comparables_count").alias("ask_count"))
    d = deals.select("subject_id", F.col("median_price_per_sqm").alias("deal_psm"), F.col("comparables_count").alias("deal_count"))
    j = a.join(d, "subject_id", "full_outer").join(subjects.select("subject_id", "area_total"), "subject_id")
    j = j.withColumns({"ask_count": F.coalesce("ask_count", F.lit(0)), "deal_count": F.coalesce("deal_count", F.lit(0))})
    wd = F.col("deal_count") * rules.deal_weight
    psm = (F.when(F.col("deal_psm").isNull(), F.col("ask_psm")).when(F.col("ask_psm").isNull(), F.col("deal_psm"))
           .otherwise((F.col("deal_psm") * wd + F.col("ask_psm") * F.col("ask_count")) / (wd + F.col("ask_count"))))
    method = (F.when(F.col("deal_psm").isNull(), "asks_only").when(F.col("ask_psm").isNull(), "deals_only").otherwise("combined_weighted"))
    n = F.col("ask_count") + F.col("deal_count")
    base = F.when(n >= 10, 80).when(n >= 5, 65).when(n >= 3, 50).otherwise(30)
    both = (F.col("ask_count") >= 3) & (F.col("deal_count") >= 3)
    out = j.withColumn("market_price_per_sqm", psm).withColumn("market_price", F.col("market_price_per_sqm") * F.col("area_total"))
    return out.select("subject_id", "market_price", "market_price_per_sqm", "ask_psm", "ask_count", "deal_psm", "deal_count",
                      (F.col("market_price") * (1 - rules.spread)).alias("price_range_low"),
                      (F.col("market_price") * (1 + rules.spread)).alias("price_range_high"),
                      F.when(both, F.least(F.lit(90), base + 10)).otherwise(base).alias("confidence"), method.alias("method_used"))


# --- buyer-side estimate ------------------------------------------------------------

@dataclass(frozen=True)
class HybridRules:
    iqr_factor: float = 1.5
    bottom: int = 3
    bargain: float = 0.93


def iqr_mark(comps: DataFrame, rules: HybridRules = HybridRules()) -> DataFrame:
    """Comparables beside ``kept``: False for price-per-m2 outliers by index quartiles.  Outliers are
    only marked if four or more comparables are given and three would survive."""
    per = Window.partitionBy(*per_subject(comps))
    c = comps.withColumns({"_n": F.count(F.lit(1)).over(per), "_s": F.array_sort(F.collect_list("price_per_sqm").over(per))})
    q1 = F.element_at("_s", F.expr("CAST(_n div 4 + 1 AS INT)"))
    q3 = F.element_at("_s", F.expr("CAST(3 * _n div 4 + 1 AS INT)"))
    reach = rules.iqr_factor * (q3 - q1)
    c = c.withColumn("_in", F.col("price_per_sqm").between(q1 - reach, q3 + reach))
    c = c.withColumn("_left", F.count_if(F.col("_in")).over(per))
    return c.withColumn("kept", (F.col("_n") < 4) | (F.col("_left") < 3) | F.col("_in")).drop("_n", "_s", "_in", "_left")


def iqr_filter(comps: DataFrame, rules: HybridRules = HybridRules()) -> DataFrame:
    return iqr_mark(comps, rules).where("kept").drop("kept")


def _range_share(conf: Column) -> Column:
    return F.when(conf >= 70, 0.05).when(conf >= 50, 0.10).otherwise(0.15)


def _low(comps: DataFrame, rules: HybridRules) -> DataFrame:
    """Comparables beside ``low_psm``: the price per m2 of the lowest kept ones, else NULL."""
    w = Window.partitionBy(*per_subject(comps), "kept").orderBy("price_per_sqm", "c_id")
    r = iqr_mark(comps, rules).withColumn("_r", F.row_number().over(w))
    return r.withColumn("low_psm", F.when(F.col("kept") & (F.col("_r") <= rules.bottom), F.col("price_per_sqm"))).drop("_r")


def _bottom(df: DataFrame, rules: HybridRules) -> DataFrame:
    """Estimate columns from ``low_avg``, ``low_count``, ``comparables_count`` and ``area_total``."""
    n = F.col("comparables_count")
    out = (df.withColumn("estimated_price_per_sqm", F.col("low_avg") * rules.bargain)
           .withColumn("estimated_price", F.col("estimated_price_per_sqm") * F.col("area_total"))
           .withColumn("confidence", F.when(n >= 5, 75).when(n >= 3, 65).when(n >= 1, 50)))
    share = _range_share(F.col("confidence"))
    return out.withColumns({"price_range_low": F.col("estimated_price") * (1 - share), "price_range_high": F.col("estimated_price") * (1 + share),
                            "method_used": F.concat(F.lit("bottom_"), F.col("low_count").cast("string"), F.lit("_with_bargain"))})


BOTTOM = ["estimated_price", "estimated_price_per_sqm", "price_range_low", "price_range_high", "confidence", "comparables_count", "method_used"]


def bottom_estimate(subjects: DataFrame, comps: DataFrame, rules: HybridRules = HybridRules()) -> DataFrame:
    """Mean of the lowest prices per m2 after the outlier filter, less the bargain."""
    low = _low(comps, rules).groupBy(*per_subject(comps)).agg(
        F.avg("low_psm").alias("low_avg"), F.count("low_psm").alias("low_count"), F.count(F.lit(1)).alias("comparables_count"))
    return _bottom(low.join(subjects.select("subject_id", "area_total"), "subject_id"), rules).select("subject_id", *BOTTOM)


def hybrid_estimate(subjects: DataFrame, comps: DataFrame, grid: DataFrame, rules: HybridRules = HybridRules()) -> DataFrame:
    """Bottom estimate where comparables exist, else the grid; the weights only describe the mix.

    ``grid``: subject_id, median_price_per_sqm, confidence (one row per subject at most).
    Subjects that neither method can value are absent.
    """
    # one pass over the comparables serves both the confidence and the estimate
    marked = _low(comps, rules)
    stats = estimate(marked, F.avg("low_psm").alias("low_avg"), F.count("low_psm").alias("low_count"))
    k = stats.select("subject_id", "low_avg", "low_count", "comparables_count", F.col("comparables_count").alias("_kn"), F.col("confidence").alias("_kc"),
                     "median_price_per_sqm", F.col("avg_similarity"))
    g = grid.select("subject_id", F.col("median_price_per_sqm").alias("_gp"), F.col("confidence").alias("_gc"))
    j = subjects.select("subject_id", "area_total").join(g, "subject_id", "left").join(k, "subject_id", "left")
    j = _bottom(j, rules)
    j = j.where(F.col("estimated_price").isNotNull() | F.col("_gp").isNotNull())
    has_k, has_g = F.col("_kn").isNotNull(), F.col("_gp").isNotNull()
    gw = (F.when(~has_g, 0.0).when(~has_k, 1.0).when((F.col("_kc") >= 70) & (F.col("_kn") >= 5), 0.2)
          .when((F.col("_kc") < 40) & (F.col("_gc") >= 60), 0.7).otherwise(0.5))
    mix = (F.when(~has_g, "knn_only").when(~has_k, "grid_only").when((F.col("_kc") >= 70) & (F.col("_kn") >= 5), "hybrid_knn_heavy")
           .when((F.col("_kc") < 40) & (F.col("_gc") >= 60), "hybrid_grid_heavy").otherwise("hybrid_balanced"))
    gprice = F.col("_gp") * F.col("area_total")
    share = _range_share(F.col("_gc"))
    return j.select(
        "subject_id", F.coalesce("estimated_price", gprice).alias("estimated_price"),
        F.coalesce("estimated_price_per_sqm", "_gp").alias("estimated_price_per_sqm"),
        F.coalesce("price_range_low", gprice * (1 - share)).alias("price_range_low"),
        F.coalesce("price_range_high", gprice * (1 + share)).alias("price_range_high"),
        F.coalesce("confidence", "_gc").alias("confidence"), F.coalesce("method_used", F.lit("grid_only")).alias("method_used"),
        F.coalesce("comparables_count", F.lit(0)).alias("comparables_count"), gw.alias("grid_weight"), (1 - gw).alias("knn_weight"), mix.alias("mix"),
        F.col("median_price_per_sqm").alias("comparables_median_psm"))
