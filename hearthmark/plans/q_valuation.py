"""Comparables, deals, grid and hybrid valuation of every listing."""

from pyspark.sql import functions as F

from hearthmark.operators import comparables as cmp
from hearthmark.operators import grid, market, segments
from hearthmark.plans.q_market import r, segmented
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF

T = f"TIMESTAMP '{AS_OF}'"


def subjects(t):
    """Every listing as a property to value, itself excluded from its comparables."""
    return t.listings.select(
        F.col("id").alias("subject_id"), "lat", "lon", "district_id", "area_total", "rooms", "floor", "total_floors", "building_type",
        segments.height_class(F.col("total_floors")).alias("building_height"), F.col("house_year").alias("building_year"), F.col("id").alias("exclude_id"))


def hav(a, b):
    return (f"round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) "
            f"* pow(sin(radians({b}.lon - {a}.lon) / 2), 2), 1.0))), 6)")


snippet("points", f"""
    SELECT l.*, coalesce(p.price, l.initial_price) AS price, coalesce(p.seen_at, l.last_seen) AS seen_at
    FROM listings l LEFT JOIN (SELECT id, arg_max(price, seen_at) AS price, max(seen_at) AS seen_at FROM listing_prices
                               WHERE seen_at >= {T} - INTERVAL 90 DAY GROUP BY id) p ON p.id = l.id
    WHERE l.is_active AND l.area_total > 0 AND l.last_seen >= {T} - INTERVAL 90 DAY AND coalesce(p.price, l.initial_price) > 0""")
snippet("candidates", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY distance_km, c_id) AS rank FROM (
        SELECT s.id AS subject_id, s.area_total, s.rooms, s.floor, s.total_floors, s.building_type, s.house_year AS building_year,
               c.id AS c_id, c.price AS c_price, c.area_total AS c_area_total, c.rooms AS c_rooms, c.floor AS c_floor, c.total_floors AS c_total_floors,
               c.building_type AS c_building_type, c.house_year AS c_building_year, c.seen_at AS c_seen_at, {hav('s', 'c')} AS distance_km
        FROM listings s JOIN points c ON abs(c.lat - s.lat) <= 0.05 AND abs(c.lon - s.lon) <= 0.07 AND c.id <> s.id
         AND (s.rooms IS NULL OR c.rooms = s.rooms OR (c.rooms = s.rooms + 1 AND c.area_total <= s.area_total + 10)
              OR (c.rooms = s.rooms - 1 AND c.area_total >= s.area_total - 10)))) WHERE rank <= 30""")
snippet("class_kept", """
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n, count(*) FILTER (WHERE ok) OVER (PARTITION BY subject_id) AS n_ok,
                          row_number() OVER (PARTITION BY subject_id, ok ORDER BY rank) AS rej FROM (
        SELECT *, NOT (CASE WHEN total_floors >= 9 THEN c_total_floors <= 5 WHEN total_floors <= 5 THEN c_total_floors >= 9
                            ELSE c_total_floors <= 5 OR c_total_floors >= 17 END
                       OR CASE WHEN building_year >= 2000 THEN c_building_year < 1990 WHEN building_year < 1990 THEN c_building_year >= 2000 ELSE false END) AS ok
        FROM candidates))
    WHERE ok OR (n_ok < 3 AND n >= 3 AND rej <= 5 - n_ok) OR (n_ok = 0 AND n < 3)""")
snippet("scored_comps", f"""
    SELECT *, CASE WHEN building_type IS NULL OR c_building_type IS NULL THEN 10 WHEN building_type = c_building_type THEN 20 ELSE 5 END
        + CASE WHEN coalesce(rooms, 0) <> 0 AND coalesce(c_rooms, 0) <> 0 THEN greatest(0, 20 - abs(rooms - c_rooms) * 10) ELSE 10 END
        + CASE WHEN area_total > 0 THEN 25 * least(area_total, c_area_total) / greatest(area_total, c_area_total) ELSE 10 END
        + CASE WHEN coalesce(floor, 0) <> 0 AND coalesce(c_floor, 0) <> 0 THEN greatest(0, 15 - abs(floor - c_floor) * 2) ELSE 7 END
        + CASE WHEN distance_km <= 1 THEN 20 WHEN distance_km <= 3 THEN 15 WHEN distance_km <= 5 THEN 10 ELSE greatest(0, 10 - (distance_km - 5) * 2) END AS similarity_score,
        c_price / c_area_total * CASE WHEN abs(area_total - c_area_total) > 0.5 THEN 1 - 0.001 * (area_total - c_area_total) ELSE 1 END
          * (1 - least(0.03, datediff('day', c_seen_at, {T}) / 30.0 * 0.01)) AS price_per_sqm
    FROM class_kept WHERE distance_km <= 10""")
snippet("comps", """
    SELECT *, similarity_score / sum(similarity_score) OVER (PARTITION BY subject_id) AS weight FROM (
        SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY subject_id ORDER BY round(similarity_score, 9) DESC, NOT ok, distance_km, c_id) AS rank FROM scored_comps)
    WHERE rank <= 10""")
snippet("knn", """
    SELECT *, CAST(least(100, floor(round(n / 10.0 * 20 + avg_sim / 100 * 50 + 30 / (1 + avg_dist), 9))) AS INT) AS confidence FROM (
        SELECT subject_id, sum(c_price * weight) AS avg_price, quantile_cont(c_price, 0.5) AS median_price, sum(price_per_sqm * weight) AS avg_psm,
               quantile_cont(price_per_sqm, 0.5) AS median_psm, count(*) AS n, avg(similarity_score) AS avg_sim, avg(distance_km) AS avg_dist, sum(weight) AS w
        FROM comps GROUP BY subject_id)""")


def points(t):
    return cmp.listing_points(t.listings, t.listing_prices, AS_OF)


def comps(t):
    return cmp.comparables(subjects(t), points(t), AS_OF)


@query("comparable_candidates", "SELECT subject_id, c_id, distance_km, rank FROM candidates")
def _(t):
    return cmp.find_candidates(subjects(t), points(t)).select("subject_id", "c_id", "distance_km", "rank")


@query("comparable_class_filter", "SELECT subject_id, c_id, NOT ok AS refilled FROM class_kept")
def _(t):
    return cmp.class_filter(cmp.find_candidates(subjects(t), points(t))).select("subject_id", "c_id", "refilled")


@query("comparable_scores", """
    SELECT subject_id, c_id, rank, round(similarity_score, 4) AS similarity_score, round(price_per_sqm, 4) AS price_per_sqm, round(weight, 6) AS weight FROM comps""")
def _(t):
    return r(r(comps(t).select("subject_id", "c_id", "rank", "similarity_score", "price_per_sqm", "weight"), 6, "weight"), 4, "similarity_score", "price_per_sqm")


@query("comparable_estimate", """
    SELECT subject_id, round(avg_price, 3) AS avg_price, round(median_price, 3) AS median_price, round(avg_psm, 3) AS avg_price_per_sqm,
           round(median_psm, 3) AS median_price_per_sqm, n AS comparables_count, round(avg_sim, 3) AS avg_similarity, round(avg_dist, 3) AS avg_distance_km,
           round(w, 3) AS total_weight, confidence FROM knn""")
def _(t):
    return r(cmp.estimate(comps(t)), 3)


snippet("deal_cands", f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY distance_km, c_id) AS rank FROM (
        SELECT s.id AS subject_id, s.area_total, s.floor, s.total_floors, s.house_year AS building_year, c.id AS c_id, c.area AS c_area_total,
               c.deal_price AS c_price, c.floor AS c_floor, c.year_build AS c_building_year, {hav('s', 'c')} AS distance_km
        FROM listings s JOIN (SELECT * FROM deals WHERE area > 0 AND deal_price > 0 AND deal_date >= {T} - INTERVAL 365 DAY) c
          ON abs(c.lat - s.lat) <= 0.05 AND abs(c.lon - s.lon) <= 0.07 AND c.area BETWEEN s.area_total * 0.8 AND s.area_total * 1.2)) WHERE rank <= 30""")
snippet("deal_comps", """
    SELECT *, similarity_score / sum(similarity_score) OVER (PARTITION BY subject_id) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(similarity_score, 9) DESC, distance_km, c_id) AS rank2 FROM (
            SELECT *, CASE WHEN area_total > 0 THEN 30 * least(area_total, c_area_total) / greatest(area_total, c_area_total) ELSE 15 END
                + CASE WHEN abs(building_year - c_building_year) <= 5 THEN 25 WHEN abs(building_year - c_building_year) <= 10 THEN 20 WHEN abs(building_year - c_building_year) <= 20 THEN 10 ELSE 5 END
                + CASE WHEN floor = c_floor THEN 15 WHEN abs(floor - c_floor) <= 2 THEN 12 WHEN abs(floor - c_floor) <= 5 THEN 8 ELSE 5 END
                + CASE WHEN distance_km <= 0.5 THEN 30 WHEN distance_km <= 1 THEN 25 WHEN distance_km <= 2 THEN 20 WHEN distance_km <= 3 THEN 15 WHEN distance_km <= 5 THEN 10
                       ELSE greatest(0, 10 - (distance_km - 5) * 2) END AS similarity_score,
                c_price / c_area_total * CASE WHEN abs(area_total - c_area_total) > 0.5 THEN 1 - 0.001 * (area_total - c_area_total) ELSE 1 END AS price_per_sqm
            FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n, count(*) FILTER (WHERE ok) OVER (PARTITION BY subject_id) AS n_ok FROM (
                    SELECT *, distance_km <= 10 AND NOT CASE WHEN building_year >= 2000 THEN c_building_year < 1990 WHEN building_year < 1990 THEN c_building_year >= 2010 ELSE false END AS ok
                    FROM deal_cands))
            WHERE (ok OR (n_ok < 3 AND n >= 3) OR n_ok = 0) AND distance_km <= 10)) WHERE rank2 <= 10""")
snippet("deal_knn", """
    SELECT *, CAST(least(100, floor(round(n / 10.0 * 20 + avg_sim / 100 * 50 + 30 / (1 + avg_dist), 9))) AS INT) AS confidence FROM (
        SELECT subject_id, sum(price_per_sqm * weight) AS avg_psm, quantile_cont(price_per_sqm, 0.5) AS median_psm, count(*) AS n,
               avg(similarity_score) AS avg_sim, avg(distance_km) AS avg_dist FROM deal_comps GROUP BY subject_id)""")


def deal_comps(t):
    return cmp.deal_comparables(subjects(t), cmp.deal_points(t.deals, AS_OF))


@query("deal_candidates", "SELECT subject_id, c_id, distance_km, rank FROM deal_cands")
def _(t):
    return cmp.deal_candidates(subjects(t), cmp.deal_points(t.deals, AS_OF)).select("subject_id", "c_id", "distance_km", "rank")


@query("deal_scores", "SELECT subject_id, c_id, round(similarity_score, 4) AS similarity_score, round(price_per_sqm, 4) AS price_per_sqm FROM deal_comps")
def _(t):
    return r(deal_comps(t).select("subject_id", "c_id", "similarity_score", "price_per_sqm"))


@query("deal_estimate", """
    SELECT subject_id, round(avg_psm, 3) AS avg_price_per_sqm, round(median_psm, 3) AS median_price_per_sqm, n AS comparables_count, confidence FROM deal_knn""")
def _(t):
    return r(cmp.deal_estimate(deal_comps(t)).select("subject_id", "avg_price_per_sqm", "median_price_per_sqm", "comparables_count", "confidence"), 3)


@query("combined_estimate", """
    SELECT subject_id, round(psm, 3) AS market_price_per_sqm, round(psm * area_total, 2) AS market_price, na AS ask_count, nd AS deal_count,
           CASE WHEN na >= 3 AND nd >= 3 THEN least(90, 10 + base) ELSE base END AS confidence, method_used FROM (
        SELECT *, CASE WHEN d IS NULL THEN a WHEN a IS NULL THEN d ELSE (d * nd * 1.5 + a * na) / (nd * 1.5 + na) END AS psm,
               CASE WHEN d IS NULL THEN 'asks_only' WHEN a IS NULL THEN 'deals_only' ELSE 'combined_weighted' END AS method_used,
               CASE WHEN na + nd >= 10 THEN 80 WHEN na + nd >= 5 THEN 65 WHEN na + nd >= 3 THEN 50 ELSE 30 END AS base FROM (
            SELECT l.id AS subject_id, l.area_total, k.median_psm * 0.93 AS a, coalesce(k.n, 0) AS na, d.median_psm AS d, coalesce(d.n, 0) AS nd
            FROM listings l LEFT JOIN knn k ON k.subject_id = l.id LEFT JOIN deal_knn d ON d.subject_id = l.id WHERE k.n IS NOT NULL OR d.n IS NOT NULL))""")
def _(t):
    out = cmp.combined_estimate(subjects(t), cmp.estimate(comps(t)), cmp.deal_estimate(deal_comps(t)))
    out = out.select("subject_id", "market_price_per_sqm", "market_price", "ask_count", "deal_count", "confidence", "method_used")
    return r(r(out, 3, "market_price_per_sqm"), 2, "market_price")


snippet("iqr_kept", """
    SELECT * FROM (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY subject_id) AS n_in FROM (
        SELECT *, price_per_sqm BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM (
            SELECT c.*, s.n AS n_comps, s.v[s.n // 4 + 1] AS q1, s.v[3 * s.n // 4 + 1] AS q3 FROM comps c
            JOIN (SELECT subject_id, count(*) AS n, list_sort(list(price_per_sqm)) AS v FROM comps GROUP BY subject_id) s ON s.subject_id = c.subject_id)))
    WHERE n_comps < 4 OR n_in < 3 OR inside""")
snippet("bottom3", """
    SELECT subject_id, avg(price_per_sqm) * 0.93 AS psm, count(*) AS used, any_value(n_comps) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY price_per_sqm, c_id) AS rr FROM iqr_kept) WHERE rr <= 3 GROUP BY subject_id""")


@query("iqr_filter", "SELECT subject_id, c_id, round(price_per_sqm, 4) AS price_per_sqm FROM iqr_kept")
def _(t):
    return r(cmp.iqr_filter(comps(t)).select("subject_id", "c_id", "price_per_sqm"))


@query("bottom_estimate", """
    SELECT subject_id, round(psm, 3) AS estimated_price_per_sqm, round(psm * l.area_total, 2) AS estimated_price, n AS comparables_count,
           CASE WHEN n >= 5 THEN 75 WHEN n >= 3 THEN 65 ELSE 50 END AS confidence, concat('bottom_', CAST(used AS VARCHAR), '_with_bargain') AS method_used
    FROM bottom3 JOIN listings l ON l.id = subject_id""")
def _(t):
    out = cmp.bottom_estimate(subjects(t), comps(t)).select("subject_id", "estimated_price_per_sqm", "estimated_price", "comparables_count", "confidence", "method_used")
    return r(r(out, 3, "estimated_price_per_sqm"), 2, "estimated_price")


# --- grid ------------------------------------------------------------------------

# Aggregates of three days: the day itself, a week before (part of the cells), and one too old.
snippet("grid_days", """
    SELECT * FROM multidim
    UNION ALL SELECT * REPLACE (date - 7 AS date, avg_price_per_sqm * 1.1 AS avg_price_per_sqm, median_price_per_sqm * 1.2 AS median_price_per_sqm) FROM multidim WHERE (district_id + segment_id) % 2 = 0
    UNION ALL SELECT * REPLACE (date - 40 AS date, avg_price_per_sqm * 2 AS avg_price_per_sqm) FROM multidim""")
snippet("grid_seg", """
    SELECT m.*, g.building_type AS t, g.building_height AS h, g.rooms_count AS r FROM grid_days m JOIN property_segments g ON g.segment_id = m.segment_id""")
snippet("grid_recent", f"SELECT * FROM grid_seg WHERE date >= DATE '{AS_OF[:10]}' - 30")


def grid_days(t):
    day = market.multidim_aggregates(segmented(t), t.listing_prices, AS_OF)
    a, m, d = F.col("avg_price_per_sqm"), F.col("median_price_per_sqm"), F.col("date")
    day_of = lambda back, x, y: F.struct(F.date_sub(d, back).alias("date"), (a * x).alias("avg_price_per_sqm"), (m * y).alias("median_price_per_sqm"))
    even = (F.col("district_id") + F.col("segment_id")) % 2 == 0
    days = F.array_compact(F.array(day_of(0, 1.0, 1.0), F.when(even, day_of(7, 1.1, 1.2)), day_of(40, 2.0, 1.0)))
    return day.withColumn("_d", F.explode(days)).select(
        *[F.col(f"_d.{c}").alias(c) if c in ("date", "avg_price_per_sqm", "median_price_per_sqm") else F.col(c) for c in day.columns])


def relaxed_sql(keys, base, step):
    k = "".join(f", {x}" for x in keys)
    return f"""SELECT district_id{k}, avg(avg_price_per_sqm) AS a, avg(median_price_per_sqm) AS m, CAST(sum(total_listings) AS BIGINT) AS n,
        least(100, {base} + (CAST(sum(total_listings) AS BIGINT) // {step}) * 10) AS c FROM grid_recent GROUP BY district_id{k} HAVING sum(total_listings) >= 3"""


snippet("grid_l1", """SELECT district_id, t, h, r, arg_max(avg_price_per_sqm, date) AS a, arg_max(median_price_per_sqm, date) AS m, arg_max(total_listings, date) AS n,
    arg_max(confidence_score, date) AS c FROM grid_recent WHERE total_listings >= 3 GROUP BY district_id, t, h, r""")
snippet("grid_l2", relaxed_sql(["t", "r"], 30, 5))
snippet("grid_l3", relaxed_sql(["h", "r"], 20, 10))
snippet("grid_l4", relaxed_sql([], 10, 20))
snippet("grid_l5", f"""SELECT avg(price_per_sqm) AS a, quantile_cont(price_per_sqm, 0.5) AS m, count(*) AS n, CAST(10 AS BIGINT) AS c FROM all_priced
    WHERE area_total > 0 AND current_price > 0 AND last_seen >= {T} - INTERVAL 90 DAY""")
snippet("grid_subject", """
    SELECT id AS subject_id, area_total, CASE WHEN district_id <> 0 THEN district_id END AS d, coalesce(building_type, 'other') AS t,
           CASE WHEN total_floors <= 5 THEN 'low' WHEN total_floors <= 10 THEN 'medium' ELSE 'high' END AS h, least(coalesce(rooms, 2), 5) AS r FROM listings""")
snippet("grid_pick", """
    SELECT s.*, coalesce(l1.a, l2.a, l3.a, l4.a, l5.a) AS a, coalesce(l1.m, l2.m, l3.m, l4.m, l5.m) AS m, coalesce(l1.n, l2.n, l3.n, l4.n, l5.n) AS n,
           coalesce(l1.c, l2.c, l3.c, l4.c, l5.c) AS c,
           CASE WHEN l1.n IS NOT NULL THEN 'exact' WHEN l2.n IS NOT NULL THEN 'relaxed_height' WHEN l3.n IS NOT NULL THEN 'relaxed_type'
                WHEN l4.n IS NOT NULL THEN 'district' ELSE 'global' END AS fallback_level
    FROM grid_subject s LEFT JOIN grid_l1 l1 ON l1.district_id = s.d AND l1.t = s.t AND l1.h = s.h AND l1.r = s.r
    LEFT JOIN grid_l2 l2 ON l2.district_id = s.d AND l2.t = s.t AND l2.r = s.r LEFT JOIN grid_l3 l3 ON l3.district_id = s.d AND l3.h = s.h AND l3.r = s.r
    LEFT JOIN grid_l4 l4 ON l4.district_id = s.d CROSS JOIN grid_l5 l5""")

PM = "round(a, 3) AS avg_price_per_sqm, round(m, 3) AS median_price_per_sqm, n AS sample_size, c AS confidence"


def grid_est(t):
    return grid.grid_estimate(subjects(t), grid_days(t), segments.build_segments(t.listings), t.listings, t.listing_prices, AS_OF)


@query("grid_exact", f"SELECT district_id AS _district, t AS _type, h AS _height, r AS _rooms, {PM} FROM grid_l1")
def _(t):
    return r(grid.grid_exact(grid_days(t), segments.build_segments(t.listings), AS_OF).drop("segment_id"), 3)


@query("grid_relaxed_height", f"SELECT district_id AS _district, t AS _type, r AS _rooms, {PM} FROM grid_l2")
def _(t):
    return r(grid.grid_relaxed_height(grid_days(t), segments.build_segments(t.listings), AS_OF).drop("segment_id"), 3)


@query("grid_relaxed_type", f"SELECT district_id AS _district, h AS _height, r AS _rooms, {PM} FROM grid_l3")
def _(t):
    return r(grid.grid_relaxed_type(grid_days(t), segments.build_segments(t.listings), AS_OF).drop("segment_id"), 3)


@query("grid_district", f"SELECT district_id AS _district, {PM} FROM grid_l4")
def _(t):
    return r(grid.grid_district(grid_days(t), segments.build_segments(t.listings), AS_OF).drop("segment_id"), 3)


@query("grid_global", f"SELECT {PM} FROM grid_l5")
def _(t):
    return r(grid.grid_global(t.listings, t.listing_prices, AS_OF).drop("segment_id"), 3)


@query("grid_estimate", f"SELECT subject_id, {PM}, fallback_level FROM grid_pick")
def _(t):
    return r(grid_est(t).drop("segment_id"), 3)


def gate_sql(keys, gate):
    k = "".join(f", {x}" for x in keys)
    having = f"HAVING round(avg(confidence_score)) >= {gate}" if gate else ""
    return f"""SELECT district_id{k}, avg(median_price_per_sqm) AS m, CAST(sum(total_listings) AS BIGINT) AS n, CAST(round(avg(confidence_score)) AS BIGINT) AS c,
        avg(price_stddev) AS sd FROM grid_seg WHERE date = DATE '{AS_OF[:10]}' GROUP BY district_id{k} {having}"""


snippet("gate1", gate_sql(["t", "h", "r"], 30))
snippet("gate2", gate_sql(["t", "r"], 30))
snippet("gate3", gate_sql(["h", "r"], 30))
snippet("gate4", gate_sql(["r"], None))
snippet("gate5", f"SELECT r, avg(median_price_per_sqm) AS m FROM grid_seg WHERE date = DATE '{AS_OF[:10]}' GROUP BY r")


@query("grid_estimate_gated", """
    SELECT subject_id, round(m * area_total, 2) AS estimated_price, round(m, 3) AS price_per_sqm, c AS confidence, strategy, n AS sample_size,
           CASE WHEN strategy <> 'global_average' THEN round((m - coalesce(nullif(sd, 0), m * 0.15)) * area_total, 2) END AS range_min,
           CASE WHEN strategy <> 'global_average' THEN round((m + coalesce(nullif(sd, 0), m * 0.15)) * area_total, 2) END AS range_max FROM (
        SELECT s.subject_id, s.area_total, coalesce(g1.m, g2.m, g3.m, g4.m, g5.m, 200000) AS m, coalesce(g1.n, g2.n, g3.n, g4.n, 0) AS n, coalesce(g1.c, g2.c, g3.c, g4.c, 10) AS c,
               CASE WHEN g1.n IS NOT NULL THEN g1.sd WHEN g2.n IS NOT NULL THEN g2.sd WHEN g3.n IS NOT NULL THEN g3.sd ELSE g4.sd END AS sd,
               CASE WHEN g1.n IS NOT NULL THEN 'exact' WHEN g2.n IS NOT NULL THEN 'relaxed_height' WHEN g3.n IS NOT NULL THEN 'relaxed_type' WHEN g4.n IS NOT NULL THEN 'district_only'
                    ELSE 'global_average' END AS strategy
        FROM grid_subject s LEFT JOIN gate1 g1 ON g1.district_id = s.d AND g1.t = s.t AND g1.h = s.h AND g1.r = s.r
        LEFT JOIN gate2 g2 ON g2.district_id = s.d AND g2.t = s.t AND g2.r = s.r LEFT JOIN gate3 g3 ON g3.district_id = s.d AND g3.h = s.h AND g3.r = s.r
        LEFT JOIN gate4 g4 ON g4.district_id = s.d AND g4.r = s.r LEFT JOIN gate5 g5 ON g5.r = s.r WHERE s.d IS NOT NULL)""")
def _(t):
    out = grid.grid_estimate_gated(subjects(t), grid_days(t), segments.build_segments(t.listings), t.districts, AS_OF, grid.GateRules(exact=30, relaxed=30))
    return r(r(out, 3, "price_per_sqm"), 2, "estimated_price", "range_min", "range_max")


@query("hybrid_estimate", """
    SELECT l.id AS subject_id, round(coalesce(b.psm, g.m), 3) AS estimated_price_per_sqm, round(coalesce(b.psm, g.m) * l.area_total, 2) AS estimated_price,
           CASE WHEN b.n >= 5 THEN 75 WHEN b.n >= 3 THEN 65 WHEN b.n IS NOT NULL THEN 50 ELSE g.c END AS confidence,
           CASE WHEN b.n IS NULL THEN 'grid_only' ELSE concat('bottom_', CAST(b.used AS VARCHAR), '_with_bargain') END AS method_used,
           coalesce(b.n, 0) AS comparables_count,
           CASE WHEN b.n IS NULL THEN 1.0 WHEN k.confidence >= 70 AND k.n >= 5 THEN 0.2 WHEN k.confidence < 40 AND g.c >= 60 THEN 0.7 ELSE 0.5 END AS grid_weight,
           CASE WHEN b.n IS NULL THEN 'grid_only' WHEN k.confidence >= 70 AND k.n >= 5 THEN 'hybrid_knn_heavy' WHEN k.confidence < 40 AND g.c >= 60 THEN 'hybrid_grid_heavy' ELSE 'hybrid_balanced' END AS mix
    FROM listings l JOIN grid_pick g ON g.subject_id = l.id LEFT JOIN bottom3 b ON b.subject_id = l.id LEFT JOIN knn k ON k.subject_id = l.id""")
def _(t):
    out = cmp.hybrid_estimate(subjects(t), comps(t), grid_est(t)).select(
        "subject_id", "estimated_price_per_sqm", "estimated_price", "confidence", "method_used", "comparables_count", "grid_weight", "mix")
    return r(r(out, 3, "estimated_price_per_sqm"), 2, "estimated_price")
