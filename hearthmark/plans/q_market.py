"""Latest prices, market aggregates and segments."""

from pyspark.sql import functions as F

from hearthmark.operators import latest, market, segments
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF


def r(df, digits=4, *cols):
    """Round double columns so that summation order does not show."""
    doubles = [n for n, t in df.dtypes if t == "double" and (not cols or n in cols)]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def ratings(t):
    """Condition ratings from document labels: 1 + 2 * quality + toxic."""
    score = 1 + 2 * F.col("quality") + F.col("toxic")
    return t.labels.select(
        F.col("doc_id").alias("listing_id"), score.alias("condition_score"),
        F.element_at(F.array(*[F.lit(x) for x in ("very poor", "poor", "fair", "good")]), score).alias("condition_label"),
        (0.5 + F.col("quality") * 0.25).alias("confidence"), F.lit("0.0100").cast("decimal(10,4)").alias("cost_usd"),
        F.timestamp_seconds(F.lit(946684800) + F.col("doc_id") * 3600).alias("analyzed_at"))


snippet("ratings", """
    SELECT doc_id AS listing_id, 1 + 2 * quality + toxic AS condition_score,
           ['very poor', 'poor', 'fair', 'good'][1 + 2 * quality + toxic] AS condition_label,
           0.5 + quality * 0.25 AS confidence, CAST('0.01' AS DECIMAL(10,4)) AS cost_usd,
           CAST(make_timestamp((946684800 + doc_id * 3600) * 1000000) AS TIMESTAMP) AS analyzed_at FROM labels""")
snippet("latest_price", "SELECT id, arg_max(price, seen_at) AS current_price, max(seen_at) AS price_seen_at FROM listing_prices GROUP BY id")
snippet("current_market", """
    SELECT l.*, p.current_price, p.price_seen_at, p.current_price / nullif(l.area_total, 0) AS price_per_sqm
    FROM listings l JOIN latest_price p ON p.id = l.id WHERE l.is_active""")
snippet("all_priced", """
    SELECT l.*, coalesce(p.current_price, l.initial_price) AS current_price,
           coalesce(p.current_price, l.initial_price) / nullif(l.area_total, 0) AS price_per_sqm
    FROM listings l LEFT JOIN latest_price p ON p.id = l.id""")
snippet("segmented", """
    SELECT *, CASE WHEN building_type IN ('panel','brick','monolithic','block','wood') THEN building_type
                   WHEN building_type IS NOT NULL THEN 'other' END AS seg_type,
           CASE WHEN total_floors <= 5 THEN 'low' WHEN total_floors <= 10 THEN 'medium' WHEN total_floors IS NOT NULL THEN 'high' END AS seg_height,
           CASE WHEN rooms IS NOT NULL THEN least(rooms, 5) END AS seg_rooms FROM all_priced""")
snippet("property_segments", """
    SELECT *, CAST(list_position(['panel', 'brick', 'monolithic', 'block', 'wood', 'other'], building_type) * 100 + list_position(['low', 'medium', 'high'], building_height) * 10 + rooms_count AS INT) AS segment_id FROM (
        SELECT DISTINCT seg_type AS building_type, seg_height AS building_height, seg_rooms AS rooms_count FROM segmented
        WHERE seg_type IS NOT NULL AND seg_height IS NOT NULL AND seg_rooms IS NOT NULL
        UNION
        SELECT t, h, r FROM (VALUES ('panel'),('brick'),('monolithic'),('block')) a(t),
                            (VALUES ('low'),('medium'),('high')) b(h), (VALUES (1),(2),(3),(4),(5)) c(r))""")
snippet("segment_of", """
    SELECT s.*, g.segment_id FROM segmented s LEFT JOIN property_segments g
      ON g.building_type = s.seg_type AND g.building_height = s.seg_height AND g.rooms_count = s.seg_rooms""")


def segmented(t):
    return segments.assign_segment(t.listings)


@query("latest_price_inner", """
    SELECT id, current_price, price_seen_at, round(price_per_sqm, 4) AS price_per_sqm FROM current_market""")
def _(t):
    return r(market.current_market(t.listings, t.listing_prices).select("id", "current_price", "price_seen_at", "price_per_sqm"), 4, "price_per_sqm")


@query("latest_price_left", "SELECT id, current_price FROM all_priced")
def _(t):
    return latest.with_latest_price(t.listings, t.listing_prices, "left").select("id", "current_price")


@query("latest_price_since", f"""
    SELECT id, arg_max(price, seen_at) AS price, max(seen_at) AS seen_at FROM listing_prices
    WHERE seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY GROUP BY id""")
def _(t):
    return latest.latest_prices(t.listing_prices, market.ts(AS_OF) - F.expr("INTERVAL 90 DAYS"))


@query("lots_per_platform", """
    SELECT p.platform_id, count(l.id) AS lots FROM (SELECT CAST(s_suppkey AS INT) AS platform_id FROM supplier) p
    LEFT JOIN auction_lots l ON l.platform_id = p.platform_id GROUP BY p.platform_id""")
def _(t):
    platforms = t.supplier.select(F.col("s_suppkey").cast("int").alias("platform_id"))
    return latest.with_counts(platforms, t.auction_lots, "platform_id", "lots")


@query("main_photo", """
    SELECT l.id, p.url AS main_photo_url FROM listings l LEFT JOIN (
        SELECT page_id // 3 AS id, arg_min(url, (page_id % 3, url)) AS url FROM pages WHERE page_id % 3 <> 1 GROUP BY page_id // 3) p ON p.id = l.id""")
def _(t):
    photos = t.pages.select(F.expr("page_id div 3").alias("listing_id"), F.col("url").alias("photo_url"),
                            (F.col("page_id") % 3).alias("photo_order"), (F.col("page_id") % 3 != 1).alias("is_main"))
    return latest.with_main_photo(t.listings.select("id"), photos)


@query("price_as_of", """
    SELECT s.id, s.at, arg_max(p.price, p.seen_at) AS price_at
    FROM (SELECT id, first_seen + INTERVAL 400 DAY AS at FROM listings) s
    LEFT JOIN listing_prices p ON p.id = s.id AND p.seen_at <= s.at GROUP BY s.id, s.at""")
def _(t):
    s = t.listings.select("id", (F.col("first_seen") + F.expr("INTERVAL 400 DAYS")).alias("at"))
    return latest.price_as_of(s, t.listing_prices)


@query("stats_by_rooms", """
    SELECT rooms, CASE WHEN rooms = 0 THEN 'studio' WHEN rooms IS NOT NULL THEN concat(CAST(rooms AS VARCHAR), '-room') END AS room_type,
           count(*) AS listings_count, round(avg(area_total), 4) AS avg_area,
           round(CAST(sum(CAST(current_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price,
           round(avg(price_per_sqm), 4) AS avg_price_per_sqm, min(current_price) AS min_price, max(current_price) AS max_price
    FROM current_market GROUP BY rooms""")
def _(t):
    return r(market.stats_by_rooms(t.listings, t.listing_prices))


@query("median_ppsm", """
    SELECT region, rooms, deal_type, count(p.price / nullif(area_total, 0)) AS points,
           round(quantile_cont(p.price / nullif(area_total, 0), 0.5), 4) AS median_price_per_sqm
    FROM listings l JOIN listing_prices p ON p.id = l.id GROUP BY region, rooms, deal_type""")
def _(t):
    return r(market.median_ppsm(t.listings, t.listing_prices))


@query("median_ppsm_latest", """
    SELECT region, rooms, deal_type, count(p.current_price / nullif(area_total, 0)) AS points,
           round(quantile_cont(p.current_price / nullif(area_total, 0), 0.5), 4) AS median_price_per_sqm
    FROM listings l JOIN latest_price p ON p.id = l.id GROUP BY region, rooms, deal_type""")
def _(t):
    return r(market.median_ppsm(t.listings, t.listing_prices, every_point=False))


snippet("district_day", f"""
    SELECT district_id, DATE '{AS_OF[:10]}' AS date, avg(price_per_sqm) AS avg_price_per_sqm,
           quantile_cont(price_per_sqm, 0.5) AS median_price_per_sqm,
           min(current_price) AS min_price, max(current_price) AS max_price, count(*) AS total_listings,
           avg(area_total) AS avg_area, avg(rooms) AS avg_rooms
    FROM current_market WHERE area_total > 0 AND current_price > 0 AND district_id IS NOT NULL GROUP BY district_id""")
DAY_COLS = """round(avg_price_per_sqm, 4) AS avg_price_per_sqm, round(median_price_per_sqm, 4) AS median_price_per_sqm,
           min_price, max_price, round(avg_area, 4) AS avg_area, round(avg_rooms, 4) AS avg_rooms"""


@query("district_aggregates", f"SELECT district_id, date, total_listings, {DAY_COLS} FROM district_day")
def _(t):
    return r(market.district_aggregates(t.listings, t.listing_prices, t.districts, AS_OF[:10]))


@query("district_stats_live", f"""
    SELECT d.district_id, name, full_name, coalesce(total_listings, 0) AS total_listings, {DAY_COLS}
    FROM districts d LEFT JOIN district_day a ON a.district_id = d.district_id""")
def _(t):
    return r(market.district_stats_live(t.listings, t.listing_prices, t.districts))


snippet("multidim", f"""
    SELECT district_id, segment_id, DATE '{AS_OF[:10]}' AS date, avg(price_per_sqm) AS avg_price_per_sqm,
           quantile_cont(price_per_sqm, 0.5) AS median_price_per_sqm, min(current_price) AS min_price,
           max(current_price) AS max_price, count(*) AS total_listings, avg(area_total) AS avg_area,
           stddev_samp(price_per_sqm) AS price_stddev, least(100, 20 + (count(*) // 5) * 10) AS confidence_score
    FROM segment_of WHERE district_id IS NOT NULL AND segment_id IS NOT NULL AND area_total > 0 AND current_price > 0
      AND is_active AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY
    GROUP BY district_id, segment_id HAVING count(*) >= 3""")


@query("district_segment_aggregates", """
    SELECT district_id, segment_id, date, round(avg_price_per_sqm, 4) AS avg_price_per_sqm,
           round(median_price_per_sqm, 4) AS median_price_per_sqm, min_price, max_price, total_listings,
           round(avg_area, 4) AS avg_area, round(price_stddev, 4) AS price_stddev, confidence_score FROM multidim""")
def _(t):
    return r(market.multidim_aggregates(segmented(t), t.listing_prices, AS_OF))


@query("aggregate_summary", """
    SELECT count(DISTINCT district_id) AS keys_with_data, CAST(sum(total_listings) AS BIGINT) AS total_listings,
           round(avg(avg_price_per_sqm), 4) AS avg_price, round(min(avg_price_per_sqm), 4) AS min_price,
           round(max(avg_price_per_sqm), 4) AS max_price FROM district_day""")
def _(t):
    return r(market.aggregate_summary(market.district_aggregates(t.listings, t.listing_prices, t.districts, AS_OF[:10])))


@query("district_map", f"""
    SELECT d.district_id, name, full_name, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon,
           total_listings, {DAY_COLS} FROM districts d LEFT JOIN district_day a ON a.district_id = d.district_id""")
def _(t):
    day = market.district_aggregates(t.listings, t.listing_prices, t.districts, AS_OF[:10])
    out = market.district_map(t.districts, day, AS_OF[:10])
    return r(r(out, 6, "center_lat", "center_lon"), 4, "avg_price_per_sqm", "median_price_per_sqm", "avg_area", "avg_rooms")


@query("district_listings", """
    SELECT id, url, current_price, area_total, rooms, floor, round(price_per_sqm, 4) AS price_per_sqm
    FROM current_market WHERE district_id = 7 AND area_total > 0 AND current_price > 0
    ORDER BY current_market.price_per_sqm, id LIMIT 50""")
def _(t):
    cols = ["id", "url", "current_price", "area_total", "rooms", "floor", "price_per_sqm"]
    return r(market.district_listings(t.listings, t.listing_prices, 7).select(*cols), 4, "price_per_sqm")


@query("dispersion_by_level", """
    SELECT level, count(DISTINCT l.district_id) AS segment_count, count(*) AS listing_count,
           round(avg(v), 4) AS avg_price_per_sqm, round(stddev_samp(v), 4) AS stddev_price, round(min(v), 4) AS min_price,
           round(max(v), 4) AS max_price, round(quantile_cont(v, 0.5), 4) AS median_price, round(stddev_samp(v) / avg(v) * 100, 4) AS cv_pct
    FROM (SELECT l.district_id, p.current_price / area_total AS v FROM listings l JOIN latest_price p ON p.id = l.id
          WHERE area_total > 0 AND p.current_price > 0) l
    JOIN districts d ON d.district_id = l.district_id GROUP BY level""")
def _(t):
    return r(market.dispersion_by_level(t.listings, t.listing_prices, t.districts))


@query("share_of_total", """
    SELECT district_id, count(*) AS cnt, round(count(*) * 100.0 / (SELECT count(*) FROM listings), 6) AS pct FROM listings GROUP BY district_id""")
def _(t):
    return r(market.pct_of_total(t.listings, ["district_id"]), 6)


@query("overview_counters", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE rooms = 0) AS studios,
           count(*) FILTER (WHERE first_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY) AS recent,
           count(*) FILTER (WHERE building_type IS NULL) AS untyped FROM listings""")
def _(t):
    return market.overview(t.listings, {
        "active": F.col("is_active"), "studios": F.col("rooms") == 0,
        "recent": F.col("first_seen") >= market.ts(AS_OF) - F.expr("INTERVAL 1000 DAYS"),
        "untyped": F.col("building_type").isNull()})


@query("count_elements", """
    SELECT w AS element, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w""")
def _(t):
    return market.count_elements(t.part.select(F.split("p_name", " ").alias("words")), "words")


@query("days_on_market", """
    SELECT id, datediff('day', CAST(first_seen AS DATE), CAST(last_seen AS DATE)) AS dom_days FROM listings WHERE NOT is_active""")
def _(t):
    return market.days_on_market(t.listings)


snippet("rated", """
    SELECT m.*, condition_score, condition_label, confidence,
           m.current_price * CASE condition_score WHEN 5 THEN 1.10 WHEN 4 THEN 1.05 WHEN 3 THEN 1.00 WHEN 2 THEN 0.90 WHEN 1 THEN 0.80 ELSE 1 END AS adjusted_price
    FROM current_market m LEFT JOIN ratings r ON r.listing_id = m.id""")


@query("stats_by_condition", """
    SELECT condition_label, condition_score, count(*) AS listings_count,
           round(CAST(sum(CAST(current_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price,
           round(avg(price_per_sqm), 4) AS avg_price_per_sqm, round(avg(area_total), 4) AS avg_area, round(avg(confidence), 4) AS avg_confidence
    FROM rated WHERE condition_score IS NOT NULL GROUP BY condition_label, condition_score""")
def _(t):
    return r(market.stats_by_condition(t.listings, t.listing_prices, ratings(t)))


@query("condition_adjusted_price", "SELECT id, current_price, condition_score, round(adjusted_price, 4) AS adjusted_price FROM rated")
def _(t):
    return r(market.rated_listings(t.listings, t.listing_prices, ratings(t)).select("id", "current_price", "condition_score", "adjusted_price"), 4, "adjusted_price")


@query("underpriced", """
    SELECT id, current_price, round(price_per_sqm, 4) AS price_per_sqm, condition_score, round(adjusted_price, 4) AS adjusted_price,
           round(adjusted_price - current_price, 4) AS potential_value, round((adjusted_price - current_price) / current_price * 100, 4) AS underpriced_percent
    FROM rated WHERE condition_score >= 3 AND price_per_sqm < (SELECT round(avg(price_per_sqm) * 0.85, 6) FROM current_market)""")
def _(t):
    out = market.underpriced(t.listings, t.listing_prices, ratings(t), min_score=3)
    return r(out.select("id", "current_price", "price_per_sqm", "condition_score", "adjusted_price", "potential_value", "underpriced_percent"))


@query("room_distribution", """
    SELECT building_type, rooms, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY building_type), 6) AS percentage
    FROM listings WHERE rooms IS NOT NULL AND building_type IS NOT NULL GROUP BY building_type, rooms""")
def _(t):
    return r(market.room_distribution(t.listings), 6)


@query("typical_building_params", """
    SELECT a.building_type, round(avg(total_floors), 6) AS avg_height, round(avg(house_year), 6) AS avg_year, min(house_year) AS min_year,
           max(house_year) AS max_year, count(*) AS sample_size, any_value(m.typical) AS typical_height
    FROM listings a JOIN (SELECT building_type, arg_min(total_floors, (-n, total_floors)) AS typical FROM
        (SELECT building_type, total_floors, count(*) AS n FROM listings GROUP BY building_type, total_floors) GROUP BY building_type) m
      ON m.building_type = a.building_type GROUP BY a.building_type""")
def _(t):
    return r(market.typical_params(t.listings), 6)


@query("building_type_profile", """
    SELECT building_type, CAST(sum(cnt) AS BIGINT) AS sample_count, round(avg(total_floors), 6) AS avg_height, min(house_year) AS min_year,
           max(house_year) AS max_year, count(DISTINCT rooms) AS room_kinds
    FROM (SELECT building_type, rooms, area_total, total_floors, house_year, count(*) AS cnt FROM listings
          WHERE building_type IS NOT NULL AND rooms IS NOT NULL AND area_total BETWEEN 20 AND 200 GROUP BY ALL) GROUP BY building_type""")
def _(t):
    return r(market.building_type_profile(t.listings), 6)


@query("similar_area_profile", """
    SELECT subject_id, area_total, rooms, building_type, cnt, round(avg_area, 4) AS avg_area, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY cnt DESC, rooms, building_type NULLS LAST) AS rank FROM (
            SELECT s.id AS subject_id, s.area_total, l.rooms, l.building_type, count(*) AS cnt, avg(l.area_total) AS avg_area
            FROM listings s JOIN listings l ON l.area_total BETWEEN s.area_total - 10 AND s.area_total + 10
            WHERE l.rooms IS NOT NULL GROUP BY s.id, s.area_total, l.rooms, l.building_type)) WHERE rank <= 10""")
def _(t):
    subjects = t.listings.select(F.col("id").alias("subject_id"), "area_total")
    return r(market.similar_area_profile(subjects, t.listings), 4, "avg_area")


RUNS_AS_OF = "2001-08-01 00:00:00"


@query("scrape_health", f"""
    SELECT s.name AS source, CAST(o_orderdate AS DATE) AS run_date, count(*) AS runs_count, CAST(sum(o_custkey % 50) AS BIGINT) AS total_collected,
           CAST(sum(o_custkey % 7) AS BIGINT) AS total_failed, CAST(sum(o_custkey % 3) AS BIGINT) AS total_cost,
           round(avg(CASE WHEN (o_custkey % 50) + (o_custkey % 7) > 0 THEN (o_custkey % 50) * 100.0 / ((o_custkey % 50) + (o_custkey % 7)) ELSE 0 END), 6) AS avg_success_rate
    FROM orders JOIN product_sources s ON s.id = o_orderkey % 10
    WHERE o_orderdate >= TIMESTAMP '{RUNS_AS_OF}' - INTERVAL 7 DAY GROUP BY s.name, CAST(o_orderdate AS DATE)""")
def _(t):
    ok, bad = F.col("o_custkey") % 50, F.col("o_custkey") % 7
    runs = t.orders.select((F.col("o_orderkey") % 10).cast("int").alias("source_id"), F.col("o_orderdate").alias("started_at"),
                           (ok + bad).alias("requested"), ok.alias("collected"), bad.alias("failed"), (F.col("o_custkey") % 3).alias("cost"))
    return r(market.scrape_health(t.product_sources, runs, RUNS_AS_OF), 6)


@query("locality_stats", """
    SELECT locality, count(DISTINCT l.id) AS listings, count(*) AS points, round(avg(p.price / nullif(area_total, 0)), 4) AS avg_price_per_sqm,
           round(CAST(sum(CAST(p.price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price
    FROM listings l JOIN listing_prices p ON p.id = l.id
    JOIN (VALUES ('first street', '%STREET 1,%'), ('tens', '%street 1_,%'), ('town', 'town%')) v(locality, pat) ON l.address ILIKE v.pat
    GROUP BY locality""")
def _(t):
    pats = t.spark.sql("VALUES ('first street', '%STREET 1,%'), ('tens', '%street 1_,%'), ('town', 'town%') AS v(locality, pattern)")
    return r(market.locality_stats(t.listings, t.listing_prices, pats))


@query("stats_by_region", """
    SELECT region, count(*) AS listings_count, round(CAST(sum(CAST(current_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg_price,
           round(avg(price_per_sqm), 4) AS avg_price_per_sqm, min(current_price) AS min_price, max(current_price) AS max_price
    FROM current_market GROUP BY region""")
def _(t):
    return r(market.stats_by_region(t.listings, t.listing_prices))


@query("arrivals_by_hour", "SELECT date_trunc('hour', ts) AS period, count(*) AS arrivals FROM events GROUP BY 1")
def _(t):
    return market.arrivals(t.events, "hour", "ts")


@query("rating_summary", """
    SELECT count(*) AS ratings, avg(condition_score) AS avg_score, CAST(sum(cost_usd) AS DOUBLE) AS total_cost,
           min(analyzed_at) AS first_rating, max(analyzed_at) AS last_rating FROM ratings""")
def _(t):
    return market.rating_summary(ratings(t))


@query("top_rated", """
    SELECT id, current_price, condition_score, condition_label FROM rated WHERE condition_score >= 3
    ORDER BY condition_score DESC, current_price, id LIMIT 20""")
def _(t):
    return market.top_rated(t.listings, t.listing_prices, ratings(t), 20, 3).select("id", "current_price", "condition_score", "condition_label")


@query("segment_dimension", "SELECT building_type, building_height, rooms_count, segment_id FROM property_segments")
def _(t):
    return segments.build_segments(t.listings)


@query("segment_assignment", "SELECT id, seg_height AS building_height, seg_type AS building_type, segment_id FROM segment_of")
def _(t):
    s = segments.assign_segment(t.listings, segments.build_segments(t.listings))
    return s.select("id", "building_height", "building_type", "segment_id")


@query("segment_summary", """
    SELECT 'segments' AS summary, count(*) AS value FROM property_segments
    UNION ALL SELECT 'listings with segment', count(*) FROM segment_of WHERE segment_id IS NOT NULL""")
def _(t):
    return segments.segment_summary(t.listings, segments.build_segments(t.listings))
