"""Search, paging, facets and data quality."""

from pyspark.sql import functions as F

from hearthmark.operators import filters, latest, market, quality
from hearthmark.operators.market import ts
from hearthmark.plans.q_market import r
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF


def priced(t):
    return latest.with_latest_price(t.listings, t.listing_prices)


snippet("priced", "SELECT l.*, p.current_price FROM listings l JOIN latest_price p ON p.id = l.id")
# Listings with tri-state flags and address-resolution columns.
snippet("flagged", """
    SELECT *, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS has_risk, CASE id % 11 WHEN 0 THEN true WHEN 1 THEN false END AS is_error,
           CASE WHEN id % 4 <> 0 THEN concat('addr-', CAST(id % 60 AS VARCHAR)) END AS address_id,
           CASE WHEN id % 4 <> 0 THEN concat('Res ', address) END AS resolved_address,
           CASE WHEN id % 4 <> 0 THEN id % 6 END AS address_quality_code,
           CASE WHEN id % 8 = 1 THEN concat('77:', CAST(id AS VARCHAR)) END AS cadastral_number,
           CASE WHEN id % 11 = 0 THEN last_seen END AS marked_at FROM listings""")


def flagged(t):
    i = F.col("id")
    return (t.listings
            .withColumn("has_risk", F.when(i % 3 == 0, True).when(i % 3 == 1, False))
            .withColumn("is_error", F.when(i % 11 == 0, True).when(i % 11 == 1, False))
            .withColumn("address_id", F.when(i % 4 != 0, F.concat(F.lit("addr-"), (i % 60).cast("string"))))
            .withColumn("resolved_address", F.when(i % 4 != 0, F.concat(F.lit("Res "), "address")))
            .withColumn("address_quality_code", F.when(i % 4 != 0, i % 6))
            .withColumn("cadastral_number", F.when(i % 8 == 1, F.concat(F.lit("77:"), i.cast("string"))))
            .withColumn("marked_at", F.when(i % 11 == 0, F.col("last_seen"))))


@query("search_listings", """
    SELECT id, rooms, area_total, current_price FROM priced WHERE is_active AND rooms = 2 AND current_price BETWEEN 20000 AND 90000
      AND area_total >= 30 ORDER BY current_price DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def _(t):
    spec = filters.SearchSpec(rooms=2, price=(20000, 90000), area=(30, None), sort=[("current_price", False)], page=2)
    return filters.search_listings(priced(t), spec, AS_OF).select("id", "rooms", "area_total", "current_price")


@query("filter_listings", f"""
    SELECT id, rooms, last_seen FROM flagged WHERE is_active AND last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
      AND coalesce(has_risk, false) = false AND coalesce(is_error, false) = false""")
def _(t):
    cond = [F.col("is_active"), filters.period_filter("month", AS_OF, "last_seen"), filters.flag_filter("has_risk", False), filters.flag_filter("is_error", False)]
    return flagged(t).where(filters.all_of(cond)).select("id", "rooms", "last_seen")


@query("sort_nulls_last", "SELECT id, marked_at, row_number() OVER (ORDER BY marked_at DESC NULLS LAST, id) AS pos FROM flagged ORDER BY pos LIMIT 250")
def _(t):
    from pyspark.sql import Window
    page = filters.page_of(flagged(t), [("marked_at", False)], 1, 250)
    return page.select("id", "marked_at", F.row_number().over(Window.orderBy(*filters.sort_columns([("marked_at", False)]))).cast("long").alias("pos"))


@query("facet_filter", """
    SELECT id FROM listings WHERE building_type IN ('panel', 'brick') AND floor BETWEEN 3 AND 12""")
def _(t):
    fs = [filters.Facet("building_type", checked=["panel", "brick"]), filters.Facet("floor", chosen=(3, 12), full=(1, 20)),
          filters.Facet("area_total", chosen=(0, 200), full=(0, 200))]
    return t.listings.where(filters.facet_condition(fs)).select("id")


@query("text_search", """
    SELECT p_partkey FROM part WHERE list_has_any(string_split_regex(lower(p_name), '[^a-z0-9_]+'), ['ring', 'blue'])""")
def _(t):
    return filters.text_search(t.part, "p_name", "Ring blue").select("p_partkey")


@query("search_address", """
    WITH a AS (SELECT address, count(*) AS listings, arg_max(id, (last_seen, id)) AS newest_id FROM listings GROUP BY address),
         q(query_id, pattern, broad_pattern) AS (VALUES ('q1', '%street 7, 1_', '%street 7,%'), ('q2', '%street 99,%', '%street 9,%')),
         e AS (SELECT query_id, a.*, false AS broad FROM a JOIN q ON address ILIKE pattern),
         ok AS (SELECT query_id FROM e GROUP BY query_id HAVING sum(listings) >= 1)
    SELECT * FROM e WHERE query_id IN (SELECT query_id FROM ok)
    UNION ALL SELECT query_id, a.*, true FROM a JOIN q ON address ILIKE broad_pattern WHERE query_id NOT IN (SELECT query_id FROM ok)""")
def _(t):
    q = t.spark.sql("VALUES ('q1', '%street 7, 1_', '%street 7,%'), ('q2', '%street 99,%', '%street 9,%') AS q(query_id, pattern, broad_pattern)")
    return filters.search_address(t.listings, q)


@query("search_addresses", """
    WITH a AS (SELECT address, count(*) AS listings, arg_max(id, (last_seen, id)) AS newest_id FROM listings GROUP BY address),
         q AS (SELECT c_custkey AS query_id, concat('%STREET ', c_custkey % 70, ', _', c_custkey % 10) AS pattern, concat('town%eet ', c_custkey % 60, ',%') AS broad_pattern FROM customer),
         p AS (SELECT DISTINCT pattern FROM (SELECT pattern FROM q UNION ALL SELECT broad_pattern FROM q)),
         m AS (SELECT p.pattern, a.* FROM p JOIN a ON a.address ILIKE p.pattern),
         e AS (SELECT query_id, m.address, m.listings, m.newest_id, false AS broad FROM q JOIN m ON m.pattern = q.pattern),
         ok AS (SELECT query_id FROM e GROUP BY query_id HAVING sum(listings) >= 2)
    SELECT * FROM e WHERE query_id IN (SELECT query_id FROM ok)
    UNION ALL SELECT query_id, m.address, m.listings, m.newest_id, true FROM q JOIN m ON m.pattern = q.broad_pattern WHERE query_id NOT IN (SELECT query_id FROM ok)""")
def _(t):
    k = F.col("c_custkey")
    num = lambda m: (k % m).cast("string")
    q = t.customer.select(k.alias("query_id"), F.concat(F.lit("%STREET "), num(70), F.lit(", _"), num(10)).alias("pattern"),
                          F.concat(F.lit("town%eet "), num(60), F.lit(",%")).alias("broad_pattern"))
    return filters.search_address(t.listings, q, 2)


@query("page_with_total", """
    SELECT id, (SELECT count(*) FROM listings WHERE rooms = 3) AS total FROM listings WHERE rooms = 3 ORDER BY area_total DESC, id LIMIT 30""")
def _(t):
    return filters.page_with_total(t.listings.where("rooms = 3"), [("area_total", False)], 1, 30).select("id", "total")


@query("top_groups", "SELECT address, count(*) AS cnt FROM listings GROUP BY address ORDER BY cnt DESC, address LIMIT 10")
def _(t):
    return filters.top_n(t.listings, ["address"], 10)


@query("substring_filter", "SELECT id FROM listings WHERE lower(address) LIKE '%street 3,%' OR lower(address) LIKE '%, 44%'")
def _(t):
    return filters.filter_any_substring(t.listings, "address", ["Street 3,", ", 44"]).select("id")


@query("pending_work", "SELECT id, url FROM listings WHERE district_id IS NULL ORDER BY first_seen DESC, id LIMIT 40")
def _(t):
    return filters.pending(t.listings, F.col("district_id").isNull(), [("first_seen", False)], 40).select("id", "url")


SCORE = """(CASE WHEN rooms IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN area_total IS NOT NULL THEN 1 ELSE 0 END
            + CASE WHEN address IS NOT NULL AND address <> '' THEN 1 ELSE 0 END + CASE WHEN floor IS NOT NULL THEN 1 ELSE 0 END
            + CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 1 ELSE 0 END) * 20"""
METRICS = f"""count(*) AS total_listings, round(count(rooms) * 100.0 / nullif(count(*), 0), 6) AS pct_has_rooms,
    round(count(area_total) * 100.0 / nullif(count(*), 0), 6) AS pct_has_area,
    round(count(*) FILTER (WHERE address <> '') * 100.0 / nullif(count(*), 0), 6) AS pct_has_address,
    round(count(floor) * 100.0 / nullif(count(*), 0), 6) AS pct_has_floor,
    round(count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) * 100.0 / nullif(count(*), 0), 6) AS pct_has_coordinates,
    round(avg({SCORE}), 6) AS avg_completeness_score"""


@query("quality_metrics", f"SELECT {METRICS} FROM listings WHERE is_active")
def _(t):
    return r(quality.quality_metrics(t.listings), 6)


@query("quality_metrics_recent", f"SELECT {METRICS} FROM listings WHERE is_active AND first_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAY")
def _(t):
    return r(quality.quality_metrics(t.listings, AS_OF, 2000), 6)


@query("suspected_shares", """
    SELECT l.id, url, address, rooms, area_total, floor, first_seen, price FROM listings l JOIN listing_prices p ON p.id = l.id
    WHERE is_active AND area_total < 20""")
def _(t):
    return quality.suspected_shares(t.listings, t.listing_prices)


@query("addresses_need_review", """
    SELECT id, url, address AS raw_address, resolved_address, address_quality_code,
           CASE address_quality_code WHEN 2 THEN 'Corrected' WHEN 3 THEN 'Incomplete' WHEN 4 THEN 'Invalid' WHEN 5 THEN 'Invalid' ELSE 'Not normalized' END AS quality_status
    FROM flagged WHERE address_quality_code IS NULL OR address_quality_code >= 2""")
def _(t):
    return quality.addresses_need_review(flagged(t))


@query("address_stats", """
    SELECT count(*) AS total_listings, count(address_id) AS normalized_count, count(cadastral_number) AS with_cadastral,
           round(count(address_id) * 100.0 / count(*), 6) AS pct_normalized, round(count(cadastral_number) * 100.0 / count(*), 6) AS pct_with_cadastral,
           count(*) FILTER (WHERE address_quality_code = 0) AS exact_matches, count(*) FILTER (WHERE address_quality_code = 1) AS good_matches,
           count(*) FILTER (WHERE address_quality_code >= 2) AS need_review FROM flagged""")
def _(t):
    return r(quality.address_stats(flagged(t)), 6)


@query("listing_issues", "SELECT id, has_risk, is_error, marked_at FROM flagged WHERE is_active AND (has_risk OR is_error)")
def _(t):
    return quality.issues(flagged(t)).select("id", "has_risk", "is_error", "marked_at")


@query("column_coverage", """
    SELECT field, filled, total, round(filled * 100.0 / total, 6) AS pct FROM (
        SELECT count(rooms) AS a, count(building_type) AS b, count(district_id) AS c, count(*) AS total,
               count(*) FILTER (WHERE lat BETWEEN 55.6 AND 55.9 AND lon BETWEEN 37.4 AND 37.9) AS i,
               count(*) FILTER (WHERE NOT (lat BETWEEN 55.6 AND 55.9 AND lon BETWEEN 37.4 AND 37.9)) AS o FROM listings),
        LATERAL (VALUES ('rooms', a), ('building_type', b), ('district_id', c), ('inside_box', i), ('outside_box', o)) v(field, filled)""")
def _(t):
    return r(quality.coverage(t.listings, ["rooms", "building_type", "district_id"], (55.6, 55.9, 37.4, 37.9)), 6)


@query("hierarchy_quality", """
    SELECT level, count(*) AS total, count(parent_district_id) AS with_parent, CAST(0 AS BIGINT) AS with_outline,
           round(count(parent_district_id) * 100.0 / count(*), 6) AS pct_with_parent FROM districts GROUP BY level""")
def _(t):
    return r(quality.hierarchy_quality(t.districts).drop("avg_area_km2", "total_area_km2"), 6)


@query("recommendations", f"""
    SELECT * FROM (SELECT 'MEDIUM' AS priority, 'listings without district' AS issue, count(*) - count(district_id) AS value, 'assign districts' AS action FROM listings
    UNION ALL SELECT 'HIGH', 'listings without coordinates', count(*) - count(lat), 'geocode listings' FROM listings) WHERE value > 0
    UNION ALL SELECT 'LOW', 'too few fine-grained districts', count(*) FILTER (WHERE level >= 3), 'load finer districts' FROM districts
    UNION ALL SELECT * FROM (SELECT 'MEDIUM', 'no aggregates for the day', count(*) AS n, 'aggregate districts' FROM price_paid WHERE date = TIMESTAMP '{AS_OF}') WHERE n = 0""")
def _(t):
    return quality.recommend(t.listings, t.districts, t.price_paid.where(F.col("date") == ts(AS_OF)))


@query("threshold_checks", """
    SELECT "check", value, bound, passed FROM (
        SELECT round(count(address_id) * 100.0 / count(*), 6) AS a, CAST(count(*) - count(url) AS DOUBLE) AS b,
               CAST(count(*) FILTER (WHERE rooms IS NULL) AS DOUBLE) AS c FROM flagged),
        LATERAL (VALUES ('normalized_pct', a, 90.0::DOUBLE, a >= 90), ('missing_url', b, 0.0::DOUBLE, b <= 0), ('missing_rooms', c, 0.0::DOUBLE, c <= 0)) v("check", value, bound, passed)""")
def _(t):
    return r(quality.threshold_checks(flagged(t), {
        "normalized_pct": (F.count("address_id") * 100.0 / F.count(F.lit(1)), "min", 90),
        "missing_url": (F.count_if(F.col("url").isNull()), "max", 0),
        "missing_rooms": (F.count_if(F.col("rooms").isNull()), "max", 0)}), 6)


@query("freshness", """
    SELECT count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 10:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS fresh,
           count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 10:00:00') AS rows_before,
           count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 12:00:00') AS rows_after, max(ts) AS newest FROM events""")
def _(t):
    return quality.freshness(t.events, "2024-01-20 12:00:00", 2, "ts")
