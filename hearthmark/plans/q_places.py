"""Geography, duplicates and quick estimates."""

from pyspark.sql import functions as F

from hearthmark.operators import duplicates as dup
from hearthmark.operators import geography as geo
from hearthmark.operators import locality as loc
from hearthmark.plans.q_market import r
from hearthmark.plans.q_valuation import T, hav, subjects
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF

# --- zones: five bands (level 1) of five rectangles (level 2), off the point grid ------
LETTERS = "абвгдежзик"
snippet("zones", f"""
    SELECT n_nationkey AS district_id, concat('Зона', translate(CAST(n_nationkey AS VARCHAR), '0123456789', '{LETTERS}')) AS name, 2 AS level,
           CAST(55.49975 AS DOUBLE) + (n_nationkey // 5) * CAST(0.1 AS DOUBLE) AS s, CAST(37.29975 AS DOUBLE) + (n_nationkey % 5) * CAST(0.16 AS DOUBLE) AS w,
           CAST(55.49975 AS DOUBLE) + (n_nationkey // 5 + 1) * CAST(0.1 AS DOUBLE) AS n, CAST(37.29975 AS DOUBLE) + (n_nationkey % 5 + 1) * CAST(0.16 AS DOUBLE) AS e FROM nation
    UNION ALL SELECT 1000 + r_regionkey, concat('Пояс', CAST(r_regionkey AS VARCHAR)), 1, CAST(55.49975 AS DOUBLE) + r_regionkey * CAST(0.1 AS DOUBLE), CAST(37.29975 AS DOUBLE),
           CAST(55.49975 AS DOUBLE) + (r_regionkey + 1) * CAST(0.1 AS DOUBLE), CAST(37.29975 AS DOUBLE) + 5 * CAST(0.16 AS DOUBLE) FROM region""")


def zones(t):
    row, col, k = F.expr("n_nationkey div 5"), F.col("n_nationkey") % 5, F.col("n_nationkey")
    lat, lon = lambda i: 55.49975 + i * 0.1, lambda i: 37.29975 + i * 0.16
    fine = t.nation.select(k.alias("district_id"), F.concat(F.lit("Зона"), F.translate(k.cast("string"), "0123456789", LETTERS)).alias("name"),
                           F.lit(2).alias("level"), geo.rectangle(lat(row), lon(col), lat(row + 1), lon(col + 1)).alias("outline"))
    b = F.col("r_regionkey")
    coarse = t.region.select((1000 + b).alias("district_id"), F.concat(F.lit("Пояс"), b.cast("string")).alias("name"), F.lit(1).alias("level"),
                             geo.rectangle(lat(b), F.lit(37.29975), lat(b + 1), lon(F.lit(5))).alias("outline"))
    z = fine.unionByName(coarse).withColumn("_c", geo.vertex_centroid(F.col("outline")))
    return z.select("district_id", "name", F.concat(F.lit("Район "), "name").alias("full_name"), "level", F.lit(None).cast("int").alias("parent_district_id"),
                    "outline", F.col("_c.lat").alias("center_lat"), F.col("_c.lon").alias("center_lon"))


@query("points_in_radius", f"""
    SELECT a.id AS subject_id, count(b.id) AS points, round(min({hav('a', 'b')}) * 1000, 3) AS nearest_m FROM listings a
    JOIN listings b ON {hav('a', 'b')} <= 1.5 GROUP BY a.id""")
def _(t):
    out = geo.within_radius(t.listings.select(F.col("id").alias("subject_id"), "lat", "lon"), t.listings.select("lat", "lon"), 1500)
    return r(out.select("subject_id", "points", "nearest_m"), 3)


@query("search_box", "SELECT id FROM listings WHERE lat BETWEEN 55.75 - 0.05 AND 55.75 + 0.05 AND lon BETWEEN 37.6 - 0.07 AND 37.6 + 0.07")
def _(t):
    return geo.bbox_filter(t.listings, 55.75003, 37.60003).select("id")


@query("district_by_polygon", """
    SELECT l.id, arg_max(z.district_id, (z.level, -z.district_id)) AS district_id, max(z.level) AS level FROM listings l
    JOIN zones z ON l.lat >= z.s AND l.lat < z.n AND l.lon >= z.w AND l.lon < z.e GROUP BY l.id""")
def _(t):
    return geo.assign_by_polygon(t.listings, zones(t))


snippet("zone_centres", "SELECT *, (3 * s + 2 * n) / 5 AS lat, (3 * w + 2 * e) / 5 AS lon FROM zones")


@query("district_by_nearest", f"""
    SELECT id, arg_min(district_id, (d, -level, district_id)) AS district_id, arg_min(level, (d, -level, district_id)) AS level, round(min(d) * 1000, 3) AS distance_m
    FROM (SELECT l.id, z.district_id, z.level, {hav('l', 'z')} AS d FROM listings l CROSS JOIN zone_centres z WHERE z.level >= 2) GROUP BY id HAVING min(d) < 5""")
def _(t):
    return r(geo.assign_by_nearest(t.listings, zones(t), max_m=5000, min_level=2), 3)


@query("district_by_nearest_any", f"""
    SELECT id, arg_min(district_id, (d, -level, district_id)) AS district_id FROM (
        SELECT l.id, z.district_id, z.level, {hav('l', 'z')} AS d FROM listings l CROSS JOIN zone_centres z) GROUP BY id""")
def _(t):
    return geo.assign_by_nearest(t.listings, zones(t)).select("id", "district_id")


# Addresses that name the zone (or none), some listings without coordinates.
snippet("addressed", f"""
    SELECT id, CASE WHEN id % 7 <> 0 THEN lat + CASE WHEN id % 11 = 5 THEN 3 ELSE 0 END END AS lat, CASE WHEN id % 7 <> 0 THEN lon END AS lon,
           CASE WHEN id % 3 = 0 THEN NULL ELSE concat('Зона', translate(CAST(id % 25 AS VARCHAR), '0123456789', '{LETTERS}')) END AS zone_name FROM listings""")


def addressed(t):
    i = F.col("id")
    zone = F.concat(F.lit("Москва, р-н Зона"), F.translate((i % 25).cast("string"), "0123456789", LETTERS), F.lit(", улица Первая, 5"))
    return t.listings.select("id", F.when(i % 7 != 0, F.col("lat") + F.when(i % 11 == 5, 3).otherwise(0)).alias("lat"), F.when(i % 7 != 0, F.col("lon")).alias("lon"),
                             F.when(i % 3 != 0, zone).otherwise("Москва, Town Road, 5").alias("address"))


@query("district_by_text", "SELECT a.id, z.district_id FROM addressed a JOIN zones z ON z.name = a.zone_name")
def _(t):
    return geo.assign_by_text(addressed(t), zones(t))


@query("district_cascade", f"""
    SELECT a.id, coalesce(p.district_id, x.district_id, n.district_id) AS district_id,
           CASE WHEN p.district_id IS NOT NULL THEN 'polygon' WHEN x.district_id IS NOT NULL THEN 'text' WHEN n.district_id IS NOT NULL THEN 'nearest' END AS method
    FROM addressed a LEFT JOIN (SELECT a.id, arg_max(z.district_id, (z.level, -z.district_id)) AS district_id FROM addressed a JOIN zones z
            ON a.lat >= z.s AND a.lat < z.n AND a.lon >= z.w AND a.lon < z.e GROUP BY a.id) p ON p.id = a.id
    LEFT JOIN zones x ON x.name = a.zone_name
    LEFT JOIN (SELECT a.id, arg_min(z.district_id, ({hav('a', 'z')}, -z.level, z.district_id)) AS district_id FROM addressed a CROSS JOIN zone_centres z
            WHERE a.lat IS NOT NULL GROUP BY a.id) n ON n.id = a.id""")
def _(t):
    return geo.assign_districts(addressed(t), zones(t))


# Outlines that are no boxes: a star of 24 vertices around each zone of level 2, with a square hole.
snippet("star_edges", """
    SELECT n_nationkey AS district_id, CASE WHEN k < 24 THEN 0 ELSE 1 END AS ring, y + r * reach * sin(a) AS y1, x + r * reach * cos(a) AS x1, y + r2 * reach * sin(a2) AS y2, x + r2 * reach * cos(a2) AS x2
    FROM (SELECT *, 55.55 + (n_nationkey // 5) * 0.1 AS y, 37.38 + (n_nationkey % 5) * 0.16 AS x, 0.04 + n_nationkey * 0.004 AS reach FROM nation) z,
         (SELECT k, CASE WHEN k < 24 THEN 1 - 0.4 * (k % 2) ELSE 0.2 END AS r, CASE WHEN k < 24 THEN 1 - 0.4 * ((k + 1) % 24 % 2) ELSE 0.2 END AS r2,
                 CASE WHEN k < 24 THEN 2 * pi() * k / 24 ELSE 2 * pi() * (k - 24) / 4 END AS a, CASE WHEN k < 24 THEN 2 * pi() * ((k + 1) % 24) / 24 ELSE 2 * pi() * ((k - 23) % 4) / 4 END AS a2
          FROM (SELECT unnest(range(28)) AS k)) v""")


def stars(t):
    k = F.col("n_nationkey")

    def closed(n, inner):
        def vertex(i):
            i = i % n
            out = F.when(F.lit(n == 24), 1 - F.lit(inner) * (i % 2)).otherwise(F.lit(inner))
            a = 2 * F.pi() * i / n
            reach = 0.04 + k * 0.004
            return F.struct((37.38 + (k % 5) * 0.16 + out * reach * F.cos(a)).alias("lon"), (55.55 + F.expr("n_nationkey div 5") * 0.1 + out * reach * F.sin(a)).alias("lat"))
        return F.transform(F.sequence(F.lit(0), F.lit(n)), vertex)
    return t.nation.select(k.alias("district_id"), F.lit(2).alias("level"), F.array(F.array(closed(24, 0.4), closed(4, 0.2))).alias("outline"))


@query("district_by_outline", """
    SELECT id, district_id FROM (SELECT l.id, e.district_id, count(*) AS n FROM listings l JOIN star_edges e ON (y1 > l.lat) <> (y2 > l.lat) AND l.lon < (x2 - x1) * (l.lat - y1) / (y2 - y1) + x1
        GROUP BY 1, 2) WHERE n % 2 = 1""")
def _(t):
    """Every zone a listing lies in: stars overlap, so it may be several."""
    return geo.polygon_matches(t.listings, stars(t)).select("id", "district_id")


@query("zone_centroids", "SELECT district_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM zone_centres")
def _(t):
    return r(zones(t).select("district_id", F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon")), 6)


@query("grid_cell_counts", """
    SELECT i AS idx, count(l.id) AS listings FROM (SELECT unnest(range(50 * 80)) AS i) g LEFT JOIN listings l
      ON floor((l.lat - 55.49975) / 0.0101) * 80 + floor((l.lon - 37.29975) / 0.0101) = g.i GROUP BY i""")
def _(t):
    g = geo.make_grid(t.listings, (55.49975, 37.29975, 55.49975 + 50 * 0.0101, 37.29975 + 80 * 0.0101), 0.0101).select("idx")
    at = F.floor((F.col("lat") - 55.49975) / 0.0101) * 80 + F.floor((F.col("lon") - 37.29975) / 0.0101)
    n = t.listings.groupBy(at.alias("idx")).agg(F.count(F.lit(1)).alias("listings"))
    return g.join(n, "idx", "left").withColumn("listings", F.coalesce("listings", F.lit(0)))


@query("district_hierarchy", "SELECT district_id, CASE WHEN level = 2 THEN 1000 + district_id // 5 END AS parent_district_id FROM zones")
def _(t):
    return geo.link_hierarchy(zones(t)).select("district_id", "parent_district_id")


@query("impute_building_type", f"""
    WITH pairs AS (SELECT a.id, b.building_type AS t, {hav('a', 'b')} * 1000 AS d FROM listings a JOIN listings b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.02
                   WHERE b.building_type IS NOT NULL),
         c AS (SELECT id, t, count(*) FILTER (WHERE d <= 200) AS n1, count(*) AS n2 FROM pairs WHERE d <= 500 GROUP BY id, t)
    SELECT l.id AS subject_id, coalesce(x.near, x.far) AS detected_type, CASE WHEN x.near IS NOT NULL THEN 200.0 WHEN x.far IS NOT NULL THEN 500.0 END AS radius_m
    FROM listings l LEFT JOIN (SELECT id, arg_min(t, (-n1, t)) FILTER (WHERE n1 > 0) AS near, arg_min(t, (-n2, t)) AS far FROM c GROUP BY id) x ON x.id = l.id""")
def _(t):
    return geo.impute_building_type(subjects(t), t.listings).select("subject_id", "detected_type", "radius_m")


@query("building_type_sources", f"""
    SELECT subject_id, id, url, CAST(floor(d * 1000) AS BIGINT) AS distance_m, rank FROM (
        SELECT a.id AS subject_id, b.id, b.url, {hav('a', 'b')} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {hav('a', 'b')}, b.id) AS rank
        FROM listings a JOIN listings b ON b.building_type = 'panel' AND {hav('a', 'b')} <= 0.5) WHERE rank <= 3""")
def _(t):
    d = t.listings.select(F.col("id").alias("subject_id"), "lat", "lon", F.lit("panel").alias("detected_type"), F.lit(500.0).alias("radius_m"))
    return geo.building_type_sources(d, t.listings)


@query("impute_building_info", f"""
    WITH p AS (SELECT a.id AS s, b.id, b.total_floors AS f, b.house_year AS y, b.building_type AS t, {hav('a', 'b')} * 1000 AS d FROM listings a
               JOIN listings b ON abs(a.lat - b.lat) < 0.003 AND abs(a.lon - b.lon) < 0.006),
         q AS (SELECT *, CASE WHEN d <= 10 THEN 10 WHEN d <= 50 THEN 50 ELSE 150 END AS ring FROM p WHERE d <= 150),
         w AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, id) AS rn FROM (SELECT *, min(ring) OVER (PARTITION BY s) AS r0 FROM q) WHERE d <= r0),
         k AS (SELECT * FROM w WHERE rn <= 10)
    SELECT b.s AS subject_id, b.n AS sources_count, mf.v AS total_floors, my.v AS building_year, mt.v AS building_type, CASE WHEN b.n >= 3 THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT s, count(*) AS n FROM k GROUP BY s) b
    LEFT JOIN (SELECT s, arg_min(v, (-c, first)) AS v FROM (SELECT s, f AS v, count(*) AS c, min(rn) AS first FROM k WHERE f <> 0 GROUP BY s, f) GROUP BY s) mf ON mf.s = b.s
    LEFT JOIN (SELECT s, arg_min(v, (-c, first)) AS v FROM (SELECT s, y AS v, count(*) AS c, min(rn) AS first FROM k WHERE y <> 0 GROUP BY s, y) GROUP BY s) my ON my.s = b.s
    LEFT JOIN (SELECT s, arg_min(v, (-c, first)) AS v FROM (SELECT s, t AS v, count(*) AS c, min(rn) AS first FROM k WHERE t IS NOT NULL GROUP BY s, t) GROUP BY s) mt ON mt.s = b.s""")
def _(t):
    return geo.impute_building_info(subjects(t), t.listings)


@query("geocode_local", """
    SELECT c_custkey AS id, k.lat, k.lon, k.address AS address_formatted FROM customer LEFT JOIN (
        SELECT CAST(regexp_extract(address, 'street ([0-9]+)', 1) AS BIGINT) AS h, arg_max(round(lat, 6), (last_seen, id)) AS lat, arg_max(round(lon, 6), (last_seen, id)) AS lon,
               arg_max(address, (last_seen, id)) AS address FROM listings GROUP BY 1) k ON k.h = c_custkey % 80""")
def _(t):
    q = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("г. Москва, ул. Street "), (F.col("c_custkey") % 80).cast("string")).alias("address"))
    return r(geo.geocode_local(q, t.listings).select("id", "lat", "lon", "address_formatted"), 6)


@query("geocode_street", """
    SELECT c_custkey AS id, k.lat, k.address AS address_formatted FROM customer LEFT JOIN (
        SELECT id % 60 AS s, arg_max(round(lat, 6), (last_seen, id)) AS lat, arg_max(concat('Москва, Хвойн', translate(CAST(id % 60 AS VARCHAR), '0123456789', 'абвгдежзик'), 'ая ул., ', CAST(id % 90 + 1 AS VARCHAR)), (last_seen, id)) AS address
        FROM listings GROUP BY 1) k ON k.s = c_custkey % 80""")
def _(t):
    # texts without a house number
    street = lambda n: F.concat(F.lit("Хвойн"), F.translate(n.cast("string"), "0123456789", "абвгдежзик"), F.lit("ая"))
    l = t.listings.withColumn("address", F.concat(F.lit("Москва, "), street(F.col("id") % 60), F.lit(" ул., "), (F.col("id") % 90 + 1).cast("string")))
    q = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("г. Москва, улица "), street(F.col("c_custkey") % 80)).alias("address"))
    return r(geo.geocode_local(q, l).select("id", "lat", "address_formatted"), 6)


H = "CAST(('0x' || substr(md5(concat(CAST(a.id AS VARCHAR), '{}')), 1, 8)) AS BIGINT) / 4294967296.0 * 2 - 1"


@query("geocode_by_district", f"""
    SELECT a.id, round(d.center_lat + ({H.format('lat')}) * 0.01, 5) AS lat, round(d.center_lon + ({H.format('lon')}) * 0.01, 5) AS lon
    FROM listings a JOIN districts d ON d.district_id = a.district_id WHERE a.id % 7 = 0""")
def _(t):
    l = t.listings.withColumn("lat", F.when(F.col("id") % 7 != 0, F.col("lat")))
    return r(geo.geocode_by_district(l, t.districts), 5)


@query("nearby_deals", f"""
    WITH p AS (SELECT * FROM (SELECT s.id AS subject_id, s.house_year AS ty, s.area_total AS a, d.id AS deal_id, d.deal_price, d.area, d.year_build AS cy, d.deal_date, {hav('s', 'd')} AS km,
                   row_number() OVER (PARTITION BY s.id ORDER BY {hav('s', 'd')}, d.id) AS rn
               FROM listings s JOIN deals d ON abs(d.lat - s.lat) < 0.02 AND abs(d.lon - s.lon) < 0.05 WHERE d.deal_price > 0 AND d.area > 0 AND d.deal_date >= {T} - INTERVAL 365 DAY
                 AND {hav('s', 'd')} <= 2) WHERE rn <= 60),
         m AS (SELECT *, area >= 20 AND NOT (CASE WHEN ty >= 2000 THEN cy < 1990 WHEN ty < 1990 THEN cy >= 2000 ELSE false END) AND (a = 0 OR area / a BETWEEN 0.5 AND 1.5) AS ok FROM p),
         n AS (SELECT *, count(*) OVER (PARTITION BY subject_id) AS n, count(*) FILTER (WHERE ok) OVER (PARTITION BY subject_id) AS n_ok FROM m)
    SELECT subject_id, deal_id, deal_price, area, deal_date, round(km * 1000, 3) AS distance_m, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY km, deal_id) AS rank FROM n WHERE ok OR (n_ok < 3 AND n >= 3)) WHERE rank <= 20""")
def _(t):
    return r(geo.nearby_deals(subjects(t), t.deals, AS_OF), 3, "distance_m")


# --- duplicates ------------------------------------------------------------------------

snippet("posts", """
    SELECT l.id, concat('Street ', CAST(l.id % 60 AS VARCHAR)) AS address, concat('R', CAST(l.id % 7 AS VARCHAR)) AS resolved_address, area_total + (l.id // 60 % 4) * CAST(0.8 AS DOUBLE) AS area_total, rooms, first_seen,
           CASE WHEN l.id % 5 = 0 THEN first_seen - INTERVAL 30 DAY END AS published_at, is_active, md5(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g'))) AS description_hash
    FROM listings l LEFT JOIN documents d ON d.doc_id = l.id""")
snippet("post_pairs", """
    SELECT a.id, b.id AS other, coalesce(b.first_seen, b.published_at) AS date, coalesce(a.published_at, a.first_seen) AS own, false AS near, 1.0::DOUBLE AS score, 'exact_match' AS reason
    FROM posts a JOIN posts b ON b.id <> a.id AND b.is_active AND ((a.address = b.address AND a.area_total = b.area_total AND a.rooms = b.rooms)
      OR (a.description_hash = b.description_hash AND (a.address = b.address OR a.resolved_address = b.resolved_address)))
    UNION ALL
    SELECT a.id, b.id, coalesce(b.first_seen, b.published_at), coalesce(a.published_at, a.first_seen), true, 1 - abs(a.area_total - b.area_total) / 10, 'similar_area'
    FROM posts a JOIN posts b ON b.is_active AND a.address = b.address AND a.rooms = b.rooms AND abs(b.area_total - a.area_total) <= 2
      AND a.area_total <> b.area_total AND a.area_total <> 0""")
snippet("reposts", """
    SELECT id, orig AS original_listing_id, score AS similarity_score, reason AS match_reason FROM (
        SELECT id, arg_min(other, (date, near, other)) AS orig, arg_min(score, (date, near, other)) AS score, arg_min(reason, (date, near, other)) AS reason,
               min(date) AS date, any_value(own) AS own FROM post_pairs GROUP BY id) WHERE own > date""")


def posts(t):
    d = t.documents.select(F.col("doc_id").alias("id"), dup.text_fingerprint(F.col("text")).alias("description_hash"))
    i = F.col("id")
    return t.listings.select("id", F.concat(F.lit("Street "), (i % 60).cast("string")).alias("address"), F.concat(F.lit("R"), (i % 7).cast("string")).alias("resolved_address"),
                             (F.col("area_total") + F.expr("id div 60 % 4") * 0.8).alias("area_total"), "rooms", "first_seen", F.when(i % 5 == 0, F.col("first_seen") - F.expr("INTERVAL 30 DAYS")).alias("published_at"), "is_active").join(d, "id", "left")


@query("text_fingerprint", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS fingerprint FROM documents")
def _(t):
    return t.documents.select("doc_id", dup.text_fingerprint(F.col("text")).alias("fingerprint"))


@query("exact_originals", "SELECT id, arg_min(other, (date, other)) AS original FROM post_pairs WHERE NOT near GROUP BY id")
def _(t):
    return dup.exact_originals(posts(t)).select("id", F.col("match.id").alias("original"))


@query("near_originals", "SELECT id, arg_min(other, (date, other)) AS original, round(arg_min(score, (date, other)), 6) AS score FROM post_pairs WHERE near GROUP BY id")
def _(t):
    return r(dup.near_originals(posts(t)).select("id", F.col("match.id").alias("original"), F.col("match.score").alias("score")), 6)


@query("match_counts", """
    SELECT a.id, count(b.id) FILTER (WHERE a.area_total = b.area_total AND a.id <> b.id) AS exact_matches, count(b.id) FILTER (WHERE a.area_total <> b.area_total) AS near_matches
    FROM posts a LEFT JOIN posts b ON b.is_active AND a.address = b.address AND a.rooms = b.rooms AND abs(a.area_total - b.area_total) <= 2 WHERE a.rooms IS NOT NULL GROUP BY a.id""")
def _(t):
    return dup.match_counts(posts(t))


@query("detect_reposts", "SELECT id, original_listing_id, round(similarity_score, 6) AS similarity_score, match_reason FROM reposts")
def _(t):
    return r(dup.detect_reposts(posts(t)), 6)


@query("duplicate_links", f"""
    SELECT original_listing_id, id AS duplicate_listing_id, match_reason, {T} AS detected_at FROM reposts
    UNION ALL SELECT id, id + 1, 'old', {T} - INTERVAL 9 DAY FROM posts p WHERE id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM reposts r WHERE r.original_listing_id = p.id AND r.id = p.id + 1)""")
def _(t):
    p = posts(t)
    old = p.where("id % 50 = 0").select(F.col("id").alias("original_listing_id"), (F.col("id") + 1).alias("duplicate_listing_id"), F.lit(0.9).alias("similarity_score"),
                                        F.lit("old").alias("match_reason"), (F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 9 DAYS")).alias("detected_at"))
    return dup.link_duplicates(old, p.withColumns({"is_repost": F.lit(False), "original_listing_id": F.lit(None).cast("long")}), dup.detect_reposts(p), AS_OF)[0].drop("similarity_score")


@query("repost_flags", """
    SELECT p.id, r.id IS NOT NULL AS is_repost, r.original_listing_id FROM posts p LEFT JOIN reposts r ON r.id = p.id""")
def _(t):
    p = posts(t).withColumns({"is_repost": F.lit(False), "original_listing_id": F.lit(None).cast("long")})
    none = p.limit(0).select(F.col("id").alias("original_listing_id"), F.col("id").alias("duplicate_listing_id"), F.lit(1.0).alias("similarity_score"),
                             F.lit("").alias("match_reason"), F.col("first_seen").alias("detected_at"))
    return dup.link_duplicates(none, p, dup.detect_reposts(p), AS_OF)[1].select("id", "is_repost", "original_listing_id")


# Chains of up to 12 steps: every listing but each 13th is a repost of the one before.
@query("repost_chain_history", """
    WITH RECURSIVE chain AS (
        SELECT id, id AS listing_id, 0 AS depth FROM listings
        UNION ALL SELECT c.id, c.listing_id - 1, c.depth + 1 FROM chain c WHERE c.listing_id % 13 <> 0 AND c.depth < 10)
    SELECT c.id, c.depth, c.listing_id, p.seen_at, p.price FROM chain c JOIN listing_prices p ON p.id = c.listing_id""")
def _(t):
    l = t.listings.select("id", F.when(F.col("id") % 13 != 0, F.col("id") - 1).alias("original_listing_id"))
    return dup.chain_history(l, t.listing_prices)


# --- quick estimates -------------------------------------------------------------------

PLACES = {"one": "%street 1%", "two": "%street 2%", "five": "%street 5_,%", "none": "%nowhere%"}


@query("locality_estimate", """
    WITH pts AS (SELECT v.name AS locality, l.id, l.rooms, l.area_total AS ca, l.last_seen, p.seen_at, p.price, p.price / l.area_total AS psm
                 FROM listings l JOIN listing_prices p ON p.id = l.id JOIN (VALUES ('one', '%street 1%'), ('two', '%street 2%'), ('five', '%street 5_,%')) v(name, pat) ON l.address ILIKE v.pat
                 WHERE l.area_total > 0 AND p.price > 0),
         s AS (SELECT id AS subject_id, ['one', 'two', 'five', 'none'][id % 4 + 1] AS locality, area_total, rooms, floor, total_floors FROM listings),
         m AS (SELECT * FROM (SELECT s.subject_id, pts.psm, row_number() OVER (PARTITION BY s.subject_id ORDER BY pts.last_seen DESC, pts.id, pts.seen_at DESC, pts.price) AS rn
               FROM s JOIN pts ON pts.locality = s.locality AND pts.rooms = s.rooms AND pts.ca BETWEEN s.area_total * 0.7 AND s.area_total * 1.3) WHERE rn <= 20),
         f AS (SELECT subject_id, list_sort(list(psm))[count(*) // 2 + 1] AS psm, count(*) AS n, min(psm) AS lo, max(psm) AS hi FROM m GROUP BY subject_id),
         b AS (SELECT list_sort(list(psm))[count(*) // 2 + 1] AS psm, count(*) AS n, min(psm) AS lo, max(psm) AS hi FROM (SELECT psm FROM pts WHERE locality = 'two' ORDER BY last_seen DESC, id, seen_at DESC, price LIMIT 20)),
         j AS (SELECT s.*, coalesce(f.psm, b.psm) AS psm, coalesce(f.n, b.n) AS n, coalesce(f.lo, b.lo) AS lo, coalesce(f.hi, b.hi) AS hi, f.n IS NULL AS used_fallback,
                      CASE WHEN floor = 1 THEN 0.95 WHEN floor = total_floors THEN 0.97 ELSE 1 END AS adj FROM s LEFT JOIN f ON f.subject_id = s.subject_id CROSS JOIN b)
    SELECT subject_id, round(psm * adj * area_total, 4) AS price, round(psm * adj, 3) AS price_sqm, n AS comparables, round(lo * area_total * 0.95, 4) AS min_price,
           round(hi * area_total * 1.05, 4) AS max_price, used_fallback FROM j""")
def _(t):
    names = F.array(*[F.lit(x) for x in PLACES])
    s = t.listings.select(F.col("id").alias("subject_id"), F.element_at(names, (F.col("id") % 4 + 1).cast("int")).alias("locality"), "area_total", "rooms", "floor", "total_floors")
    pats = t.spark.createDataFrame([(k, v) for k, v in PLACES.items() if k != "none"], "locality string, pattern string")
    return r(r(loc.locality_estimate(s, t.listings, t.listing_prices, pats, "two"), 3, "price_sqm"), 4, "price", "min_price", "max_price")


snippet("room_subjects", "SELECT id AS subject_id, area_total, CASE WHEN id % 5 <> 0 THEN building_type END AS building_type, CASE WHEN id % 3 <> 0 THEN lat END AS lat, lon FROM listings")


@query("estimate_rooms", f"""
    WITH c AS (SELECT s.subject_id, l.rooms AS r, count(*) AS n FROM room_subjects s JOIN listings l ON l.building_type = s.building_type AND abs(l.area_total - s.area_total) <= 10
                 AND l.rooms IS NOT NULL AND (s.lat IS NULL OR {hav('s', 'l')} <= 5) GROUP BY 1, 2),
         k AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, r) AS rn FROM c),
         b AS (SELECT subject_id, arg_min(r, rn) AS rooms, max(n) / sum(n) AS conf FROM k WHERE rn <= 3 GROUP BY subject_id)
    SELECT s.subject_id, coalesce(b.rooms, CASE WHEN building_type IS NULL THEN CASE WHEN area_total < 45 THEN 1 WHEN area_total < 70 THEN 2 WHEN area_total < 90 THEN 3 WHEN area_total < 120 THEN 4 ELSE 5 END
               WHEN area_total < 45 THEN 1 WHEN area_total < 70 THEN 2 ELSE 3 END) AS rooms,
           round(coalesce(b.conf, CASE WHEN building_type IS NULL THEN CASE WHEN area_total < 30 THEN 0.6 WHEN area_total < 90 THEN 0.7 WHEN area_total < 120 THEN 0.6 ELSE 0.5 END
               WHEN area_total < 70 THEN 0.6 ELSE 0.5 END), 6) AS confidence FROM room_subjects s LEFT JOIN b ON b.subject_id = s.subject_id""")
def _(t):
    i = F.col("id")
    s = t.listings.select(i.alias("subject_id"), "area_total", F.when(i % 5 != 0, F.col("building_type")).alias("building_type"), F.when(i % 3 != 0, F.col("lat")).alias("lat"), "lon")
    return r(loc.estimate_rooms(s, t.listings), 6)


@query("renovation_adjusted", """
    SELECT doc_id, quality + toxic + 1 AS cls, CASE quality + toxic + 1 WHEN 1 THEN 0.85 WHEN 2 THEN 1.00 WHEN 3 THEN 1.10 ELSE 1.20 END AS coef FROM labels""")
def _(t):
    cls = F.col("quality") + F.col("toxic") + 1
    return t.labels.select("doc_id", cls.alias("cls"), loc.renovation_coef(cls).alias("coef"))


# --- the same market at 69 degrees north, on both sides of the date line -----------------
EAST = "CASE WHEN {0} + 142.3 >= 180 THEN {0} + 142.3 - 360 ELSE {0} + 142.3 END"
snippet("moved", f"SELECT * REPLACE (lat + 13.5 AS lat, {EAST.format('lon')} AS lon) FROM listings")
snippet("moved_centres", f"SELECT * REPLACE (lat + 13.5 AS lat, {EAST.format('lon')} AS lon) FROM zone_centres")


def moved(df, lat="lat", lon="lon"):
    return df.withColumns({lat: F.col(lat) + 13.5, lon: F.expr(EAST.format(lon))})


@query("points_in_radius_moved", f"""
    SELECT a.id AS subject_id, count(b.id) AS points, round(min({hav('a', 'b')}) * 1000, 3) AS nearest_m FROM moved a
    JOIN moved b ON abs(a.lat - b.lat) < 0.02 AND {hav('a', 'b')} <= 1.5 GROUP BY a.id""")
def _(t):
    m = moved(t.listings)
    return r(geo.within_radius(m.select(F.col("id").alias("subject_id"), "lat", "lon"), m.select("lat", "lon"), 1500).select("subject_id", "points", "nearest_m"), 3)


@query("district_by_nearest_moved", f"""
    SELECT id, arg_min(district_id, (d, -level, district_id)) AS district_id, round(min(d) * 1000, 3) AS distance_m
    FROM (SELECT l.id, z.district_id, z.level, {hav('l', 'z')} AS d FROM moved l CROSS JOIN moved_centres z) GROUP BY id HAVING min(d) < 9""")
def _(t):
    out = geo.assign_by_nearest(moved(t.listings), moved(zones(t), "center_lat", "center_lon"), max_m=9000)
    return r(out.select("id", "district_id", "distance_m"), 3)


@query("nearest_sources_moved", f"""
    SELECT a.id AS subject_id, least(count(*), 10) AS sources_count FROM moved a JOIN moved b ON abs(a.lat - b.lat) < 0.002 AND {hav('a', 'b')} * 1000 <= 150
    JOIN (SELECT a.id, min(CASE WHEN {hav('a', 'b')} * 1000 <= 10 THEN 10 WHEN {hav('a', 'b')} * 1000 <= 50 THEN 50 ELSE 150 END) AS ring FROM moved a
          JOIN moved b ON abs(a.lat - b.lat) < 0.002 AND {hav('a', 'b')} * 1000 <= 150 GROUP BY a.id) f ON f.id = a.id AND {hav('a', 'b')} * 1000 <= f.ring
    GROUP BY a.id""")
def _(t):
    return geo.impute_building_info(moved(subjects(t)), moved(t.listings)).select("subject_id", "sources_count")
