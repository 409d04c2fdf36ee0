"""Merges, price facts, price movements and snapshots."""

from pyspark.sql import functions as F

from hearthmark.operators import merge, price_history
from hearthmark.operators.market import ts
from hearthmark.plans.q_market import r
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF

SPLIT = "2000-01-01 00:00:00"

# Listings known before the split, and a batch seen from then on with some fields missing.
snippet("cur_listings", f"""
    SELECT id, url, rooms, area_total, address, house_year, first_seen, first_seen AS last_seen, id % 3 = 0 AS is_active
    FROM listings WHERE first_seen < TIMESTAMP '{SPLIT}' AND id % 5 <> 0""")
snippet("batch_listings", f"""
    SELECT id, concat(url, '#b') AS url, CASE WHEN id % 4 = 0 THEN NULL ELSE rooms END AS rooms, area_total + 1 AS area_total,
           address, CASE WHEN id % 2 = 0 THEN house_year + 1 END AS house_year
    FROM listings WHERE last_seen >= TIMESTAMP '{SPLIT}' AND id % 3 <> 1""")


def cur_listings(t):
    return t.listings.where((F.col("first_seen") < ts(SPLIT)) & (F.col("id") % 5 != 0)).select(
        "id", "url", "rooms", "area_total", "address", "house_year", "first_seen", F.col("first_seen").alias("last_seen"),
        (F.col("id") % 3 == 0).alias("is_active"))


def batch_listings(t):
    return t.listings.where((F.col("last_seen") >= ts(SPLIT)) & (F.col("id") % 3 != 1)).select(
        "id", F.concat("url", F.lit("#b")).alias("url"), F.when(F.col("id") % 4 != 0, F.col("rooms")).alias("rooms"),
        (F.col("area_total") + 1).alias("area_total"), "address", F.when(F.col("id") % 2 == 0, F.col("house_year") + 1).alias("house_year"))


def old_prices(t):
    return t.listing_prices.where(F.col("seen_at") < ts(SPLIT))


def new_prices(t):
    return t.listing_prices.where(F.col("seen_at") >= ts(SPLIT))


@query("merge_listings", f"""
    SELECT coalesce(c.id, b.id) AS id, CASE WHEN b.id IS NULL THEN c.url ELSE b.url END AS url,
           CASE WHEN b.id IS NULL THEN c.rooms ELSE b.rooms END AS rooms,
           CASE WHEN b.id IS NULL THEN c.area_total ELSE b.area_total END AS area_total,
           CASE WHEN b.id IS NULL THEN c.address ELSE b.address END AS address, coalesce(b.house_year, c.house_year) AS house_year,
           coalesce(c.first_seen, TIMESTAMP '{AS_OF}') AS first_seen,
           CASE WHEN b.id IS NULL THEN c.last_seen ELSE TIMESTAMP '{AS_OF}' END AS last_seen,
           CASE WHEN b.id IS NULL THEN c.is_active ELSE true END AS is_active
    FROM cur_listings c FULL JOIN batch_listings b ON b.id = c.id""")
def _(t):
    return merge.merge_listings(cur_listings(t), batch_listings(t), AS_OF)


@query("patch_details", """
    SELECT c.id, c.url, coalesce(b.rooms, c.rooms) AS rooms, coalesce(b.house_year, c.house_year) AS house_year
    FROM cur_listings c LEFT JOIN batch_listings b ON b.id = c.id""")
def _(t):
    return merge.patch_details(cur_listings(t).select("id", "url", "rooms", "house_year"), batch_listings(t).select("id", "rooms", "house_year"))


@query("overwrite_address_ids", """
    SELECT c.id, c.url, CASE WHEN b.id IS NULL THEN c.rooms ELSE b.rooms END AS rooms
    FROM cur_listings c LEFT JOIN batch_listings b ON b.id = c.id""")
def _(t):
    return merge.overwrite_columns(cur_listings(t).select("id", "url", "rooms"), batch_listings(t).select("id", "rooms"))


@query("append_price_changes", f"""
    SELECT id, seen_at, price FROM (
        SELECT b.id, b.seen_at, b.price, coalesce(lag(b.price) OVER (PARTITION BY b.id ORDER BY b.seen_at), s.price) AS before
        FROM (SELECT id, seen_at, round(price / 40000) AS price FROM listing_prices WHERE seen_at >= TIMESTAMP '{SPLIT}') b
        LEFT JOIN (SELECT id, round(arg_max(price, seen_at) / 40000) AS price FROM listing_prices
                   WHERE seen_at < TIMESTAMP '{SPLIT}' GROUP BY id) s ON s.id = b.id)
    WHERE before IS NULL OR before <> price""")
def _(t):
    coarse = lambda df: df.withColumn("price", F.round(F.col("price") / 40000))
    return merge.append_price_changes(coarse(old_prices(t)), coarse(new_prices(t)))


@query("append_new_facts", """
    SELECT id, seen_at, min(price) AS price FROM listing_prices WHERE id % 3 <> 0 OR seen_at >= TIMESTAMP '2001-01-01' GROUP BY id, seen_at""")
def _(t):
    stored = t.listing_prices.where("id % 3 = 0 AND seen_at < TIMESTAMP_NTZ '2001-01-01'")
    twice = t.listing_prices.unionByName(t.listing_prices.withColumn("price", F.col("price") + 1))
    return merge.append_new(stored, twice, ["id", "seen_at"], ["price"])


@query("upsert_snapshot", """
    SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v
    FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def _(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"))
    return merge.upsert_snapshot(base.where("k % 2 = 0"), base.where("k % 3 = 0").withColumn("v", F.col("v") + 1), ["k", "date"])


@query("retention", f"""
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}' - INTERVAL 1500 DAY OR o_orderstatus <> 'F'""")
def _(t):
    return merge.retain(t.orders, "o_orderdate", 1500, AS_OF, F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("deactivate_unseen", "SELECT id, is_active AND CAST(last_seen AS DATE) >= DATE '2001-10-30' AS is_active FROM listings")
def _(t):
    return merge.deactivate(t.listings, "2001-10-30 12:00:00").select("id", "is_active")


@query("price_change_rollup", """
    SELECT id, arg_min(price, seen_at) AS initial_price, arg_max(price, seen_at) AS price,
           count(*) FILTER (WHERE prev <> price) AS price_change_count,
           round((arg_max(price, seen_at) - arg_min(price, seen_at)) / arg_min(price, seen_at) * 100, 6) AS price_change_pct
    FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at) AS prev FROM listing_prices) GROUP BY id""")
def _(t):
    return r(merge.price_change_rollup(t.listing_prices), 6, "price_change_pct")


@query("merge_lots", f"""
    SELECT coalesce(c.platform_id, b.platform_id) AS platform_id, coalesce(c.external_id, b.external_id) AS external_id,
           CASE WHEN b.external_id IS NULL THEN c.status ELSE b.status END AS status,
           CASE WHEN b.external_id IS NULL THEN c.current_price ELSE b.current_price END AS current_price, coalesce(b.lat, c.lat) AS lat,
           coalesce(c.first_seen_at, TIMESTAMP '{AS_OF}') AS first_seen_at,
           CASE WHEN b.external_id IS NULL THEN c.last_seen_at ELSE TIMESTAMP '{AS_OF}' END AS last_seen_at
    FROM (SELECT platform_id, external_id, status, current_price, lat, auction_date AS first_seen_at, auction_date AS last_seen_at
          FROM auction_lots WHERE id % 3 <> 0) c
    FULL JOIN (SELECT CASE source_type WHEN 'fssp' THEN 0 WHEN 'bankrupt' THEN 1 WHEN 'bank_pledge' THEN 2 ELSE 3 END AS platform_id, external_id,
                      CASE WHEN id % 4 = 0 THEN NULL ELSE status END AS status, current_price * 2 AS current_price,
                      CASE WHEN id % 2 = 0 THEN lat END AS lat FROM auction_lots WHERE id % 7 = 0) b
      ON b.platform_id = c.platform_id AND b.external_id = c.external_id""")
def _(t):
    lots = t.auction_lots
    cur = lots.where("id % 3 <> 0").select("platform_id", "external_id", "status", "current_price", "lat",
                                           F.col("auction_date").alias("first_seen_at"), F.col("auction_date").alias("last_seen_at"))
    batch = lots.where("id % 7 = 0").select(
        F.lit(None).cast("int").alias("platform_id"), "source_type", "external_id", F.when(F.col("id") % 4 != 0, F.col("status")).alias("status"),
        (F.col("current_price") * 2).alias("current_price"), F.when(F.col("id") % 2 == 0, F.col("lat")).alias("lat"))
    return merge.merge_lots(cur, batch, platforms(t), AS_OF)


def platforms(t):
    """Auction platforms over the four source types, from the suppliers."""
    kinds = F.array(*[F.lit(x) for x in ("fssp", "bankrupt", "bank_pledge", "dgi_moscow")])
    return t.supplier.select(
        F.col("s_suppkey").cast("int").alias("id"), F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("source_type"),
        F.concat(F.lit("Platform "), F.col("s_suppkey").cast("string")).alias("name"))


snippet("auction_platforms", """
    SELECT CAST(s_suppkey AS INT) AS id, ['fssp', 'bankrupt', 'bank_pledge', 'dgi_moscow'][s_suppkey % 4 + 1] AS source_type,
           concat('Platform ', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier""")


@query("derived_lot_columns", f"""
    SELECT id, round(CASE WHEN area_total > 0 THEN current_price / area_total END, 6) AS price_per_sqm,
           CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN round(lon, 6) END AS point_lon, TIMESTAMP '{AS_OF}' AS updated_at FROM auction_lots""")
def _(t):
    out = merge.derive_lot_columns(t.auction_lots, AS_OF)
    return r(out.select("id", "price_per_sqm", F.col("point.lon").alias("point_lon"), "updated_at"), 6)


@query("versioned_history", """
    SELECT id, stock, valid_from, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) AS valid_to,
           lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) IS NULL AS is_current
    FROM (SELECT product_id AS id, collected_at AS valid_from, in_stock AS stock,
                 lag(in_stock) OVER (PARTITION BY product_id ORDER BY collected_at) AS before FROM product_offers)
    WHERE before IS NULL OR before <> stock""")
def _(t):
    ev = t.product_offers.select(F.col("product_id").alias("id"), "collected_at", F.col("in_stock").alias("stock"))
    return merge.versioned_history(ev, ["id"], ["stock"], "collected_at")


@query("manual_marks", """
    SELECT l.id, coalesce(m.err = 'error', false) AS is_error, CASE WHEN m.err = 'error' THEN m.txt END AS error_comment,
           m.contact IS NOT NULL AS contacted, m.risk IS NOT NULL AS risk_cleared, m.marked_at
    FROM (SELECT id FROM listings) l LEFT JOIN (
        SELECT user_id AS id,
               arg_max(CASE event_type WHEN 'error' THEN 'error' ELSE 'clear_error' END, (ts, event_type)) FILTER (WHERE event_type IN ('error', 'view')) AS err,
               arg_max(props, (ts, event_type)) FILTER (WHERE event_type IN ('error', 'view')) AS txt,
               arg_max(event_type, ts) FILTER (WHERE event_type = 'click') AS contact,
               arg_max(event_type, ts) FILTER (WHERE event_type = 'purchase') AS risk,
               max(ts) FILTER (WHERE event_type IN ('error', 'view', 'click', 'purchase')) AS marked_at
        FROM events GROUP BY user_id) m ON m.id = l.id""")
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("error", "error", "view", "clear_error", "click", "contacted", "purchase", "clear_risk")])
    marks = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("marked_at"), F.try_element_at(names, "event_type").alias("action"),
                            F.col("props").alias("comment")).where("action IS NOT NULL")
    return merge.apply_marks(t.listings.select("id"), marks).select("id", "is_error", "error_comment", "contacted", "risk_cleared", "marked_at")


@query("snapshot_run_stats", """
    SELECT count(*) FILTER (WHERE id % 5 <> 0) AS lots_found, count(*) FILTER (WHERE id % 3 = 0 AND id % 5 <> 0) AS lots_new,
           count(*) FILTER (WHERE id % 3 <> 0 AND id % 5 <> 0 AND id % 4 = 0) AS lots_updated,
           count(*) FILTER (WHERE id % 3 <> 0 AND id % 5 = 0)
             + count(*) FILTER (WHERE id % 3 <> 0 AND id % 5 <> 0 AND id % 4 = 0 AND status <> 'completed') AS lots_closed FROM auction_lots""")
def _(t):
    lots = t.auction_lots.select("id", "status", "current_price")
    after = lots.where("id % 5 <> 0").withColumn("current_price", F.when(F.col("id") % 4 == 0, F.col("current_price") + 1).otherwise(F.col("current_price"))) \
        .withColumn("status", F.when(F.col("id") % 4 == 0, "completed").otherwise(F.col("status")))
    return merge.run_stats(lots.where("id % 3 <> 0"), after, ["id"], ["status", "current_price"], F.col("status") == "completed")


@query("price_drops", """
    SELECT l.id, url, address, rooms, area_total, prev AS prev_price, price AS current_price, round((price - prev) / prev * 100, 6) AS change_percent, seen_at
    FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at) AS prev FROM listing_prices) p JOIN listings l ON l.id = p.id
    WHERE prev IS NOT NULL AND (price - prev) / prev <= -0.05 AND is_active""")
def _(t):
    return r(price_history.price_drops(t.listings, t.listing_prices), 6, "change_percent")


snippet("timeline", """
    SELECT *, (price_minor - prev_price_minor) / prev_price_minor * 100 AS price_change_percent FROM (
        SELECT *, lag(price_minor) OVER (PARTITION BY product_id ORDER BY collected_at) AS prev_price_minor FROM product_offers)""")


@query("price_timeline", """
    SELECT product_id, collected_at, price_minor, in_stock, prev_price_minor, round(price_change_percent, 6) AS price_change_percent FROM timeline""")
def _(t):
    return r(price_history.price_timeline(t.product_offers), 6)


@query("daily_drops", """
    SELECT t.product_id, p.name, p.brand, s.name AS source, t.collected_at, prev_price_minor, price_minor, in_stock,
           round(price_change_percent, 6) AS price_change_percent, p.source_id
    FROM timeline t JOIN products p ON p.id = t.product_id JOIN product_sources s ON s.id = p.source_id
    WHERE price_change_percent <= -5 AND collected_at >= TIMESTAMP '2001-10-01' AND p.is_active""")
def _(t):
    return r(price_history.daily_drops(t.products, t.product_sources, t.product_offers, "2001-10-01 09:00:00"), 6)


@query("dedupe_by_url", """
    SELECT url, arg_max(id, (last_seen, id)) AS id FROM listings GROUP BY url""")
def _(t):
    return price_history.dedupe_by(t.listings.select("url", "id", "last_seen"), ["url"], [F.desc("last_seen"), F.desc("id")]).select("url", "id")


@query("address_group_count", "SELECT id, address, count(*) OVER (PARTITION BY address) AS group_count FROM listings")
def _(t):
    return price_history.with_group_count(t.listings.select("id", "address"), ["address"])


@query("best_level", """
    SELECT c_custkey AS id, arg_max(district_id, (level, -district_id)) AS district_id, max(level) AS level
    FROM customer JOIN districts ON district_id = c_nationkey OR district_id = 1000 + c_nationkey % 5 GROUP BY c_custkey""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"),
                          F.explode(F.array(F.col("c_nationkey"), 1000 + F.col("c_nationkey") % 5)).alias("district_id"))
    return price_history.best_level(c.join(t.districts.select("district_id", "level"), "district_id"))


@query("exposure_stats", f"""
    SELECT l.id, datediff('day', CAST(coalesce(o.first_seen, l.first_seen) AS DATE), DATE '{AS_OF[:10]}') AS days_on_market,
           l.initial_price, c.price AS current_price, round((c.price - l.initial_price) / l.initial_price * 100, 6) AS price_change_pct,
           c.n AS price_change_count, l.orig IS NOT NULL AS is_repost
    FROM (SELECT *, CASE WHEN id % 6 = 5 THEN id - 5 END AS orig FROM listings) l LEFT JOIN listings o ON o.id = l.orig
    LEFT JOIN (SELECT id, arg_max(price, seen_at) AS price, count(*) FILTER (WHERE prev <> price) AS n
               FROM (SELECT *, lag(price) OVER (PARTITION BY id ORDER BY seen_at) AS prev FROM listing_prices) GROUP BY id) c ON c.id = l.id""")
def _(t):
    l = t.listings.withColumn("original_listing_id", F.when(F.col("id") % 6 == 5, F.col("id") - 5))
    return r(price_history.exposure_stats(l, merge.price_change_rollup(t.listing_prices), AS_OF), 6, "price_change_pct")


# --- batches that repeat ids, and versions of nullable columns --------------------------
snippet("repeated_batch", """
    SELECT b.* REPLACE (b.rooms + k AS rooms), k AS page FROM batch_listings b, range(0, 3) x(k) WHERE k = 0 OR id % 3 = 0""")


def repeated_batch(t):
    """The batch as read from result pages: every third listing stands on three pages, the last page counts."""
    pages = F.when(F.col("id") % 3 == 0, F.array(*[F.lit(k).cast("long") for k in range(3)])).otherwise(F.array(F.lit(0).cast("long")))
    return batch_listings(t).withColumn("page", F.explode(pages)).withColumn("rooms", (F.col("rooms") + F.col("page")).cast("int"))


@query("merge_repeated_ids", """
    SELECT coalesce(c.id, b.id) AS id, CASE WHEN b.id IS NULL THEN c.url ELSE b.url END AS url,
           CAST(CASE WHEN b.id IS NULL THEN c.rooms ELSE b.rooms END AS INT) AS rooms
    FROM cur_listings c FULL JOIN (SELECT * FROM repeated_batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY page DESC) = 1) b ON b.id = c.id""")
def _(t):
    return merge.merge(cur_listings(t).select("id", "url", "rooms"), repeated_batch(t).select("id", "url", "rooms", "page"), ["id"], overwrite=["url", "rooms"], order=["page"])


@query("patch_repeated_ids", """
    SELECT c.id, CAST(coalesce(b.rooms, c.rooms) AS INT) AS rooms FROM cur_listings c
    LEFT JOIN (SELECT * FROM repeated_batch QUALIFY row_number() OVER (PARTITION BY id ORDER BY page DESC) = 1) b ON b.id = c.id""")
def _(t):
    return merge.patch_details(cur_listings(t).select("id", "rooms"), repeated_batch(t).select("id", "rooms", "page"), order=["page"])


@query("versioned_history_nulls", """
    SELECT id, a, b, valid_from, lead(valid_from) OVER w AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM (
        SELECT *, lag(valid_from) OVER v IS NULL OR lag(a) OVER v IS DISTINCT FROM a OR lag(b) OVER v IS DISTINCT FROM b AS fresh FROM (
            SELECT product_id AS id, collected_at AS valid_from, CASE WHEN in_stock THEN 'x' END AS a, CASE WHEN price_minor % 2 = 0 THEN 'x' END AS b FROM product_offers)
        WINDOW v AS (PARTITION BY id ORDER BY valid_from)) WHERE fresh WINDOW w AS (PARTITION BY id ORDER BY valid_from)""")
def _(t):
    ev = t.product_offers.select(F.col("product_id").alias("id"), "collected_at", F.when(F.col("in_stock"), "x").alias("a"), F.when(F.col("price_minor") % 2 == 0, "x").alias("b"))
    return merge.versioned_history(ev, ["id"], ["a", "b"], "collected_at")
