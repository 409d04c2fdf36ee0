"""Auctions, products, priorities and monitoring."""

from pyspark.sql import functions as F

from hearthmark.operators import auctions, latest, merge, monitor, products
from hearthmark.operators.market import ts
from hearthmark.plans.q_lifecycle import platforms
from hearthmark.plans.q_market import r, ratings
from hearthmark.plans.registry import query, snippet
from hearthmark.sources.tables import AS_OF, EVENTS_AS_OF

# Market estimate per lot as given by an outside valuation: price moved by up to +-50 % along the key.
snippet("comparison", """
    SELECT id AS lot_id, current_price * (50 + id % 101) / 100 AS market_price_estimate, CAST(id % 12 AS INT) AS comparables_count,
           (current_price * (50 + id % 101) / 100 - current_price) / (current_price * (50 + id % 101) / 100) * 100 AS discount_from_market
    FROM auction_lots WHERE id % 4 <> 3""")
snippet("compared", """
    SELECT l.*, c.market_price_estimate, c.discount_from_market, c.comparables_count FROM auction_lots l LEFT JOIN comparison c ON c.lot_id = l.id""")


def comparison(t):
    est = F.col("current_price") * (50 + F.col("id") % 101) / 100
    return t.auction_lots.where("id % 4 <> 3").select(
        F.col("id").alias("lot_id"), est.alias("market_price_estimate"), (F.col("id") % 12).cast("int").alias("comparables_count"),
        ((est - F.col("current_price")) / est * 100).alias("discount_from_market"))


OPEN = "status IN ('announced', 'active')"


@query("lots_active", f"""
    SELECT l.id, l.source_type, p.name AS platform_name, current_price, auction_date, round(discount_from_market, 6) AS discount_from_market
    FROM compared l LEFT JOIN auction_platforms p ON p.id = l.platform_id WHERE {OPEN}""")
def _(t):
    return r(auctions.active_lots(t.auction_lots, platforms(t), comparison(t)).select(
        "id", "source_type", "platform_name", "current_price", "auction_date", "discount_from_market"), 6, "discount_from_market")


@query("lots_search", f"""
    SELECT id, city, current_price, round(discount_from_market, 6) AS discount_from_market, (SELECT count(*) FROM compared WHERE source_type = 'fssp' AND {OPEN}
        AND city ILIKE '%build%' AND discount_from_market >= 5) AS total FROM compared
    WHERE source_type = 'fssp' AND {OPEN} AND city ILIKE '%build%' AND discount_from_market >= 5 ORDER BY compared.discount_from_market DESC NULLS LAST, id LIMIT 20""")
def _(t):
    spec = auctions.LotSearch("fssp", "active", "build", 5.0, "discount")
    return r(auctions.search_lots(t.auction_lots, comparison(t), spec).select("id", "city", "current_price", "discount_from_market", "total"), 6, "discount_from_market")


AVGP = "CAST(sum(CAST(current_price AS DECIMAL(18,2))) AS DOUBLE) / count(*)"


@query("lots_by_source", f"""
    SELECT source_type, status, count(*) AS lots, round({AVGP}, 4) AS avg_price, round(avg(current_price / nullif(area_total, 0)), 4) AS avg_price_per_sqm,
           round(avg(area_total), 4) AS avg_area FROM auction_lots GROUP BY source_type, status""")
def _(t):
    return r(auctions.lots_by_source(t.auction_lots))


@query("lots_overview", f"""
    SELECT count(*) AS total_lots, count(*) FILTER (WHERE {OPEN}) AS active_lots, count(*) FILTER (WHERE status = 'completed') AS completed_lots,
           round(CAST(sum(CAST(current_price AS DECIMAL(18,2))) FILTER (WHERE {OPEN}) AS DOUBLE) / count(*) FILTER (WHERE {OPEN}), 4) AS avg_price,
           round(avg(area_total) FILTER (WHERE {OPEN}), 4) AS avg_area, round(avg(current_price / nullif(area_total, 0)) FILTER (WHERE {OPEN}), 4) AS avg_price_per_sqm,
           count(discount_from_market) FILTER (WHERE {OPEN}) AS with_comparison, round(avg(discount_from_market) FILTER (WHERE {OPEN}), 4) AS avg_discount,
           count(*) FILTER (WHERE {OPEN} AND discount_from_market >= 20) AS discount_20_plus, count(*) FILTER (WHERE {OPEN} AND discount_from_market >= 30) AS discount_30_plus,
           count(*) FILTER (WHERE {OPEN} AND auction_date >= TIMESTAMP '2001-03-01' AND auction_date <= TIMESTAMP '2001-03-08') AS upcoming FROM compared""")
def _(t):
    return r(auctions.lot_overview(t.auction_lots, comparison(t), "2001-03-01 00:00:00"))


@query("lots_overview_by_source", f"""
    SELECT source_type, count(*) AS total, count(*) FILTER (WHERE {OPEN}) AS active,
           round(CAST(sum(CAST(current_price AS DECIMAL(18,2))) FILTER (WHERE {OPEN}) AS DOUBLE) / count(*) FILTER (WHERE {OPEN}), 4) AS avg_price
    FROM auction_lots GROUP BY source_type""")
def _(t):
    return r(auctions.overview_by_source(t.auction_lots))


@query("lots_best_deals", f"SELECT id, current_price, round(discount_from_market, 6) AS discount_from_market, comparables_count FROM compared WHERE {OPEN} AND discount_from_market > 10")
def _(t):
    return r(auctions.best_deals(t.auction_lots, comparison(t)).select("id", "current_price", "discount_from_market", "comparables_count"), 6, "discount_from_market")


@query("lots_of_city", f"SELECT id, auction_date FROM auction_lots WHERE {OPEN} AND city = 'BUILDING' AND property_type = 'apartment'")
def _(t):
    return auctions.city_lots(t.auction_lots, "BUILDING").select("id", "auction_date")


@query("lots_merge_comparison", """
    SELECT lot_id, CASE WHEN lot_id % 2 = 0 THEN 1 ELSE comparables_count END AS comparables_count FROM comparison WHERE lot_id % 2 = 0 OR lot_id % 3 = 0""")
def _(t):
    c = comparison(t).select("lot_id", "comparables_count")
    return auctions.merge_comparison(c.where("lot_id % 3 = 0"), c.where("lot_id % 2 = 0").withColumn("comparables_count", F.lit(1)))


@query("lots_price_history", """
    SELECT lot_id, price, recorded_at, rank FROM (SELECT id AS lot_id, price, seen_at AS recorded_at,
        row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, price DESC) AS rank FROM listing_prices) WHERE rank <= 20""")
def _(t):
    return auctions.lot_price_history(t.listing_prices.select(F.col("id").alias("lot_id"), "price", F.col("seen_at").alias("recorded_at")))


@query("lots_winning_bids", """
    SELECT l_orderkey AS lot_id, count(*) AS bids, arg_max(l_suppkey, (l_extendedprice, -epoch_us(l_shipdate), l_suppkey)) AS bidder, max(l_extendedprice) AS bid_amount,
           arg_max(l_suppkey, (l_extendedprice, -epoch_us(l_shipdate), l_suppkey)) FILTER (WHERE l_linenumber = 1) AS winner
    FROM lineitem GROUP BY l_orderkey""")
def _(t):
    bids = t.lineitem.select(F.col("l_orderkey").alias("lot_id"), F.col("l_suppkey").alias("bidder"), F.col("l_extendedprice").alias("bid_amount"),
                             F.col("l_shipdate").alias("bid_at"), (F.col("l_linenumber") == 1).alias("is_winner"))
    return auctions.winning_bids(bids).select("lot_id", "bids", "bidder", "bid_amount", "winner")


@query("lots_daily_stats", """
    SELECT d.scrape_date, p.source_type, p.name AS platform_name, d.lots_found FROM (
        SELECT platform_id, CAST(auction_date AS DATE) AS scrape_date, count(*) AS lots_found FROM auction_lots GROUP BY 1, 2) d JOIN auction_platforms p ON p.id = d.platform_id""")
def _(t):
    stats = t.auction_lots.groupBy("platform_id", F.to_date("auction_date").alias("scrape_date")).agg(F.count(F.lit(1)).alias("lots_found"))
    return auctions.daily_scrape_stats(stats, platforms(t)).drop("platform_id")


@query("offers_latest", """
    SELECT p.id AS product_id, source_id, name, brand, o.collected_at, o.price_minor, o.in_stock FROM products p JOIN (
        SELECT product_id, max(collected_at) AS collected_at, arg_max(price_minor, collected_at) AS price_minor, arg_max(in_stock, collected_at) AS in_stock
        FROM product_offers GROUP BY product_id) o ON o.product_id = p.id WHERE is_active""")
def _(t):
    return products.latest_offers(t.products, t.product_offers).drop("category", "is_active")


@query("products_inactive", f"""
    SELECT p.id, p.is_active AND o.seen >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS is_active FROM products p
    JOIN (SELECT product_id, max(collected_at) AS seen FROM product_offers GROUP BY 1) o ON o.product_id = p.id""")
def _(t):
    seen = t.product_offers.groupBy(F.col("product_id").alias("id")).agg(F.max("collected_at").alias("last_seen_at"))
    return merge.mark_inactive(t.products.join(seen, "id"), AS_OF).select("id", "is_active")


@query("products_facet", "SELECT id, name FROM products WHERE brand = 'Brand#2' AND category = 'ECONOMY'")
def _(t):
    p = t.products.withColumn("category_path", F.array(F.lit("home"), F.col("category")))
    return products.facet(p, "Brand#2", "ECONOMY").select("id", "name")


@query("failure_summary", """
    SELECT l_orderkey AS run_id, l_returnflag AS error_type, o_custkey AS source_id, count(*) AS failures,
           count(*) FILTER (WHERE l_linestatus = 'O') AS unresolved, max(l_shipdate) AS last_failure
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def _(t):
    f = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("error_type"), F.col("l_shipdate").alias("failed_at"),
                          F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("resolved_at"))
    return products.failure_summary(f, t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id")))


snippet("tasks", """
    SELECT city AS source, external_id, concat('u', external_id) AS url, CAST(id % 5 AS INT) AS priority, CAST(NULL AS VARCHAR) AS metadata,
           CASE id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'retrying' ELSE 'completed' END AS status,
           CAST(id % 3 AS INT) AS retry_count, 2 AS max_retries, auction_date AS created_at, id FROM auction_lots""")


def tasks(t):
    i = F.col("id")
    return t.auction_lots.select(
        F.col("city").alias("source"), "external_id", F.concat(F.lit("u"), "external_id").alias("url"), (i % 5).cast("int").alias("priority"),
        F.lit(None).cast("string").alias("metadata"),
        F.when(i % 4 == 0, "pending").when(i % 4 == 1, "in_progress").when(i % 4 == 2, "retrying").otherwise("completed").alias("status"),
        (i % 3).cast("int").alias("retry_count"), F.lit(2).alias("max_retries"), F.col("auction_date").alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("error_message"), "id")


@query("tasks_merge", f"""
    SELECT source, external_id, CASE WHEN id % 3 = 0 THEN 'new' ELSE url END AS url, CASE WHEN id % 3 = 0 THEN 9 ELSE priority END AS priority,
           CASE WHEN id % 2 = 0 THEN status ELSE 'pending' END AS status,
           CASE WHEN id % 2 = 0 THEN created_at ELSE TIMESTAMP '{AS_OF}' END AS created_at FROM tasks WHERE id % 2 = 0 OR id % 3 = 0""")
def _(t):
    x = tasks(t)
    cur = x.where("id % 2 = 0").drop("id")
    inc = x.where("id % 3 = 0").select("source", "external_id", F.lit("new").alias("url"), F.lit(9).alias("priority"), "metadata")
    return products.merge_tasks(cur, inc, AS_OF).select("source", "external_id", "url", "priority", "status", "created_at")


@query("tasks_next", """
    SELECT source, external_id, priority, created_at FROM tasks WHERE status IN ('pending', 'retrying')
    ORDER BY priority DESC, created_at, source, external_id LIMIT 25""")
def _(t):
    return products.next_batch(tasks(t), 25).select("source", "external_id", "priority", "created_at")


@query("tasks_transition", f"""
    SELECT external_id, CASE WHEN id % 4 <> 1 THEN status WHEN id % 3 = 0 THEN 'completed' WHEN retry_count < 2 THEN 'retrying' ELSE 'failed' END AS status,
           CASE WHEN id % 4 = 1 AND id % 3 <> 0 THEN retry_count + 1 ELSE retry_count END AS retry_count,
           CASE WHEN id % 4 = 1 AND (id % 3 = 0 OR retry_count >= 2) THEN TIMESTAMP '{AS_OF}' END AS completed_at FROM tasks""")
def _(t):
    x = tasks(t)
    out = x.where("id % 4 = 1").select("source", "external_id", (F.col("id") % 3 == 0).alias("ok"), F.lit(True).alias("retry"), F.lit("timeout").alias("error"))
    return products.transition(x, out, AS_OF).select("external_id", "status", "retry_count", "completed_at")


@query("tasks_counts", "SELECT status, count(*) AS cnt FROM tasks GROUP BY status")
def _(t):
    return products.task_counts(tasks(t))


# --- priorities and monitoring --------------------------------------------------

snippet("scored", f"""
    SELECT id, current_price * 200 AS current_price, area_total, datediff('day', CAST(first_seen AS DATE), DATE '1996-01-10') AS age_days, is_active
    FROM (SELECT l.*, p.current_price FROM listings l JOIN latest_price p ON p.id = l.id)""")
P_AS_OF = "1996-01-10 00:00:00"


def scored(t):
    return latest.with_latest_price(t.listings, t.listing_prices).withColumn("current_price", F.col("current_price") * 200)


PPS = "(CASE WHEN area_total > 0 THEN current_price / area_total ELSE 0 END)"


@query("analysis_selection", f"""
    SELECT id, CAST(least(100, CASE WHEN current_price > 15000000 THEN 30 ELSE 0 END + CASE WHEN {PPS} > 250000 THEN 25 WHEN {PPS} < 150000 THEN 20 ELSE 0 END
           + CASE WHEN age_days < 1 THEN 25 WHEN age_days < 7 THEN 10 ELSE 0 END + CASE WHEN area_total > 100 THEN 10 ELSE 0 END) AS INT) AS priority_score
    FROM scored WHERE is_active AND id NOT IN (SELECT doc_id FROM labels)
      AND (current_price > 15000000 OR {PPS} > 250000 OR {PPS} < 150000 OR age_days < 1)""")
def _(t):
    return monitor.select_for_analysis(scored(t), ratings(t), "important", P_AS_OF).select("id", "priority_score")


@query("analysis_cost", """
    SELECT count(*) AS listings_count, count(*) * 2 AS total_photos, round(count(*) * 2 * 0.00425, 6) AS total_cost_usd, round(count(*) * 4.0 / 3600, 6) AS estimated_time_hours
    FROM scored WHERE is_active AND id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return r(monitor.project_cost(monitor.select_for_analysis(scored(t), ratings(t), "all", P_AS_OF), 2), 6)


# Stored prices are those before 2001, offers the newest prices of all.
snippet("market_rows", """
    SELECT l.id, CAST(l.district_id AS VARCHAR) AS district, l.rooms, l.area_total, p.price, l.is_active, l.id % 11 = 0 AS is_error
    FROM listings l JOIN (SELECT id, arg_max(price, seen_at) AS price FROM listing_prices WHERE seen_at < TIMESTAMP '2001-01-01' GROUP BY id) p ON p.id = l.id""")
snippet("deal_stats", """
    SELECT district, rooms, count(*) AS sample, avg(price / nullif(area_total, 0)) AS avg_price_per_sqm, quantile_cont(price, 0.5) AS median_price,
           quantile_cont(price, 0.25) AS p25_price FROM market_rows WHERE is_active AND NOT is_error AND district IS NOT NULL AND price > 0
    GROUP BY district, rooms HAVING count(*) >= 5""")
snippet("offers_now", """
    SELECT l.id, CAST(l.district_id AS VARCHAR) AS district, l.rooms, p.current_price AS price FROM listings l JOIN latest_price p ON p.id = l.id""")
snippet("offers_judged", """
    SELECT o.*, s.median_price, s.p25_price, coalesce(o.rooms <> 0 AND o.price > 0 AND o.price < s.p25_price, false) AS is_good_deal,
           CASE WHEN o.rooms <> 0 AND o.price > 0 AND o.price < s.p25_price THEN (1 - o.price / s.median_price) * 100 END AS discount_pct
    FROM offers_now o LEFT JOIN deal_stats s ON s.district = o.district AND s.rooms = o.rooms""")


def market_rows(t):
    p = latest.latest_prices(t.listing_prices.where("seen_at < TIMESTAMP_NTZ '2001-01-01'")).select("id", "price")
    return t.listings.select("id", F.col("district_id").cast("string").alias("district"), "rooms", "area_total", "is_active",
                             (F.col("id") % 11 == 0).alias("is_error")).join(p, "id")


def offers_now(t):
    p = latest.latest_prices(t.listing_prices).select("id", "price")
    return t.listings.select("id", F.col("district_id").cast("string").alias("district"), "rooms").join(p, "id")


@query("deal_stats", """
    SELECT district, rooms, sample, round(avg_price_per_sqm, 4) AS avg_price_per_sqm, round(median_price, 4) AS median_price, round(p25_price, 4) AS p25_price FROM deal_stats""")
def _(t):
    return r(monitor.deal_stats(market_rows(t)))


@query("good_deals", """
    SELECT id, district, rooms, price, round(median_price, 4) AS median_price, round(p25_price, 4) AS p25_price, is_good_deal, round(discount_pct, 4) AS discount_pct FROM offers_judged""")
def _(t):
    return r(monitor.good_deals(offers_now(t), monitor.deal_stats(market_rows(t))), 4, "median_price", "p25_price", "discount_pct")


@query("change_classes", """
    SELECT o.id, o.price, m.price AS old_price, CASE WHEN m.id IS NULL THEN 'NEW' WHEN m.price IS DISTINCT FROM o.price THEN 'PRICE_CHANGE' ELSE 'UNCHANGED' END AS change,
           round(CASE WHEN o.price < m.price THEN (1 - o.price / m.price) * 100 END, 4) AS drop_pct,
           coalesce(m.id IS NULL AND discount_pct >= 15, false) OR coalesce(m.price <> o.price AND is_good_deal AND o.price < m.price AND (1 - o.price / m.price) * 100 >= 10, false) AS alert
    FROM offers_judged o LEFT JOIN (SELECT * FROM market_rows WHERE id % 7 <> 0) m ON m.id = o.id""")
def _(t):
    rows = market_rows(t)
    out = monitor.classify_changes(rows.where("id % 7 <> 0"), offers_now(t), monitor.deal_stats(rows))
    return r(out.select("id", "price", "old_price", "change", "drop_pct", "alert"), 4, "drop_pct")


@query("alerts_pending", """
    SELECT e.event_id AS id, e.ts AS first_seen, p.current_price AS price FROM events e JOIN latest_price p ON p.id = e.event_id
    WHERE e.event_type = 'click' AND e.ts > TIMESTAMP '2024-01-03 09:00:00' AND e.ts <= TIMESTAMP '2024-01-03 12:00:00' AND e.event_id % 5 <> 0
    ORDER BY e.ts DESC, id LIMIT 10""")
def _(t):
    l = t.events.select(F.col("event_id").alias("id"), F.col("ts").alias("first_seen"), (F.col("event_type") == "click").alias("has_risk"))
    sent = t.events.where("event_id % 5 = 0").select(F.col("event_id").alias("id"))
    return monitor.pending_alerts(l, t.listing_prices, sent, "2024-01-03 12:00:00", 180).select("id", "first_seen", "price")


@query("ingest_counters", """
    SELECT count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS added_today, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30 17:30:00') AS added_last_hour,
           count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-30 09:00:00' AND event_type <> 'error') AS active_at_cut_off
    FROM events WHERE ts <= TIMESTAMP '2024-01-30 18:30:00'""")
def _(t):
    l = t.events.select(F.col("ts").alias("first_seen"), (F.col("event_type") != "error").alias("is_active"))
    return monitor.ingest_counters(l, "2024-01-30 18:30:00")
