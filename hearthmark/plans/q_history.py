"""Investment prices, valuation history and end-to-end valuation."""

import re

from pyspark.sql import functions as F

from hearthmark.operators import auctions, history, market, resolve, segments, valuation
from hearthmark.operators import comparables as cmp
from hearthmark.operators import investment as inv
from hearthmark.plans.q_market import r, segmented
from hearthmark.plans.q_places import zones
from hearthmark.plans.q_valuation import T, comps, points, subjects
from hearthmark.plans.registry import SNIPPETS, query, snippet
from hearthmark.sources.tables import AS_OF

# --- investment -----------------------------------------------------------------------
# Properties to buy: every auction lot at a market price of 60 times its price.

snippet("deals_to_buy", "SELECT id, current_price * 60 AS m, area_total AS a FROM auction_lots")


def to_buy(t):
    return t.auction_lots.select("id", (F.col("current_price") * 60).alias("market_price"), "area_total")


def invest_sql(kind, reno):
    """Closed form of one project type at the default parameters, utilities on (fixed costs 61 500)."""
    bank, flip = kind == "bank_flip", kind.endswith("flip")
    fc = "61500.0" if not bank else "(61500.0 + ip * 0.265 / 12 * 3 + ip * 0.0075)"
    rc = "a * 60000.0" if reno else "0.0"
    income = f"({rc} * 0.16" + (" + ip * 0.04 * 3)" if kind == "partner_flip" else ")")
    ours = {"own": "profit", "partner": "greatest(profit * 0.5, invested * 0.12)",
            }.get(kind, f"greatest((profit - {income}) * 0.5 + {income}, greatest(invested * 0.02, 1000000.0))")
    return f"""SELECT id, '{kind}' AS project_type, ip AS interest_price, profit AS expected_profit, profit / invested AS profit_rate, {ours} AS our_profit FROM (
        SELECT *, sale - ip - (fct) - (sale - ip) * 0.06 AS profit, ip + (fct) AS invested FROM (
            SELECT *, {fc} + {rc} AS fct, m * 0.93 + {rc} * 1.6 AS sale FROM (SELECT *, (m * 0.93 * 0.94 - 61500.0 * 1.12) / 1.06 AS ip FROM deals_to_buy))) WHERE ip > 0"""


OUTS = "id, project_type, round(interest_price, 2) AS interest_price, round(expected_profit, 2) AS expected_profit, round(profit_rate, 8) AS profit_rate, round(our_profit, 2) AS our_profit"
UTIL = inv.InvestParams(include_utilities=True)


def show(df):
    d = df.select("id", "project_type", "interest_price", "expected_profit", "profit_rate", "our_profit")
    return r(r(d, 8, "profit_rate"), 2, "interest_price", "expected_profit", "our_profit")


for _kind in inv.TYPES:
    def _one(t, kind=_kind):
        p = inv.with_renovation(UTIL) if kind.endswith("flip") else UTIL
        return show(inv.interest_price(to_buy(t), p, kind).where("reject_reason IS NULL"))
    query(f"interest_price_{_kind}", f"SELECT {OUTS} FROM ({invest_sql(_kind, _kind.endswith('flip'))})")(_one)


@query("interest_price_all", f"SELECT {OUTS} FROM (" + " UNION ALL ".join(invest_sql(k, k.endswith("flip")) for k in inv.TYPES) + ")")
def _(t):
    return show(inv.interest_price_all(to_buy(t), UTIL).where("reject_reason IS NULL"))


@query("interest_price_financed", """
    SELECT id, round(ip, 2) AS interest_price FROM (SELECT id, (m * 0.93 * 0.94 - (27000 + ip0 * 0.3 / 0.7) * 1.12) / 1.06 AS ip
    FROM (SELECT *, (m * 0.93 * 0.94 - 27000 * 1.12) / 1.06 AS ip0 FROM deals_to_buy)) WHERE ip > 0""")
def _(t):
    return r(inv.interest_price(to_buy(t), inv.InvestParams(include_financing=True), "own").where("reject_reason IS NULL").select("id", "interest_price"), 2)


@query("interest_price_rejects", "SELECT id FROM deals_to_buy WHERE m / 60 * 0.93 * 0.94 <= (27000 + 61500 - 27000) * 1.12")
def _(t):
    return inv.invest_rejects(inv.interest_price(t.auction_lots.select("id", F.col("current_price").alias("market_price"), "area_total"), UTIL, "own")).select("id")


@query("interest_price_simple", """
    SELECT id, round(greatest((m / a * 0.93 - (254000 / a + 1500 + 34500 / a)) / (1 + 0.12 / 0.94), 0) + 0.0000012, 4) AS psm FROM deals_to_buy""")
def _(t):
    b = to_buy(t)
    # the offset keeps values off the rounding border, where engines differ
    return r(b.select("id", (inv.interest_price_simple(F.col("market_price") / F.col("area_total"), F.col("area_total")) + 0.0000012).alias("psm")), 4)


@query("report_price", "SELECT id, round(m - (283000 + a * 1500) - greatest(m * (0.12 / 1.12), 1000000) / 0.94, 4) AS price FROM deals_to_buy")
def _(t):
    return r(to_buy(t).select("id", inv.report_interest_price(F.col("market_price"), F.col("area_total")).alias("price")))


@query("fixed_costs", """
    SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 50000 ELSE 0 END + 27000 + 11500 * (id % 5 + 1) AS DOUBLE) AS fixed_costs, CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END AS items FROM auction_lots""")
def _(t):
    d = to_buy(t).withColumns({"p_include_notary": F.col("id") % 2 == 0, "p_project_period_months": (F.col("id") % 5 + 1).cast("double")})
    return inv.fixed_costs(d, UTIL).select("id", "fixed_costs", F.size("cost_items").alias("items"))


@query("key_rate_as_of", """
    SELECT l.id, arg_max(p.price, p.seen_at) AS key_rate FROM auction_lots l LEFT JOIN (SELECT seen_at, max(price) AS price FROM listing_prices GROUP BY seen_at) p
      ON p.seen_at <= l.auction_date GROUP BY l.id""")
def _(t):
    rates = t.listing_prices.groupBy(F.col("seen_at").alias("valid_from")).agg(F.max("price").alias("key_rate"))
    return inv.with_key_rate(t.auction_lots.select("id", F.col("auction_date").alias("at")), rates).select("id", "key_rate")


# --- history --------------------------------------------------------------------------
# Valuations as recorded: one per order, addressed by customer.

snippet("history", """
    SELECT o_orderkey AS valuation_id, CASE WHEN o_custkey % 50 = 0 THEN 'Unknown' ELSE concat('Street ', CAST(o_custkey % 30 AS VARCHAR), ', house ', CAST(o_custkey AS VARCHAR)) END AS address,
           CASE WHEN o_custkey % 3 <> 0 THEN concat('street ', CAST(o_custkey // 2 AS VARCHAR)) END AS address_normalized, CAST(20 + o_orderkey % 100 AS DOUBLE) AS area_total,
           o_totalprice AS estimated_price, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 0.8 END AS interest_price, o_orderdate AS created_at FROM orders""")


def hist(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    addr = F.when(c % 50 == 0, "Unknown").otherwise(F.concat(F.lit("Street "), (c % 30).cast("string"), F.lit(", house "), c.cast("string")))
    return t.orders.select(k.alias("valuation_id"), addr.alias("address"), F.when(c % 3 != 0, F.concat(F.lit("street "), F.expr("o_custkey div 2").cast("string"))).alias("address_normalized"),
                           (20 + k % 100).cast("double").alias("area_total"), F.col("o_totalprice").alias("estimated_price"),
                           F.when(k % 4 != 0, F.col("o_totalprice") * 0.8).alias("interest_price"), F.col("o_orderdate").alias("created_at"))


@query("history_summary", """
    SELECT address, count(*) AS valuation_count, min(estimated_price) AS min_price, max(estimated_price) AS max_price,
           round(CAST(sum(CAST(estimated_price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 7) AS avg_price, min(created_at) AS first_valuation, max(created_at) AS last_valuation,
           CAST(datediff('day', min(created_at), max(created_at)) AS DOUBLE) AS days_tracked FROM history GROUP BY address HAVING count(*) > 1""")
def _(t):
    return r(history.history_summary(hist(t)), 7)


@query("history_discount", "SELECT valuation_id, CASE WHEN interest_price IS NOT NULL THEN round((estimated_price - interest_price) / estimated_price * 100, 6) END AS market_discount_percent FROM history")
def _(t):
    return r(history.history_discount(hist(t)).select("valuation_id", "market_discount_percent"), 6)


snippet("history_b", """
    SELECT coalesce(address_normalized, address) AS address_key, max(address) AS address, count(*) AS valuation_count, max(created_at) AS last_valuation, max(estimated_price) AS max_price,
           min(estimated_price) AS min_price, trim(regexp_extract(max(address), '^([^,0-9]+)', 1)) AS street FROM history WHERE address <> 'Unknown' GROUP BY 1""")


@query("history_buildings", "SELECT * FROM history_b")
def _(t):
    return history.history_buildings(hist(t))


@query("history_by_street", "SELECT street, count(*) AS buildings, CAST(sum(valuation_count) AS BIGINT) AS total_valuations, max(last_valuation) AS last_valuation FROM history_b GROUP BY street")
def _(t):
    return history.history_by_street(hist(t))


@query("history_search", """
    SELECT valuation_id, created_at, (SELECT count(*) FROM history WHERE address <> 'Unknown' AND address ILIKE '%street 7,%') AS total FROM history
    WHERE address <> 'Unknown' AND address ILIKE '%street 7,%' ORDER BY created_at DESC, valuation_id LIMIT 20 OFFSET 20""")
def _(t):
    return history.history_search(hist(t), "street 7,", 2).select("valuation_id", "created_at", "total")


@query("history_of_address", """
    SELECT valuation_id, estimated_price, created_at, round(estimated_price - lag(estimated_price) OVER (ORDER BY created_at, valuation_id), 2) AS change
    FROM history WHERE coalesce(address_normalized, address) = 'street 7'""")
def _(t):
    v = history.valuations_of_address(hist(t), "street 7")
    return r(v.select("valuation_id", "estimated_price", "created_at", "change"), 2, "change")


@query("listing_detail", """
    SELECT l.id, l.current_price, CAST(coalesce(h.n, 0) AS INT) AS points, h.last_price FROM all_priced l LEFT JOIN (
        SELECT id, count(*) AS n, arg_max(price, seen_at) AS last_price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, price DESC) AS rn FROM listing_prices)
        WHERE rn <= 20 GROUP BY id) h ON h.id = l.id""")
def _(t):
    d = history.listing_detail(t.listings, t.listing_prices)
    return d.select("id", "current_price", F.coalesce(F.size("price_history"), F.lit(0)).alias("points"), F.get("price_history", F.lit(0))["price"].alias("last_price"))


@query("history_adjusted", f"""
    SELECT h.valuation_id, CASE WHEN a.user_id IS NULL THEN h.interest_price ELSE nullif(a.v, 0) END AS interest_price, a.v AS price_adjustment, nullif(a.note, '') AS adjustment_note,
           CASE WHEN a.v <> 0 THEN {T} END AS adjusted_at
    FROM history h LEFT JOIN (SELECT user_id, arg_max(value, (ts, event_type)) AS v, arg_max(event_type, (ts, event_type)) AS note FROM events GROUP BY user_id) a ON a.user_id = h.valuation_id""")
def _(t):
    none = F.lit(None).cast("double")
    a = t.events.select(F.col("user_id").alias("valuation_id"), F.col("ts").alias("requested_at"), F.col("value").alias("price_adjustment"), F.col("event_type").alias("note"),
                        F.col("value").alias("interest_price"), none.alias("interest_price_per_sqm"), none.alias("expected_profit"), none.alias("profit_rate"))
    h = hist(t).withColumns({"interest_price_per_sqm": none, "expected_profit": none, "profit_rate": none})
    return history.apply_adjustments(h, a, AS_OF).select("valuation_id", "interest_price", "price_adjustment", "adjustment_note", "adjusted_at")


@query("report_list", """
    SELECT o_orderkey AS report_id, o_orderdate AS created_at, (SELECT count(*) FROM orders WHERE o_custkey = 17 AND o_orderdate + INTERVAL 1500 DAY > TIMESTAMP '2001-11-05') AS total FROM orders
    WHERE o_custkey = 17 AND o_orderdate + INTERVAL 1500 DAY > TIMESTAMP '2001-11-05' ORDER BY o_orderdate DESC, o_orderkey LIMIT 5""")
def _(t):
    rep = t.orders.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
                          (F.col("o_orderdate") + F.expr("INTERVAL 1500 DAYS")).alias("expires_at"))
    return history.report_list(rep, AS_OF, 17, 1, 5).select("report_id", "created_at", "total")


@query("pasted_links", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN a.id ELSE b.id END AS id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN a.id IS NOT NULL THEN 'id' END ELSE CASE WHEN b.id IS NOT NULL THEN 'url' END END AS matched_by,
           CASE WHEN c_custkey % 2 = 0 THEN a.current_price ELSE b.current_price END AS current_price
    FROM customer LEFT JOIN all_priced a ON a.id = c_custkey LEFT JOIN (SELECT url, max(id) AS id, arg_max(current_price, id) AS current_price FROM all_priced GROUP BY url) b
      ON b.url = concat('https://example.test/', CAST(c_custkey AS VARCHAR))""")
def _(t):
    k = F.col("c_custkey").cast("string")
    links = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://x.test/sale/flat/"), k, F.lit("/"))).otherwise(
        F.concat(F.lit("https://example.test/"), k)).alias("link"))
    return resolve.resolve_urls(links, t.listings, t.listing_prices).select("k", "id", "matched_by", "current_price")


# --- recorded comparables and refinement ---------------------------------------------

@query("recorded_comparables", "SELECT subject_id AS valuation_id, c_id AS listing_id, row_number() OVER (PARTITION BY subject_id ORDER BY price_per_sqm, c_id) AS rank FROM comps")
def _(t):
    return history.record_valuations(subjects(t), comps(t), AS_OF)[1].select("valuation_id", "listing_id", "rank")


snippet("refine_left", "SELECT * FROM comps WHERE NOT (subject_id % 2 = 0 AND c_id % 4 = 0)")


@query("refined_valuations", """
    SELECT n.subject_id AS valuation_id, n.k AS remaining, n.k >= 3 AS accepted, CASE WHEN n.k >= 3 THEN round(b.s / 3 * 0.93, 3) END AS refined_price_per_sqm FROM (
        SELECT x.subject_id, count(l.c_id) AS k FROM (SELECT DISTINCT subject_id FROM comps WHERE subject_id % 2 = 0 AND c_id % 4 = 0) x LEFT JOIN refine_left l ON l.subject_id = x.subject_id GROUP BY 1) n
    LEFT JOIN (SELECT subject_id, sum(price_per_sqm) AS s FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY price_per_sqm, c_id) AS rn FROM refine_left) WHERE rn <= 3 GROUP BY 1) b ON b.subject_id = n.subject_id""")
def _(t):
    v, c = history.record_valuations(subjects(t).withColumns({"estimated_price": F.lit(1.0), "estimated_price_per_sqm": F.lit(1.0)}), comps(t), AS_OF)
    drop = c.where("valuation_id % 2 = 0 AND listing_id % 4 = 0").select("valuation_id", "listing_id", F.lit("not alike").alias("reason"))
    return r(history.refine(v, c, drop, AS_OF)[1].select("valuation_id", "remaining", "accepted", "refined_price_per_sqm"), 3)


# --- lots against the market -----------------------------------------------------------

CHAIN = ["candidates", "class_kept", "scored_comps", "comps", "knn", "iqr_kept", "bottom3"]


def chain(prefix, source):
    """The oracle's comparables chain once more over another subject table."""
    for n in CHAIN:
        text = SNIPPETS[n].replace("FROM listings s JOIN points", f"FROM {source} s JOIN points")
        for m in CHAIN:
            text = re.sub(rf"\bFROM {m}\b|\bFROM {m} c\b", lambda x: x.group(0).replace(m, prefix + m, 1), text)
        snippet(prefix + n, text)


snippet("lot_subjects", """
    SELECT id, lat, lon, area_total, CAST(1 AS INT) AS rooms, CAST(NULL AS INT) AS floor, CAST(NULL AS INT) AS total_floors, CAST(NULL AS VARCHAR) AS building_type, CAST(NULL AS INT) AS house_year,
           -1 AS self FROM auction_lots WHERE lat IS NOT NULL""")
chain("lot_", "lot_subjects")
SNIPPETS["lot_candidates"] = SNIPPETS["lot_candidates"].replace("c.id <> s.id", "c.id <> s.self")
SNIPPETS["lot_class_kept"] = SNIPPETS["lot_class_kept"].replace("NOT (CASE WHEN total_floors >= 9", "coalesce(NOT (CASE WHEN total_floors IS NULL THEN false WHEN total_floors >= 9").replace(
    "ELSE false END) AS ok", "ELSE false END), true) AS ok")


def lot_valuations(t):
    s = t.auction_lots.where("lat IS NOT NULL").select(
        F.col("id").alias("subject_id"), "lat", "lon", "area_total", F.lit(1).alias("rooms"), F.lit(None).cast("int").alias("floor"), F.lit(None).cast("int").alias("total_floors"),
        F.lit(None).cast("string").alias("building_type"), F.lit(None).cast("int").alias("building_year"), F.lit(None).cast("long").alias("exclude_id"))
    return cmp.bottom_estimate(s, cmp.comparables(s, points(t), AS_OF))


@query("lots_against_market", """
    SELECT l.id AS lot_id, round(b.psm * l.area_total, 2) AS market_price_estimate, round(b.psm, 3) AS market_price_per_sqm, b.n AS comparables_count,
           CASE WHEN b.n >= 5 THEN 75 WHEN b.n >= 3 THEN 65 ELSE 50 END AS estimation_confidence,
           round((b.psm * l.area_total - l.current_price) / (b.psm * l.area_total) * 100, 3) AS discount_from_market FROM auction_lots l JOIN lot_bottom3 b ON b.subject_id = l.id""")
def _(t):
    out = auctions.compare_with_market(t.auction_lots, lot_valuations(t)).drop("estimation_method")
    return r(r(out, 2, "market_price_estimate"), 3, "market_price_per_sqm", "discount_from_market")


# --- end to end ------------------------------------------------------------------------

def context(t, with_zones=True):
    agg = market.multidim_aggregates(segmented(t), t.listing_prices, AS_OF)
    d = zones(t) if with_zones else t.districts
    return valuation.MarketContext(t.listings, t.listing_prices, d, agg, segments.build_segments(t.listings), t.deals, AS_OF)


snippet("imputed_type", f"""
    SELECT s, arg_min(v, (-c, first)) AS t FROM (SELECT s, t AS v, count(*) AS c, min(rn) AS first FROM (
        SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, id) AS rn FROM (SELECT *, min(ring) OVER (PARTITION BY s) AS r0 FROM (
            SELECT *, CASE WHEN d <= 10 THEN 10 WHEN d <= 50 THEN 50 ELSE 150 END AS ring FROM (
                SELECT a.id AS s, b.id, b.building_type AS t, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) * 1000 AS d
                FROM listings a JOIN listings b ON abs(a.lat - b.lat) < 0.003 AND abs(a.lon - b.lon) < 0.006 WHERE a.building_type IS NULL) WHERE d <= 150)) WHERE d <= r0)
    WHERE rn <= 10 AND t IS NOT NULL GROUP BY s, t) GROUP BY s""")
snippet("near_type", f"""
    SELECT s, coalesce(arg_min(t, (-n1, t)) FILTER (WHERE n1 > 0), arg_min(t, (-n2, t))) AS t FROM (SELECT s, t, count(*) FILTER (WHERE d <= 200) AS n1, count(*) AS n2 FROM (
        SELECT a.id AS s, b.building_type AS t, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0))) * 1000 AS d
        FROM listings a JOIN listings b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.02 WHERE a.building_type IS NULL AND b.building_type IS NOT NULL) WHERE d <= 500 GROUP BY s, t) GROUP BY s""")
snippet("val_subjects", """
    SELECT l.* REPLACE (coalesce(l.building_type, i.t, n.t) AS building_type), CASE WHEN l.building_type IS NOT NULL THEN 'manual' WHEN i.t IS NOT NULL THEN 'auto' WHEN n.t IS NOT NULL THEN 'auto_nearby' END AS src
    FROM listings l LEFT JOIN imputed_type i ON i.s = l.id LEFT JOIN near_type n ON n.s = l.id WHERE l.area_total > 0""")
chain("val_", "val_subjects")


@query("value_properties", """
    SELECT s.id AS subject_id, s.building_type, s.src AS building_type_source, round(b.psm, 3) AS estimated_price_per_sqm, k.n AS comparables_count, round(k.median_psm, 3) AS market_price_per_sqm,
           CASE WHEN k.median_psm * s.area_total * 0.93 * 0.94 > 61500.0 * 1.12 THEN round((k.median_psm * s.area_total * 0.93 * 0.94 - 61500.0 * 1.12) / 1.06, 1) END AS interest_price
    FROM val_subjects s JOIN val_knn k ON k.subject_id = s.id JOIN val_bottom3 b ON b.subject_id = s.id""")
def _(t):
    # every listing with an area; those without a comparable are valued by the grid (see grid_estimate)
    v = valuation.value_properties(subjects(t).where("area_total > 0"), context(t)).where("comparables_count > 0")
    out = v.select("subject_id", "building_type", "building_type_source", "estimated_price_per_sqm", "comparables_count", "market_price_per_sqm", "interest_price")
    return r(r(out, 3, "estimated_price_per_sqm", "market_price_per_sqm"), 1, "interest_price")


@query("value_properties_all")
def _(t):
    # every listing and every column: those without a comparable or an area, the nearby deals, warnings and costs as well
    return valuation.value_properties(subjects(t), context(t))


@query("subjects_from_text", """
    SELECT c_custkey AS subject_id, CAST(c_custkey % 4 + 1 AS INT) AS rooms, 30.5 + c_custkey % 50 AS area_total, CAST(c_custkey % 9 + 1 AS INT) AS floor, CASE WHEN c_custkey % 2 = 0 THEN 17 ELSE 12 END AS total_floors,
           round(k.lat, 6) AS lat, k.house_year AS building_year, k.building_type FROM customer LEFT JOIN (
        SELECT CAST(regexp_extract(address, 'street ([0-9]+)', 1) AS BIGINT) AS h, arg_max(lat, (last_seen, id)) AS lat, arg_max(house_year, (last_seen, id)) AS house_year,
               arg_max({'v': building_type}, (last_seen, id)).v AS building_type FROM listings GROUP BY 1) k ON k.h = c_custkey % 60""")
def _(t):
    return r(valuation.subjects_from_text(text_subjects(t), t.listings).select("subject_id", "rooms", "area_total", "floor", "total_floors", "lat", "building_year", "building_type"), 6, "lat")


def text_subjects(t):
    k = F.col("c_custkey")
    st = lambda c: c.cast("string")
    text = F.concat(st(k % 4 + 1), F.lit("-комнатная квартира, "), F.format_string("%.1f", 30.5 + k % 50), F.lit(" м2, "), st(k % 9 + 1), F.lit("/12 этаж, ул. Street "), st(k % 60))
    return t.customer.select(k.alias("subject_id"), text.alias("text"), F.when(k % 2 == 0, 17).alias("o_total_floors"))


@query("value_from_text")
def _(t):
    v = valuation.value_from_text(text_subjects(t), context(t))
    return r(v.select("subject_id", "estimated_price", "confidence", "method_used", "deals_count", "interest_price"), 2)
