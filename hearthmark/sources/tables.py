"""Table scans and the market tables derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Instants the market tables are valued at: one day after the last price point / event day.
AS_OF = "2001-11-05 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The views below are plain SQL that Spark and other engines read alike.
# name -> (tables and views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "listing_prices": (("lineitem",), """
        SELECT l_partkey AS id, l_shipdate AS seen_at, max(l_extendedprice) AS price
        FROM lineitem GROUP BY l_partkey, l_shipdate"""),
    "listings": (("part", "lineitem"), """
        SELECT p_partkey AS id,
               concat('https://example.test/', CAST(p_partkey % 1900 AS STRING)) AS url,
               CAST(p_partkey % 5 AS INT) AS region,
               CASE WHEN p_partkey % 4 = 0 THEN 'rent' ELSE 'sale' END AS deal_type,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size % 6 END AS rooms,
               CAST(CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE 15 + 2 * p_size END AS DOUBLE) AS area_total,
               CAST(1 + p_partkey % 20 AS INT) AS floor,
               CAST(20 + (p_partkey * 7) % 6 - CASE WHEN p_partkey % 20 < 5 THEN 15 ELSE 0 END AS INT) AS total_floors,
               CASE p_type WHEN 'ECONOMY' THEN 'panel' WHEN 'STANDARD' THEN 'brick' WHEN 'MEDIUM' THEN 'monolithic'
                           WHEN 'SMALL' THEN 'block' WHEN 'LARGE' THEN 'wood' END AS building_type,
               CAST(1950 + (p_partkey * 13) % 75 AS INT) AS house_year,
               concat('Town, street ', CAST(p_partkey % 60 AS STRING), ', ', CAST(p_size AS STRING)) AS address,
               CASE p_partkey % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'Realtor' ELSE 'builder' END AS seller_type,
               CAST(55.5 + ((p_partkey * 37) % 1000) / 2000.0 AS DOUBLE) AS lat,
               CAST(37.3 + ((p_partkey * 91) % 1000) / 1250.0 AS DOUBLE) AS lon,
               CAST(CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey % 25 END AS INT) AS district_id,
               p_retailprice * 50 AS initial_price,
               x.first_seen, x.last_seen, p_partkey % 10 <> 0 AS is_active
        FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen
                        FROM lineitem GROUP BY l_partkey) x ON x.l_partkey = p_partkey"""),
    "price_paid": (("orders", "customer", "nation", "region"), """
        SELECT o_orderdate AS date, o_totalprice AS price, n_name AS town, r_name AS district,
               c_mktsegment AS postcode1, o_orderpriority AS type,
               CASE o_orderstatus WHEN 'F' THEN 'freehold' WHEN 'O' THEN 'leasehold' ELSE 'unknown' END AS duration
        FROM orders JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"""),
    "auction_lots": (("orders", "customer"), """
        SELECT o_orderkey AS id, CAST(o_orderkey % 10 AS INT) AS platform_id,
               concat('lot-', CAST(o_orderkey AS STRING)) AS external_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'fssp' WHEN 1 THEN 'bankrupt' WHEN 2 THEN 'bank_pledge' ELSE 'dgi_moscow' END AS source_type,
               CASE o_orderkey % 3 WHEN 0 THEN 'apartment' WHEN 1 THEN 'room' ELSE 'land' END AS property_type,
               CASE o_orderkey % 5 WHEN 0 THEN 'announced' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status,
               CAST(20 + o_orderkey % 100 AS DOUBLE) AS area_total, o_totalprice AS current_price,
               o_totalprice * 1.1 AS initial_price, o_orderdate AS auction_date, c_mktsegment AS city,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(55.5 + ((o_orderkey * 37) % 1000) / 2000.0 AS DOUBLE) END AS lat,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(37.3 + ((o_orderkey * 91) % 1000) / 1250.0 AS DOUBLE) END AS lon
        FROM orders JOIN customer ON c_custkey = o_custkey"""),
    "product_offers": (("lineitem",), """
        SELECT l_partkey AS product_id, l_shipdate AS collected_at,
               CAST(round(max(l_extendedprice) * 100) AS BIGINT) AS price_minor,
               max(l_returnflag) <> 'R' AS in_stock
        FROM lineitem GROUP BY l_partkey, l_shipdate"""),
    "products": (("part",), """
        SELECT p_partkey AS id, CAST(p_partkey % 10 AS INT) AS source_id, p_name AS name, p_brand AS brand,
               p_type AS category, p_partkey % 9 <> 0 AS is_active FROM part"""),
    "product_sources": (("supplier",), """
        SELECT CAST(s_suppkey AS INT) AS id, s_name AS name FROM supplier"""),
    "deals": (("lineitem", "listings"), """
        SELECT l_partkey * 100000 + CAST(datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') AS BIGINT) AS id,
               l_shipdate AS deal_date, max(l_extendedprice) AS deal_price,
               max(l.area_total) AS area, max(l.lat) AS lat, max(l.lon) AS lon, max(l.house_year) AS year_build,
               max(l.floor) AS floor, max(l.address) AS street
        FROM lineitem JOIN listings l ON l.id = l_partkey
        WHERE l_returnflag = 'R' GROUP BY l_partkey, l_shipdate"""),
    "districts": (("nation", "region", "listings"), """
        SELECT n_nationkey AS district_id, n_name AS name, concat('Area ', n_name) AS full_name,
               1000 + n_regionkey AS parent_district_id, 2 AS level, c.center_lat, c.center_lon
        FROM nation LEFT JOIN (SELECT district_id, avg(lat) AS center_lat, avg(lon) AS center_lon
                               FROM listings GROUP BY district_id) c ON c.district_id = n_nationkey
        UNION ALL
        SELECT 1000 + r_regionkey, r_name, concat('Area ', r_name), NULL, 1, NULL, NULL FROM region"""),
}


def view_text(name: str, dialect: str = "spark") -> str:
    text = VIEWS[name][1]
    if dialect == "duckdb":
        text = text.replace("datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01')",
                            "datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))")
    return text


class Tables:
    """Lazy access to base tables and market tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in VIEWS:
                deps, text = VIEWS[name]
                for d in deps:
                    text = _mark(text, d)
                self._seen[name] = self.spark.sql(text, **{d: getattr(self, d) for d in deps})
            else:
                self._seen[name] = load(self.spark, self.folder, name)
        return self._seen[name]


def _mark(text: str, name: str) -> str:
    import re
    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
