"""Price-paid dashboards."""

from pyspark.sql import functions as F

from hearthmark.operators import pricepaid as pp
from hearthmark.plans.q_market import r
from hearthmark.plans.registry import query, snippet

PP_AS_OF = "2001-07-01 00:00:00"
D = "DATE '2001-07-01'"
COND = "district = 'ASIA'"
AVG = "round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*))"
AVG_F = f"round(CAST(sum(CAST(price AS DECIMAL(18,2))) FILTER (WHERE {COND}) AS DOUBLE) / count(*) FILTER (WHERE {COND}))"


def cond():
    return pp.area_condition(district="ASIA")


@query("paid_sold_over_time", f"""
    SELECT CAST(date_trunc('year', date) AS DATE) AS year, count(*) FILTER (WHERE {COND}) AS filtered_count,
           CAST(round(count(*) / count(DISTINCT district)) AS BIGINT) AS count FROM price_paid GROUP BY 1""")
def _(t):
    return pp.sold_over_time(t.price_paid, cond(), pp.area_column(district="ASIA"))


@query("paid_sold_over_time_all", """
    SELECT CAST(date_trunc('year', date) AS DATE) AS year, CAST(round(count(*) / count(DISTINCT town)) AS BIGINT) AS count FROM price_paid GROUP BY 1""")
def _(t):
    return pp.sold_over_time(t.price_paid, None)


@query("paid_price_over_time", f"""
    SELECT CAST(date_trunc('month', date) AS DATE) AS month, {AVG_F} AS filter_price, {AVG} AS avg FROM price_paid GROUP BY 1""")
def _(t):
    return pp.price_over_time(t.price_paid, cond())


@query("paid_price_stats", f"""
    SELECT round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS avg, round(quantile_cont(price, 0.5), 4) AS median,
           round(quantile_cont(price, 0.95), 4) AS p95, round(quantile_cont(price, 0.99), 4) AS p99, count(*) AS sold
    FROM price_paid WHERE date > {D} - INTERVAL 6 MONTH AND {COND}""")
def _(t):
    return r(pp.price_stats(t.price_paid, cond(), PP_AS_OF))


@query("paid_yearly_averages", f"SELECT CAST(year(date) AS INT) AS year, {AVG_F} AS filter_avg, {AVG} AS avg FROM price_paid GROUP BY 1")
def _(t):
    return pp.yearly_averages(t.price_paid, cond())


snippet("pp_yearly", f"SELECT year(date) AS year, {AVG_F} AS filter_avg, {AVG} AS avg FROM price_paid GROUP BY 1")


@query("paid_price_increase", """
    SELECT n AS year, CASE WHEN b.avg > 0 THEN CAST(floor((l.avg - b.avg) / b.avg * 100 + 0.5) AS BIGINT) ELSE 0 END AS national,
           CASE WHEN b.filter_avg > 0 THEN CAST(floor((l.filter_avg - b.filter_avg) / b.filter_avg * 100 + 0.5) AS BIGINT) ELSE 0 END AS regional
    FROM (VALUES (10), (5), (3), (1)) v(n)
    JOIN (SELECT *, row_number() OVER (ORDER BY year DESC) AS rn FROM pp_yearly) b ON b.rn = n + 1
    JOIN (SELECT *, row_number() OVER (ORDER BY year DESC) AS rn FROM pp_yearly) l ON l.rn = 1""")
def _(t):
    return pp.price_increase(t.price_paid, cond())


@query("paid_price_rank", f"""
    WITH w AS (SELECT * FROM price_paid WHERE date > {D} - INTERVAL 6 MONTH),
         a AS (SELECT {AVG_F} AS filtered_avg, {AVG} AS avg FROM w),
         q AS (SELECT i, quantile_disc_i FROM (SELECT unnest(range(100)) AS i, unnest(quantile_cont(price, [{', '.join(str(i / 100) for i in range(100))}])) AS quantile_disc_i FROM w))
    SELECT coalesce(min(i) FILTER (WHERE quantile_disc_i > filtered_avg), -1) - 1 AS quantile, filtered_avg, avg FROM q, a GROUP BY filtered_avg, avg""")
def _(t):
    return pp.price_rank(t.price_paid, cond(), PP_AS_OF)


@query("paid_by_duration", f"""
    SELECT duration AS name, count(*) FILTER (WHERE {COND}) AS value FROM price_paid WHERE duration IN ('freehold', 'leasehold') GROUP BY 1""")
def _(t):
    return pp.by_duration(t.price_paid, cond())


@query("paid_by_duration_where", f"SELECT duration AS name, count(*) AS value FROM price_paid WHERE duration <> 'unknown' AND {COND} GROUP BY 1")
def _(t):
    return pp.by_duration(t.price_paid, cond(), "where")


@query("paid_by_duration_all", "SELECT duration AS name, count(*) AS value FROM price_paid WHERE duration <> 'unknown' GROUP BY 1")
def _(t):
    return pp.by_duration(t.price_paid, None, "where")


@query("paid_by_type", f"""
    SELECT type, count(*) FILTER (WHERE {COND}) AS filtered_count, CAST(round(count(*) / count(DISTINCT district)) AS BIGINT) AS count FROM price_paid GROUP BY 1""")
def _(t):
    return pp.by_type(t.price_paid, cond(), "district")


@query("paid_sold_by_period", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS value FROM price_paid WHERE {COND} AND date >= {D} - INTERVAL {m} MONTH"
    + (f" AND date < {D} - INTERVAL {m - 6} MONTH" if m > 6 else "") for m, n in ((6, '6 months'), (12, '1 year'), (18, '18 months'), (24, '2 years'))))
def _(t):
    return pp.sold_by_period(t.price_paid, cond(), PP_AS_OF)


BOX = """round(quantile_cont(price, 0.25)) AS p25, round(quantile_cont(price, 0.5)) AS median, round(quantile_cont(price, 0.75)) AS p75, round(max(price)) AS max"""


@query("paid_price_by_type", f"""
    SELECT type, 'all' AS scope, round(min(price)) + 100 AS min, {BOX} FROM price_paid GROUP BY type
    UNION ALL SELECT type, 'filtered', round(min(price)), {BOX} FROM price_paid WHERE {COND} GROUP BY type""")
def _(t):
    return pp.price_by_type(t.price_paid, cond())


def day_sql(year):
    return f"""
    SELECT CAST({year} AS INT) AS year, CAST(d.day AS DATE) AS day, count(p.price) AS c
    FROM (SELECT unnest(generate_series(DATE '{year}-01-01', DATE '{year}-12-31', INTERVAL 1 DAY)) AS day) d
    LEFT JOIN price_paid p ON p.date >= d.day AND p.date < d.day + INTERVAL 1 DAY AND {COND} GROUP BY d.day"""


@query("paid_sales_by_day_previous", day_sql(2000))
def _(t):
    return pp.sales_by_day(t.price_paid, cond(), 2000)


@query("paid_sales_by_day_current", day_sql(2001))
def _(t):
    return pp.sales_by_day(t.price_paid, cond(), 2001)


@query("paid_min_max", f"""
    SELECT round(quantile_cont(price, 0.01)) AS min_price, round(quantile_cont(price, 0.99)) AS max_price FROM price_paid
    WHERE date > {D} - INTERVAL 18 MONTH AND {COND}""")
def _(t):
    return pp.min_max(t.price_paid, cond(), PP_AS_OF)


@query("paid_popular_towns", f"SELECT town, count(*) AS popularity FROM price_paid WHERE {COND} GROUP BY town ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return pp.popular(t.price_paid, "town", {"district": "ASIA"})


@query("paid_popular_districts", "SELECT district, count(*) AS popularity FROM price_paid GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return pp.popular(t.price_paid, "district")


@query("paid_popular_postcodes", f"""
    SELECT postcode1, count(*) AS popularity FROM price_paid WHERE {COND} AND town = 'NATION_2' AND postcode1 <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    return pp.popular(t.price_paid, "postcode1", {"district": "ASIA", "town": "NATION_2"})


@query("paid_house_sales", f"SELECT count(*) FILTER (WHERE {COND}) AS area_count, count(*) AS national_count FROM price_paid")
def _(t):
    return pp.house_sales(t.price_paid, cond())


def rollup_sql(grain, expr):
    return f"""SELECT {expr} AS {grain}, count(*) AS sales, count(*) FILTER (WHERE {COND}) AS filtered_count,
        CAST(round(count(*) / count(DISTINCT district)) AS BIGINT) AS count, {AVG} AS avg, {AVG_F} AS filter_price,
        min(price) AS min, min(price) FILTER (WHERE {COND}) AS min_filtered, max(price) AS max, max(price) FILTER (WHERE {COND}) AS max_filtered
        FROM price_paid GROUP BY 1"""


@query("paid_rollup_year", rollup_sql("year", "CAST(date_trunc('year', date) AS DATE)"))
def _(t):
    return pp.query_rollup(pp.build_rollup(t.price_paid, "year"), "year", cond(), "district")


@query("paid_rollup_month", rollup_sql("month", "CAST(date_trunc('month', date) AS DATE)"))
def _(t):
    return pp.query_rollup(pp.build_rollup(t.price_paid, "month"), "month", cond(), "district")


@query("paid_rollup_type", rollup_sql("type", "type"))
def _(t):
    return pp.query_rollup(pp.build_rollup(t.price_paid, "type"), "type", cond(), "district")


@query("paid_rollup_quantiles")
def _(t):
    return pp.query_rollup(pp.build_rollup(t.price_paid, "type"), "type", cond(), "district", [0.25, 0.5, 0.75]).select("type", "q25", "q50", "q75")


@query("paid_rollup_quantile_ranks", "SELECT type, count(price) AS n, true AS ok_25, true AS ok_50, true AS ok_75 FROM price_paid GROUP BY type")
def _(t):
    return pp.quantile_ranks(t.price_paid, "type", [0.25, 0.5, 0.75]).select("type", "n", "ok_25", "ok_50", "ok_75")
