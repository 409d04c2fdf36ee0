"""Golden tables and properties of merges, geography, investment, streams and plans."""

import os

import pytest
from pyspark.sql import functions as F

from hearthmark.operators import comparables as cmp
from hearthmark.operators import geography as geo
from hearthmark.operators import investment as inv
from hearthmark.operators import merge
from hearthmark.plans import q_lifecycle as ql
from hearthmark.plans import q_valuation as qv
from hearthmark.plans.catalog import QUERIES
from hearthmark.sources import files
from hearthmark.sources.tables import AS_OF
from hearthmark.streaming import monitor as stream

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_life_cycle(spark):
    cols = "id long, url string, rooms int, area_living double"
    empty = spark.createDataFrame([], cols + ", first_seen timestamp_ntz, last_seen timestamp_ntz, is_active boolean")
    one = merge.merge_listings(empty, spark.createDataFrame([(1, "u1", 2, 30.0)], cols), "2024-01-01 00:00:00")
    two = merge.merge_listings(one, spark.createDataFrame([(1, "u2", None, None)], cols), "2024-01-02 00:00:00").collect()[0]
    assert (two.url, two.rooms, two.area_living, str(two.first_seen), str(two.last_seen)) == ("u2", None, 30.0, "2024-01-01 00:00:00", "2024-01-02 00:00:00")


def test_merge_idempotent(tables):
    cur, b = ql.cur_listings(tables), ql.batch_listings(tables)
    once = merge.merge_listings(cur, b, AS_OF)
    assert rows(merge.merge_listings(once, b, AS_OF)) == rows(once)


def test_price_append(spark):
    s = "id long, seen_at timestamp_ntz, price double"
    p = spark.sql("SELECT id, CAST(at AS timestamp_ntz) seen_at, price FROM VALUES (1L,'2024-01-01',9.9D),(1L,'2024-01-02',9.9D),(1L,'2024-01-03',10.1D) AS t(id,at,price)")
    new = merge.append_price_changes(spark.createDataFrame([], s), p)
    assert [r.price for r in new.orderBy("seen_at").collect()] == [9.9, 10.1]
    assert merge.append_price_changes(new, p).count() == 0


def test_no_equal_neighbours(tables):
    from hearthmark.operators.skew import lagged
    new = merge.append_price_changes(ql.old_prices(tables), ql.new_prices(tables))
    assert lagged(new, ["id"], "seen_at", ["price"], ["price"]).where("prev_price = price").count() == 0


def test_weights_and_range(tables):
    c = qv.comps(tables).cache()
    off = c.groupBy("subject_id").agg(F.sum("weight").alias("w"), F.min("price_per_sqm").alias("lo"), F.max("price_per_sqm").alias("hi"))
    assert off.where(F.abs(F.col("w") - 1) > 1e-9).count() == 0
    b = cmp.bottom_estimate(qv.subjects(tables), c).join(off, "subject_id")
    assert b.where("estimated_price_per_sqm < lo * 0.93 - 1e-6 OR estimated_price_per_sqm > hi * 0.93 + 1e-6").count() == 0


def square(s, w, n, e):
    return [(float(x), float(y)) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]


POLY = "district_id int, name string, full_name string, level int, parent_district_id int, outline array<array<array<struct<lon:double,lat:double>>>>"


def test_polygons(spark):
    d = spark.createDataFrame([
        (1, "A", "A", 1, None, [[square(0, 0, 10, 10), square(4, 4, 6, 6)]]),   # hole in the middle
        (2, "B", "B", 2, None, [[square(1, 1, 3, 3)], [square(7, 7, 9, 9)]]),   # two parts inside A
        (3, "C", "C", 3, None, [[square(1.5, 1.5, 2, 2)]])], POLY)
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.5, 0.5), (3, 1.2, 1.2), (4, 1.7, 1.7), (5, 8.0, 8.0), (6, 11.0, 5.0), (7, 0.0, 5.0), (8, 10.0, 5.0)], "id long, lat double, lon double")
    got = {r.id: r.district_id for r in geo.assign_by_polygon(p, d).collect()}
    assert got == {2: 1, 3: 2, 4: 3, 5: 2, 7: 1}  # lower edge in, upper edge out, hole out
    up = {r.district_id: r.parent_district_id for r in geo.link_hierarchy(d).collect()}
    assert up[1] is None and up[3] == 2


def test_polygon_area(spark):
    from hearthmark.operators.quality import hierarchy_quality
    d = spark.createDataFrame([(1, "A", "A", 1, None, [[square(0, 0, 1, 1)]])], POLY)
    assert hierarchy_quality(d, "outline").collect()[0].avg_area_km2 == pytest.approx(12363.7, rel=1e-3)


def test_district_text(spark):
    d = spark.createDataFrame([(1, "Зона", "р-н Зона", 2), (2, "Зональный", "р-н Зональный", 2), (3, "Северное Бутово", "район", 2)], "district_id int, name string, full_name string, level int")
    l = spark.createDataFrame([(1, "Москва, р-н Зона, ул. А, 1"), (2, "Москва, р-н Зональный, 2"), (3, "Москва, р-н Бутово, 5"), (4, "Москва, р-н Нет, 5")], "id long, address string")
    assert rows(geo.assign_by_text(l, d)) == [(1, 1), (2, 2), (3, 3)]


def test_investment_golden(spark):
    df = spark.createDataFrame([(1, 8_000_000.0, 50.0)], "id long, market_price double, area_total double")
    r = {x.project_type: x for x in inv.interest_price_all(df).collect()}
    ip = (8e6 * 0.93 * 0.94 - 27_000 * 1.12) / 1.06
    assert all(x.interest_price == pytest.approx(ip) for x in r.values())
    gross = 8e6 * 0.93 - ip
    profit = gross * 0.94 - 27_000
    assert r["own"].expected_profit == pytest.approx(profit) and r["own"].our_profit == pytest.approx(profit)
    assert r["partner"].our_profit == pytest.approx(max(profit / 2, (ip + 27_000) * 0.12))
    reno = 3_000_000.0
    gross_f = gross + reno * 1.6
    profit_f = gross_f * 0.94 - 27_000 - reno
    assert r["partner_flip"].expected_profit == pytest.approx(profit_f)
    extra = reno * 0.16 + ip * 0.12
    assert r["partner_flip"].our_profit == pytest.approx(max((profit_f - extra) / 2 + extra, 1e6))
    interest, issue = ip * 0.265 / 12 * 3, ip * 0.0075
    assert r["bank_flip"].mortgage_total_interest == pytest.approx(interest)
    assert r["bank_flip"].expected_profit == pytest.approx(gross_f * 0.94 - 27_000 - reno - interest - issue)
    assert r["own"].cost_breakdown["certification"] == 27_000 and "renovation" not in r["own"].cost_breakdown
    bad = inv.interest_price(spark.createDataFrame([(1, 10.0, 50.0)], df.schema), kind="own").collect()[0]
    assert bad.interest_price is None and bad.reject_reason
    short = inv.interest_price(df, inv.InvestParams(project_period_months=2), "partner").collect()[0]
    assert short.interest_price == pytest.approx(8e6 * 0.93 - (1e6 + 27_000) / 0.94)


def test_stream_over_batches(spark, tmp_path):
    """Several micro-batches, repeats and a late point: same events as one ordered batch."""
    src = str(tmp_path / "in")
    pts = [(1, "2024-01-01 10:00:00", 5.0), (2, "2024-01-01 10:00:00", 7.0), (1, "2024-01-01 11:00:00", 5.0), (1, "2024-01-01 12:00:00", 6.0),
           (1, "2024-01-01 11:30:00", 9.0), (2, "2024-01-01 13:00:00", 8.0), (2, "2024-01-01 13:00:00", 8.0), (3, "2024-01-01 13:30:00", 1.0)]
    for i in range(0, len(pts), 2):
        df = spark.createDataFrame(pts[i:i + 2], "id long, at string, price double").selectExpr("id", "cast(at as timestamp_ntz) seen_at", "price")
        df.coalesce(1).write.mode("append").parquet(src)
    offers = spark.readStream.schema("id long, seen_at timestamp_ntz, price double").option("maxFilesPerTrigger", 1).parquet(src)
    out = stream.run_available(stream.price_changes(offers), folder=str(tmp_path / "work"))
    got = {(r.id, r.change, r.price, r.old_price) for r in stream.last_state(out, ["id", "seen_at", "price"]).where("change IS NOT NULL").collect()}
    assert got == {(1, "NEW", 5.0, None), (2, "NEW", 7.0, None), (1, "PRICE_CHANGE", 9.0, 5.0), (1, "PRICE_CHANGE", 6.0, 9.0), (2, "PRICE_CHANGE", 8.0, 7.0), (3, "NEW", 1.0, None)}
    # a restart with the same checkpoint finds nothing new and writes nothing twice
    again = stream.run_available(stream.price_changes(offers), folder=str(tmp_path / "work"))
    assert again.count() == out.count()


def test_snapshot_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, d string").selectExpr("k", "cast(d as date) date")
    files.write_snapshot(df, path)
    files.write_snapshot(df.where("k = 2").selectExpr("k + 10 AS k", "date"), path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 12]


def test_ordered_pages(spark):
    df = spark.range(25).selectExpr("0 AS k", "id AS pos", "cast(id as string) AS v")
    got = files.collect_ordered(df, ["k"], ["pos"], ["v"], F.floor(F.col("pos") / 4), page=10).orderBy("page").collect()
    assert [r.items for r in got] == [10, 10, 5] and got[2].json.startswith('[{"v":"20"}')


@pytest.mark.parametrize("name", ["comparable_candidates", "deal_candidates", "points_in_radius", "exact_originals", "near_originals", "district_by_nearest_any",
                                  "district_by_polygon", "search_address", "price_drops", "median_ppsm", "risk_tags", "offers_mapped"])
def test_plans(tables, name):
    plan = QUERIES[name](tables.spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition"):
        assert bad not in plan, (name, bad)


def test_filters_reach_the_scan(tables):
    from hearthmark.operators.market import ts
    plan = tables.lineitem.where(F.col("l_shipdate") >= ts("2001-01-01 00:00:00")).select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("most", [inv.MOST_RATES, 3])
def test_key_rate_of_every_instant(spark, most):
    """As a list and as joined intervals; before the first rate, on it, after the last, over empty years, and for NULL."""
    rates = spark.createDataFrame([("1999-05-05 10:00:00", 3.0), ("2001-01-31 00:00:00", 5.0), ("2001-01-31 00:00:00", 4.0), ("2001-02-01 12:00:00", 6.0), ("2009-12-31 23:59:59", 7.0),
                                   ("2010-01-01 00:00:00", None), (None, 9.0)], "valid_from string, key_rate double").selectExpr("cast(valid_from as timestamp_ntz) valid_from", "key_rate")
    rows = spark.createDataFrame([(1, "1999-05-05 09:59:59"), (2, "1999-05-05 10:00:00"), (3, "2001-01-30 23:59:59"), (4, "2001-02-01 00:00:00"), (5, "2001-02-01 12:00:00"),
                                  (6, "2009-12-31 23:59:58"), (7, "2009-12-31 23:59:59"), (8, "2024-01-01 00:00:00"), (9, None), (5, "2001-02-01 12:00:00")], "id int, at string")
    got = inv.with_key_rate(rows.selectExpr("id", "cast(at as timestamp_ntz) at"), rates, most=most)
    assert sorted((r.id, r.key_rate) for r in got.collect()) == [(1, None), (2, 3.0), (3, 3.0), (4, 5.0), (5, 6.0), (5, 6.0), (6, 6.0), (7, 7.0), (8, None), (9, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan and "hashpartitioning(0" not in plan
    assert most == 3 or "Exchange" not in plan
    assert inv.with_key_rate(rows.selectExpr("id", "cast(at as timestamp_ntz) at"), rates.limit(0)).where("key_rate IS NOT NULL").count() == 0


def test_valuation_of_all_listings(spark, tables):
    """The whole result: what comparables do not value is valued by the grid alone."""
    from hearthmark.plans.catalog import QUERIES
    from hearthmark.plans.q_history import subjects
    areas = {r.subject_id: r.area_total for r in subjects(tables).collect()}
    rows = QUERIES["value_properties_all"](spark, SF).collect()
    assert rows and len({r.subject_id for r in rows}) == len(rows) and all(r.subject_id in areas for r in rows)
    for r in rows:
        if r.comparables_count == 0:
            assert r.method_used == "grid_only" and r.market_price is None and r.grid_weight == 1.0
            assert r.estimated_price is None or abs(r.estimated_price - r.estimated_price_per_sqm * areas[r.subject_id]) < 1e-6
        assert r.deals_count >= 0 and (r.building_info_warning is None) == (r.total_floors is not None and r.building_year is not None)
