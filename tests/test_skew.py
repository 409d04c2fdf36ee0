"""The skew-safe forms give what the plain ones give, hot keys included."""

import math

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthmark.operators import geography as geo
from hearthmark.operators import skew
from hearthmark.operators.nearest import SEARCH_LEVELS, Box, candidate_pairs, nearest


@pytest.fixture(scope="module")
def facts(spark):
    """4000 points; key 0 holds most of them, values repeat and include zero and negatives."""
    h = F.abs(F.hash("id"))
    return spark.range(4000).select(
        F.when(h % 3 > 0, 0).otherwise(F.when(h % 11 == 0, None).otherwise(h % 7)).alias("k"), "id",
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 700, h % 24)).alias("at"),
        F.when(F.col("id") % 50 == 0, None).otherwise((h % 997 - 300) * 0.37).alias("v")).cache()


def rows(df):
    return sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=repr)


def test_exact_quantiles(facts):
    got = skew.exact_quantiles(facts, ["k"], "v", [0.0, 0.25, 0.5, 0.95, 1.0], list("abcde"))
    want = facts.groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", p).alias(c) for c, p in zip("abcde", (0.0, 0.25, 0.5, 0.95, 1.0))])
    a = got.toPandas().sort_values("k").reset_index(drop=True)
    b = want.toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


def test_global_quantile(facts):
    got = skew.exact_quantiles(facts, [], "v", [0.5], ["m"]).collect()[0].m
    assert got == pytest.approx(facts.agg(F.percentile("v", 0.5)).collect()[0][0])


SPLITS = pytest.mark.parametrize("depth", [100, skew.SPLIT_ROWS])


@SPLITS
def test_lagged(facts, depth):
    w = Window.partitionBy("k").orderBy("at", "id")
    want = facts.select("k", "id", F.lag("v").over(w).alias("prev_v"))
    got = skew.lagged(facts, ["k"], "at", ["v"], ["id"], depth).select("k", "id", "prev_v")
    assert rows(got) == rows(want)


def test_ranked(facts):
    w = Window.partitionBy("k").orderBy("at", "id")
    want = facts.select("id", F.row_number().over(w).cast("long").alias("rank"))
    got = skew.ranked(facts, ["k"], ["at", "id"], F.date_trunc("month", "at")).select("id", "rank")
    assert rows(got) == rows(want)


@SPLITS
def test_asof_last(facts, depth):
    left = facts.where("id % 9 = 0").select("k", "id", (F.col("at") + F.expr("INTERVAL 5 HOURS")).alias("t"))
    fact = facts.where("id % 9 <> 0 AND v IS NOT NULL").groupBy("k", "at").agg(F.max("v").alias("v"))
    got = skew.asof_last(left, fact, ["k"], "t", "at", "v", (), depth).select("id", "value_at")
    j = left.join(fact.withColumnRenamed("k", "fk"), F.col("k").eqNullSafe(F.col("fk")) & (F.col("at") <= F.col("t")), "left")
    want = j.groupBy("id").agg(F.max_by("v", "at").alias("value_at"))
    assert rows(got) == rows(want)


def places(spark, n, seed, pile):
    """Points in a dense core, a sparse rim and a pile of identical coordinates."""
    h = F.abs(F.hash(F.col("id") + seed))
    g = F.abs(F.xxhash64(F.col("id") + seed))
    near, far = (h % 1000) / 40000.0, (h % 1000) / 2500.0
    lat = F.when(F.col("id") % 5 < pile, 55.75).when(F.col("id") % 5 < 4, 55.75 + near).otherwise(55.5 + far)
    lon = F.when(F.col("id") % 5 < pile, 37.61).when(F.col("id") % 5 < 4, 37.60 + (g % 1000) / 30000.0).otherwise(37.2 + (g % 1000) / 1500.0)
    return spark.range(n).select("id", lat.alias("lat"), lon.alias("lon"), (20 + h % 90).cast("double").alias("area_total"), (g % 4).cast("int").alias("rooms"))


def rooms_rule():
    ok = (F.col("c_rooms") == F.col("rooms")) | ((F.col("c_rooms") == F.col("rooms") + 1) & (F.col("c_area_total") <= F.col("area_total") + 10))
    sure = lambda c, lo, hi: (c == F.col("rooms")) | ((c == F.col("rooms") + 1) & (hi <= F.col("area_total") + 10))
    return ok, sure


@pytest.mark.parametrize("by_lane", [True, False])
def test_nearest_is_exact(spark, by_lane):
    box = Box()
    pts = places(spark, 3000, 1, 2).withColumn("rooms", F.when(F.col("id") % 40 == 0, 30).when(F.col("id") % 41 == 0, None).otherwise(F.col("rooms"))).withColumn(
        "area_total", F.when(F.col("id") % 50 == 0, 1e6).when(F.col("id") % 60 == 0, 0.5).otherwise(F.col("area_total"))).cache()
    subj = places(spark, 200, 99, 1).withColumnRenamed("id", "subject_id").withColumn("rooms", F.when(F.col("subject_id") % 20 == 0, 29).otherwise(F.col("rooms"))).cache()
    ok, sure = rooms_rule()
    lanes = {"lane": F.col("rooms"), "lanes": F.array(F.col("rooms"), F.col("rooms") + 1)} if by_lane else {}
    got = nearest(subj, pts, 9, ok, sure, ["rooms", "area_total"], box, F.col("rooms"), **lanes).select("subject_id", "c_id", "rank")
    c = pts.select(*[F.col(x).alias(f"c_{x}") for x in pts.columns])
    d = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))
    inside = (F.abs(F.col("c_lat") - F.col("lat")) <= box.lat) & (F.abs(F.col("c_lon") - F.col("lon")) <= box.lon)
    brute = subj.crossJoin(c).where(inside & ok).withColumn("d", d)
    want = brute.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy("d", "c_id"))).where("rank <= 9").select("subject_id", "c_id", "rank")
    assert rows(got) == rows(want)


def test_a_rare_class_in_a_crowded_place_meets_few_points(spark):
    """12,000 points around one place, a dozen of them with five rooms: five-room subjects meet those alone, not the crowd."""
    pts = places(spark, 12_000, 1, 0).withColumn("rooms", F.when(F.col("id") % 1000 == 7, 5).otherwise(F.col("rooms"))).withColumn("area_total", F.col("area_total") + F.col("id") % 7 / 10)
    subj = places(spark, 300, 7, 0).where("lat < 55.78 AND lat > 55.74").withColumnRenamed("id", "subject_id").withColumn(
        "rooms", F.when(F.col("subject_id") % 3 == 0, 5).otherwise(F.col("rooms"))).cache()
    pairs = candidate_pairs(subj, pts, 9, rooms_rule()[1], ["rooms", "area_total"], Box(), F.col("rooms"), SEARCH_LEVELS, False,
                            F.col("rooms"), F.array(F.col("rooms"), F.col("rooms") + 1))
    per = pairs.groupBy("subject_id", "rooms").count().groupBy("rooms").agg(F.max("count").alias("most"), F.avg("count").alias("mean")).collect()
    # some subjects lie just outside of the crowd
    assert subj.count() > 100 and {r.rooms: r.most for r in per}[5] <= 12 and max(r["mean"] for r in per) < 1_000


def test_piles_are_cut(spark):
    from hearthmark.operators import nearest as nn
    pts, subj = places(spark, 20000, 1, 2), places(spark, 500, 7, 1).withColumnRenamed("id", "subject_id")
    kept = nn.collapse_piles(pts, ["rooms", "area_total"], 10)
    assert kept.where("lat = 55.75 AND lon = 37.61").count() < 4000  # the pile alone held 8000
    assert nearest(subj, pts, 9, F.lit(True), lambda c, lo, hi: F.lit(True), [], Box()).groupBy("subject_id").count().where("count > 9").count() == 0


def test_radius_pairs(spark):
    a, b = places(spark, 150, 3, 1), places(spark, 800, 4, 1)
    got = geo.radius_pairs(a, b, 1200).select("id", "c_id")
    c = b.select(*[F.col(x).alias(f"c_{x}") for x in b.columns])
    want = a.crossJoin(c).where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) * 1000 <= 1200).select("id", "c_id")
    assert rows(got) == rows(want)


def test_patterns_meet_what_ilike_meets(spark):
    """Wildcards, escapes, short and empty patterns, NULLs and repeated rows."""
    from hearthmark.operators.containment import matching
    pats = ["%", "", "_", "%street 1%", "%STREET _,%", "a_", "%_b%", "__", "100\\%", "%\\_x%", "Ж%", "%nowhere%", None, "%street 1%"]
    texts = ["", "a", "ab", "Street 1, 2", "street 12", "Main STREET 3, 4", "100%", "1000", "a_x", "abx", "жук", None, "ab"]
    p, t = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((pats, "pattern"), (texts, "text")))
    want = p.dropna().distinct().crossJoin(t.dropna().distinct()).where(F.ilike("text", "pattern"))
    assert rows(matching(p, t).select("pattern", "text")) == rows(want)
    assert matching(p.limit(0), t).count() == 0 and matching(p, t.limit(0)).count() == 0


def test_quantiles_scan_once(tables):
    """The facts below a quantile are read once: its second use of them is a reused shuffle."""
    q = skew.exact_quantiles(tables.lineitem, ["l_returnflag"], "l_extendedprice", [0.5], ["m"])
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@SPLITS
def test_next_instant(facts, depth):
    w = Window.partitionBy("k").orderBy("at")
    once = facts.dropDuplicates(["k", "at"]).cache()
    want = once.select("id", F.lead("at").over(w).alias("_next"))
    assert rows(skew.next_instant(once, ["k"], "at", depth).select("id", "_next")) == rows(want)


def test_a_third_in_one_key_is_cut_evenly(spark):
    """Key 0 has a third of 30,000 rows, 9,000 of them on one day; its splits are alike in size, other keys stay whole."""
    i = F.col("id")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.when(i % 30 < 27, F.make_dt_interval(F.lit(0), F.lit(0), i % 1440)).otherwise(F.make_dt_interval(i % 900))
    df = spark.range(30_000).select(F.when(i % 3 == 0, 0).otherwise(i % 997 + 1).alias("k"), "id", at.alias("at")).cache()
    points = skew.split_points(df, ["k"], "at", 500)
    sizes = skew.in_splits(df, points, ["k"], "at").groupBy("k", "_bucket").count().collect()
    hot = [r["count"] for r in sizes if r.k == 0]
    assert sum(hot) == 10_000 and len(hot) >= 18 and max(hot) <= 520 and all(r._bucket == 0 for r in sizes if r.k != 0)
    # beyond the bound of the broadcast the join is a shuffled one, with the same answer
    skew.BROADCAST_POINTS, kept = 0, skew.BROADCAST_POINTS
    try:
        assert sorted(skew.in_splits(df, points, ["k"], "at").groupBy("k", "_bucket").count().collect()) == sorted(sizes)
    finally:
        skew.BROADCAST_POINTS = kept
    assert skew.split_points(df.limit(0), ["k"], "at", 500) is None
