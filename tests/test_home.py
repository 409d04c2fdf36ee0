"""Searches that stay in one task, comparables refined in one pass, offers read once."""

from compare import norm
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthmark.functions import geo
from hearthmark.operators import comparables as cmp
from hearthmark.operators import history
from hearthmark.operators.nearest import ALL_LANES, SEARCH_LEVELS, Box, candidate_pairs, nearest
from hearthmark.plans.catalog import QUERIES


def rows(df):
    return sorted((norm(r.asDict()) for r in df.collect()), key=repr)


def test_a_pile_of_one_kind_is_not_paired_up(spark):
    """3,000 flats of one place and room count, all of different area: a subject of that count meets the first ids alone."""
    pts = spark.range(3000).selectExpr("id", "55.75 AS lat", "37.61 AS lon", "20 + id / 100 AS area_total", "CAST(CASE WHEN id < 2900 THEN 2 ELSE 3 END AS INT) AS rooms")
    subj = spark.range(40).selectExpr("id AS subject_id", "55.75 + id % 3 / 1000 AS lat", "37.61 AS lon", "40.0 AS area_total", "CAST(CASE WHEN id % 4 > 0 THEN 2 END AS INT) AS rooms")
    r, cr = F.col("rooms"), F.col("c_rooms")
    ok = r.isNull() | (cr == r)
    lanes = F.when(r.isNull(), F.array(F.lit(2), F.lit(3))).otherwise(F.array(r))
    args = (subj, pts, 9), ["rooms", "area_total"], (F.col("rooms"), SEARCH_LEVELS, False, F.col("rooms"), lanes)
    sure = lambda c, lo, hi: r.isNull() | (c == r)
    pairs = candidate_pairs(*args[0], sure, args[1], Box(), *args[2], free=(F.col("rooms"), F.coalesce(r, F.lit(ALL_LANES))))
    assert pairs.groupBy("subject_id").count().agg(F.max("count")).first()[0] <= 10
    got = nearest(*args[0], ok, sure, args[1], Box(), F.col("rooms"), lane=F.col("rooms"), lanes=lanes, free=(F.col("rooms"), F.coalesce(r, F.lit(ALL_LANES))))
    assert {tuple(sorted(x)) for _, x in got.groupBy("subject_id").agg(F.collect_list("c_id")).collect()} == {tuple(range(9))}


def test_subjects_with_several_searches(spark):
    """Ids that repeat at other places, and places by the date line: one list per id, as by brute force, in one task."""
    h = F.abs(F.xxhash64("id"))
    pts = spark.range(1500).select("id", (10 + h % 1000 / 5000).alias("lat"), F.when(h % 2 == 0, 179.9 + h % 97 / 1000).otherwise(-179.9 - h % 89 / 1000).alias("lon"),
                                   F.lit(30.0).alias("area_total")).cache()
    subj = spark.range(60).select((F.col("id") % 45).alias("subject_id"), (10 + h % 500 / 2500).alias("lat"), F.when(h % 3 == 0, 179.97).when(h % 3 == 1, -179.96).otherwise(179.93).alias("lon")).cache()
    box = Box()
    got = nearest(subj, pts, 7, F.lit(True), lambda c, lo, hi: F.lit(True), [], box)
    c = pts.select(*[F.col(x).alias(f"c_{x}") for x in pts.columns])
    gap = F.abs(F.col("c_lon") - F.col("lon"))
    inside = (F.abs(F.col("c_lat") - F.col("lat")) <= box.lat) & (F.least(gap, 360 - gap) <= box.lon)
    brute = subj.crossJoin(c).where(inside).withColumn("d", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")))
    want = brute.withColumn("rank", F.row_number().over(Window.partitionBy("subject_id").orderBy("d", "c_id"))).where("rank <= 7").select("subject_id", "c_id", "rank")
    assert rows(got.select("subject_id", "c_id", "rank")) == rows(want) != []
    spread = got.withColumn("_task", F.spark_partition_id()).groupBy("subject_id").agg(F.count_distinct("_task").alias("tasks"), F.count_distinct("_home").alias("homes"))
    assert spread.where("tasks > 1 OR homes > 1").count() == 0


def test_comparables_are_not_moved_after_the_search(tables):
    """From the search to the weights no exchange by subject: rows stay where the search has put them."""
    conf = tables.spark.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        plan = QUERIES["comparable_scores"](tables.spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = plan[:plan.index("_c_home")]
    assert top.count("Window") >= 3 and "Exchange" not in top


def test_refine_counts_what_stays(spark):
    comps = spark.createDataFrame([(1, i, 100.0 + i) for i in range(5)] + [(2, i, 50.0 - i) for i in range(4)] + [(3, 1, 7.0), (None, 1, 1.0), (2, None, 3.0)],
                                  "valuation_id long, listing_id long, price_per_sqm double")
    out = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 99, "c"), (2, 3, "x"), (2, 2, "y"), (2, 1, "z"), (2, None, "n"), (4, 1, "q"), (None, 1, "w")],
                                "valuation_id long, listing_id long, reason string")
    v = spark.createDataFrame([(i, 10.0, 1.0, 1.0) for i in range(1, 5)], "valuation_id long, area_total double, estimated_price double, estimated_price_per_sqm double")
    done, log = history.refine(v, comps, out, "2001-11-05 00:00:00")
    got = {r.valuation_id: (r.excluded, r.reason, r.remaining, r.accepted, r.refined_price_per_sqm and round(r.refined_price_per_sqm, 6)) for r in log.collect()}
    # a listing without an id is never excluded
    assert got == {1: (3, "a", 4, True, round((101 + 102 + 103) / 3 * 0.93, 6)), 2: (4, "n", 2, False, None), 4: (1, "q", 0, False, None)}
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("price_per_sqm#") and plan.count("LogicalRDD") <= 3 and done.count() == 4


def test_fields_of_an_offer_are_read_once(tables):
    plan = QUERIES["offers_rejected"](tables.spark, tables.folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("try_variant_get") < 60


def test_class_filter_without_a_search(spark):
    """Candidates of any origin, without a home: the nearest rejected ones fill up to five."""
    c = spark.createDataFrame([(1, k, k, 9, 3 if k % 2 else 9, None, None) for k in range(1, 5)] + [(2, k, k, 9, 3, None, None) for k in range(1, 9)],
                              "subject_id int, c_id int, rank int, total_floors int, c_total_floors int, building_year int, c_building_year int")
    got = cmp.class_filter(c).groupBy("subject_id").agg(F.sort_array(F.collect_list("c_id")).alias("ids"), F.count_if("refilled").alias("n"))
    assert {r.subject_id: (r.ids, r.n) for r in got.collect()} == {1: ([1, 2, 3, 4], 2), 2: ([1, 2, 3, 4, 5], 5)}
