"""Band joins, covers of outlines, counts within a radius and nearest centres: against brute force, with bounds on the work."""

import math

import pytest
from pyspark.sql import functions as F

from hearthmark.operators import duplicates, geography, radius
from hearthmark.operators.bands import with_bins
from hearthmark.operators.cover import cover, holders

LISTING = "id long, address string, area_total double, rooms int, description_hash string, resolved_address string, is_active boolean, first_seen timestamp_ntz"


@pytest.fixture(scope="module")
def crowded(spark):
    """Listings a third of which share address and rooms, with areas of every hundredth of a square metre."""
    h = F.abs(F.xxhash64("id"))
    return spark.range(6_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), h % 300)).alias("address"), (10 + (h % 9_000) / 100.0).alias("area_total"),
        F.when(F.col("id") % 3 == 0, 2).otherwise((h % 4).cast("int")).alias("rooms"), F.lit(None).cast("string").alias("description_hash"),
        F.lit(None).cast("string").alias("resolved_address"), (h % 5 > 0).alias("is_active"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(h % 900)).alias("first_seen")).cache()


def test_band_join_against_pairs(crowded):
    a, b = crowded.alias("a"), crowded.where("is_active").alias("b")
    gap = F.abs(F.round(F.col("a.area_total") * 10_000).cast("long") - F.round(F.col("b.area_total") * 10_000).cast("long"))
    pairs = a.join(b, (F.col("a.address") == F.col("b.address")) & (F.col("a.rooms") == F.col("b.rooms")) & (gap <= 20_000))
    near = pairs.where(gap > 0).groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct("b.first_seen", "b.id")).alias("o"), F.count(F.lit(1)).alias("n")).collect()
    got = {r.id: (r.match.date, r.match.id) for r in duplicates.near_originals(crowded).collect()}
    assert got == {r.id: (r.o.first_seen, r.o.id) for r in near}
    counts = {r.id: r.near_matches for r in duplicates.match_counts(crowded).collect()}
    assert {k: n for k, n in counts.items() if n} == {r.id: r.n for r in near} and len(counts) == 6_000


def test_a_bin_holds_no_more_than_its_numbers(crowded):
    areas = crowded.select("address", "rooms", F.round(F.col("area_total") * 100).cast("long").alias("a")).distinct()
    binned = with_bins(areas, "a", 200)
    assert binned.where("_own").count() == areas.count() and binned.count() == 2 * areas.count()
    # twice the reach in the bin itself and the halves beside it
    assert binned.groupBy("address", "rooms", "_bin").count().agg(F.max("count")).first()[0] <= 2 * 400
    plan = duplicates.near_originals(crowded)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "_bin" in plan


def test_exact_match_rules_skip_rows_without_keys(crowded):
    rows = crowded.withColumn("description_hash", F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id") % 100))).withColumn(
        "resolved_address", F.when(F.col("id") % 2 == 0, F.concat(F.lit("r"), F.col("id") % 10)))
    found = {}
    for keys in duplicates.EXACT_KEYS:
        a, b = rows.alias("a"), rows.where("is_active").alias("b")
        on = F.col("a.id") != F.col("b.id")
        for k in keys:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        for r in a.join(b, on).groupBy(F.col("a.id").alias("id")).agg(F.min(F.struct("b.first_seen", "b.id")).alias("o")).collect():
            found[r.id] = min(found.get(r.id, (r.o.first_seen, r.o.id)), (r.o.first_seen, r.o.id))
    assert {r.id: (r.match.date, r.match.id) for r in duplicates.exact_originals(rows).collect()} == found


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in [*points, points[0]]]


def star(lat, lon, reach, n, depth=0.3):
    """Closed outline of n vertices, in and out in turn."""
    return ring([(lon + reach * (1 - depth * (k % 2)) * math.cos(2 * math.pi * k / n), lat + reach * (1 - depth * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)])


SHAPES = {1: [[ring([(0, 0), (1, 0), (1, 1), (0, 1)])]],
          2: [[ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (2, 1), (2, 2), (1, 2)])], [ring([(5, 5), (6, 5), (6, 6), (5, 6)])]],
          3: [[star(2.0, 3.0, 2.5, 24)]],
          4: [[ring([(-3, -3), (3.3, 0.1), (-2.9, 2.7)])]],
          5: [[ring([(0.5, 0.5), (0.5, 0.5)])]],
          6: [[star(0.5, 0.5, 1e-7, 12)]],
          7: [[ring([(-170, -80), (170, -80), (170, 80), (-170, 80)])]],
          8: None, 9: [], 10: [[]]}
OUTLINE = "outline_id long, outline array<array<array<struct<lon:double,lat:double>>>>"


def test_cover_against_ray_casting(spark):
    outlines = spark.createDataFrame(list(SHAPES.items()), OUTLINE)
    h, g = F.abs(F.hash("id")), F.abs(F.xxhash64("id"))
    # whole and half degrees lie on edges and vertices
    points = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, (h % 20 - 8) / 2.0).otherwise((h % 9_973) / 900.0 - 4).alias("lat"),
                                       F.when(F.col("id") % 3 == 0, (g % 20 - 8) / 2.0).otherwise((g % 9_967) / 900.0 - 4).alias("lon"))
    points = points.union(spark.createDataFrame([(-1, None, 1.0), (-2, 0.5, 0.5), (-3, 0.5, 0.5 + 5e-8), (-4, 79.9, -169.9), (-5, 80.0, 0.0)], "id long, lat double, lon double"))
    covered = cover(outlines)
    got = sorted((r.id, r.outline_id) for r in holders(points, "id", covered).collect())
    plain = points.where("lat IS NOT NULL").crossJoin(outlines.where("outline IS NOT NULL AND outline_id < 9"))
    want = sorted((r.id, r.outline_id) for r in plain.where(geography.contains(F.col("outline"), F.col("lat"), F.col("lon"))).collect())
    assert got == want and len({k for _, k in want}) >= 6


def test_cover_of_a_country_is_bounded(spark):
    outlines = spark.createDataFrame([(1, [[star(60.0, 90.0, 40.0, 10_000, 0.02)]]), (2, [[star(55.75, 37.6, 0.001, 40)]])], OUTLINE)
    covered = cover(outlines)
    border = F.col("edges").isNotNull()
    per = {(r.outline_id, r.border): r.n for r in covered.cells.groupBy("outline_id", border.alias("border")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n <= 1_500 for n in per.values()) and len(covered.levels) <= 4
    sizes = covered.cells.where("outline_id = 1 AND edges IS NOT NULL").agg(F.max(F.size("edges")).alias("most"), F.sum(F.size("edges")).alias("all")).first()
    # a border cell has the edges of its row, a small part of the outline
    assert sizes["most"] < 2_500 and sizes["all"] < 20 * 10_000
    points = spark.range(2_000).select("id", (20 + F.rand(1) * 80).alias("lat"), (50 + F.rand(2) * 80).alias("lon")).cache()
    outline = outlines.where("outline_id = 1").select("outline")
    want = points.crossJoin(outline).where(geography.contains(F.col("outline"), F.col("lat"), F.col("lon"))).count()
    assert holders(points, "id", covered).where("outline_id = 1").count() == want > 500


def spread(spark, n, seed, crowded=0.8):
    """Places, most of them within a few hundred metres, the others far and wide; poles and the date line included."""
    h, g = F.abs(F.hash(F.col("id") + seed)), F.abs(F.xxhash64(F.col("id") + seed))
    dense = F.col("id") % 100 < int(100 * crowded)
    lat = F.when(dense, 55.75 + (h % 10_000) / 2e6).otherwise((h % 18_001) / 100.0 - 90.0)
    lon = F.when(dense, 37.61 + (g % 10_000) / 1.2e6).otherwise((g % 36_001) / 100.0 - 180.0)
    corner = F.array(F.lit(90.0), F.lit(-90.0), F.lit(89.99), F.lit(70.0), F.lit(0.0))[(F.col("id") % 5).cast("int")]
    return spark.range(n).select("id", F.when(F.col("id") % 97 == 0, corner).otherwise(lat).alias("lat"), F.when(F.col("id") % 89 == 0, 180.0).otherwise(lon).alias("lon"),
                                 F.concat(F.lit("t"), g % 3).alias("t"))


@pytest.mark.parametrize("metres", [60.0, 300.0, 2_000.0, 900_000.0])
def test_radius_counts_against_pairs(spark, metres):
    spots = spread(spark, 4_000, 1).groupBy("lat", "lon", "t").agg(F.count(F.lit(1)).alias("n")).cache()
    asked = spread(spark, 150, 9, 0.5).select("lat", "lon").distinct().cache()
    far = geography.haversine_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("c"))
    pairs = asked.crossJoin(spots.select(F.col("lat").alias("b"), F.col("lon").alias("c"), "t", "n")).where(far * 1000 <= metres)
    want = {tuple(r[:3]): r.n for r in pairs.groupBy("lat", "lon", "t").agg(F.sum("n").alias("n")).collect()}
    got = {tuple(r[:3]): r.n for r in radius.radius_counts(asked, spots, metres, ["t"]).collect()}
    assert got == want


def test_a_crowded_circle_is_not_paired_up(spark):
    """With four times the points around, the rows looked at grow by about two and not by four."""
    work = []
    for n in (20_000, 80_000):
        h, g = F.abs(F.hash("id")), F.abs(F.xxhash64("id"))
        spots = spark.range(n).select((55.7 + (h % 1_000_003) / 1e7).alias("lat"), (37.5 + (g % 1_000_003) / 6e6).alias("lon"), F.lit(1).alias("n")).distinct().cache()
        asked = spots.orderBy(F.xxhash64("lat", "lon")).limit(40).select("lat", "lon").cache()
        cells = radius.circle_cells(asked, spots, 3_000.0)
        deg = radius.radius_degrees(3_000.0)
        near = spots.withColumn("_gen", F.explode(F.array(*[F.lit(k) for k in range(radius.GENERATIONS + 1)]))).select(
            "_gen", *radius._pyramid_cell(deg, F.col("_gen")))
        pairs = cells.where("NOT _whole").join(near, ["_gen", "_cy", "_cx"]).count()
        inside = sum(r.n for r in radius.radius_counts(asked, spots, 3_000.0).collect())
        work.append((cells.count() + pairs, inside))
    (small, few), (large, many) = work
    assert many > 3.5 * few and large < 2.8 * small and large < many / 5


def test_nearest_centre_against_brute_force(spark):
    centres = spread(spark, 600, 4, 0.5).select("id", "lat", "lon").cache()
    asked = spread(spark, 400, 8, 0.3).select("lat", "lon").distinct().cache()
    d = geography.haversine_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("c"))
    pairs = asked.crossJoin(centres.select("id", F.col("lat").alias("b"), F.col("lon").alias("c")))
    want = {(r.lat, r.lon): (r.m.d, r.m.id) for r in pairs.groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), "id")).alias("m")).collect()}
    got = {(r.lat, r.lon): (r.distance_km, r.id) for r in radius.nearest_centre(asked, centres).collect()}
    assert got == want
    assert radius.nearest_centre(asked, centres.limit(0)).collect() == []


def test_far_and_polar_places_meet_few_centres(spark):
    """20,000 centres in one country: places anywhere look at a bounded number of them."""
    h, g = F.abs(F.hash("id")), F.abs(F.xxhash64("id"))
    centres = spark.range(20_000).select("id", (50 + (h % 100_003) / 1e4).alias("lat"), (30 + (g % 100_003) / 5e3).alias("lon")).cache()
    asked = spark.createDataFrame([(-90.0, 0.0), (90.0, 0.0), (0.0, 0.0), (-55.0, -143.0), (55.0, 179.9), (55.5, 41.0), (-55.0, -150.0)], "lat double, lon double")
    leaves = centres.select(radius._node("lat", "lon", radius.NODE_DEGREES[-1]).alias("_node"))
    looked = radius.nearest_candidates(asked, centres).join(leaves, "_node").groupBy("lat", "lon").count().collect()
    assert len(looked) == 7 and max(r["count"] for r in looked) < 400
