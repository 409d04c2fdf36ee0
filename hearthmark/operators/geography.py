"""Radius search, district assignment and imputation from neighbours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.address import district_from_address, lookup_text, street_house_key
from hearthmark.functions.geo import cell, haversine_km
from hearthmark.operators.containment import containing
from hearthmark.operators.cover import cover, holders
from hearthmark.operators.market import ts
from hearthmark.operators.nearest import Box, nearest, per_subject
from hearthmark.operators.radius import KM_PER_DEG, asked_cells, nearest_centre, radius_counts, radius_degrees, row_width
from hearthmark.operators.segments import BUILDING_TYPES
from hearthmark.operators.skew import top_rows
from hearthmark.session import cut_lineage

# Centre used for an outline without vertices (lat, lon).
DEFAULT_CENTRE = (55.75, 37.62)


# --- radius search -------------------------------------------------------------------

def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows within ``radius_m``, met on latitude-adapted grid cells.

    Both sides carry lat and lon; right columns come out prefixed ``c_``.  For counts see ``radius.radius_counts``, which
    lists no pairs inside of a crowded circle.
    """
    deg = radius_degrees(radius_m)
    c = right.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        *[F.col(x).alias(f"c_{x}") for x in right.columns if x not in on], *on)
    c = c.withColumn("_cy", cell(F.col("c_lat"), deg)).withColumn("_cx", cell(F.col("c_lon"), row_width(F.col("_cy"), deg)))
    pairs = asked_cells(left, deg).join(c, ["_cy", "_cx", *on]).drop("_cy", "_cx")
    return (pairs.withColumn("distance_m", haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) * 1000)
            .where(F.col("distance_m") <= radius_m))


def bbox_filter(points: DataFrame, lat: float, lon: float, box: Box = Box()) -> DataFrame:
    """Points inside the search box around one place."""
    return points.where(F.col("lat").between(lat - box.lat, lat + box.lat) & F.col("lon").between(lon - box.lon, lon + box.lon))


def places(df: DataFrame) -> DataFrame:
    return df.select("lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").distinct()


def within_radius(subjects: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Per subject: points within the radius and the distance to the nearest."""
    spots = points.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    asked = places(subjects)
    counts = radius_counts(asked, spots, radius_m).select("lat", "lon", F.col("n").alias("points"))
    one = nearest_centre(counts, spots.select(F.struct("lat", "lon").alias("id"), "lat", "lon")).select(
        "lat", "lon", (F.col("distance_km") * 1000).alias("nearest_m"))
    return subjects.join(counts.join(one, ["lat", "lon"], "left"), ["lat", "lon"], "left").withColumn("points", F.coalesce("points", F.lit(0)))


# --- polygons ------------------------------------------------------------------------
# outline: array of polygons, each an array of closed rings of struct(lon, lat); further rings are holes.

def _crossings(ring: Column, lat: Column, lon: Column) -> Column:
    n = F.size(ring) - 1
    hits = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.when(
        ((a["lat"] > lat) != (b["lat"] > lat))
        & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda acc, x: acc + x)


def contains(outline: Column, lat: Column, lon: Column) -> Column:
    """Ray casting: inside if some polygon has an odd number of crossings over all its rings.
    Lower and left edges belong to the polygon, upper and right ones do not."""
    return F.exists(outline, lambda poly: F.aggregate(
        poly, F.lit(0), lambda acc, ring: acc + _crossings(ring, lat, lon)) % 2 == 1)


def polygon_matches(points: DataFrame, districts: DataFrame, key: str = "id") -> DataFrame:
    """All (point, district) containments: points meet the cells that cover the outlines, and only those in a border cell
    meet edges, the ones of their row."""
    covered = cover(districts.select(F.col("district_id").alias("outline_id"), "outline"))
    levels = districts.select(F.col("district_id").alias("outline_id"), "level")
    return holders(points, key, covered).join(levels, "outline_id").select(key, F.col("outline_id").alias("district_id"), "level")


def assign_by_polygon(points: DataFrame, districts: DataFrame, key: str = "id") -> DataFrame:
    """Most granular district that contains the point; the smallest id on ties."""
    m = polygon_matches(points, districts, key)
    return (m.groupBy(key).agg(F.max_by(F.struct("district_id", "level"), F.struct(F.col("level"), -F.col("district_id"))).alias("_m"))
            .select(key, "_m.district_id", "_m.level"))


def assign_by_nearest(points: DataFrame, districts: DataFrame, max_m: float | None = None, min_level: int = 1, key: str = "id") -> DataFrame:
    """Nearest district centre, at any distance or closer than ``max_m``; on equal distance the more
    granular, then the smaller id."""
    c = districts.where((F.col("level") >= min_level) & F.col("center_lat").isNotNull() & F.col("center_lon").isNotNull())
    # ids ordered so that the tie rule of the search (smallest id) prefers granular districts
    c = c.select(F.struct((-F.col("level")).alias("l"), "district_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(key).alias("subject_id"), "lat", "lon")
    if max_m is None:
        spots = nearest_centre(p.select("lat", "lon").distinct(), c)
        found = p.join(spots, ["lat", "lon"]).select("subject_id", F.col("id").alias("c_id"), "distance_km")
    else:
        found = nearest(p, c, 1, F.lit(True), lambda cls, lo, hi: F.lit(True), [], _meters_box(max_m), round_box=True)
        found = found.where(F.col("distance_km") * 1000 < max_m)
    return found.select(F.col("subject_id").alias(key), F.col("c_id.district_id").alias("district_id"),
                        (-F.col("c_id.l")).alias("level"), (F.col("distance_km") * 1000).alias("distance_m"))


def district_names(districts: DataFrame, min_len: int = 3) -> DataFrame:
    """Lookup of every substring of the district names, so that 'name contains text' is an equi-join.

    A name of n letters gives at most n^2 / 2 entries.
    """
    names = districts.select("district_id", "level", "name", F.lower("name").alias("_own"),
                             F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.lower("full_name"))))).alias("_text"))
    subs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_text") - i + 1, F.lit(1))), lambda n: F.substring(F.col("_text"), i, n))))
    keys = names.withColumn("_key", F.explode(F.array_distinct(F.filter(subs, lambda s: F.length(s) >= min_len))))
    best = F.struct((F.col("_key") != F.col("_own")).alias("partial"), -F.col("level"), F.col("name"), F.col("district_id"))
    return keys.groupBy("_key").agg(F.min_by("district_id", best).alias("district_id"))


def assign_by_text(listings: DataFrame, districts: DataFrame, fields: Sequence[str] = ("address",), key: str = "id") -> DataFrame:
    """District named in the address text: exact name first, then a name that contains the text."""
    name = F.coalesce(*[district_from_address(F.col(f)) for f in fields])
    found = listings.select(key, F.lower(name).alias("_key")).where("_key IS NOT NULL")
    return found.join(district_names(districts), "_key").select(key, "district_id")


def assign_districts(listings: DataFrame, districts: DataFrame, order: Sequence[str] = ("polygon", "text", "nearest"),
                     fields: Sequence[str] = ("address",), max_m: float | None = None) -> DataFrame:
    """Listing id, district and the method that found it; each method sees only what the earlier left.

    Between two methods the open rows are checkpointed: later stages read them several times.
    """
    find = {"polygon": lambda rows: assign_by_polygon(rows, districts), "text": lambda rows: assign_by_text(rows, districts, fields),
            "nearest": lambda rows: assign_by_nearest(rows, districts, max_m)}
    rest, done = listings.select("id", "lat", "lon", *fields), []
    for i, method in enumerate(order):
        hit = find[method](rest).select("id", F.col("district_id").cast("long"))
        j = rest.join(hit, "id", "left").withColumn("method", F.when(F.col("district_id").isNotNull(), method))
        if i < len(order) - 1:
            j = cut_lineage(j)
            done.append(j.where("method IS NOT NULL"))
            rest = j.where("method IS NULL").drop("district_id", "method")
        else:
            done.append(j)
    return reduce(DataFrame.unionByName, [d.select("id", "district_id", "method") for d in done])


def vertex_centroid(outline: Column) -> Column:
    """Mean of all vertices (closing points count twice), or the default centre."""
    pts = F.flatten(F.flatten(outline))
    n = F.size(pts)

    def mean(part: str, default: float) -> Column:
        total = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p[part])
        return F.when(n > 0, total / n).otherwise(F.lit(default))

    return F.struct(mean("lat", DEFAULT_CENTRE[0]).alias("lat"), mean("lon", DEFAULT_CENTRE[1]).alias("lon"))


def rectangle(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Outline of one closed rectangle."""
    def p(lon: Column, lat: Column) -> Column:
        return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    return F.array(F.array(F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))))


def make_grid(df: DataFrame, bbox: tuple[float, float, float, float], size: float = 0.01) -> DataFrame:
    """Square cells over (min_lat, min_lon, max_lat, max_lon), row by row from the south-west."""
    s, w, n, e = bbox
    rows, cols = -int(-(n - s - 1e-9) // size), -int(-(e - w - 1e-9) // size)
    g = df.sparkSession.range(rows * cols).withColumnRenamed("id", "idx")
    y, x = F.expr(f"idx div {cols}"), F.col("idx") % cols
    lat, lon = s + y * size, w + x * size
    return g.select("idx", F.concat(F.lit("Grid_"), F.col("idx").cast("string")).alias("name"), lat.alias("south"), lon.alias("west"),
                    rectangle(lat, lon, lat + size, lon + size).alias("outline"))


def link_hierarchy(districts: DataFrame) -> DataFrame:
    """Parent of each district below level 1 without one: the district one level up that holds its centre."""
    c = districts.withColumn("_c", vertex_centroid(F.col("outline")))
    kids = c.where("level > 1 AND parent_district_id IS NULL AND outline IS NOT NULL").select(
        F.col("district_id").alias("id"), F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))
    m = polygon_matches(kids, districts).withColumnRenamed("level", "_plevel").withColumnRenamed("district_id", "_parent")
    levels = districts.select(F.col("district_id").alias("id"), "level")
    up = (m.join(levels, "id").where(F.col("_plevel") == F.col("level") - 1).groupBy(F.col("id").alias("district_id")).agg(F.min("_parent").alias("_parent")))
    return (districts.join(up, "district_id", "left").withColumn("parent_district_id", F.coalesce("parent_district_id", "_parent")).drop("_parent"))


# --- imputation from neighbours ------------------------------------------------------

def _meters_box(m: float) -> Box:
    """Box for searches by radius: its width suits 64 degrees of latitude, and ``round_box`` widens it beyond."""
    lat = m / 1000.0 / KM_PER_DEG * 1.001
    return Box(lat, lat * 2.29)


def impute_building_type(subjects: DataFrame, listings: DataFrame, radii: tuple[float, float] = (200.0, 500.0)) -> DataFrame:
    """Most frequent type within the small radius, else within the large one; smallest name on ties."""
    near, far = radii
    spots = (listings.where("building_type IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
             .groupBy("lat", "lon", "building_type").agg(F.count(F.lit(1)).alias("n")))
    asked = places(subjects)
    wide, close = (radius_counts(asked, spots, m, ["building_type"]).select("lat", "lon", F.col("building_type").alias("t"), F.col("n").alias(name))
                   for m, name in ((far, "n_far"), (near, "n_near")))
    per = wide.join(close, ["lat", "lon", "t"], "left")
    pick = per.groupBy("lat", "lon").agg(
        F.min_by("t", F.when(F.col("n_near").isNotNull(), F.struct(-F.col("n_near"), F.col("t")))).alias("_near"),
        F.min_by("t", F.struct(-F.col("n_far"), F.col("t"))).alias("_far"))
    out = subjects.join(pick, ["lat", "lon"], "left")
    return out.select("subject_id", "lat", "lon", F.coalesce("_near", "_far").alias("detected_type"),
                      F.when(F.col("_near").isNotNull(), near).when(F.col("_far").isNotNull(), far).alias("radius_m"))


def building_type_sources(detected: DataFrame, listings: DataFrame, n: int = 3) -> DataFrame:
    """Nearest listings of the detected type as evidence: of the five nearest, the first ``n`` with a URL."""
    idx = F.array_position(F.array(*[F.lit(t) for t in BUILDING_TYPES]), F.col("building_type")) - 1
    want = F.array_position(F.array(*[F.lit(t) for t in BUILDING_TYPES]), F.col("detected_type")) - 1
    pts = listings.where("building_type IS NOT NULL").select("id", "lat", "lon", "building_type", "url")
    hits = nearest(detected.where("detected_type IS NOT NULL"), pts, 5, F.col("c_building_type") == F.col("detected_type"),
                   lambda cls, lo, hi: (cls >= 0) & (cls == want), ["building_type"], _meters_box(500), idx, round_box=True)
    hits = hits.where((F.col("distance_km") * 1000 <= F.col("radius_m")) & F.col("c_url").isNotNull()).drop("rank")
    return top_rows(hits, per_subject(hits), [F.asc("distance_km"), F.asc("c_id")], n).select(
        "subject_id", "rank", F.col("c_id").alias("id"), F.col("c_url").alias("url"), F.floor(F.col("distance_km") * 1000).alias("distance_m"))


def impute_building_info(subjects: DataFrame, listings: DataFrame, rings: tuple[float, ...] = (10.0, 50.0, 150.0), n: int = 10) -> DataFrame:
    """Floors, year and type of the building from the nearest rows of the first ring that has any.

    Modes are taken over at most ``n`` rows; the value met nearest wins ties.
    """
    pts = listings.where("total_floors IS NOT NULL OR house_year IS NOT NULL").select("id", "lat", "lon", "total_floors", "house_year", "building_type")
    # piles keep n rows each: which of them come first is settled by id alone
    near = nearest(subjects, pts, n, F.lit(True), lambda cls, lo, hi: F.lit(True), [], _meters_box(rings[-1]), round_box=True)
    d = F.col("distance_km") * 1000
    ring = F.when(d <= rings[0], rings[0])
    for x in rings[1:]:
        ring = ring.when(d <= x, x)
    rows = near.withColumn("_ring", ring).where("_ring IS NOT NULL")
    per = per_subject(rows)
    rows = rows.withColumn("_first", F.min("_ring").over(Window.partitionBy(*per))).where(d <= F.col("_first"))
    facts = {"c_total_floors": "total_floors", "c_house_year": "building_year", "c_building_type": "building_type"}

    def votes(col: str) -> Column:
        """How often the value is met and where first; NULL for an unknown value."""
        w = Window.partitionBy(*per, col)
        return F.when(F.col(col).isNotNull() & (F.col(col).cast("string") != "0"), F.struct(-F.count(F.lit(1)).over(w), F.min("rank").over(w)))

    for col in facts:
        rows = rows.withColumn(f"_v{col}", votes(col))
    out = rows.groupBy(*per).agg(F.count(F.lit(1)).alias("sources_count"), *[F.min_by(col, f"_v{col}").alias(name) for col, name in facts.items()]).drop("_home")
    return out.withColumn("confidence", F.when(F.col("sources_count") >= 3, "high").otherwise("medium")).where(
        "total_floors IS NOT NULL OR building_year IS NOT NULL OR building_type IS NOT NULL")


def geocode_local(queries: DataFrame, listings: DataFrame) -> DataFrame:
    """Coordinates of the latest listing with the same street and house; without a house number, of the latest listing
    whose address contains the rest of the text.

    Both sides are reduced to a (street, house) key; the known places are one row per key. Texts without a number are looked
    up by their rarest gram (``containing``), ignoring case. A text of which nothing is left finds no place.
    """
    places = listings.where("lat IS NOT NULL AND lon IS NOT NULL")
    latest = F.max_by(F.struct("lat", "lon", "address"), F.struct("last_seen", "id")).alias("_p")
    known = places.withColumn("_k", street_house_key(F.col("address"))).where("_k IS NOT NULL").groupBy("_k").agg(latest)
    q = queries.withColumns({"_k": street_house_key(F.col("address")), "_text": lookup_text(F.col("address"))})
    at_house = q.where("_k IS NOT NULL").join(known, "_k", "left")
    streets = q.where("_k IS NULL")
    named = places.withColumn("_low", F.lower("address"))
    found = containing(streets, named, "_text", "_low").join(named, F.col("text") == F.col("_low")).groupBy("pattern").agg(latest)
    on_street = streets.join(found, F.col("_text") == F.col("pattern"), "left")
    return at_house.select(*queries.columns, "_p").unionByName(on_street.select(*queries.columns, "_p")).select(
        *queries.columns, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), F.col("_p.address").alias("address_formatted"))


def jitter(key: Column, salt: str, width: float) -> Column:
    """Reproducible offset in [-width, width) from a hash of the key."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double")
    return (h / 4294967296.0 * 2 - 1) * width


def geocode_by_district(listings: DataFrame, districts: DataFrame, width: float = 0.01) -> DataFrame:
    """Listings without coordinates placed near the centre of their district."""
    c = districts.where("center_lat IS NOT NULL AND center_lon IS NOT NULL").select("district_id", "center_lat", "center_lon")
    return listings.where("lat IS NULL OR lon IS NULL").select("id", "district_id").join(c, "district_id").select(
        "id", (F.col("center_lat") + jitter(F.col("id"), "lat", width)).alias("lat"),
        (F.col("center_lon") + jitter(F.col("id"), "lon", width)).alias("lon"))


def nearby_deals(subjects: DataFrame, deals: DataFrame, as_of: str, radius_m: float = 2000.0, max_age_days: int = 365, limit: int = 20) -> DataFrame:
    """Nearest recent deals of fitting size and era; all nearest ones if fewer than three fit."""
    cut = ts(as_of) - F.expr(f"INTERVAL {max_age_days} DAYS")
    pts = deals.where((F.col("deal_price") > 0) & (F.col("area") > 0) & (F.col("deal_date") >= cut)).select(
        "id", "lat", "lon", "area", "year_build", "deal_price", "deal_date")
    near = nearest(subjects, pts, 3 * limit, F.lit(True), lambda cls, lo, hi: F.lit(True), [], _meters_box(radius_m), round_box=True)
    near = near.where(F.col("distance_km") * 1000 <= radius_m)
    ty, cy, a = F.col("building_year"), F.col("c_year_build"), F.col("area_total")
    era_bad = F.coalesce((ty != 0) & (cy != 0) & F.when(ty >= 2000, cy < 1990).when(ty < 1990, cy >= 2000).otherwise(F.lit(False)), F.lit(False))
    ratio_bad = F.coalesce(~(F.col("c_area") / F.nullif(a, F.lit(0.0))).between(0.5, 1.5), F.lit(False))
    ok = (F.col("c_area") >= 20) & ~era_bad & ~ratio_bad
    per = Window.partitionBy(*per_subject(near))
    m = near.withColumn("_ok", ok).withColumns({"_n": F.count(F.lit(1)).over(per), "_pass": F.count_if(F.col("_ok")).over(per)})
    kept = m.where(F.col("_ok") | ((F.col("_pass") < 3) & (F.col("_n") >= 3))).drop("rank")
    return top_rows(kept, per_subject(kept), [F.asc("distance_km"), F.asc("c_id")], limit).select(
        "subject_id", "rank", F.col("c_id").alias("deal_id"), F.col("c_deal_price").alias("deal_price"), F.col("c_area").alias("area"),
        F.col("c_deal_date").alias("deal_date"), (F.col("distance_km") * 1000).alias("distance_m"))
