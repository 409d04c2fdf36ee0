"""Counts within a radius, and the nearest of a set of centres, without pairing up crowded places.

Counts: around a crowded place the circle is cut into cells of a pyramid. Cells wholly inside give their sums; only points
in cells on the rim are compared one by one. How fine the cells are follows from the number of points around, so the work
grows with its root and not with the number itself.

Nearest: a tree of the centres is searched from the top for all places at once. A node bounds the distance to its centres
from below and above, and what lies surely farther than the best bound is left. That holds at any distance, at the poles
and over the date line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.geo import EARTH_KM, cell, haversine_km

KM_PER_DEG = EARTH_KM * 3.141592653589793 / 180.0
# Pyramid: a cell has 4 x 4 children, down to this many generations below cells as high as the radius.
GENERATIONS = 4
# Points around a place that are still compared one by one per cell of a row of cells.
PER_CELL = 20
SLACK_KM = 1e-3     # distances are rounded to a millimetre
# Tree of centres: degrees of a node's cell, each a part of the one before.
NODE_DEGREES = (64.0, 8.0, 1.0, 1 / 8, 1 / 64)


# --- cells around a place --------------------------------------------------------------

def row_width(row: Column, deg: float) -> Column:
    """Width in degrees of longitude of the cells in a latitude row: at least ``deg`` on the ground."""
    edge = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * deg, F.lit(89.0))
    return F.lit(deg) / F.cos(F.radians(edge))


def radius_degrees(radius_m: float) -> float:
    return radius_m / 1000.0 / KM_PER_DEG * 1.001


def asked_cells(left: DataFrame, deg: float) -> DataFrame:
    """Rows of ``left`` with each cell (``_cy``, ``_cx``) that a circle of ``deg`` degrees around lat, lon may meet."""
    reach = F.lit(deg) / F.cos(F.radians(F.least(F.abs("lat") + deg, F.lit(89.0))))
    # close to a pole a circle may hold all longitudes; over the date line it is asked for on both sides
    polar = F.abs("lat") + deg >= 89.0
    sides = F.when(~polar & (F.abs("lon") + reach > 180.0), F.array(F.col("lon"), F.col("lon") - F.signum("lon") * 360.0)).otherwise(F.array("lon"))
    west, east = (F.when(polar, F.lit(end)).otherwise(F.col("_at") + side) for end, side in ((-180.0, -reach), (180.0, reach)))
    return (left.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_at", F.explode(sides))
            .withColumn("_cy", F.explode(F.sequence(cell(F.col("lat") - deg, deg), cell(F.col("lat") + deg, deg))))
            .withColumn("_w", row_width(F.col("_cy"), deg))
            .withColumn("_cx", F.explode(F.sequence(cell(west, F.col("_w")), cell(east, F.col("_w"))))).drop("_w", "_at"))


def _box_slack_km(half_lat: Column, half_lon: Column, lat: Column) -> Column:
    """No point of the box is farther from its centre: along the meridian and then along its own parallel."""
    nearest_equator = F.greatest(F.abs(lat) - half_lat, F.lit(0.0))
    return (half_lat + half_lon * F.cos(F.radians(nearest_equator))) * KM_PER_DEG


# --- counts within a radius ------------------------------------------------------------

def _pyramid_cell(deg: float, gen: Column) -> list[Column]:
    """Cell of a point in the given generation; exact, as generations differ by powers of two."""
    scale = F.pow(F.lit(4.0), gen)
    width = row_width(cell(F.col("lat"), deg), deg)
    return [F.floor(F.col("lat") / deg * scale).alias("_cy"), F.floor(F.col("lon") / width * scale).alias("_cx")]


def _side(asked: DataFrame, deg: float, radius_km: float) -> DataFrame:
    """``_whole``: the cell (``_gen``, ``_cy``, ``_cx``) lies inside of the circle; cells outside of it are left out."""
    gen = F.col("_gen")
    scale = F.pow(F.lit(4.0), gen)
    width = row_width(F.floor(F.col("_cy") / scale), deg)
    lat, lon = (F.col("_cy") + 0.5) / scale * deg, (F.col("_cx") + 0.5) / scale * width
    slack = _box_slack_km(deg / 2 / scale, width / 2 / scale, lat)
    d = haversine_km(F.col("lat"), F.col("lon"), lat, lon)
    return (asked.withColumns({"_d": d, "_slack": slack}).where(F.col("_d") - F.col("_slack") <= radius_km + SLACK_KM)
            .withColumn("_whole", F.col("_d") + F.col("_slack") <= radius_km - SLACK_KM).drop("_d", "_slack"))


def circle_cells(places: DataFrame, spots: DataFrame, radius_m: float) -> DataFrame:
    """(lat, lon, _gen, _cy, _cx, _whole): the cells that make up the circle around each place, fine where it is crowded."""
    deg, radius_km = radius_degrees(radius_m), radius_m / 1000.0
    base = spots.select(*_pyramid_cell(deg, F.lit(0))).groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_m"))
    met = asked_cells(places.select("lat", "lon"), deg).join(base, ["_cy", "_cx"])
    # a handful of cells per place
    around = met.groupBy("lat", "lon").agg(F.sum("_m").alias("_m"), F.collect_list(F.struct("_cy", "_cx")).alias("_cells"))
    depth = F.ceil(F.log2(F.col("_m") / PER_CELL) / 4).cast("int")
    rows = around.select("lat", "lon", F.least(F.greatest(depth, F.lit(0)), F.lit(GENERATIONS)).alias("_to"), F.inline("_cells"))
    rows = _side(rows.withColumn("_gen", F.lit(0)), deg, radius_km)
    for gen in range(1, GENERATIONS + 1):
        split = (F.col("_to") >= gen) & ~F.col("_whole")
        own = F.array(F.struct(F.col("_gen").alias("g"), F.col("_cy").alias("y"), F.col("_cx").alias("x")))
        kids = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(
            F.lit(gen).alias("g"), (F.col("_cy") * 4 + i).alias("y"), (F.col("_cx") * 4 + k).alias("x")))))
        rows = rows.select("lat", "lon", "_to", F.explode(F.when(split, kids).otherwise(own)).alias("_c"))
        rows = _side(rows.select("lat", "lon", "_to", F.col("_c.g").alias("_gen"), F.col("_c.y").alias("_cy"), F.col("_c.x").alias("_cx")), deg, radius_km)
    return rows.drop("_to")


def radius_counts(places: DataFrame, spots: DataFrame, radius_m: float, by: Sequence[str] = ()) -> DataFrame:
    """(lat, lon, *by, n): per place the sum of ``n`` over the spots within the radius.

    places: distinct lat, lon. spots: lat, lon, *by, n; distinct but for n, few values of ``by`` at one place.
    """
    deg, keys = radius_degrees(radius_m), ["_gen", "_cy", "_cx"]
    cells = circle_cells(places, spots, radius_m)
    known = spots.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", *by, "n")
    every = known.withColumn("_gen", F.explode(F.array(*[F.lit(g) for g in range(GENERATIONS + 1)]))).select("*", *_pyramid_cell(deg, F.col("_gen")))
    sums = every.groupBy(*keys, *by).agg(F.sum("n").alias("n"))
    whole = cells.where("_whole").join(sums, keys).select("lat", "lon", *by, "n")
    rim = every.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *by, "n")
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    close = cells.where("NOT _whole").join(rim, keys).where(d * 1000 <= radius_m).select("lat", "lon", *by, "n")
    return whole.unionByName(close).groupBy("lat", "lon", *by).agg(F.sum("n").alias("n"))


# --- nearest centre at any distance ----------------------------------------------------

def _node(lat: str, lon: str, deg: float) -> Column:
    return F.struct(cell(F.col(lat), deg).alias("y"), cell(F.col(lon), deg).alias("x"))


def _nodes(centres: DataFrame, level: int) -> DataFrame:
    """_up (node one level up), _node, _lat, _lon, _slack: no centre of the node is farther than _slack from its middle."""
    deg = NODE_DEGREES[level]
    up = _node("lat", "lon", NODE_DEGREES[max(level - 1, 0)])
    boxes = centres.groupBy(up.alias("_up"), _node("lat", "lon", deg).alias("_node")).agg(
        *[f(c).alias(f"{name}_{c}") for c in ("lat", "lon") for f, name in ((F.min, "lo"), (F.max, "hi"))])
    half_lat, half_lon = ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2 for c in ("lat", "lon"))
    lat, lon = ((F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2 for c in ("lat", "lon"))
    return boxes.select("_up", "_node", lat.alias("_lat"), lon.alias("_lon"), _box_slack_km(half_lat, half_lon, lat).alias("_slack"))


def nearest_candidates(places: DataFrame, centres: DataFrame) -> DataFrame:
    """(lat, lon, _node): the finest nodes that may hold a centre nearest to the place."""
    # at most 18 nodes of 64 degrees
    top = _nodes(centres, 0).select("_node", "_lat", "_lon", "_slack").collect()
    roots = F.array(*[F.struct(F.struct(F.lit(n._node.y).alias("y"), F.lit(n._node.x).alias("x")).alias("node"), haversine_km(F.col("lat"), F.col("lon"), F.lit(n._lat), F.lit(n._lon)).alias("d"),
                               F.lit(n._slack).alias("slack")) for n in top])
    best = F.array_min(F.transform("_roots", lambda r: r["d"] + r["slack"]))
    kept = F.filter("_roots", lambda r: r["d"] - r["slack"] <= F.col("_best") + SLACK_KM)
    open_ = places.select("lat", "lon", roots.alias("_roots")).withColumn("_best", best).select("lat", "lon", F.explode(kept).alias("_r")).select(
        "lat", "lon", F.col("_r.node").alias("_up"))
    for level in range(1, len(NODE_DEGREES)):
        far = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
        met = open_.join(_nodes(centres, level), "_up").withColumn("_d", far)
        bound = F.min(F.col("_d") + F.col("_slack")).over(Window.partitionBy("lat", "lon"))
        open_ = met.withColumn("_best", bound).where(F.col("_d") - F.col("_slack") <= F.col("_best") + SLACK_KM).select("lat", "lon", F.col("_node").alias("_up"))
    return open_.withColumnRenamed("_up", "_node")


def nearest_centre(places: DataFrame, centres: DataFrame) -> DataFrame:
    """(lat, lon, id, distance_km): per place (distinct lat, lon) the nearest centre (id, lat, lon), the smallest id on ties."""
    known = centres.where("lat IS NOT NULL AND lon IS NOT NULL")
    if known.isEmpty():
        return places.select("lat", "lon", F.lit(None).cast(centres.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("distance_km")).limit(0)
    leaves = known.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), _node("lat", "lon", NODE_DEGREES[-1]).alias("_node"))
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    met = nearest_candidates(places, known).join(leaves, "_node")
    best = met.groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), F.col("id").alias("id"))).alias("_b"))
    return best.select("lat", "lon", F.col("_b.id").alias("id"), F.col("_b.d").alias("distance_km"))

