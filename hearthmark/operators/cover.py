"""Outlines as cells of a quadtree: cells wholly inside need no test, border cells need the few edges of their row.

An outline lies on a grid of its own fineness, fitted to its extent, so a house and a country take a like number of cells:
coarse ones that no edge passes, and in the others 2 ** STEP by 2 ** STEP fine ones, at most (2 ** (2 * STEP) + 2 ** STEP) ** 2
together. Cells are named by absolute powers of two, so the cells of all outlines share a few levels and a point is looked
up once per level. Powers of two also keep the cell arithmetic exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 3                  # a coarse cell has 2 ** STEP by 2 ** STEP fine ones, an outline at most one coarse cell more each way
DEEPEST = 30              # cells of 2 ** -30 degrees are the smallest
MARGIN = 1e-9             # degrees: an edge also marks cells that it passes so closely


@dataclass(frozen=True)
class Cover:
    """cells: outline_id, lv, cy, cx, edges (of the outline in the cell's row; null for a cell wholly inside)."""

    cells: DataFrame
    levels: list[int]


def _scale(lv: Column) -> Column:
    return F.pow(F.lit(2.0), lv.cast("double"))


def _cell(value: Column, lv: Column) -> Column:
    return F.floor(value * _scale(lv)).cast("long")


def finest_level(outline: Column) -> Column:
    """The level of the fine cells: coarse ones are 1 to 2 ** -STEP times as large as the outline."""
    points = F.flatten(F.flatten(outline))

    def extent(axis: str) -> Column:
        along = F.transform(points, lambda p: p[axis])
        return F.array_max(along) - F.array_min(along)
    widest = F.greatest(extent("lon"), extent("lat"), F.lit(2.0 ** -DEEPEST))
    return F.least(F.floor(-F.log2(widest) / STEP) * STEP + 2 * STEP, F.lit(DEEPEST)).cast("int")


def outline_edges(outlines: DataFrame) -> DataFrame:
    """outline_id, lv, edge (poly, x1, y1, x2, y2) of every edge. Edges with a missing vertex do not count."""
    polys = outlines.where("outline IS NOT NULL").select("outline_id", finest_level(F.col("outline")).alias("lv"), F.posexplode("outline").alias("poly", "rings"))
    rings = polys.select("outline_id", "lv", "poly", F.explode("rings").alias("ring")).where("size(ring) > 1")
    n = F.size("ring") - 1
    ends = F.zip_with(F.slice("ring", 1, n), F.slice("ring", 2, n), lambda a, b: F.struct(
        F.col("poly"), a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))
    known = F.filter(ends, lambda e: (e["x1"] + e["y1"] + e["x2"] + e["y2"]).isNotNull())
    return rings.select("outline_id", "lv", F.explode(known).alias("edge"))


def _crossed(edge: Column, lat: Column, lon: Column) -> Column:
    """A ray to the east of the point meets the edge; lower and left edges belong to an outline."""
    slope = (edge["x2"] - edge["x1"]) * (lat - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0))
    return ((edge["y1"] > lat) != (edge["y2"] > lat)) & (lon < slope + edge["x1"])


def inside(edges: Column, lat: Column, lon: Column) -> Column:
    """Some polygon has an odd number of crossings; ``edges`` are at least those that meet the point's latitude."""
    polys = F.transform(F.filter(edges, lambda e: F.coalesce(_crossed(e, lat, lon), F.lit(False))), lambda e: e["poly"])
    return F.exists(F.array_distinct(polys), lambda p: F.size(F.filter(polys, lambda q: q == p)) % 2 == 1)


def _meets_row(edge: Column, lv: Column, cy: Column) -> Column:
    return (_cell(F.least(edge["y1"], edge["y2"]), lv) <= cy) & (_cell(F.greatest(edge["y1"], edge["y2"]), lv) >= cy)


def _reach(edge: Column, lv: Column, cy: Column) -> tuple[Column, Column]:
    """From where to where the edge goes within a row of cells that it meets."""
    size = 1.0 / _scale(lv)
    low = F.greatest(F.least(edge["y1"], edge["y2"]), cy * size)
    high = F.least(F.greatest(edge["y1"], edge["y2"]), (cy + 1) * size)

    def at(y: Column, flat: Column) -> Column:
        return F.when(edge["y1"] == edge["y2"], flat).otherwise(edge["x1"] + (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / F.nullif(edge["y2"] - edge["y1"], F.lit(0.0)))
    one, two = at(low, edge["x1"]), at(high, edge["x2"])
    return F.least(one, two) - MARGIN, F.greatest(one, two) + MARGIN


def _with_cells(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """outline_id, lv, cy, edges -> one row per cell from ``first`` to ``last`` that an edge passes or that lies inside, with ``border``."""
    lv, cy = F.col("lv"), F.col("cy")
    spans = F.transform("edges", lambda e: F.struct(*[_cell(x, lv).alias(name) for x, name in zip(_reach(e, lv, cy), ("w", "e"))]))
    cells = rows.withColumn("_spans", spans).withColumn("cx", F.explode(F.sequence(first, last)))
    border = F.exists("_spans", lambda s: (s["w"] <= F.col("cx")) & (s["e"] >= F.col("cx")))
    # no edge passes through: one point tells for the whole cell
    middle = [(F.col(c) + 0.5) / _scale(lv) for c in ("cy", "cx")]
    return cells.withColumn("border", border).drop("_spans").where(F.col("border") | inside(F.col("edges"), *middle))


def cover(outlines: DataFrame) -> Cover:
    """Cells of all outlines (outline_id, unique; outline: array of polygons, each an array of closed rings of lon, lat).

    The only shuffle brings the edges of a coarse row of one outline together.
    """
    lv, wide = F.col("lv"), 1 << STEP
    edges = outline_edges(outlines).withColumn("lv", lv - STEP)
    in_row = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("edge.y1", "edge.y2"), lv), _cell(F.greatest("edge.y1", "edge.y2"), lv))))
    rows = in_row.groupBy("outline_id", "lv", "cy").agg(F.collect_list("edge").alias("edges"))
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["x1"], e["x2"])))
    coarse = _with_cells(rows, _cell(F.array_min(ends) - MARGIN, lv), _cell(F.array_max(ends) + MARGIN, lv))

    fine = coarse.where("border").select("outline_id", (lv + STEP).alias("lv"), F.explode(F.sequence(F.col("cy") * wide, F.col("cy") * wide + wide - 1)).alias("cy"),
                                         F.col("cx").alias("_cx"), "edges")
    # cells of a fine row that no edge meets are outside
    fine = fine.withColumn("edges", F.filter("edges", lambda e: _meets_row(e, lv, F.col("cy")))).where("size(edges) > 0")
    fine = _with_cells(fine, F.col("_cx") * wide, F.col("_cx") * wide + wide - 1)
    named = ["outline_id", "lv", "cy", "cx"]
    cells = coarse.where("NOT border").select(*named, F.lit(None).cast(coarse.schema["edges"].dataType).alias("edges")).unionByName(
        fine.select(*named, F.when(F.col("border"), F.col("edges")).alias("edges")))
    # at most one level in STEP up to the deepest
    finest = [r.lv for r in outlines.where("outline IS NOT NULL").select(finest_level(F.col("outline")).alias("lv")).distinct().collect() if r.lv is not None]
    return Cover(cells, sorted({level - up for level in finest for up in (0, STEP)}))


def holders(points: DataFrame, key: str, covered: Cover) -> DataFrame:
    """(key, outline_id) of every outline that holds a point (key, lat, lon)."""
    p = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon", F.explode(F.array(*[F.lit(v) for v in covered.levels]).cast("array<int>")).alias("lv"))
    p = p.select("*", _cell(F.col("lat"), F.col("lv")).alias("cy"), _cell(F.col("lon"), F.col("lv")).alias("cx"))
    met = p.join(covered.cells, ["lv", "cy", "cx"])
    return met.where(F.col("edges").isNull() | inside(F.col("edges"), F.col("lat"), F.col("lon"))).select(key, "outline_id")
