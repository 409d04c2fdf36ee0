"""Nearest eligible points for a whole table of subjects, without a spatial index.

Points are keyed by grid cells of several sizes and by a lane (their rooms, or a step of area), so that a subject meets only
those of the lanes that may suit it. A dense neighbourhood is searched in small cells, a sparse one in the largest cells,
whose 3 x 3 block covers the search box. Which size is enough follows from counts alone, so the result is the exact
nearest-n, and the pairs looked at per subject stay near a multiple of n however crowded a place is, or are all that the
lanes hold where eligible points are rare.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.geo import block, cell, haversine_km


@dataclass(frozen=True)
class Box:
    """Half-extent of the search box in degrees."""

    lat: float = 0.05
    lon: float = 0.07


# Cell size is halved per level; a search at level j needs the counts of level j + 2.
SEARCH_LEVELS = (0, 2, 4, 6, 8)
# Width over height of a cell in km.  Inside these bounds a 3 x 3 block of search cells reaches
# every point that can beat the ones counted two levels down; outside, the whole box is searched.
SHAPE_BOUNDS = (0.6, 1.7)
# Close to the date line neighbours may lie across it: search the whole box there, on both sides.
DATE_LINE = 175.0
# Areas are counted in steps of a tenth, the last of them open; larger classes than the last share one.
AREA_STEP, LAST_STEP, LAST_CLASS = 0.0953, 120, 10
NO_AREA, OTHER_CLASS, NO_LANE, ALL_LANES = -1, LAST_CLASS + 1, -1, LAST_CLASS + 1
# Borders of steps are not exact in floating point.
HAIR = 1e-9
# Degrees are taken as a plane when far corners are cut off; this much (of squares) covers the difference. Cells of boxes
# above PLANE are too large for that at the coarsest level.
SLACK, PLANE = 1.1, 1.0
# A search and what it depends on; one of more subjects than this is dealt out in parts.
SEARCH = ["_level", "cy", "cx", "_lanes", "_free", "_step"]
HOME_SUBJECTS = 100_000

Condition = Callable[[Column, Column, Column], Column]


def _size(extent: float, level: int | Column) -> Column:
    # a hair larger than the box, so that box edges never fall two cells away
    lev = F.lit(level) if isinstance(level, int) else level
    return F.lit(extent * 1.002) / F.pow(F.lit(2.0), lev)


def _cells(box: Box, level: Column, lat: str, lon: str) -> list[Column]:
    return [cell(F.col(lat), _size(box.lat, level)).alias("cy"), cell(F.col(lon), _size(box.lon, level)).alias("cx")]


def collapse_piles(points: DataFrame, attrs: Sequence[str], keep: int, key: str = "id") -> DataFrame:
    """Of points alike in place and in every attribute that decides eligibility, only the first
    ``keep`` by id can be among the nearest ``keep``: distance ties are settled by id."""
    w = Window.partitionBy("lat", "lon", *attrs).orderBy(key)
    return points.withColumn("_pile", F.row_number().over(w)).where(F.col("_pile") <= keep).drop("_pile")


def _area_step(area: Column) -> Column:
    step = F.when(area > 1.0, F.least(F.floor(F.log(area) / AREA_STEP), F.lit(LAST_STEP))).when(area.isNotNull(), F.lit(0))
    return F.coalesce(step, F.lit(NO_AREA)).cast("int")


def _meets(condition: Condition, e: Column) -> Column:
    """``condition`` of a histogram entry: its class (null if it shares the last one) and the areas it reaches from and to."""
    return F.coalesce(condition(F.when(e["_r"] != OTHER_CLASS, e["_r"]), e["_lo"], e["_hi"]), F.lit(False))


def _block_histograms(points: DataFrame, box: Box, cls: Column, levels: Sequence[int], need: int) -> DataFrame:
    """Per (level, cell): how many points of each class and area step the 3 x 3 block holds, where it has ``need`` in all."""
    area = F.col("area_total") if "area_total" in points.columns else F.lit(None)
    kind = F.coalesce(cls.cast("int"), F.lit(-1))
    p = points.select("lat", "lon", F.when(kind > LAST_CLASS, OTHER_CLASS).otherwise(kind).alias("_r"), _area_step(area).alias("_b"))
    counted = F.array(*[F.lit(j + 2) for j in levels])
    own = (p.withColumn("level", F.explode(counted)).select("level", "_r", "_b", *_cells(box, F.col("level"), "lat", "lon"))
           .groupBy("level", "cy", "cx", "_r", "_b").agg(F.count(F.lit(1)).alias("_n")))
    near = (own.withColumn("_c", F.explode(block(F.col("cy"), F.col("cx"))))
            .groupBy("level", F.col("_c.cy").alias("cy"), F.col("_c.cx").alias("cx"), "_r", "_b").agg(F.sum("_n").alias("_n")))
    lo = F.when(F.col("_b") == 0, F.lit(float("-inf"))).when(F.col("_b") > 0, F.exp(F.col("_b") * AREA_STEP) * (1 - HAIR))
    hi = F.when(F.col("_b") == LAST_STEP, F.lit(float("inf"))).when(F.col("_b") >= 0, F.exp((F.col("_b") + 1) * AREA_STEP) * (1 + HAIR))
    # at most (LAST_CLASS + 3) * (LAST_STEP + 2) entries per cell
    return near.groupBy("level", "cy", "cx").agg(F.collect_list(F.struct("_r", lo.alias("_lo"), hi.alias("_hi"), "_n")).alias("_hist"), F.sum("_n").alias("_all")).where(
        F.col("_all") >= need).drop("_all")


def _shut(points: DataFrame, need: int, of_point: Column) -> DataFrame:
    """Points beside ``_shut``, the free lanes (ALL_LANES for all together) that hold ``need`` smaller ids at the very place.

    Those come before the point for every subject that accepts the whole lane. A place holds ``need`` points per combination of
    attributes at most (``collapse_piles``).
    """
    w = Window.partitionBy("lat", "lon").orderBy("id")
    p = points.withColumn("_new", F.col("id").isNotNull() & F.coalesce(F.lag("id").over(w) != F.col("id"), F.lit(True))).withColumn("_f", of_point)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = {k: F.sum(F.when(F.col("_new") & ((F.col("_f") == k) if k < ALL_LANES else F.lit(True)), 1)).over(before) for k in range(ALL_LANES + 1)}
    return p.withColumn("_shut", F.array_compact(F.array(*[F.when(n >= need, k) for k, n in ahead.items()]))).drop("_new", "_f")


def _search_level(s: DataFrame, pts: DataFrame, need: int, sure: Condition, box: Box, cls: Column | None, levels: Sequence[int]) -> DataFrame:
    """Subjects beside ``_level``, the finest at which counts alone show that the block holds the answer (else 0), and ``_far``.

    ``_far`` is the squared distance, in cells of that level, to the farthest corner of what was counted; NULL where nothing was.
    """
    counted = [j for j in levels if j > 0 or box.lat <= PLANE]
    hist = _block_histograms(pts, box, F.lit(-1) if cls is None else cls, counted, need).withColumnRenamed("level", "_lv")
    ratio = F.cos(F.radians("lat")) * (box.lon / box.lat)
    plain = ratio.between(*SHAPE_BOUNDS) & (F.abs("lon") <= DATE_LINE)
    look = s.where(plain).withColumn("_lv", F.explode(F.array(*[F.lit(j + 2) for j in counted])))
    look = look.select("*", *_cells(box, F.col("_lv"), "lat", "lon")).join(hist, ["_lv", "cy", "cx"])
    fits = F.aggregate("_hist", F.lit(0).cast("long"), lambda acc, e: F.when(_meets(sure, e), acc + e["_n"]).otherwise(acc))
    best = look.where(fits >= need).groupBy("subject_id").agg((F.max("_lv") - 2).alias("_best"))

    def reach(name: str, extent: float) -> Column:
        at = F.col(name) / _size(extent, F.col("_best") + 2)
        return F.pow((1 + F.greatest(at - F.floor(at), 1 - at + F.floor(at))) / 4, 2)

    far = (reach("lat", box.lat) + F.pow(ratio, 2) * reach("lon", box.lon)) * SLACK
    return s.join(best, "subject_id", "left").withColumns({"_level": F.coalesce("_best", F.lit(0)), "_far": far}).drop("_best")


def _asked(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects beside ``_home`` and ``_ask``, a hash of their search, and the searches of each home with the same columns.

    A home is one search, shared by all subjects that ask for it; searches of very many subjects are split. Subjects that
    need several (near the date line, or an id that repeats) have a home of their own, so a subject id meets one home only.
    """
    same = Window.partitionBy("subject_id")
    placed = placed.withColumns({"_k": F.xxhash64(*SEARCH), "_ask": F.xxhash64(F.lit("ask"), *SEARCH)})
    placed = placed.withColumn("_own", F.when(F.min("_k").over(same) != F.max("_k").over(same), F.xxhash64("subject_id")))
    asks = placed.groupBy("_k", "_own", "_ask", *SEARCH).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / HOME_SUBJECTS).cast("int")
    crowded = F.broadcast(asks.where("_own IS NULL").groupBy("_k").agg(F.sum("_n").alias("_n")).where(F.col("_n") > HOME_SUBJECTS).select("_k", parts.alias("_parts")))

    def home(part: Column) -> Column:
        return F.when(F.col("_own").isNull(), F.xxhash64("_k", part)).otherwise(F.xxhash64(F.col("_own"), F.lit("own")))

    many = F.coalesce("_parts", F.lit(1))
    s = placed.join(crowded, "_k", "left").withColumn("_home", home(F.pmod(F.xxhash64("subject_id", F.lit("part")), many).cast("int")))
    a = asks.join(crowded, "_k", "left").withColumn("_part", F.explode(F.when(F.col("_own").isNull(), F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.lit(0)))))
    return s.drop("_k", "_own", "_parts"), a.select(home(F.col("_part")).alias("_home"), "_ask", *SEARCH).distinct()


def candidate_pairs(subjects: DataFrame, points: DataFrame, n: int, sure: Condition, attrs: Sequence[str], box: Box, cls: Column | None,
                    levels: Sequence[int], round_box: bool, lane: Column | None, lanes: Column | None,
                    free: tuple[Column, Column] | None = None) -> DataFrame:
    """The pairs that ``nearest`` looks at, dealt out by ``_home``."""
    need = n + 1  # one spare: the subject itself may be excluded
    pts = collapse_piles(points, attrs, need)
    s = subjects.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if round_box:
        near_pole = F.abs("lat") + box.lat >= 89.0
        width = F.when(near_pole, 180.0).otherwise(F.lit(box.lat) / F.cos(F.radians(F.abs("lat") + box.lat)))
        s = s.withColumn("_reach", F.greatest(width, F.lit(box.lon)))
    else:
        s = s.withColumn("_reach", F.lit(box.lon))

    placed = _search_level(s, pts, need, sure, box, cls, levels)
    # a box over the date line is asked for on both sides; only searches of the whole box are that close to it
    over = F.abs("lon") + F.col("_reach") > 180.0
    placed = placed.withColumn("_at", F.explode(F.when(over, F.array(F.col("lon"), F.col("lon") - F.signum("lon") * 360.0)).otherwise(F.array("lon"))))
    # at level 0 a round box may be several cells wide
    step = F.when(F.col("_level") == 0, F.greatest(F.ceil(F.col("_reach") / _size(box.lon, 0)), F.lit(1))).otherwise(F.lit(1)).cast("long")
    placed = placed.select("*", *_cells(box, F.col("_level"), "lat", "_at"), step.alias("_step"), (F.array(F.lit(0)) if lanes is None else lanes).alias("_lanes"),
                           (F.lit(None) if free is None else free[1]).cast("int").alias("_free"), (1 / _size(box.lat, F.col("_level"))).alias("_per_lat"),
                           (F.cos(F.radians("lat")) * (box.lon / box.lat) / _size(box.lon, F.col("_level"))).alias("_per_lon"))
    placed, asks = _asked(placed)
    # few rows meet here and many come out: keep AQE from merging the tasks
    placed = placed.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_home")

    # each point goes to the homes that ask for it, so all pairs of a subject arise in one task and are not moved
    asks = (asks.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
            .withColumn("cx", F.explode(F.sequence(F.col("cx") - F.col("_step"), F.col("cx") + F.col("_step"))))
            .withColumn("_lane", F.explode("_lanes")).select("_home", "_ask", "_level", "cy", "cx", "_lane", "_free"))
    kept = pts.columns
    c = pts if free is None else _shut(pts, need, free[0])
    c = c.withColumn("_lane", F.lit(0) if lane is None else F.coalesce(lane.cast("int"), F.lit(NO_LANE)))
    c = c.select("_lane", *[x for x in ("_shut",) if free is not None], *[F.col(x).alias(f"c_{x}") for x in kept]).withColumn(
        "_level", F.explode(F.array(*[F.lit(j) for j in levels])))
    c = c.select("*", *_cells(box, F.col("_level"), "c_lat", "c_lon")).join(asks, ["_level", "cy", "cx", "_lane"])
    if free is not None:
        c = c.where(F.col("_free").isNull() | ~F.array_contains("_shut", F.col("_free")))
    c = c.select(F.col("_home").alias("_c_home"), F.col("_ask").alias("_c_ask"), *[f"c_{x}" for x in kept])
    pairs = placed.join(c, (F.col("_home") == F.col("_c_home")) & (F.col("_ask").bitwiseXOR(F.col("_c_ask")) == 0))
    # what lies beyond the corners of the counted block comes after all that was counted
    dy, dx = (F.col("c_lat") - F.col("lat")) * F.col("_per_lat"), (F.col("c_lon") - F.col("_at")) * F.col("_per_lon")
    pairs = pairs.where(F.col("_far").isNull() | (dy * dy + dx * dx <= F.col("_far")))
    return pairs.drop("_c_home", "_c_ask", "_ask", "_far", "_per_lat", "_per_lon", *SEARCH)


def per_subject(df: DataFrame, key: str = "subject_id") -> list[str]:
    """Columns to window or group by, per subject: with ``_home`` beside the id the rows stay where ``nearest`` has put them."""
    return [key, *[c for c in df.columns if c == "_home"]]


def nearest(subjects: DataFrame, points: DataFrame, n: int, eligible: Column, sure: Condition, attrs: Sequence[str], box: Box = Box(),
            cls: Column | None = None, levels: Sequence[int] = SEARCH_LEVELS, round_box: bool = False, lane: Column | None = None,
            lanes: Column | None = None, free: tuple[Column, Column] | None = None) -> DataFrame:
    """The ``n`` nearest eligible points per subject inside the box, by (distance, id).

    With ``round_box`` the box must hold a circle of radius ``box.lat`` degrees: its width follows the latitude of the
    subject, up to the whole parallel. Longitudes are compared the short way round, so boxes reach over the date line.

    subjects: subject_id, lat, lon, ...; points: id, lat, lon, [area_total], ....
    ``cls``: small integer class of a point, e.g. its room count.
    ``eligible``: condition over subject columns and point columns prefixed ``c_``; besides
    subject values it may use only ``c_id`` inequality and the point columns in ``attrs``.
    ``sure(class, lo, hi)``: true only if every point of that class (-1 = none) with an area in [lo, hi) is eligible for the
    subject; it merely picks the cell size. It gets NULL for a class beyond the last and for a missing area.
    ``lane``: whole number of a point (NULL counts as NO_LANE); ``lanes``: array of all those that may hold eligible points for
    a subject, without repeats.
    ``free``: lane from 0 to LAST_CLASS of a point (or NULL), and of a subject that accepts every point of it (ALL_LANES if it
    accepts all points, NULL if it may reject any): where a place holds many of that lane, only the first ids are looked at.
    Point columns come out prefixed ``c_``, with ``distance_km`` and ``rank``, and ``_home``, the same for all rows of a
    subject (see ``per_subject``).
    """
    pairs = candidate_pairs(subjects, points, n, sure, attrs, box, cls, levels, round_box, lane, lanes, free)
    pairs = pairs.where((F.abs(F.col("c_lat") - F.col("lat")) <= box.lat) & (F.abs(F.col("c_lon") - F.col("_at")) <= F.col("_reach"))
                        & (F.col("c_lon") - F.col("_at") > -180.0) & eligible).drop("_at", "_reach")
    pairs = pairs.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")))
    w = Window.partitionBy(*per_subject(pairs)).orderBy("distance_km", "c_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
