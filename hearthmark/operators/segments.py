"""Price segments: building type x height class x room count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known building types, height classes and their upper floor bounds.
BUILDING_TYPES = ("panel", "brick", "monolithic", "block", "wood")
COMMON_TYPES = ("panel", "brick", "monolithic", "block")
HEIGHTS = ("low", "medium", "high")
LOW_MAX_FLOORS, MEDIUM_MAX_FLOORS = 5, 10
MAX_ROOMS = 5
# Adjective forms of the building types in listing texts.
TYPE_WORDS = {
    "панельный": "panel", "кирпичный": "brick", "монолитный": "monolithic",
    "блочный": "block", "деревянный": "wood",
}

SEGMENT_KEYS = ["building_type", "building_height", "rooms_count"]


def height_class(floors: Column) -> Column:
    return (F.when(floors <= LOW_MAX_FLOORS, "low").when(floors <= MEDIUM_MAX_FLOORS, "medium")
            .when(floors.isNotNull(), "high"))


def norm_building_type(raw: Column) -> Column:
    low = F.lower(raw)
    words = F.create_map(*[F.lit(x) for kv in TYPE_WORDS.items() for x in kv])
    return (F.when(raw.isNull(), "unknown").when(low.isin(*BUILDING_TYPES), low)
            .otherwise(F.coalesce(F.try_element_at(words, low), F.lit("other"))))


def segment_key(listings: DataFrame) -> DataFrame:
    """Listings with the three segment columns; NULL parts stay NULL."""
    return (listings
            .withColumn("building_type", F.when(F.col("building_type").isNotNull(), norm_building_type(F.col("building_type"))))
            .withColumn("building_height", height_class(F.col("total_floors")))
            .withColumn("rooms_count", F.when(F.col("rooms").isNotNull(), F.least("rooms", F.lit(MAX_ROOMS)))))


def build_segments(listings: DataFrame) -> DataFrame:
    """Segment dimension: every observed combination and the common grid, with its id.

    At most (types + other) x heights x (rooms + 1) rows, whatever the size of ``listings``.
    """
    seen = segment_key(listings).select(*SEGMENT_KEYS).dropna().distinct()
    grid = listings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in COMMON_TYPES])).alias("building_type"))
    grid = grid.withColumn("building_height", F.explode(F.array(*[F.lit(h) for h in HEIGHTS])))
    grid = grid.withColumn("rooms_count", F.explode(F.sequence(F.lit(1), F.lit(MAX_ROOMS))))
    return seen.unionByName(grid).distinct().withColumn("segment_id", segment_id())


def segment_id() -> Column:
    """Id spelled from the three keys: it never changes when new combinations turn up."""
    kind = F.array_position(F.array(*[F.lit(t) for t in (*BUILDING_TYPES, "other", "unknown")]), F.col("building_type"))
    height = F.array_position(F.array(*[F.lit(h) for h in HEIGHTS]), F.col("building_height"))
    return (kind * 100 + height * 10 + F.col("rooms_count")).cast("int")


def assign_segment(listings: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Listings beside ``segment_id``, NULL where a key is unknown.

    With ``segments`` only its rows count; the dimension has at most some hundred rows, so it is broadcast.
    """
    keyed = segment_key(listings)
    if segments is None:
        return keyed.withColumn("segment_id", segment_id())
    return keyed.join(F.broadcast(segments.select(*SEGMENT_KEYS, "segment_id")), SEGMENT_KEYS, "left")


def segment_summary(listings: DataFrame, segments: DataFrame) -> DataFrame:
    """Counters as rows: how many segments exist, how many listings have one."""
    n_seg = segments.agg(F.lit("segments").alias("summary"), F.count(F.lit(1)).alias("value"))
    n_lst = (assign_segment(listings, segments).where("segment_id IS NOT NULL")
             .agg(F.lit("listings with segment").alias("summary"), F.count(F.lit(1)).alias("value")))
    return n_seg.unionByName(n_lst)
