"""Data-quality measures over listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.latest import with_latest_price
from hearthmark.operators.market import ts

# Label by address quality code.
ADDRESS_LABELS = {0: "Exact match", 1: "Good", 2: "Corrected", 3: "Incomplete"}


def _field_rules() -> dict[str, Column]:
    return {
        "rooms": F.col("rooms").isNotNull(),
        "area": F.col("area_total").isNotNull(),
        "address": F.col("address").isNotNull() & (F.col("address") != ""),
        "floor": F.col("floor").isNotNull(),
        "coordinates": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
    }


def quality_metrics(listings: DataFrame, as_of: str | None = None, recent_days: int | None = None) -> DataFrame:
    """Completeness of five fields over active rows, optionally only those first seen lately."""
    rows = listings.where("is_active")
    if recent_days is not None:
        rows = rows.where(F.col("first_seen") >= ts(as_of) - F.expr(f"INTERVAL {recent_days} DAYS"))
    rules = _field_rules()
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    score = sum((F.when(c, 1).otherwise(0) for c in rules.values()), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("total_listings"),
                    *[(F.count_if(c) * 100.0 / n).alias(f"pct_has_{k}") for k, c in rules.items()],
                    (F.sum(score * 20) / n).alias("avg_completeness_score"))


def suspected_shares(listings: DataFrame, prices: DataFrame, max_area: float = 20.0) -> DataFrame:
    """Price points of active listings too small to be a whole flat."""
    small = listings.where(F.col("is_active") & (F.col("area_total") < max_area))
    return small.select("id", "url", "address", "rooms", "area_total", "floor", "first_seen").join(prices.select("id", "price"), "id")


def address_label(code: Column) -> Column:
    out = None
    for k, v in ADDRESS_LABELS.items():
        out = (F if out is None else out).when(code == k, v)
    return out.when(code >= 4, "Invalid").otherwise("Not normalized")


def addresses_need_review(listings: DataFrame) -> DataFrame:
    code = F.col("address_quality_code")
    return (listings.where(code.isNull() | (code >= 2))
            .select("id", "url", F.col("address").alias("raw_address"), "resolved_address", "address_quality_code",
                    address_label(code).alias("quality_status"))
            .orderBy(code.desc_nulls_first(), "id"))


def address_stats(listings: DataFrame) -> DataFrame:
    code = F.col("address_quality_code")
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return listings.agg(
        F.count(F.lit(1)).alias("total_listings"), F.count("address_id").alias("normalized_count"),
        F.count("cadastral_number").alias("with_cadastral"), (F.count("address_id") * 100.0 / n).alias("pct_normalized"),
        (F.count("cadastral_number") * 100.0 / n).alias("pct_with_cadastral"), F.count_if(code == 0).alias("exact_matches"),
        F.count_if(code == 1).alias("good_matches"), F.count_if(code >= 2).alias("need_review"))


def issues(listings: DataFrame) -> DataFrame:
    """Active listings tagged with a risk or marked as an error, newest mark first."""
    return (listings.where(F.col("is_active") & (F.coalesce("has_risk", F.lit(False)) | F.coalesce("is_error", F.lit(False))))
            .orderBy(F.col("marked_at").desc_nulls_last(), F.desc("id")))


def coverage(df: DataFrame, columns: Sequence[str], bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row per column: filled rows and percent; plus inside / outside the (lat, lat, lon, lon) box.

    One aggregate over the data, unpivoted afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]]
    names = list(columns)
    if bbox:
        inside = F.col("lat").between(*bbox[:2]) & F.col("lon").between(*bbox[2:])
        aggs += [F.count_if(inside).alias("inside_box"), F.count_if(~inside).alias("outside_box")]
        names += ["inside_box", "outside_box"]
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names])
    return (one.select("_n", F.explode(items).alias("i")).select("i.field", "i.filled", F.col("_n").alias("total"))
            .withColumn("pct", F.col("filled") * 100.0 / F.nullif("total", F.lit(0))))


def ring_area_km2(ring: Column) -> Column:
    """Spherical area of a closed ring of (lon, lat) degrees."""
    steps = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
                       lambda a, b: F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"]))))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
    return F.abs(total) / 2 * 6371.0 * 6371.0


def hierarchy_quality(districts: DataFrame, outline: str | None = None) -> DataFrame:
    """Per level: districts, how many have a parent and an outline, and their area.

    ``outline``: array of polygons, each an array of rings (the first is the outer one).
    """
    has = F.col(outline).isNotNull() if outline else F.lit(False)
    d = districts
    if outline:
        poly = lambda p: ring_area_km2(p[0]) - F.aggregate(
            F.slice(p, 2, F.size(p)), F.lit(0.0), lambda acc, h: acc + ring_area_km2(h))
        d = d.withColumn("_km2", F.aggregate(outline, F.lit(0.0), lambda acc, p: acc + poly(p)))
    else:
        d = d.withColumn("_km2", F.lit(None).cast("double"))
    n = F.count(F.lit(1))
    return d.groupBy("level").agg(
        n.alias("total"), F.count("parent_district_id").alias("with_parent"), F.count_if(has).alias("with_outline"),
        (F.count("parent_district_id") * 100.0 / n).alias("pct_with_parent"), F.avg("_km2").alias("avg_area_km2"),
        F.sum("_km2").alias("total_area_km2"))


def recommend(listings: DataFrame, districts: DataFrame, aggregates_today: DataFrame, min_fine: int = 100) -> DataFrame:
    """Open issues as rows (priority, issue, value, action), from three one-row counts."""
    m = listings.agg((F.count(F.lit(1)) - F.count("lat")).alias("no_coords"),
                     (F.count(F.lit(1)) - F.count("district_id")).alias("no_district"))
    fine = districts.where("level >= 3").agg(F.count(F.lit(1)).alias("n"))
    today = aggregates_today.agg(F.count(F.lit(1)).alias("n"))
    m = m.withColumn("fine", fine.scalar()).withColumn("today", today.scalar())

    def item(priority: str, issue: str, value: Column, action: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(issue).alias("issue"),
                                     value.cast("long").alias("value"), F.lit(action).alias("action")))

    rows = F.array_compact(F.array(
        item("HIGH", "listings without coordinates", F.col("no_coords"), "geocode listings", F.col("no_coords") > 0),
        item("MEDIUM", "listings without district", F.col("no_district"), "assign districts", F.col("no_district") > 0),
        item("LOW", "too few fine-grained districts", F.col("fine"), "load finer districts", F.col("fine") < min_fine),
        item("MEDIUM", "no aggregates for the day", F.col("today"), "aggregate districts", F.col("today") == 0)))
    return m.select(F.inline(rows))


def threshold_checks(df: DataFrame, rules: Mapping[str, tuple[Column, str, float]]) -> DataFrame:
    """One row per check.  rule = (measured aggregate, 'min' or 'max', bound)."""
    one = df.agg(*[m.cast("double").alias(k) for k, (m, _, _) in rules.items()])
    rows = F.array(*[
        F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.lit(float(b)).alias("bound"),
                 (F.col(k) >= b if side == "min" else F.col(k) <= b).alias("passed"))
        for k, (_, side, b) in rules.items()])
    return one.select(F.inline(rows))


def freshness(listings: DataFrame, as_of: str, hours: int = 2, at: str = "first_seen") -> DataFrame:
    """Rows first seen in the last hours before ``as_of``, and before / after that point."""
    cut = ts(as_of) - F.expr(f"INTERVAL {hours} HOURS")
    return listings.agg(F.count_if((F.col(at) > cut) & (F.col(at) <= ts(as_of))).alias("fresh"),
                        F.count_if(F.col(at) <= cut).alias("rows_before"),
                        F.count_if(F.col(at) <= ts(as_of)).alias("rows_after"), F.max(at).alias("newest"))
