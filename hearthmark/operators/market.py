"""Market aggregates over listings and their latest prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.containment import matching
from hearthmark.operators.latest import with_latest_price
from hearthmark.operators.skew import exact_quantiles, null_safe_join, top_rows

# Factor on the price by condition score.
CONDITION_FACTORS = {5: 1.10, 4: 1.05, 3: 1.00, 2: 0.90, 1: 0.80}


def ts(value: str | Column) -> Column:
    """Instant literal without zone: it reaches the scan as a pushed filter for either timestamp type."""
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else value


def ppsm(price: Column, area: Column) -> Column:
    """Price per square metre; NULL on zero area."""
    return price / F.nullif(area, F.lit(0.0))


def with_ppsm(df: DataFrame, price: str = "current_price") -> DataFrame:
    return df.withColumn("price_per_sqm", ppsm(F.col(price), F.col("area_total")))


def exact_avg(col: str | Column, scale: int = 2) -> Column:
    """Average of money-like values, summed exactly so that no row order shows in it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double") / F.count(c)


def with_quantiles(agg: DataFrame, rows: DataFrame, keys: Sequence[str], value: str,
                   quantiles: Mapping[str, float]) -> DataFrame:
    """Aggregates beside exact quantiles of ``value`` over the same groups."""
    q = exact_quantiles(rows, keys, value, list(quantiles.values()), list(quantiles)).drop("n")
    return null_safe_join(agg, q, keys, "left")


def current_market(listings: DataFrame, prices: DataFrame) -> DataFrame:
    """Active listings with latest price and price per square metre."""
    return with_ppsm(with_latest_price(listings.where("is_active"), prices))


def stats_by_rooms(listings: DataFrame, prices: DataFrame) -> DataFrame:
    label = (F.when(F.col("rooms") == 0, "studio")
             .when(F.col("rooms").isNotNull(), F.concat(F.col("rooms").cast("string"), F.lit("-room"))))
    return (current_market(listings, prices).groupBy("rooms")
            .agg(F.count(F.lit(1)).alias("listings_count"), F.avg("area_total").alias("avg_area"),
                 exact_avg("current_price").alias("avg_price"), F.avg("price_per_sqm").alias("avg_price_per_sqm"),
                 F.min("current_price").alias("min_price"), F.max("current_price").alias("max_price"))
            .withColumn("room_type", label))


def median_ppsm(listings: DataFrame, prices: DataFrame, keys: Sequence[str] = ("region", "rooms", "deal_type"),
                every_point: bool = True) -> DataFrame:
    """Median price per m2 by group; over every price point, or the latest only."""
    rows = (listings.join(prices.withColumnRenamed("price", "current_price"), "id") if every_point
            else with_latest_price(listings, prices))
    rows = with_ppsm(rows).select(*keys, "price_per_sqm")
    groups = rows.groupBy(*keys).agg(F.count("price_per_sqm").alias("points"))
    return with_quantiles(groups, rows, keys, "price_per_sqm", {"median_price_per_sqm": 0.5})


def _priced(listings: DataFrame, prices: DataFrame, how: str) -> DataFrame:
    return with_ppsm(with_latest_price(listings.where("is_active"), prices, how)
                     .where("area_total > 0 AND current_price > 0"))


def district_aggregates(listings: DataFrame, prices: DataFrame, districts: DataFrame, date: str) -> DataFrame:
    """One row per district that has priced active listings, for the given day."""
    rows = _priced(listings, prices, "inner").where("district_id IS NOT NULL")
    rows = rows.join(districts.select("district_id"), "district_id", "left_semi")
    agg = rows.groupBy("district_id").agg(
        F.avg("price_per_sqm").alias("avg_price_per_sqm"), F.min("current_price").alias("min_price"),
        F.max("current_price").alias("max_price"), F.count(F.lit(1)).alias("total_listings"),
        F.avg("area_total").alias("avg_area"), F.avg("rooms").alias("avg_rooms"))
    out = with_quantiles(agg, rows, ["district_id"], "price_per_sqm", {"median_price_per_sqm": 0.5})
    return out.withColumn("date", F.to_date(F.lit(date)))


def district_stats_live(listings: DataFrame, prices: DataFrame, districts: DataFrame) -> DataFrame:
    """Like the daily aggregates, but districts without listings stay in the result."""
    names = districts.select("district_id", "name", "full_name")
    agg = district_aggregates(listings, prices, districts, "1970-01-01").drop("date")
    return (names.join(agg, "district_id", "left")
            .withColumn("total_listings", F.coalesce("total_listings", F.lit(0))))


def multidim_aggregates(listings: DataFrame, prices: DataFrame, as_of: str, max_age_days: int = 90,
                        min_listings: int = 3, segment: str = "segment_id") -> DataFrame:
    """District x segment price statistics with a sample-size confidence."""
    recent = listings.where((F.col("last_seen") >= F.date_sub(ts(as_of), max_age_days))
                            & F.col("district_id").isNotNull() & F.col(segment).isNotNull())
    rows = _priced(recent, prices, "left")
    keys = ["district_id", segment]
    agg = rows.groupBy(*keys).agg(
        F.avg("price_per_sqm").alias("avg_price_per_sqm"), F.min("current_price").alias("min_price"),
        F.max("current_price").alias("max_price"), F.count(F.lit(1)).alias("total_listings"),
        F.avg("area_total").alias("avg_area"), F.stddev_samp("price_per_sqm").alias("price_stddev"),
    ).where(F.col("total_listings") >= min_listings)
    out = with_quantiles(agg, rows, keys, "price_per_sqm", {"median_price_per_sqm": 0.5})
    return (out.withColumn("confidence_score", F.least(F.lit(100), F.expr("20 + (total_listings div 5) * 10")))
            .withColumn("date", F.to_date(F.lit(as_of))))


def aggregate_summary(aggregates: DataFrame, key: str = "district_id") -> DataFrame:
    return aggregates.agg(
        F.countDistinct(key).alias("keys_with_data"), F.sum("total_listings").alias("total_listings"),
        F.avg("avg_price_per_sqm").alias("avg_price"), F.min("avg_price_per_sqm").alias("min_price"),
        F.max("avg_price_per_sqm").alias("max_price"))


def district_map(districts: DataFrame, aggregates: DataFrame, date: str) -> DataFrame:
    """All districts beside their aggregates of one day."""
    day = aggregates.where(F.col("date") == F.to_date(F.lit(date))).drop("date")
    return districts.select("district_id", "name", "full_name", "center_lat", "center_lon").join(day, "district_id", "left")


def district_listings(listings: DataFrame, prices: DataFrame, district_id: int, sort: str = "price_per_sqm",
                      ascending: bool = True, limit: int = 50) -> DataFrame:
    """Page of priced listings of one district."""
    rows = _priced(listings.where(F.col("district_id") == district_id), prices, "inner")
    by = {"price": "current_price", "area": "area_total"}.get(sort, "price_per_sqm")
    return rows.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "id").limit(limit)


def dispersion_by_level(listings: DataFrame, prices: DataFrame, districts: DataFrame) -> DataFrame:
    """Spread of price per m2 by district level, with the coefficient of variation."""
    rows = with_ppsm(with_latest_price(listings, prices).where("area_total > 0 AND current_price > 0"))
    rows = rows.join(districts.select("district_id", "level"), "district_id").select("level", "district_id", "price_per_sqm")
    agg = rows.groupBy("level").agg(
        F.countDistinct("district_id").alias("segment_count"), F.count(F.lit(1)).alias("listing_count"),
        F.avg("price_per_sqm").alias("avg_price_per_sqm"), F.stddev_samp("price_per_sqm").alias("stddev_price"),
        F.min("price_per_sqm").alias("min_price"), F.max("price_per_sqm").alias("max_price"))
    out = with_quantiles(agg, rows, ["level"], "price_per_sqm", {"median_price": 0.5})
    return out.withColumn("cv_pct", F.col("stddev_price") / F.nullif("avg_price_per_sqm", F.lit(0.0)) * 100)


def pct_of_total(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per group and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pct", F.col("cnt") * 100.0 / total.scalar())


def overview(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: total and one conditional count per entry."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def count_elements(df: DataFrame, arr: str) -> DataFrame:
    return df.select(F.explode(arr).alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("cnt"))


def days_on_market(listings: DataFrame) -> DataFrame:
    """Whole days between first and last sight of inactive listings."""
    return (listings.where(~F.col("is_active"))
            .select("id", F.datediff("last_seen", "first_seen").alias("dom_days")))


def adjusted_price(score: Column, price: Column) -> Column:
    out = None
    for s, f in CONDITION_FACTORS.items():
        out = (F if out is None else out).when(score == s, price * f)
    return out.otherwise(price)


def rated_listings(listings: DataFrame, prices: DataFrame, ratings: DataFrame) -> DataFrame:
    """Current market beside condition ratings and the condition-adjusted price."""
    r = ratings.select(F.col("listing_id").alias("id"), "condition_score", "condition_label", "confidence")
    return (current_market(listings, prices).join(r, "id", "left")
            .withColumn("adjusted_price", adjusted_price(F.col("condition_score"), F.col("current_price"))))


def stats_by_condition(listings: DataFrame, prices: DataFrame, ratings: DataFrame) -> DataFrame:
    return (rated_listings(listings, prices, ratings).where("condition_score IS NOT NULL")
            .groupBy("condition_label", "condition_score")
            .agg(F.count(F.lit(1)).alias("listings_count"), exact_avg("current_price").alias("avg_price"),
                 F.avg("price_per_sqm").alias("avg_price_per_sqm"), F.avg("area_total").alias("avg_area"),
                 F.avg("confidence").alias("avg_confidence")))


def underpriced(listings: DataFrame, prices: DataFrame, ratings: DataFrame, min_score: int = 4,
                below: float = 0.85) -> DataFrame:
    """Well-rated listings clearly below the average price per m2 of all current listings."""
    market = current_market(listings, prices)
    bar = market.agg(F.round(F.avg("price_per_sqm") * below, 6).alias("bar"))
    rated = rated_listings(listings, prices, ratings)
    gain = F.col("adjusted_price") - F.col("current_price")
    return (rated.where((F.col("condition_score") >= min_score) & (F.col("price_per_sqm") < bar.scalar()))
            .withColumn("potential_value", gain).withColumn("underpriced_percent", gain / F.nullif("current_price", F.lit(0.0)) * 100))


def room_distribution(listings: DataFrame) -> DataFrame:
    """Share of each room count within a building type."""
    counts = (listings.where("rooms IS NOT NULL AND building_type IS NOT NULL").groupBy("building_type", "rooms")
              .agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy("building_type")
    return counts.withColumn("percentage", F.col("cnt") * 100.0 / F.sum("cnt").over(w))


def typical_params(listings: DataFrame, height: str = "total_floors", year: str = "house_year") -> DataFrame:
    """Average and modal height and year range per building type (smallest height wins ties)."""
    ok = listings.where(F.col(height).isNotNull() & F.col(year).isNotNull() & F.col("building_type").isNotNull())
    agg = ok.groupBy("building_type").agg(
        F.avg(height).alias("avg_height"), F.avg(year).alias("avg_year"), F.min(year).alias("min_year"),
        F.max(year).alias("max_year"), F.count(F.lit(1)).alias("sample_size"))
    mode = (ok.groupBy("building_type", height).agg(F.count(F.lit(1)).alias("n")).groupBy("building_type")
            .agg(F.min_by(height, F.struct(-F.col("n"), F.col(height))).alias("typical_height")))
    return agg.join(mode, "building_type")


def building_type_profile(listings: DataFrame) -> DataFrame:
    """Sample size, mean height of the distinct unit profiles and year range per building type."""
    rows = (listings.where("building_type IS NOT NULL AND rooms IS NOT NULL AND area_total BETWEEN 20 AND 200")
            .groupBy("building_type", "rooms", "area_total", "total_floors", "house_year").agg(F.count(F.lit(1)).alias("cnt")))
    return rows.groupBy("building_type").agg(
        F.sum("cnt").alias("sample_count"), F.avg("total_floors").alias("avg_height"),
        F.min("house_year").alias("min_year"), F.max("house_year").alias("max_year"),
        F.countDistinct("rooms").alias("room_kinds"))


def similar_area_profile(subjects: DataFrame, listings: DataFrame, radius: float = 10.0, top: int = 10) -> DataFrame:
    """For every subject area: the most frequent (rooms, type) within +-radius m2.

    Listings are first counted per (rooms, type, area); subjects are reduced to their
    distinct areas.  The range join then meets on 2*radius-wide area bins.
    """
    width = 2 * radius
    cells = (listings.where("rooms IS NOT NULL AND area_total IS NOT NULL")
             .groupBy("rooms", "building_type", F.col("area_total").alias("c_area")).agg(F.count(F.lit(1)).alias("n"))
             .withColumn("bin", F.floor(F.col("c_area") / width)))
    areas = subjects.select("area_total").where("area_total IS NOT NULL").distinct()
    a = areas.withColumn("bin", F.explode(F.array_distinct(F.array(
        F.floor((F.col("area_total") - radius) / width), F.floor((F.col("area_total") + radius) / width)))))
    prof = (a.join(cells, "bin").where(F.abs(F.col("c_area") - F.col("area_total")) <= radius)
            .groupBy("area_total", "rooms", "building_type")
            .agg(F.sum("n").alias("cnt"), (F.sum(F.col("n") * F.col("c_area")) / F.sum("n")).alias("avg_area")))
    best = top_rows(prof, ["area_total"], [F.desc("cnt"), F.asc("rooms"), F.asc_nulls_last("building_type")], top)
    return subjects.select("subject_id", "area_total").join(best, "area_total")


def scrape_health(sources: DataFrame, runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Runs, items and mean success rate per source and day; a run that asked for nothing counts as 0 %."""
    recent = runs.where(F.col("started_at") >= ts(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    rate = F.when(F.col("requested") > 0, F.col("collected") * 100.0 / F.col("requested")).otherwise(0.0)
    return (recent.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
            .groupBy("source", F.to_date("started_at").alias("run_date"))
            .agg(F.count(F.lit(1)).alias("runs_count"), F.sum("collected").alias("total_collected"),
                 F.sum("failed").alias("total_failed"), F.avg(rate).alias("avg_success_rate"),
                 F.sum("cost").alias("total_cost")))


def in_localities(listings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Listings beside each ``locality`` with an ILIKE pattern that their address matches; patterns: locality, pattern."""
    met = patterns.join(matching(patterns, listings, "pattern", "address"), "pattern")
    return listings.join(met.select("locality", F.col("text").alias("address")).distinct(), "address")


def locality_stats(listings: DataFrame, prices: DataFrame, patterns: DataFrame, every_point: bool = True) -> DataFrame:
    """Counts and price levels of listings whose address matches each locality pattern (locality, pattern)."""
    listings = in_localities(listings, patterns)
    rows = (listings.join(prices.withColumnRenamed("price", "current_price"), "id") if every_point
            else with_latest_price(listings, prices, "left"))
    return (with_ppsm(rows).groupBy("locality")
            .agg(F.countDistinct("id").alias("listings"), F.count(F.lit(1)).alias("points"),
                 F.avg("price_per_sqm").alias("avg_price_per_sqm"), exact_avg("current_price").alias("avg_price")))


def stats_by_region(listings: DataFrame, prices: DataFrame) -> DataFrame:
    return (current_market(listings, prices).groupBy("region")
            .agg(F.count(F.lit(1)).alias("listings_count"), exact_avg("current_price").alias("avg_price"),
                 F.avg("price_per_sqm").alias("avg_price_per_sqm"), F.min("current_price").alias("min_price"),
                 F.max("current_price").alias("max_price")))


def arrivals(listings: DataFrame, grain: str = "day", at: str = "first_seen") -> DataFrame:
    return listings.groupBy(F.date_trunc(grain, at).cast("timestamp_ntz").alias("period")).agg(F.count(F.lit(1)).alias("arrivals"))


def rating_summary(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count(F.lit(1)).alias("ratings"), F.avg("condition_score").alias("avg_score"),
                       F.sum("cost_usd").cast("double").alias("total_cost"), F.min("analyzed_at").alias("first_rating"),
                       F.max("analyzed_at").alias("last_rating"))


def top_rated(listings: DataFrame, prices: DataFrame, ratings: DataFrame, n: int = 20, min_score: int = 4) -> DataFrame:
    """Best-rated current listings, cheapest first within a score."""
    return (rated_listings(listings, prices, ratings).where(F.col("condition_score") >= min_score)
            .orderBy(F.desc("condition_score"), "current_price", "id").limit(n))
