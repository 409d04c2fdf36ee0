"""Re-posted listings: fingerprints, matches, links and price chains.

No operator here pairs up the members of a group.  A repost only needs the *oldest*
match, so every group is reduced to its oldest rows before anything is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.bands import within
from hearthmark.operators.market import ts
from hearthmark.operators.merge import patch_details, upsert_snapshot
from hearthmark.operators.skew import top_rows

# Areas are compared in steps of 1/10000 m2.
AREA_SCALE = 10_000
# Sorts after every real date: listings without a date are never the original.
NO_DATE = "9999-12-31 00:00:00"


def text_fingerprint(text: Column) -> Column:
    """MD5 of the lower-cased text with whitespace runs collapsed."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")))


def _posted(first: str, second: str) -> Column:
    return F.coalesce(F.col(first), F.col(second))


def _rows(listings: DataFrame) -> DataFrame:
    """Listings with the columns the matchers use; absent optional ones are NULL."""
    opt = {"published_at": "timestamp_ntz", "description_hash": "string", "resolved_address": "string"}
    for c, t in opt.items():
        if c not in listings.columns:
            listings = listings.withColumn(c, F.lit(None).cast(t))
    return listings.select("id", "address", "resolved_address", "area_total", "rooms", "description_hash", "is_active",
                           _posted("published_at", "first_seen").alias("own_date"),
                           F.coalesce(_posted("first_seen", "published_at"), F.lit(NO_DATE).cast("timestamp_ntz")).alias("date"))


def _oldest_two(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the two oldest active rows; the second serves the oldest one itself."""
    two = top_rows(rows.where("is_active").select(*keys, F.struct("date", "id", "area_total").alias("_row")), keys, [F.col("_row")], 2)
    return two.groupBy(*keys).agg(F.min("_row").alias("_a"), F.max(F.when(F.col("rank") == 2, F.col("_row"))).alias("_b"))


NEAR_KEYS = ["address", "rooms"]
EXACT_KEYS = (("address", "area_total", "rooms"), ("description_hash", "address"), ("description_hash", "resolved_address"))


def _match(date: Column, near: bool, ident: Column, score: Column, reason: str) -> Column:
    return F.struct(date.alias("date"), F.lit(near).alias("near"), ident.alias("id"), score.alias("score"), F.lit(reason).alias("reason"))


def _oldest(matches: DataFrame) -> DataFrame:
    return matches.groupBy("id").agg(F.min("match").alias("match"), F.first("own_date").alias("own_date")).select("id", "own_date", "match")


def exact_matches(listings: DataFrame) -> DataFrame:
    """(id, own_date, match) once for each rule that finds an exact original.

    One equi-join per rule, on rows of the rule's keys alone; rows that lack a key stay out of its shuffle.
    """
    rows, found = _rows(listings), []
    for keys in EXACT_KEYS:
        asked = rows.dropna(subset=list(keys)).select("id", "own_date", *keys)
        other = F.when(F.col("_a.id") != F.col("id"), F.col("_a")).otherwise(F.col("_b"))
        hit = asked.join(_oldest_two(rows.dropna(subset=list(keys)), keys), list(keys)).select("id", "own_date", other.alias("_o")).where("_o IS NOT NULL")
        found.append(hit.select("id", "own_date", _match(F.col("_o.date"), False, F.col("_o.id"), F.lit(1.0), "exact_match").alias("match")))
    return reduce(DataFrame.unionByName, found)


def exact_originals(listings: DataFrame) -> DataFrame:
    """Oldest other active listing that is an exact match: same address, area and rooms, or the
    same description at the same (plain or resolved) address."""
    return _oldest(exact_matches(listings))


def _scaled(listings: DataFrame) -> DataFrame:
    """Rows with an area, address and rooms, and the area as a whole number ``_a``."""
    return _rows(listings).dropna(subset=["area_total", *NEAR_KEYS]).withColumn("_a", F.round(F.col("area_total") * AREA_SCALE).cast("long"))


def near_originals(listings: DataFrame, tol: float = 2.0) -> DataFrame:
    """Oldest active listing at the same address with the same rooms and another area within ``tol``.

    Rows are first reduced to one per distinct area; a band join finds the oldest on either side of each.
    """
    rows = _scaled(listings)
    areas = rows.groupBy(*NEAR_KEYS, "_a").agg(F.min(F.when(F.col("is_active"), F.struct("date", "id", "area_total"))).alias("_m"))
    cells = within(areas, NEAR_KEYS, "_a", round(tol * AREA_SCALE), {"_o": (F.min("_m"), F.min("_m"))})
    cells = cells.select(*NEAR_KEYS, "_a", F.least("_o.below", "_o.above").alias("_o")).where("_o IS NOT NULL")
    j = rows.where("area_total <> 0").select("id", "own_date", "area_total", *NEAR_KEYS, "_a").join(cells, [*NEAR_KEYS, "_a"])
    score = 1.0 - F.abs(F.col("_o.area_total") - F.col("area_total")) / 10.0
    return j.select("id", "own_date", _match(F.col("_o.date"), True, F.col("_o.id"), score, "similar_area").alias("match"))


def detect_reposts(listings: DataFrame, tol: float = 2.0) -> DataFrame:
    """Listings older copies of which exist: original id, score and reason.

    The oldest match wins; on equal dates an exact match beats a near one, then the smaller id.
    """
    best = _oldest(exact_matches(listings).unionByName(near_originals(listings, tol)))
    return best.where(F.col("own_date") > F.col("match.date")).select(
        "id", F.col("match.id").alias("original_listing_id"), F.col("match.score").alias("similarity_score"), F.col("match.reason").alias("match_reason"))


def match_counts(listings: DataFrame, tol: float = 2.0) -> DataFrame:
    """Exact (same address, area, rooms) and near matches of each listing, counted without pairing."""
    rows = _scaled(listings)
    areas = rows.groupBy(*NEAR_KEYS, "_a").agg(F.count_if("is_active").alias("_n"))
    cells = within(areas, NEAR_KEYS, "_a", round(tol * AREA_SCALE), {"_s": (F.sum("_n"), F.sum("_n"))})
    near = F.coalesce("_s.below", F.lit(0)) + F.coalesce("_s.above", F.lit(0))
    self_n = F.when(F.col("is_active"), 1).otherwise(0)
    return rows.select("id", "is_active", *NEAR_KEYS, "_a").join(cells.select(*NEAR_KEYS, "_a", "_n", near.alias("_near")), [*NEAR_KEYS, "_a"]).select(
        "id", (F.col("_n") - self_n).alias("exact_matches"), F.col("_near").alias("near_matches"))


def link_duplicates(links: DataFrame, listings: DataFrame, reposts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New link table and listings with their repost flags."""
    new = reposts.select("original_listing_id", F.col("id").alias("duplicate_listing_id"), "similarity_score", "match_reason",
                         ts(as_of).alias("detected_at"))
    flags = reposts.select("id", F.lit(True).alias("is_repost"), "original_listing_id")
    return upsert_snapshot(links, new, ["original_listing_id", "duplicate_listing_id"]), patch_details(listings, flags)


def repost_chain(links: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, ancestor, depth) up the repost chain, the listing itself at depth 0.

    Path doubling: each join doubles the reach, so the plan has log2(depth) joins and
    a cycle cannot run longer than ``max_depth``.
    """
    step = links.select("id", F.col("original_listing_id").alias("ancestor")).where("ancestor IS NOT NULL").withColumn("depth", F.lit(1))
    paths, reach = step, 1
    while reach < max_depth:
        tip = paths.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("_mid"))
        more = paths.select(F.col("id").alias("_mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        paths = paths.unionByName(tip.join(more, "_mid").select("id", "ancestor", "depth"))
        reach *= 2
    return paths.where(F.col("depth") <= max_depth)


def chain_history(listings: DataFrame, prices: DataFrame, max_depth: int = 10) -> DataFrame:
    """Price points of every listing and of the listings it was re-posted from."""
    own = listings.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    chain = own.unionByName(repost_chain(listings, max_depth))
    return chain.join(prices.select(F.col("id").alias("ancestor"), "seen_at", "price"), "ancestor").select(
        "id", "depth", F.col("ancestor").alias("listing_id"), "seen_at", "price")
