"""Search, facets, sorting and paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.containment import matching
from hearthmark.operators.market import ts

# Days back per named period.
PERIOD_DAYS = {"today": 0, "week": 7, "month": 30}


@dataclass(frozen=True)
class SearchSpec:
    """Listing search; None means no restriction."""

    rooms: int | None = None
    price: tuple[float | None, float | None] = (None, None)
    area: tuple[float | None, float | None] = (None, None)
    period: str | None = None
    flags: Mapping[str, bool | None] = field(default_factory=dict)
    active_only: bool = True
    sort: Sequence[tuple[str, bool]] = ()
    page: int = 1
    per_page: int = 20


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _bounds(col: str, lo_hi: tuple[float | None, float | None]) -> list[Column]:
    lo, hi = lo_hi
    out = []
    if lo is not None:
        out.append(F.col(col) >= lo)
    if hi is not None:
        out.append(F.col(col) <= hi)
    return out


def period_filter(period: str | None, as_of: str, col: str = "first_seen") -> Column:
    if period not in PERIOD_DAYS:
        return F.lit(True)
    return F.col(col) >= F.date_sub(ts(as_of), PERIOD_DAYS[period])


def flag_filter(col: str, want: bool | None) -> Column:
    """Tri-state flag: None accepts all, False also accepts NULL."""
    if want is None:
        return F.lit(True)
    return F.coalesce(F.col(col), F.lit(False)) == F.lit(want)


def search_condition(spec: SearchSpec, as_of: str, price: str = "current_price") -> Column:
    cond = [F.col("is_active")] if spec.active_only else []
    if spec.rooms is not None:
        cond.append(F.col("rooms") == spec.rooms)
    cond += _bounds(price, spec.price) + _bounds("area_total", spec.area)
    cond.append(period_filter(spec.period, as_of))
    cond += [flag_filter(c, v) for c, v in spec.flags.items()]
    return all_of(cond)


def sort_columns(sort: Sequence[tuple[str, bool]], tie: str = "id") -> list[Column]:
    """(column, ascending) pairs, NULLs always last, closed by a unique column."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in sort] + [F.col(tie).asc()]


def page_of(df: DataFrame, sort: Sequence[tuple[str, bool]], page: int, per_page: int, tie: str = "id") -> DataFrame:
    """One page; a bounded top-k, never a full sort to the driver."""
    return df.orderBy(*sort_columns(sort, tie)).offset((page - 1) * per_page).limit(per_page)


def search_listings(df: DataFrame, spec: SearchSpec, as_of: str) -> DataFrame:
    hits = df.where(search_condition(spec, as_of))
    return page_of(hits, spec.sort or [("last_seen", False)], spec.page, spec.per_page)


def page_with_total(df: DataFrame, sort: Sequence[tuple[str, bool]], page: int, per_page: int, tie: str = "id") -> DataFrame:
    """A page beside the total number of hits (a scalar count, not a window over all hits)."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return page_of(df, sort, page, per_page, tie).withColumn("total", total.scalar())


@dataclass(frozen=True)
class Facet:
    """``checked`` values, or a ``chosen`` range that counts only if it differs from ``full``."""

    column: str
    checked: Sequence = ()
    chosen: tuple[float, float] | None = None
    full: tuple[float, float] | None = None


def facet_condition(facets: Sequence[Facet]) -> Column:
    cond = []
    for f in facets:
        if f.checked:
            cond.append(F.col(f.column).isin(*f.checked))
        elif f.chosen is not None and f.chosen != f.full:
            cond.append(F.col(f.column).between(*f.chosen))
    return all_of(cond)


def text_search(df: DataFrame, col: str, terms: str) -> DataFrame:
    """Rows with any of the words; case-insensitive whole words, no stemming."""
    words = [w.lower() for w in terms.split()]
    tokens = F.split(F.lower(col), r"[^\p{L}\p{N}_]+")
    return df.where(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])))


def filter_any_substring(df: DataFrame, col: str, needles: Sequence[str]) -> DataFrame:
    """Rows whose text contains any of the needles, ignoring case."""
    return df.where(reduce(lambda a, b: a | b, [F.lower(col).contains(n.lower()) for n in needles], F.lit(False)))


def search_address(listings: DataFrame, queries: DataFrame, min_hits: int = 1) -> DataFrame:
    """Addresses matching each query, and for queries with too few hits the broader pattern.

    ``queries``: query_id (unique), pattern, broad_pattern (ILIKE patterns).  Addresses are reduced to distinct values with
    their counts and newest listing first, so the work grows with the number of addresses, not of listings, and the
    plan is the same for any number of queries.
    """
    addr = listings.groupBy("address").agg(
        F.count(F.lit(1)).alias("listings"), F.max_by("id", F.struct("last_seen", "id")).alias("newest_id"))
    both = F.array(F.struct(F.lit(False).alias("broad"), "pattern"), F.struct(F.lit(True).alias("broad"), F.col("broad_pattern").alias("pattern")))
    asked = queries.select("query_id", F.inline(both))
    hits = asked.join(matching(asked, addr, "pattern", "address"), "pattern").withColumnRenamed("text", "address").join(addr, "address")
    enough = hits.where("NOT broad").groupBy("query_id").agg(F.sum("listings").alias("n")).where(F.col("n") >= min_hits)
    told = hits.join(enough.select("query_id", F.lit(True).alias("_enough")), "query_id", "left")
    return told.where(F.col("broad") != F.coalesce("_enough", F.lit(False))).select("query_id", "address", "listings", "newest_id", "broad")


def top_n(df: DataFrame, keys: Sequence[str], n: int = 10, name: str = "cnt") -> DataFrame:
    """Most frequent groups; ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys).limit(n)


def pending(df: DataFrame, missing: Column, sort: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """Next ``n`` rows that still lack something."""
    return df.where(missing).orderBy(*sort_columns(sort)).limit(n)
