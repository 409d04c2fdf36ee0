"""Price-paid analytics: every measure for all sales and for a filtered area side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.market import exact_avg, ts
from hearthmark.operators.skew import exact_quantiles, null_safe_join

ALL = "All"


def area_condition(town: str = ALL, district: str = ALL, postcode: str = ALL) -> Column:
    """Conjunction over the chosen area parts; nothing chosen means every sale."""
    cond = F.lit(True)
    for col, v in (("town", town), ("district", district), ("postcode1", postcode)):
        if v != ALL:
            cond = cond & (F.col(col) == v)
    return cond


def area_column(town: str = ALL, district: str = ALL, postcode: str = ALL) -> str | None:
    """Finest chosen area part: the one the nation-wide count is averaged over."""
    chosen = [c for c, v in (("town", town), ("district", district), ("postcode1", postcode)) if v != ALL]
    return chosen[-1] if chosen else None


def months_back(as_of: str, n: int) -> Column:
    return F.to_date(ts(as_of)) - F.expr(f"INTERVAL {n} MONTHS")


def _avg(cond: Column | None = None) -> Column:
    return F.round(exact_avg(F.col("price") if cond is None else F.when(cond, F.col("price"))))


def _per_area(area: str) -> Column:
    return F.round(F.count(F.lit(1)) / F.countDistinct(area)).cast("long")


def sold_over_time(df: DataFrame, cond: Column | None, area: str = "town") -> DataFrame:
    """Per year: filtered sales and mean sales per area."""
    aggs = [] if cond is None else [F.count_if(cond).alias("filtered_count")]
    return df.groupBy(F.to_date(F.date_trunc("year", "date")).alias("year")).agg(*aggs, _per_area(area).alias("count"))


def price_over_time(df: DataFrame, cond: Column) -> DataFrame:
    return df.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(
        _avg(cond).alias("filter_price"), _avg().alias("avg"))


def price_stats(df: DataFrame, cond: Column, as_of: str, months: int = 6) -> DataFrame:
    rows = df.where(cond & (F.col("date") > months_back(as_of, months)))
    head = rows.agg(exact_avg("price").alias("avg"), F.count(F.lit(1)).alias("sold"))
    q = exact_quantiles(rows, [], "price", [0.5, 0.95, 0.99], array="q").select("q")
    return head.withColumn("_q", q.scalar()).select("avg", "sold", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("median", "p95", "p99"))])


def yearly_averages(df: DataFrame, cond: Column) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(_avg(cond).alias("filter_avg"), _avg().alias("avg"))


def price_increase(df: DataFrame, cond: Column, years: Sequence[int] = (10, 5, 3, 1)) -> DataFrame:
    """Percent change from n rows before the last year, nation-wide and in the area.

    One row per calendar year enters the window, so it stays small whatever the data.
    """
    rn = F.row_number().over(Window.orderBy(F.desc("year")))
    y = yearly_averages(df, cond).withColumn("_rn", rn)
    by = y.agg(F.map_from_entries(F.collect_list(F.struct("_rn", F.struct("avg", "filter_avg")))).alias("m"))
    r = by.withColumn("year", F.explode(F.array(*[F.lit(n) for n in years])))
    last, then = F.col("m")[F.lit(1)], F.try_element_at("m", F.col("year") + 1)

    def pct(part: str) -> Column:
        return F.when(then[part] > 0, F.floor((last[part] - then[part]) / then[part] * 100 + 0.5)).otherwise(F.lit(0))

    return r.where(then.isNotNull()).select("year", pct("avg").alias("national"), pct("filter_avg").alias("regional"))


def price_rank(df: DataFrame, cond: Column, as_of: str, months: int = 6) -> DataFrame:
    """Percentile the area's average falls into: first of 100 quantiles above it, minus one."""
    rows = df.where(F.col("date") > months_back(as_of, months))
    q = exact_quantiles(rows, [], "price", [i / 100 for i in range(100)], array="quantiles").drop("n")
    head = rows.agg(_avg(cond).alias("filtered_avg"), _avg().alias("avg")).withColumn("quantiles", q.scalar())
    first = F.array_position(F.transform("quantiles", lambda x: F.coalesce(x > F.col("filtered_avg"), F.lit(False))), True) - 1
    return head.select((first - 1).alias("quantile"), "filtered_avg", "avg")


def by_duration(df: DataFrame, cond: Column | None, mode: str = "filtered") -> DataFrame:
    """Sales per ownership kind.  'filtered' counts matching sales of all kinds, 'where' restricts."""
    known = df.where(F.col("duration") != "unknown")
    if mode == "filtered":
        known = df.where(F.col("duration").isin("freehold", "leasehold"))
        return known.groupBy(F.col("duration").alias("name")).agg(F.count_if(cond).alias("value"))
    if cond is not None:
        known = known.where(cond)
    return known.groupBy(F.col("duration").alias("name")).agg(F.count(F.lit(1)).alias("value"))


def by_type(df: DataFrame, cond: Column, area: str = "town") -> DataFrame:
    return df.groupBy("type").agg(F.count_if(cond).alias("filtered_count"), _per_area(area).alias("count"))


def sold_by_period(df: DataFrame, cond: Column, as_of: str) -> DataFrame:
    """Sales in each of the last four half-years, as rows."""
    cuts = [(6, "6 months"), (12, "1 year"), (18, "18 months"), (24, "2 years")]
    d = F.col("date")
    aggs = [F.count_if((d >= months_back(as_of, m)) & (F.lit(True) if m == 6 else d < months_back(as_of, m - 6))).alias(n) for m, n in cuts]
    one = df.where(cond).agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for _, n in cuts])))


def price_by_type(df: DataFrame, cond: Column) -> DataFrame:
    """Box plot per type for all sales and for the filtered ones (five numbers each)."""
    scoped = df.select("type", "price", F.lit("all").alias("scope")).unionByName(
        df.where(cond).select("type", "price", F.lit("filtered").alias("scope")))
    keys = ["type", "scope"]
    ends = scoped.groupBy(*keys).agg(F.round(F.min("price")).alias("lo"), F.round(F.max("price")).alias("max"))
    q = exact_quantiles(scoped, keys, "price", [0.25, 0.5, 0.75], ["p25", "median", "p75"]).drop("n")
    return null_safe_join(ends, q, keys).select(
        "type", "scope", F.when(F.col("scope") == "all", F.col("lo") + 100).otherwise(F.col("lo")).alias("min"),
        *[F.round(c).alias(c) for c in ("p25", "median", "p75")], "max")


def sales_by_day(df: DataFrame, cond: Column, year: int, fill: bool = True) -> DataFrame:
    """Sales per day of one calendar year; with ``fill`` days without a sale show zero."""
    first, last = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))
    rows = df.where(cond & (F.col("date") >= first) & (F.col("date") < F.date_add(last, 1)))
    days = rows.groupBy(F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("c"))
    if fill:
        cal = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
        days = cal.join(days, "day", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return days.select(F.year("day").alias("year"), "day", "c")


def min_max(df: DataFrame, cond: Column, as_of: str, months: int = 18) -> DataFrame:
    rows = df.where(cond & (F.col("date") > months_back(as_of, months)))
    return exact_quantiles(rows, [], "price", [0.01, 0.99], ["min_price", "max_price"]).select(
        F.round("min_price").alias("min_price"), F.round("max_price").alias("max_price"))


def popular(df: DataFrame, level: str, parent: Mapping[str, str] | None = None, n: int = 10) -> DataFrame:
    """Areas with most sales, optionally inside a parent area; ties by name."""
    for col, v in (parent or {}).items():
        df = df.where(F.col(col) == v)
    return (df.where(F.col(level) != "").groupBy(level).agg(F.count(F.lit(1)).alias("popularity"))
            .orderBy(F.desc("popularity"), level).limit(n))


def house_sales(df: DataFrame, cond: Column) -> DataFrame:
    return df.agg(F.count_if(cond).alias("area_count"), F.count(F.lit(1)).alias("national_count"))


# --- rollup with mergeable states -------------------------------------------------

AREAS = ("town", "district", "postcode1")
GRAINS = {"year": lambda: F.to_date(F.date_trunc("year", "date")),
          "month": lambda: F.to_date(F.date_trunc("month", "date")), "type": lambda: F.col("type")}


def build_rollup(df: DataFrame, grain: str, sketch_k: int = 400) -> DataFrame:
    """One row per (grain, area): count, exact sum, min, max and a quantile sketch.

    The rows are mergeable, so any area condition is answered from the rollup alone.
    """
    return df.groupBy(GRAINS[grain]().alias(grain), *AREAS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).alias("price_sum"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.kll_sketch_agg_double("price", F.lit(sketch_k)).alias("price_sketch"))


def query_rollup(rollup: DataFrame, grain: str, cond: Column, area: str = "town",
                 probs: Sequence[float] = ()) -> DataFrame:
    """Merge states per grain, for all areas and for the filtered ones; quantiles are sketched."""
    def mean(c: Column) -> Column:
        return F.sum(F.when(c, F.col("price_sum"))).cast("double") / F.sum(F.when(c, F.col("n")))
    yes = F.lit(True)
    aggs = [F.sum("n").alias("sales"), F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias("filtered_count"),
            F.round(F.sum("n") / F.countDistinct(area)).cast("long").alias("count"),
            F.round(mean(yes)).alias("avg"), F.round(mean(cond)).alias("filter_price"),
            F.min("price_min").alias("min"), F.min(F.when(cond, F.col("price_min"))).alias("min_filtered"),
            F.max("price_max").alias("max"), F.max(F.when(cond, F.col("price_max"))).alias("max_filtered")]
    if probs:
        aggs.append(F.kll_merge_agg_double("price_sketch").alias("_s"))
    out = rollup.groupBy(grain).agg(*aggs)
    for p in probs:
        out = out.withColumn(f"q{round(p * 100)}", F.kll_sketch_get_quantile_double("_s", F.lit(float(p))))
    return out.drop("_s") if probs else out


def rank_error(sketch_k: int) -> float:
    """Share of ranks by which a sketched quantile is off in at most one of a hundred cases."""
    return 2.446 / sketch_k ** 0.9433


def quantile_ranks(df: DataFrame, grain: str, probs: Sequence[float], sketch_k: int = 400) -> DataFrame:
    """How far the quantiles merged from a rollup are from the true ranks in ``df``, per grain.

    For each probability: the share of rows below the sketched value (``below_p``) and up to it (``upto_p``), and whether the
    probability lies between them, give or take twice the ``rank_error`` (``ok_p``). One pass over the rows; the
    quantiles are one row per grain and are joined by size.
    """
    sketched = query_rollup(build_rollup(df, grain, sketch_k), grain, F.lit(True), probs=probs)
    names = {p: str(round(p * 100)) for p in probs}
    rows = null_safe_join(df.select(GRAINS[grain]().alias(grain), "price"), sketched.select(grain, *[f"q{n}" for n in names.values()]), [grain])
    share = lambda cond: F.count_if(cond) / F.count("price")
    ranks = rows.groupBy(grain).agg(F.count("price").alias("n"), *[
        share(test).alias(name) for n in names.values() for test, name in ((F.col("price") < F.col(f"q{n}"), f"below_{n}"), (F.col("price") <= F.col(f"q{n}"), f"upto_{n}"))])
    slack = 2 * rank_error(sketch_k)
    return ranks.withColumns({f"ok_{n}": (F.col(f"below_{n}") <= p + slack) & (F.col(f"upto_{n}") >= p - slack) for p, n in names.items()})
