"""Row rules: what is not a plain flat on the secondary market, and what is not plausible."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and marks the routing rules look for.
NEW_BUILDING_STATES = ("new", "newbuilding", "новостройка", "новострой")
SHARE_WORDS = ("доля", "доли", "долевая", "долевое", "долевой", "share", "shares", "часть квартиры", "часть кв",
               "1/2", "1/3", "1/4", "2/3", "3/4", "1/5", "доля в", "продается доля", "продаю долю")
APARTMENT_WORDS = ("апартамент", "apartment", "апартаменты", "apartments", "коммерческая недвижимость", "коммерческая")
SHARE_MAX_AREA = 20
COLLECTED_TYPES = ("apartment", "room", "house")
SELLERS = {"owner": ("owner", "homeowner", "собственник"), "agent": ("agent", "realtor", "агент", "риелтор"), "developer": ("developer", "builder", "застройщик")}
DEALS = {"sale": ("sale", "продажа"), "rent": ("rent", "аренда")}


def _txt(df: DataFrame, name: str) -> Column:
    """Lower-cased text column, empty if NULL or absent."""
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in df.columns else F.lit("")


def _has(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def is_newbuilding(df: DataFrame) -> Column:
    return _txt(df, "building_status").isin(*NEW_BUILDING_STATES) | (_txt(df, "category") == "newbuilding") | _txt(df, "url").contains("/newbuilding/")


def is_share(df: DataFrame) -> Column:
    small = F.coalesce(F.col("area_total") < SHARE_MAX_AREA, F.lit(False))
    text = F.concat(_txt(df, "title"), F.lit(" "), _txt(df, "description"))
    kinds = [_has(_txt(df, c), ("share", "доля")) for c in ("property_type", "room_type")]
    return small | _has(text, SHARE_WORDS) | _has(_txt(df, "url"), ("/share/", "/доля")) | kinds[0] | kinds[1] | _has(_txt(df, "address"), ("доля", "долевая"))


def is_apartment(df: DataFrame) -> Column:
    text = F.concat(_txt(df, "title"), F.lit(" "), _txt(df, "description"))
    return _has(_txt(df, "property_type"), ("apartment", "апартамент")) | _has(_txt(df, "url"), ("/apartment/", "/апартамент")) | _has(text, APARTMENT_WORDS)


def route_offers(df: DataFrame) -> DataFrame:
    """Rows beside ``reject_reason`` (NULL = accepted); new building before share before apartment."""
    return df.withColumn("reject_reason", F.when(is_newbuilding(df), "newbuilding").when(is_share(df), "share").when(is_apartment(df), "apartment"))


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("cnt"))


def lot_is_share(df: DataFrame) -> Column:
    return _has(_txt(df, "title"), ("доля", "долей")) | _txt(df, "description").contains("доля в праве")


def lot_is_collectable(df: DataFrame) -> Column:
    return ~lot_is_share(df) & F.coalesce(F.col("property_type").isin(*COLLECTED_TYPES), F.lit(False))


def listing_rules(url_prefix: str = "https://") -> dict[str, Column]:
    """Condition each strict listing must meet; NULL fails."""
    c = F.col
    return {
        "id": c("id").isNotNull(), "url": c("url").startswith(url_prefix) & (F.length("url") >= 10), "region": c("region") > 0,
        "address": F.length("address") >= 5, "lat": c("lat").between(-90, 90), "lon": c("lon").between(-180, 180),
        "deal_type": c("deal_type").isin("sale", "rent"), "rooms": c("rooms").between(0, 10), "area_total": c("area_total") > 0,
        "floor": c("floor") >= 1, "seller_type": F.length("seller_type") >= 1,
    }


def price_rules(low: float = 100_000, high: float = 1_000_000_000) -> dict[str, Column]:
    return {"price": F.col("price").between(low, high)}


def check_constraints(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows beside ``violations``: names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("violations", broken)


def _norm(c: Column, table: Mapping[str, Sequence[str]]) -> Column:
    low = F.lower(c)
    out = F
    for k, words in table.items():
        out = out.when(low.isin(*words), k)
    return out.otherwise(low)


def norm_seller(c: Column) -> Column:
    return _norm(c, SELLERS)


def norm_deal(c: Column) -> Column:
    return _norm(c, DEALS)


def validate_and_map(offers: DataFrame, url_prefix: str = "https://", low: float = 100_000, high: float = 1_000_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid listings, their prices, and the rejects with reasons.

    An offer counts only as a whole: a bad price rejects the listing, too.
    """
    o = offers.withColumns({"seller_type": norm_seller(F.trim("seller_type")), "deal_type": norm_deal(F.col("deal_type"))})
    checked = check_constraints(o, {**listing_rules(url_prefix), **price_rules(low, high)})
    good = checked.where(F.size("violations") == 0)
    listings = good.drop("violations", "price", "seen_at")
    return listings, good.select("id", "seen_at", "price"), checked.where(F.size("violations") > 0).withColumnRenamed("violations", "reasons")
