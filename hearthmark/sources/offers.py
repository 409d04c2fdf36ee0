"""Semi-structured offers: JSON responses to listing and price rows.

The shape drifts from response to response, so documents are read as VARIANT and every
field is a list of candidate places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.market import ts

# Places an offer list was seen at, and candidate fields, in the order they are tried.
OFFER_PATHS = ("$.data.offersSerialized", "$.data.items", "$.data.offers", "$.result.offers", "$.result.items", "$.offersSerialized")
ID_FIELDS = ("offerId", "id")
URL_FIELDS = ("seoUrl", "absoluteUrl", "url")
REGION_FIELDS = ("region", "regionId")
DEAL_FIELDS = ("operationName", "dealType")
ROOM_FIELDS = ("rooms", "roomsCount", "roomsCountTotal")
FLOOR_FIELDS = ("floor", "floorNumber")
ADDRESS_FIELDS = ("address", "geoLabel")
SELLER_FIELDS = ("userType", "ownerType", "sellerName")
PRICE_PARTS = ("value", "rub", "amount")
TIME_FIELDS = ("addedTimestamp", "creationDate", "creationTs")


def extract_offers(df: DataFrame, json_col: str) -> DataFrame:
    """One row per offer (VARIANT column ``offer``) of the first list found; responses without one give none."""
    keep = [c for c in df.columns if c != json_col]
    lists = F.coalesce(*[F.try_variant_get("_v", p, "array<variant>") for p in OFFER_PATHS])
    return _once(df, keep, F.try_parse_json(F.col(json_col)), "_v").select(*keep, F.explode(lists).alias("offer"))


def _once(df: DataFrame, keep: Sequence[str], value: Column, name: str) -> DataFrame:
    """Columns beside ``value``, as the output of a generator: that is where the planner does not put the expression itself
    wherever the column is read, to be evaluated time and again."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


# Fields read as texts, and those whose kind matters or that may be nested.
TEXT_FIELDS = (*ID_FIELDS, *URL_FIELDS, *REGION_FIELDS, *DEAL_FIELDS, *ROOM_FIELDS, *FLOOR_FIELDS, *ADDRESS_FIELDS, *SELLER_FIELDS,
               "buildingStatus", "building_status", "category", "title", "name", "description", "text", "propertyType", "property_type",
               "roomType", "room_type")
OPEN_FIELDS = ("totalSquare", "spaceTotal", "areaTotal", "area", "price", "geo", *TIME_FIELDS)
SHAPE = "struct<" + ", ".join([*[f"{f}: string" for f in TEXT_FIELDS], *[f"{f}: variant" for f in OPEN_FIELDS]]) + ">"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    """A text field, or a place in one of the open fields, of a ``SHAPE``."""
    field, *inner = path.split(".")
    return v[field] if field in TEXT_FIELDS else F.try_variant_get(v[field], ".".join(["$", *inner]), kind)


def _first(v: Column, fields: Sequence[str]) -> Column:
    """First text of the fields, passing over missing, null, empty, zero and false ones."""
    return F.get(F.filter(F.array(*[_get(v, f) for f in fields]), lambda s: ~s.isin("", "0", "0.0", "false")), F.lit(0))


def _or(v: Column, fields: Sequence[str]) -> Column:
    """First usable value; if none is, the last field as it is (it may be zero)."""
    return F.coalesce(_first(v, fields), _get(v, fields[-1]))


def _to_int(s: Column) -> Column:
    """Whole numbers as they are, numbers with a fraction cut."""
    return F.when(s.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), F.regexp_extract(s, r"([+-]?\d+)", 1)).try_cast("long")


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(v[field])


def _area(v: Column) -> Column:
    """totalSquare / spaceTotal if given at all, else areaTotal / area, plain or nested."""
    plain = F.coalesce(*[F.when(_kind(v, f).isNotNull(), F.struct(_get(v, f, "double").alias("v"))) for f in ("totalSquare", "spaceTotal")])
    nested = F.coalesce(*[F.coalesce(_get(v, f"{f}.value", "double"), _get(v, f"{f}.total", "double"), _get(v, f, "double")) for f in ("areaTotal", "area")])
    return F.when(plain.isNotNull(), plain["v"]).otherwise(nested)


def _price(v: Column) -> Column:
    """price.value / rub / amount, or a plain price; no price at all counts as zero."""
    nested = F.coalesce(*[_get(v, f"price.{p}", "double") for p in PRICE_PARTS])
    return F.coalesce(nested, _get(v, "price", "double"), F.when(_kind(v, "price").isNull() | (_kind(v, "price") == "VOID"), F.lit(0.0)))


def _seen_at(v: Column, as_of: str) -> Column:
    """Epoch seconds or ISO text in UTC; the first field that parses, else ``as_of``."""
    tries = []
    for f in TIME_FIELDS:
        num = F.when(_kind(v, f) != "STRING", _get(v, f, "double"))
        tries.append(F.coalesce(F.timestamp_seconds(num), F.when(_kind(v, f) == "STRING", F.try_to_timestamp(_get(v, f)))).cast("timestamp_ntz"))
    return F.coalesce(*tries, ts(as_of))


def map_offers(offers: DataFrame, as_of: str, col: str = "offer") -> DataFrame:
    """Listing fields and price point of every offer; what is not there stays NULL."""
    v = F.col("_o")
    low = lambda names: F.lower(F.coalesce(*[_get(v, n) for n in names], F.lit("")))
    text = lambda fields: F.coalesce(_first(v, fields), F.lit(""))
    keep = [c for c in offers.columns if c != col]
    fields = [
        _to_int(_first(v, ID_FIELDS)).alias("id"), text(URL_FIELDS).alias("url"),
        _to_int(_or(v, REGION_FIELDS)).cast("int").alias("region"), text(DEAL_FIELDS).alias("deal_type"),
        _to_int(_or(v, ROOM_FIELDS)).cast("int").alias("rooms"), _area(v).alias("area_total"), _to_int(_or(v, FLOOR_FIELDS)).cast("int").alias("floor"),
        text(ADDRESS_FIELDS).alias("address"), text(SELLER_FIELDS).alias("seller_type"),
        F.coalesce(_get(v, "geo.coordinates.lat", "double"), _get(v, "geo.coordinates.LAT", "double")).alias("lat"),
        F.coalesce(_get(v, "geo.coordinates.lng", "double"), _get(v, "geo.coordinates.LNG", "double")).alias("lon"),
        _price(v).alias("price"), _seen_at(v, as_of).alias("seen_at"),
        # what the routing rules read
        low(("buildingStatus", "building_status")).alias("building_status"), low(("category",)).alias("category"),
        low(("title", "name")).alias("title"), low(("description", "text")).alias("description"),
        low(("propertyType", "property_type")).alias("property_type"), low(("roomType", "room_type")).alias("room_type")]
    # the lambdas keep this step out of whole-stage code, whose one method would be too long for the JVM to compile
    o = _once(offers, keep, F.try_variant_get(F.col(col), "$", SHAPE), "_o").select(*keep, *fields)
    names = [c for c in o.columns if c not in keep]
    return _once(o, keep, F.struct(*names), "_o").select(*keep, "_o.*")
