"""Offer fields from listing pages kept as HTML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.address import address_valid, clean_address, pick, replace_all
from hearthmark.functions.parsing import parse_loose_price, try_double, try_int

# Entities worth resolving before patterns are applied.
ENTITIES = (("&nbsp;", " "), ("&sup2;", "²"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Visible text: no scripts, styles, comments or tags; whitespace collapsed."""
    t = replace_all(html, [(r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"<[^>]+>", " ")])
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def element_text(html: Column, attribute: str, value: str) -> Column:
    """Text of the first element with attribute="value" (up to its first closing tag)."""
    return F.nullif(plain_text(F.regexp_extract(html, rf"""(?s)<[^>]*\b{attribute}=["']{value}["'][^>]*>(.*?)</""", 1)), F.lit(""))


def card_fields(text: Column) -> dict[str, Column]:
    """Rooms, area and floors of an offer title."""
    rooms = F.coalesce(try_int(pick(text, r"(?U)\b(\d+)\s+комнат")), try_int(pick(text, r"(?U)\b(\d+)-комн")),
                       F.when(text.contains("Студия") | text.contains("студия"), F.lit(0)))
    area = try_double(F.replace(pick(text, r"(\d+(?:[.,]\d+)?)\s*м²"), F.lit(","), F.lit(".")))
    return {"rooms": rooms, "area_total": area, "floor": try_int(pick(text, r"(\d+)/(\d+)\s*этаж", 1)), "total_floors": try_int(pick(text, r"(\d+)/(\d+)\s*этаж", 2))}


def card_price(text: Column) -> Column:
    """'12 345 678 ₽' or '12,5 млн ₽'."""
    n = parse_loose_price(text)
    return F.when(text.contains("млн"), n * 1_000_000).otherwise(n)


def _card_text(sub: Column, title: Column) -> Column:
    """The subtitle if it tells facts, else the title if that does."""
    facts = r"\d+[-\s]*комн|м²|этаж|Студия"
    return F.when(sub.rlike(facts), sub).when(title.rlike(facts), title)


def _price_text(html: Column) -> Column:
    return F.coalesce(*[element_text(html, a, v) for a, v in (("data-testid", "offer-discount-new-price"), ("data-mark", "DiscountPrice"), ("data-mark", "MainPrice"))])


def extract_from_html(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Id from the URL, title, price, seller, address, rooms, area and floors of each page, by its first card.

    Texts are cut out first, and the fields read from those, so that no pattern runs twice over a page.
    """
    h = F.col(html)
    texts = pages.withColumns({
        "page_title": F.nullif(plain_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), "seller_type": element_text(h, "data-mark", "OfferCardSeller"),
        "_sub": element_text(h, "data-mark", "OfferSubtitle"), "_title": element_text(h, "data-mark", "OfferTitle"), "_price": _price_text(h), "_geo": element_text(h, "data-name", "GeoLabel")})
    chosen = texts.withColumn("card_text", _card_text(F.col("_sub"), F.col("_title")))
    return chosen.withColumns({
        "offer_id": pick(F.col(url), r"/(\d+)(?:[/?#]|$)").try_cast("long"), "price": card_price(F.col("_price")),
        "address": F.nullif(clean_address(F.col("_geo")), F.lit("")), **card_fields(F.col("card_text"))}).drop("_sub", "_title", "_price", "_geo")


# --- all cards of a list page -------------------------------------------------------------

# Elements that hold a card's address where it has no labels, in the order they are tried.
ADDRESS_HOLDERS = (("data-name", "SpecialGeo"), ("data-name", "Breadcrumbs"), ("class", "geo-label"), ("class", "address-label"), ("class", "--geo--"), ("class", "--address--"))
# Words of a card that tell its kind and the state of the house.
APARTMENT_WORDS, SHARE_WORDS = "апартамент|apartment", "доля|долев|share"
COMPLETED = "дом сдан|сдан в 20|введён в эксплуатацию|введен в эксплуатацию"
TO_COME = r"сдача\s+(в\s+)?202[5-9]|сдача\s+(в\s+)?203\d|срок\s+сдачи.*(202[5-9]|203\d)|строится|в стадии строительства|котлован|от застройщика|переуступка дду"
COMPLEX_WORDS = r"жилой комплекс|жилой район|жк |жк\."

_CARD = r"""<[^>]*\bdata-name=["']LinkArea["']"""


def _pieces(html: Column) -> Column:
    """Texts between the tags, those with none left out, joined as parts of an address."""
    texts = F.filter(F.transform(F.split(html, "<[^>]*>"), plain_text), lambda p: p != "")
    return F.nullif(F.array_join(texts, ", "), F.lit(""))


def _holder(html: Column, attribute: str, value: str) -> Column:
    """Inside of the first element whose attribute is (of a class: contains) ``value``, to the first end tag of its kind."""
    around = r"""[^"']*""" if attribute == "class" else ""
    return F.regexp_extract(html, rf"""(?s)<(\w+)\b[^>]*\b{attribute}=["']{around}{value}{around}["'][^>]*>(.*?)</\1\s*>""", 2)


def _raw_address(card: Column) -> Column:
    """All labels of the card, else the first holder with a text."""
    labels = F.regexp_extract_all(card, F.lit(r"""(?s)<(\w+)\b[^>]*\bdata-name=["']GeoLabel["'][^>]*>(.*?)</\1\s*>"""), F.lit(2))
    return F.coalesce(_pieces(F.array_join(labels, "<i>")), *[_pieces(_holder(card, a, v)) for a, v in ADDRESS_HOLDERS])


def _card_texts(card: Column) -> Column:
    """What the fields of a card are read from: its link and the texts of its elements, each looked for once."""
    card = F.substring_index(card, "</article", 1)
    return F.struct(
        pick(card, r"""<a\b[^>]*\bhref=["']([^"']*/sale/[^"']*)["']""").alias("link"), _price_text(card).alias("price"), element_text(card, "data-mark", "OfferSubtitle").alias("sub"),
        element_text(card, "data-mark", "OfferTitle").alias("title"), element_text(card, "data-mark", "OfferCardSeller").alias("seller"),
        _raw_address(card).alias("address"), F.lower(plain_text(card)).alias("words"))


def page_offers(pages: DataFrame, html: str = "html", site: str = "") -> DataFrame:
    """One row per card of a list page, beside the page's own columns: card_no (from 0), offer_url, offer_id, price, address,
    title, rooms, area_total, floor, total_floors, seller_type, property_type, building_status (which replace such of the page).

    A card reaches to the next one, or to the end of its article element. Cards without an id or a price are left out, as
    are pages without cards; an address that is none is NULL. Links within the site get ``site`` in front. Pages become arrays
    of the texts of their cards, so that the fields are read from small structs.
    """
    cards = F.filter(F.split(F.concat(F.lit(" "), F.col(html)), f"(?={_CARD})"), lambda _, n: n > 0)
    rows = pages.select("*", F.posexplode(F.transform(cards, _card_texts)).alias("card_no", "_c"))
    rows = rows.withColumns({"offer_id": pick(F.col("_c.link"), r"/(\d+)/").try_cast("long"), "price": card_price(F.col("_c.price"))}).where("offer_id IS NOT NULL AND price IS NOT NULL")
    rows = rows.withColumns({"_text": _card_text(F.col("_c.sub"), F.col("_c.title")), "_address": clean_address(F.col("_c.address"))})
    rows = rows.withColumn("address", F.when(address_valid(F.col("_address")), F.col("_address")))
    words, link = F.col("_c.words"), F.col("_c.link")
    named = F.coalesce(F.lower("address").rlike(COMPLEX_WORDS), F.lit(False))
    planned = words.rlike("(?U)" + TO_COME) | ((words.rlike(COMPLEX_WORDS) | named) & ~words.rlike(COMPLETED))
    return rows.withColumns({
        "offer_url": F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(site), link)), "seller_type": F.col("_c.seller"),
        "title": F.coalesce(F.when(F.col("_text") == F.col("_c.sub"), F.col("_c.sub")), F.col("_c.title")), **card_fields(F.col("_text")),
        "property_type": F.when(words.rlike(APARTMENT_WORDS), "apartment").when(words.rlike(SHARE_WORDS), "share"),
        "building_status": F.when(planned, "newbuilding")}).drop("_c", "_text", "_address")


# --- detail pages ---------------------------------------------------------------------------

# States of repair and layouts, in the order they are tried.
RENOVATIONS = (("без ремонта", "без ремонта"), ("требуется ремонт", "требуется ремонт"), ("косметический", "косметический"), ("евроремонт", "евроремонт"),
               ("евро", "евроремонт"), ("дизайнерский", "дизайнерский"), ("хороший", "хороший"))
LAYOUTS = (("смежн", "смежные"), ("раздельн", "раздельные"), ("свободная", "свободная планировка"))
_FACTOID = r"""(?s)<[^>]*\bdata-name=["']ObjectFactoidsItem["'][^>]*>(.*?)(?=<[^>]*\bdata-name=|</?section|</ul|<h[1-6]|$)"""


def detail_fields(text: Column) -> dict[str, Column]:
    """Living and kitchen area, year, series and amenities of a detail page's text."""
    num = r"[^\d]{0,20}(\d+(?:[.,]\d+)?)"
    year = try_int(pick(text, r"(?iU)год[а]?\s*постройки[:\s]*(\d{4})"))
    dec = lambda p: try_double(F.replace(pick(text, p), F.lit(","), F.lit(".")))
    return {"area_living": dec(r"(?iU)жилая\s+площадь" + num), "area_kitchen": dec(r"(?iU)площадь\s+кухни" + num),
            "house_year": F.when(year.between(1900, 2030), year), "house_series": pick(text, r"(?iU)серия[:\s]+([А-ЯЁ0-9\-]+)"),
            "balcony": text.rlike("(?iU)балкон"), "loggia": text.rlike("(?iU)лоджия"), "house_has_elevator": text.rlike("(?iU)лифт"),
            "house_has_parking": text.rlike("(?iU)парковк[аи]|паркинг")}


def page_details(pages: DataFrame, html: str = "html") -> DataFrame:
    """``detail_fields`` of each page beside its own columns, with renovation and rooms_layout.

    Areas come from the page's list of facts where it has one (the last fact of a kind counts), else from its text.
    Pages without html have NULL in all fields.
    """
    facts = F.transform(F.regexp_extract_all(html, F.lit(_FACTOID), F.lit(1)), lambda f: F.lower(plain_text(f)))
    rows = pages.withColumns({"_text": plain_text(F.col(html)), "_facts": facts})

    def number(f: Column) -> Column:
        return try_double(F.replace(pick(f, r"(\d+(?:[.,]\d+)?)"), F.lit(","), F.lit(".")))

    def last(test) -> Column:
        return F.try_element_at(F.filter(F.transform(F.filter("_facts", test), number), lambda x: x.isNotNull()), F.lit(-1))

    def living(f: Column) -> Column:
        return f.contains("жилая") & f.contains("площадь")
    text, fields = F.col("_text"), detail_fields(F.col("_text"))
    fields["area_living"] = F.coalesce(last(living), fields["area_living"])
    fields["area_kitchen"] = F.coalesce(last(lambda f: ~living(f) & (f.contains("кухни") | f.contains("кухня"))), fields["area_kitchen"])
    for name, words in (("renovation", RENOVATIONS), ("rooms_layout", LAYOUTS)):
        fields[name] = F.coalesce(*[F.when(text.rlike("(?iU)" + w), F.lit(v)) for w, v in words])
    return rows.withColumns(fields).drop("_text", "_facts")
