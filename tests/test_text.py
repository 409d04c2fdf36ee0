"""Golden strings for addresses, descriptions, risks and offers."""

import pytest
from pyspark.sql import functions as F

from hearthmark.functions import address, parsing, risk
from hearthmark.sources import files, offers, pages


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("r")).collect()[0].r


@pytest.mark.parametrize("raw,want", [
    ("Москва, ЮЗАО, р-н Ясенево, ул. ПаустовскогоНа карте Ясенево 9 мин. Новоясеневская 12 мин.", "Москва, ЮЗАО, р-н Ясенево, ул. Паустовского"),
    ("Москва, САО, р-н Левобережный, Беломорская ул., 14К2 На карте Беломорская 6 мин.", "Москва, САО, р-н Левобережный, Беломорская ул., 14К2"),
    ("Москва, район Хамовники, улица Усачёва", "Москва, район Хамовники, улица Усачёва"),
    ("Москва, ЗАО, р-н Кунцево, ул. Молодогвардейская, 31К1, Молодёжная, Кунцевская", "Москва, ЗАО, р-н Кунцево, ул. Молодогвардейская, 31К1"),
    ("Москва, ТАО (Троицкий), Былово деревня, ул. Садовая, 4к2, Калужское шоссе 30 км от МКАД, Калужское", "Москва, ТАО (Троицкий), Былово деревня, ул. Садовая, 4к2"),
])
def test_clean_address(spark, raw, want):
    got = one(spark, raw, address.clean_address)
    assert got == want
    assert one(spark, got, address.address_valid) is True


def test_invalid_addresses(spark):
    for t in ("", "Москва", "abc", None):
        assert one(spark, t, address.address_valid) is False


@pytest.mark.parametrize("raw,okrug,district,street,house,building,structure,key", [
    ("Москва, ЮАО, р-н Царицыно, Бакинская ул., 29К2", "ЮАО", "Царицыно", "Бакинская", "29", "2", None, "бакинская_29к2"),
    ("Москва, ВАО, р-н Гольяново, Уссурийская ул., 7", "ВАО", "Гольяново", "Уссурийская", "7", None, None, "уссурийская_7"),
    ("Москва, ТАО (Троицкий), Былово посёлок, 3", "ТАО", "Былово", None, "3", None, None, None),
    ("Москва, САО, район Аэропорт, Малая Коптевская улица, 6К1С2", "САО", "Аэропорт", "Малая Коптевская", "6", "1", "2", "малая коптевская_6к1"),
    ("Москва, СВАО, р-н Лианозово, улица Абрамцевская, дом 11", "СВАО", "Лианозово", "Абрамцевская", "11", None, None, "абрамцевская_11"),
    ("Москва, ЗелАО, мкр. 9-й, к911", "ЗелАО", None, "мкр. 9", "911", "911", None, "мкр. 9_911к911"),
    ("", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
])
def test_parse_address(spark, raw, okrug, district, street, house, building, structure, key):
    p = one(spark, raw, address.parse_address)
    assert (p.okrug, p.district, p.street, p.house, p.building, p.structure, p.house_key) == (okrug, district, street, house, building, structure, key)
    assert p.street_key == (street and street.lower())


def test_same_place(spark):
    a, b = "Москва, Кленовая ул., 7", "г. Москва, р-н Лефортово, улица Кленовая, дом 9"
    df = spark.createDataFrame([(a, b), (a, a), (a, "Москва"), (None, a)], "a string, b string")
    got = df.select(address.same_place(F.col("a"), F.col("b")).alias("h"), address.same_place(F.col("a"), F.col("b"), "street_key").alias("s")).collect()
    assert [(r.h, r.s) for r in got] == [(False, True), (True, True), (False, False), (False, False)]


def test_norm_address_spellings(spark):
    for t in ("Россия, г. Москва, ул. Лесная, д. 5", "москва, улица Лесная, дом 5", "ул Лесная, 5"):
        assert one(spark, t, address.norm_address) == "лесная, 5"
    assert one(spark, "Лесная, 5 корп. 2 кв. 17", address.norm_address) == "лесная, 5 к2"


def test_clean_for_lookup(spark):
    t = "Москва, ЮЗАО, р-н Северное Бутово, ЖК Парк, ул. Грина, 1к2"
    assert one(spark, t, address.clean_for_lookup) == "Москва, ул. Грина, 1к2"


@pytest.mark.parametrize("text,rooms,area,floor,total,addr", [
    ("1-комнатная квартира, 36.2 м2, 4 этаж, Москва, ул. Маршала Чуйкова, дом 6", 1, 36.2, 4, None, "Москва, ул. Маршала Чуйкова, дом 6"),
    ("2к 54м2 7/12 Волгоградский проспект 80", 2, 54.0, 7, 12, "2к 7/12 Волгоградский проспект 80"),
    ("СТУДИЯ 24 м², 2 этаж, ул. Полярная 9", 0, 24.0, 2, None, "ул. Полярная 9"),
    ("Трёхкомнатная, 80,5 кв. м, 3 из 5", 3, 80.5, 3, 5, "Трёхкомнатная, 3 из 5"),
    ("", None, None, None, None, None), (None, None, None, None, None, None),
])
def test_property_text(spark, text, rooms, area, floor, total, addr):
    p = one(spark, text, parsing.parse_property_text)
    assert (p.rooms, p.area, p.floor, p.total_floors, p.address) == (rooms, area, floor, total, addr)


def test_numbers(spark):
    assert one(spark, "53,4 м²", parsing.parse_area) == 53.4
    assert one(spark, "12 345 678 ₽", parsing.parse_price) == 12345678
    assert one(spark, "по запросу", parsing.parse_price) is None
    assert one(spark, "12a", parsing.parse_int) is None
    assert str(one(spark, "до 05.03.2024 включительно", parsing.parse_date)) == "2024-03-05"
    assert one(spark, "31.02.2024", parsing.parse_date) is None


@pytest.mark.parametrize("text,want", [
    ("Продается квартира. Помогу с ипотекой. Быстрый выход на сделку.", False),
    ("Квартира в ипотеке, требуется снятие обременения банка. Прописаны 2 человека.", True),
    ("Чистая продажа, никто не прописан, без обременений. Готова к сделке.", False),
    ("Возможна покупка в ипотеку. Свободная продажа.", False),
    ("коротко", False), (None, False),
])
def test_risk(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    r = risk.tag_risks(df, "text").collect()[0]
    assert r.has_risk is want
    assert (r.risk_confidence > 0) == (len(r.risks) > 0)


def test_risk_positions(spark):
    t = "Тут зарегистрированы дети, и ещё зарегистрированы дети."
    df = spark.createDataFrame([(1, t)], "id long, text string")
    m = sorted((r.position, r.text) for r in risk.risk_matches(df, "id", "text").collect())
    low = t.lower()
    assert m and all(low[p:p + len(x)] == x for p, x in m) and len(m) == 2


def test_highlight(spark):
    got = one(spark, "Есть <b> под арестом & всё", risk.highlight)
    assert got == "Есть &lt;b&gt; <mark>под арестом</mark> &amp; всё"


@pytest.mark.parametrize("body,n", [
    ('{"data":{"offersSerialized":[{"offerId":1,"price":{"value":10}}]}}', 1), ('{"data":{"items":[{"id":2}]}}', 1),
    ('{"unexpected":{},"offersSerialized":[]}', 0), ("not json", 0), ('{"data":{"items":"x"},"result":{"offers":[{"id":1},{"id":2}]}}', 2)])
def test_extract_offers(spark, body, n):
    assert offers.extract_offers(spark.createDataFrame([(body,)], "b string"), "b").count() == n


def test_map_offer(spark):
    body = ('{"data":{"items":[{"offerId":501,"seoUrl":"https://offers.test/501","region":50,"operationName":"rent","roomsCount":3,"spaceTotal":71.25,"floor":9,'
            '"address":"Harbour road 4","sellerName":"agency","price":{"value":64000},"creationDate":"2023-11-12T08:30:00Z"},{"id":33,"price":1250000},{"id":44,"rooms":0}]}}')
    r = {x.id: x for x in offers.map_offers(offers.extract_offers(spark.createDataFrame([(body,)], "b string"), "b"), "2024-02-03 00:00:00").collect()}
    a, b, c = r[501], r[33], r[44]
    assert (a.region, a.rooms, a.area_total, a.floor, a.seller_type, a.price) == (50, 3, 71.25, 9, "agency", 64000.0)
    assert str(a.seen_at) == "2023-11-12 08:30:00"
    assert (b.price, str(b.seen_at), b.rooms) == (1250000.0, "2024-02-03 00:00:00", None)
    assert c.price == 0.0


def test_plain_text(spark):
    html = '<p>a<script>var x="</p>";</script><!-- <b>no</b> --> b&nbsp;<i>c</i></p>'
    assert one(spark, html, pages.plain_text) == "a b c"


def test_targets(spark):
    lines = spark.createDataFrame([("# c",), ("",), (" http://a , 7",), ("http://b",)], "value string")
    got = {r.url: r.external_id for r in files.parse_targets(lines, "s").collect()}
    assert got["http://a"] == "7" and got["http://b"].startswith("product-") and len(got) == 2


def test_page_offers(spark):
    card = '<article data-name="LinkArea"><a href="{}">{}</a><b data-mark="MainPrice">{}</b>{}</article>'
    facts = '<i data-mark="OfferSubtitle">2 комнаты, 50 м², 3/9 этаж</i>'
    place = '<a data-name="GeoLabel">Москва</a>, <a data-name="GeoLabel">улица Кленовая</a>, <a data-name="GeoLabel">7</a>'
    html = "".join([
        '<nav><a href="/sale/flat/1/">x</a></nav>', card.format("/sale/flat/12/", facts, "7 000 000 ₽", place), card.format("/rent/13/", facts, "1 ₽", ""),
        card.format("/sale/flat/14/", facts, "по запросу", ""), card.format("https://h.test/sale/flat/15/?a=1", "", "2,5 млн ₽", "<p>Переуступка ДДУ</p>"), '<i data-mark="OfferSubtitle">9 комнат</i>'])
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>none</p>"), (1, html), (5, card.format("/sale/7/", facts, "5 ₽", ""))], "title int, html string")
    rows = pages.page_offers(df.withColumnRenamed("title", "page"), site="https://s.test").orderBy("page", "card_no").collect()
    got = [(r.page, r.card_no, r.offer_id, r.offer_url, r.price, r.rooms, r.area_total, r.address, r.building_status) for r in rows]
    first = (1, 0, 12, "https://s.test/sale/flat/12/", 7e6, 2, 50.0, "Москва, улица Кленовая, 7", None)
    last = (1, 3, 15, "https://h.test/sale/flat/15/?a=1", 2.5e6, None, None, None, "newbuilding")
    assert got == [first, first, last, last, (5, 0, 7, "https://s.test/sale/7/", 5.0, 2, 50.0, None, None)]


def test_page_details_without_html(spark):
    r = pages.page_details(spark.createDataFrame([(1, None), (2, "")], "id int, html string")).orderBy("id").collect()
    assert r[0].balcony is None and r[0].area_living is None and r[1].balcony is False and r[1].area_kitchen is None


def test_containing_against_plain(spark):
    from hearthmark.operators.containment import containing
    texts = ["москва, лесная 5", "лесная", "ул. полевая", "a", "", None, "лесная", "абвабв"]
    patterns = ["лесная", "есн", "а", "аб", "бва", "нет такого", "", None, "ул. полевая", "длиннее всех текстов вместе"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    p = spark.createDataFrame([(x,) for x in patterns + patterns], "pattern string")
    got = sorted((r.pattern, r.text) for r in containing(p, t).collect())
    assert got == sorted({(q, x) for q in patterns if q for x in texts if x and q in x})
    assert containing(p.limit(0), t).collect() == [] and containing(p, t.limit(0)).collect() == []
