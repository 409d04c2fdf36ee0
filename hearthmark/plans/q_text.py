"""Texts, offers, pages, validation and investment."""

from pyspark.sql import functions as F

from hearthmark.functions import address as adr
from hearthmark.functions import parsing, risk
from hearthmark.operators import validation as val
from hearthmark.plans.q_market import r
from hearthmark.plans.registry import query, snippet
from hearthmark.sources import files, offers, pages
from hearthmark.sources.tables import AS_OF
from hearthmark.streaming.monitor import work_folder

# --- risk tags with a plain ASCII rule pack -------------------------------------------

PACK = risk.RiskPack(
    rules=(risk.RiskRule("a", "Alpha", ("the [a-z]+", "erin[a-z]*"), ("that [a-z]+ing",)),
           risk.RiskRule("b", "Beta", ("que [a-z]+", "de [a-z]+ment"), ("ouelle", "pour [a-z]+")),
           risk.RiskRule("c", "Gamma", ("sich[a-z]*", "der [a-z]+"), ("nicht",))),
    positive=("theshe[a-z]*", "aiau[a-z]*"), flags="(?i)")


def n_of(p):
    return f"len(regexp_extract_all(t, '{p}'))"


def risk_sql(source):
    cols = []
    for rr in PACK.rules:
        n = " + ".join(n_of(p) for p in rr.patterns)
        neg = " OR ".join(f"regexp_matches(t, '{p}')" for p in rr.negative)
        cols.append(f"{n} AS n_{rr.kind}, {neg} AS neg_{rr.kind}")
    conf = ", ".join(f"CASE WHEN ok AND n_{k} > 0 THEN CASE WHEN neg_{k} THEN 0.3 * least(n_{k} / 2, 1) ELSE least(0.7 + (n_{k} - 1) * 0.1, 1.0) END END AS c_{k}" for k in "abc")
    pos = " OR ".join(f"regexp_matches(t, '{p}')" for p in PACK.positive)
    return f"""SELECT *, cnt > 0 AND conf >= 0.5 AS has_risk FROM (
        SELECT *, CASE WHEN cnt > 0 THEN (coalesce(c_a, 0) + coalesce(c_b, 0) + coalesce(c_c, 0)) / cnt * CASE WHEN pos THEN 0.5 ELSE 1 END ELSE 0 END AS conf FROM (
            SELECT *, (c_a IS NOT NULL)::INT + (c_b IS NOT NULL)::INT + (c_c IS NOT NULL)::INT AS cnt FROM (
                SELECT *, {conf} FROM (SELECT id, length(text) >= 20 AS ok, {', '.join(cols)}, {pos} AS pos, len FROM (SELECT id, lower(text) AS t, text, length(text) AS len FROM {source})))))"""


snippet("doc_text", "SELECT doc_id AS id, text FROM documents")
snippet("doc_risks", risk_sql("doc_text"))


@query("risk_tags", """
    SELECT id, CAST(cnt AS INT) AS risks, round(conf, 6) AS risk_confidence, has_risk, ok AND pos AS positive_indicators,
           concat_ws(',', CASE WHEN c_a >= 0.7 THEN 'a' END, CASE WHEN c_b >= 0.7 THEN 'b' END, CASE WHEN c_c >= 0.7 THEN 'c' END) AS risk_flags FROM doc_risks""")
def _(t):
    out = risk.tag_risks(t.documents.select(F.col("doc_id").alias("id"), "text"), "text", PACK)
    return r(out.select("id", F.size("risks").alias("risks"), "risk_confidence", "has_risk", "positive_indicators", F.array_join("risk_flags", ",").alias("risk_flags")), 6)


@query("risk_match_counts", " UNION ALL ".join(
    f"SELECT id, '{rr.kind}' AS type, '{p}' AS pattern, {n_of(p)} AS matches FROM (SELECT id, lower(text) AS t FROM doc_text WHERE length(text) >= 20) WHERE {n_of(p)} > 0"
    for rr in PACK.rules for p in rr.patterns))
def _(t):
    m = risk.risk_matches(t.documents, "doc_id", "text", PACK)
    return m.groupBy(F.col("doc_id").alias("id"), "type", "pattern").agg(F.count(F.lit(1)).alias("matches"))


@query("risk_match_positions", """
    SELECT id, pattern, substr(t, position + 1, length(text)) AS text, position FROM (
        SELECT id, 'erin[a-z]*' AS pattern, t, regexp_extract(t, 'erin[a-z]*') AS text, strpos(t, regexp_extract(t, 'erin[a-z]*')) - 1 AS position
        FROM (SELECT id, lower(text) AS t FROM doc_text WHERE length(text) >= 20) WHERE regexp_matches(t, 'erin[a-z]*'))""")
def _(t):
    m = risk.risk_matches(t.documents, "doc_id", "text", PACK).where(F.col("pattern") == "erin[a-z]*")
    first = m.groupBy(F.col("doc_id").alias("id"), "pattern").agg(F.min("position").alias("position"), F.min_by("text", "position").alias("text"))
    return first.select("id", "pattern", "text", F.col("position").cast("long").alias("position"))


@query("risk_summaries", """
    SELECT id, CASE WHEN has_risk THEN concat_ws(chr(10), concat('Risks found: ', CAST(cnt AS VARCHAR)), concat('Confidence: ', CAST(CAST(round(conf * 100) AS INT) AS VARCHAR), '%'),
        '- Alpha (' || CAST(CAST(round(c_a * 100) AS INT) AS VARCHAR) || '%)', '- Beta (' || CAST(CAST(round(c_b * 100) AS INT) AS VARCHAR) || '%)',
        '- Gamma (' || CAST(CAST(round(c_c * 100) AS INT) AS VARCHAR) || '%)', CASE WHEN pos THEN 'Positive indicators found (possible false alarm)' END) ELSE 'No risks found' END AS summary FROM doc_risks""")
def _(t):
    out = risk.tag_risks(t.documents.select(F.col("doc_id").alias("id"), "text"), "text", PACK)
    return out.select("id", risk.risk_summary(F.col("risks"), F.col("risk_confidence"), F.col("has_risk"), F.col("positive_indicators")).alias("summary"))


@query("risk_highlights", """
    SELECT id, md5(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
        '(the [a-z]+|erin[a-z]*|que [a-z]+|de [a-z]+ment[a-z]*|sich[a-z]*|der [a-z]+)', '<mark>\\1</mark>', 'gi')) AS marked FROM doc_text""")
def _(t):
    pack = risk.RiskPack(rules=(risk.RiskRule("x", "X", ("the [a-z]+", "erin[a-z]*", "que [a-z]+", "de [a-z]+ment[a-z]*", "sich[a-z]*", "der [a-z]+"), ()),), positive=(), flags="(?i)")
    return t.documents.select(F.col("doc_id").alias("id"), F.md5(risk.highlight(F.col("text"), pack)).alias("marked"))


@query("risk_retag", """
    SELECT id, has_risk, concat_ws(',', CASE WHEN c_a IS NOT NULL THEN 'a' END, CASE WHEN c_b IS NOT NULL THEN 'b' END, CASE WHEN c_c IS NOT NULL THEN 'c' END) AS risk_types,
           round(conf, 6) AS risk_confidence FROM doc_risks WHERE id % 10 <> 0 AND len > 50""")
def _(t):
    l = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), (F.col("doc_id") % 10 != 0).alias("is_active"))
    return r(risk.retag_all(l, PACK).withColumn("risk_types", F.array_join("risk_types", ",")), 6)


# --- addresses rebuilt from listing columns -------------------------------------------

snippet("addr_parts", "SELECT id, id % 60 AS s, id % 90 + 1 AS h, id % 4 AS b, id % 25 AS d FROM listings")


def spelled(t):
    """Full scraped address per listing, with metro noise behind it."""
    i = F.col("id")
    st = lambda c: c.cast("string")
    street = F.concat(F.lit("Улица"), F.translate(st(i % 60), "0123456789", "абвгдежзик"))
    house = F.concat(st(i % 90 + 1), F.when(i % 4 > 0, F.concat(F.lit("К"), st(i % 4))).otherwise(F.lit("")))
    clean = F.concat(F.lit("Москва, ЮАО, р-н Зона"), F.translate(st(i % 25), "0123456789", "абвгдежзик"), F.lit(", "), street, F.lit("ская ул., "), house)
    return t.listings.select("id", clean.alias("clean"), F.concat(clean, F.lit(" На карте Сокольники 14 мин.")).alias("raw"))


TR = "translate(CAST({} AS VARCHAR), '0123456789', 'абвгдежзик')"
CLEAN = f"concat('Москва, ЮАО, р-н Зона', {TR.format('d')}, ', Улица', {TR.format('s')}, 'ская ул., ', CAST(h AS VARCHAR), CASE WHEN b > 0 THEN concat('К', CAST(b AS VARCHAR)) ELSE '' END)"


@query("address_cleaning", f"SELECT id, {CLEAN} AS address, true AS valid FROM addr_parts")
def _(t):
    c = adr.clean_address(F.col("raw"))
    return spelled(t).select("id", c.alias("address"), adr.address_valid(c).alias("valid"))


@query("address_parsing", f"""
    SELECT id, 'ЮАО' AS okrug, concat('Зона', {TR.format('d')}) AS district, concat('Улица', {TR.format('s')}, 'ская') AS street, 'ул' AS street_type,
           CAST(h AS VARCHAR) AS house, CASE WHEN b > 0 THEN CAST(b AS VARCHAR) END AS building,
           lower(concat('Улица', {TR.format('s')}, 'ская_', CAST(h AS VARCHAR), CASE WHEN b > 0 THEN concat('к', CAST(b AS VARCHAR)) ELSE '' END)) AS house_key FROM addr_parts""")
def _(t):
    p = spelled(t).select("id", adr.parse_address(F.col("clean")).alias("p"))
    return p.select("id", "p.okrug", "p.district", "p.street", "p.street_type", "p.house", "p.building", "p.house_key")


@query("same_house_groups", "SELECT s, h, b, count(*) AS listings, min(id) AS first_id FROM addr_parts GROUP BY s, h, b")
def _(t):
    k = spelled(t).select("id", (F.col("id") % 60).alias("s"), (F.col("id") % 90 + 1).alias("h"), (F.col("id") % 4).alias("b"),
                          adr.parse_address(F.col("clean"))["house_key"].alias("house_key"))
    return k.groupBy("house_key").agg(F.first("s").alias("s"), F.first("h").alias("h"), F.first("b").alias("b"), F.count(F.lit(1)).alias("listings"),
                                      F.min("id").alias("first_id")).drop("house_key")


@query("same_street_groups", "SELECT s, count(*) AS listings, count(DISTINCT h * 10 + b) AS houses, min(id) AS first_id FROM addr_parts GROUP BY s")
def _(t):
    p = spelled(t).select("id", adr.parse_address(F.col("clean")).alias("p")).select("id", "p.street_key", "p.house_key")
    s = F.col("first_id") % 60
    return p.groupBy("street_key").agg(F.count(F.lit(1)).alias("listings"), F.countDistinct("house_key").alias("houses"), F.min("id").alias("first_id")).select(
        s.alias("s"), "listings", "houses", "first_id")


@query("same_place_flags", """
    SELECT id, b % 2 = 0 AND h % 3 > 0 AS same_house, h % 3 > 0 AS same_street FROM addr_parts""")
def _(t):
    # the other spelling drops the building for odd ones, and names another street for each third house
    i = F.col("id")
    n = (i % 90 + 1).cast("string")
    one = F.concat(F.lit("Москва, улица Кленовая, дом "), n, F.when(i % 4 % 2 == 1, F.lit("К2")).otherwise(F.lit("")))
    other = F.concat(F.when((i % 90 + 1) % 3 > 0, F.lit("г. Москва, р-н Лефортово, Кленовая ул., ")).otherwise(F.lit("Москва, Осиновая ул., ")), n)
    a, b = F.col("a"), F.col("b")
    return t.listings.select("id", one.alias("a"), other.alias("b")).select("id", adr.same_place(a, b).alias("same_house"), adr.same_place(a, b, "street_key").alias("same_street"))


@query("address_spellings", f"""
    SELECT id, CASE id % 4 WHEN 0 THEN 'ЮЗАО' WHEN 1 THEN NULL WHEN 2 THEN 'НАО' ELSE 'ЗелАО' END AS okrug,
           CASE WHEN id % 4 < 3 THEN concat('Зона', {TR.format('d')}) END AS district,
           CASE id % 4 WHEN 0 THEN concat('Нижняя Хвойн', {TR.format('s')}, 'ая') WHEN 1 THEN concat('Хвойн', {TR.format('s')}, 'ая') WHEN 3 THEN concat('мкр. ', CAST(s AS VARCHAR)) END AS street,
           CASE id % 4 WHEN 0 THEN 'ш' WHEN 1 THEN 'ул' END AS street_type, CAST(h AS VARCHAR) AS house,
           CASE id % 4 WHEN 0 THEN '2' WHEN 3 THEN CAST(h AS VARCHAR) END AS building, CASE id % 4 WHEN 0 THEN '1' END AS structure FROM addr_parts""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    letters = lambda c: F.translate(st(c), "0123456789", "абвгдежзик")
    zone, street, house = F.concat(F.lit("Зона"), letters(i % 25)), F.concat(F.lit("Хвойн"), letters(i % 60), F.lit("ая")), st(i % 90 + 1)
    text = F.when(i % 4 == 0, F.concat(F.lit("Москва, ЮЗАО, р-н "), zone, F.lit(", Нижняя "), street, F.lit(" шоссе, "), house, F.lit("К2С1"))) \
        .when(i % 4 == 1, F.concat(F.lit("Москва, район "), zone, F.lit(", улица "), street, F.lit(", д. "), house)) \
        .when(i % 4 == 2, F.concat(F.lit("Москва, НАО (Новомосковский), "), zone, F.lit(" деревня, "), house)) \
        .otherwise(F.concat(F.lit("Москва, ЗелАО, мкр. "), st(i % 60), F.lit("-й, к"), house))
    p = t.listings.select("id", text.alias("text")).select("id", adr.parse_address(F.col("text")).alias("p"))
    return p.select("id", "p.okrug", "p.district", "p.street", "p.street_type", "p.house", "p.building", "p.structure")


@query("address_grouping", """
    SELECT CAST(p_partkey % 40 AS INT) AS street, count(*) AS spellings, count(DISTINCT p_partkey % 3) AS forms FROM part GROUP BY 1""")
def _(t):
    i = F.col("p_partkey")
    n = (i % 40).cast("string")
    forms = F.when(i % 3 == 0, F.concat(F.lit("г. Москва, ул. Лесная "), n)).when(i % 3 == 1, F.concat(F.lit("Россия, Москва, улица Лесная "), n)).otherwise(
        F.concat(F.lit("Лесная  "), n))
    g = t.part.select((i % 40).cast("int").alias("street"), (i % 3).alias("f"), adr.norm_address(forms).alias("k"))
    return g.groupBy("k").agg(F.min("street").alias("street"), F.count(F.lit(1)).alias("spellings"), F.countDistinct("f").alias("forms")).drop("k")


@query("address_for_lookup", f"SELECT id, concat('Москва, ул. Зона, ', CAST(h AS VARCHAR)) AS lookup FROM addr_parts")
def _(t):
    a = F.concat(F.lit("Москва, ЮАО, р-н Чертаново, ул. Зона, "), (F.col("id") % 90 + 1).cast("string"))
    return t.listings.select("id", adr.clean_for_lookup(a).alias("lookup"))


@query("address_resolution", """
    SELECT a.id, CASE WHEN h % 5 <> 0 THEN concat('ref-', CAST(s AS VARCHAR), '-', CAST(h AS VARCHAR)) END AS address_id, CASE WHEN h % 5 <> 0 THEN CAST(h % 3 AS INT) END AS address_quality_code FROM addr_parts a""")
def _(t):
    from hearthmark.operators.resolve import resolve_addresses
    i = F.col("id")
    l = t.listings.select("id", F.concat(F.lit("Москва, улица Лесная "), (i % 60).cast("string"), F.lit(", дом "), (i % 90 + 1).cast("string")).alias("address"))
    s, h = F.col("s"), F.col("h")
    ref = t.listings.select((i % 60).alias("s"), (i % 90 + 1).alias("h")).distinct().where("h % 5 <> 0").select(
        F.concat(F.lit("ул. Лесная "), s.cast("string"), F.lit(", д. "), h.cast("string")).alias("address"),
        F.concat(F.lit("ref-"), s.cast("string"), F.lit("-"), h.cast("string")).alias("address_id"), (h % 3).cast("int").alias("address_quality_code"),
        F.lit("101000").alias("postal_code"))
    return resolve_addresses(l, ref).select("id", "address_id", "address_quality_code")


@query("property_texts", """
    SELECT id, CAST(CASE WHEN id % 3 = 2 THEN 0 ELSE id % 5 + 1 END AS INT) AS rooms, area_total + 0.5 AS area, floor, CASE WHEN id % 3 <> 2 THEN total_floors END AS total_floors,
           concat('Лесной проспект ', CAST(id % 60 AS VARCHAR)) AS address FROM listings""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    area = F.format_string("%.1f", F.col("area_total") + 0.5)
    tail = F.concat(F.lit("Лесной проспект "), st(i % 60))
    text = F.when(i % 3 == 0, F.concat(st(i % 5 + 1), F.lit("-комнатная квартира, "), area, F.lit(" м2, "), st(F.col("floor")), F.lit("/"), st(F.col("total_floors")), F.lit(" этаж, "), tail)) \
        .when(i % 3 == 1, F.concat(st(i % 5 + 1), F.lit("-комнатная квартира, "), F.replace(area, F.lit("."), F.lit(",")), F.lit(" кв.м, "), st(F.col("floor")), F.lit("/"), st(F.col("total_floors")), F.lit(" этаж, "), tail)) \
        .otherwise(F.concat(F.lit("Студия "), area, F.lit(" м², "), st(F.col("floor")), F.lit(" этаж, "), tail))
    return t.listings.select("id", text.alias("text")).select("id", parsing.parse_property_text(F.col("text")).alias("p")).select("id", "p.*")


@query("title_facts", """
    SELECT id, CASE WHEN id % 3 < 2 THEN area_total END AS area, CASE WHEN id % 3 <> 2 THEN CAST(id % 5 + 1 AS INT) END AS rooms FROM listings""")
def _(t):
    i = F.col("id")
    area, rooms = F.format_string("%.0f", "area_total"), (i % 5 + 1).cast("string")
    title = F.when(i % 3 == 0, F.concat(rooms, F.lit("-комнатная квартира, "), area, F.lit(" кв. м"))).when(i % 3 == 1, F.concat(F.lit("Лот: "), rooms, F.lit("к. кв., площадью "), area)) \
        .otherwise(F.lit("Нежилое помещение"))
    return t.listings.select("id", title.alias("text")).select("id", parsing.parse_title(F.col("text")).alias("p")).select("id", "p.*")


@query("register_texts", """
    SELECT id, concat('г Москва, ул Лесная, д ', CAST(id % 60 AS VARCHAR)) AS address, area_total + 0.3 AS area,
           concat('77:01:', lpad(CAST(id AS VARCHAR), 7, '0'), ':', CAST(id % 900 + 1 AS VARCHAR)) AS cadastral_number, floor, total_floors, house_year AS building_year FROM listings""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    text = F.concat(F.lit("Кадастровый номер: 77:01:"), F.lpad(st(i), 7, "0"), F.lit(":"), st(i % 900 + 1), F.lit("\nАдрес: г Москва, ул Лесная, д "), st(i % 60),
                    F.lit("\nПлощадь, кв.м: "), F.format_string("%.1f", F.col("area_total") + 0.3), F.lit("\nЭтаж: "), st(F.col("floor")), F.lit("\nЭтажность: "), st(F.col("total_floors")),
                    F.lit("\nГод постройки: "), st(F.col("house_year")))
    return t.listings.select("id", text.alias("text")).select("id", parsing.parse_register_text(F.col("text")).alias("p")).select("id", "p.*")


@query("offer_texts", """
    SELECT id, CAST(id % 5 + 1 AS INT) AS rooms, area_total AS area, floor, total_floors, house_year AS building_year, CASE id % 2 WHEN 0 THEN 'panel' ELSE 'brick' END AS building_type,
           CASE WHEN id % 2 = 0 THEN (5 + id % 20) * 1000000.0 ELSE 5000000.0 + id END AS price FROM listings""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    area = F.coalesce(F.concat(F.format_string("%.0f", "area_total"), F.lit(" м², ")), F.lit(""))
    text = F.concat(st(i % 5 + 1), F.lit("-комн. кв. "), F.when(F.col("area_total").isNotNull(), area).otherwise(F.lit("")), st(F.col("floor")), F.lit("/"), st(F.col("total_floors")), F.lit(" этаж, дом "),
                    F.when(i % 2 == 0, "панельный").otherwise("кирпичный"), F.lit(", "), st(F.col("house_year")), F.lit(" года, цена "),
                    F.when(i % 2 == 0, F.concat(st(5 + i % 20), F.lit(" млн"))).otherwise(F.concat(st(5000000 + i), F.lit(" руб"))))
    return t.listings.select("id", text.alias("text")).select("id", parsing.parse_offer_text(F.col("text")).alias("p")).select("id", "p.rooms", "p.area", "p.floor", "p.total_floors", "p.building_year", "p.building_type", "p.price")


@query("number_texts", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE (o_orderkey % 200) + 0.5 END AS area, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE o_totalprice END AS price,
           CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END AS floor, CAST(o_orderdate AS DATE) AS day FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    bad = k % 6 == 5
    area = F.when(bad, "нет").otherwise(F.concat((k % 200).cast("string"), F.lit(",5 м²")))
    price = F.when(bad, "договорная").otherwise(F.concat(F.format_string("%.2f", "o_totalprice"), F.lit(" руб")))
    floor = F.when(bad, "3a").otherwise((k % 30).cast("string"))
    return t.orders.select(k.alias("id"), parsing.parse_area(area).alias("area"), parsing.parse_price(price).alias("price"), parsing.parse_int(floor).alias("floor"),
                           parsing.parse_date(F.concat(F.lit("торги "), F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("day"))


@query("resale_flag", "SELECT id, (id % 4 = 0) AND total_floors > 22 AS resale FROM listings")
def _(t):
    year = F.when(F.col("id") % 4 != 0, F.col("house_year"))
    return t.listings.select("id", parsing.resale_in_new_building(year, F.col("total_floors"), 22).alias("resale"))


# --- offers from JSON ------------------------------------------------------------------

def responses(t):
    """One response per order with its lines as offers, in three shapes of the document."""
    l = t.lineitem
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = F.when(F.col("l_linenumber") % 3 == 0, F.to_json(F.struct((cents * 1000).alias("value")))).when(
        F.col("l_linenumber") % 3 == 1, F.to_json(F.struct((cents * 1000).alias("rub")))).otherwise((cents * 1000).cast("string"))
    offer = F.concat(
        F.lit('{"offerId":'), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"), F.lit(',"seoUrl":"https://example.test/'), F.col("l_partkey").cast("string"),
        F.lit('","region":"'), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit('","operationName":"'), F.when(F.col("l_returnflag") == "R", "продажа").otherwise("rent"),
        F.lit('","rooms":0,"roomsCount":'), (F.col("l_quantity").cast("int") % 7).cast("string"), F.lit(',"area":{"value":'), (F.col("l_quantity") + 14).cast("string"),
        F.lit('},"floorNumber":'), F.col("l_linenumber").cast("string"), F.lit(',"address":"Street '), F.col("l_partkey").cast("string"), F.lit('","ownerType":"Realtor","geo":{"coordinates":{"lat":55.5,"lng":37.5}},"price":'), price,
        F.lit(',"addedTimestamp":'), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string"), F.lit(',"propertyType":"'),
        F.when(F.col("l_partkey") % 10 == 0, "apartment").when(F.col("l_partkey") % 10 == 1, "share").otherwise("flat"), F.lit('","category":"'),
        F.when(F.col("l_partkey") % 20 == 2, "newBuilding").otherwise("flats"), F.lit('"}'))
    doc = F.concat(F.lit("["), F.array_join(F.collect_list("offer"), ","), F.lit("]"))
    g = l.select("l_orderkey", (F.col("l_linenumber") % 8).alias("part"), offer.alias("offer")).groupBy("l_orderkey", "part").agg(doc.alias("d"))
    k = F.col("l_orderkey") % 4
    return g.select("l_orderkey", F.when(k == 0, F.concat(F.lit('{"data":{"offersSerialized":'), "d", F.lit("}}"))).when(k == 1, F.concat(F.lit('{"data":{"items":'), "d", F.lit("}}")))
                    .when(k == 2, F.concat(F.lit('{"offersSerialized":'), "d", F.lit("}"))).otherwise(F.concat(F.lit('{"unexpected":'), "d", F.lit("}"))).alias("body"))


snippet("offer_rows", """
    SELECT l_orderkey * 10 + l_linenumber AS id, concat('https://example.test/', CAST(l_partkey AS VARCHAR)) AS url, CAST(l_suppkey % 9 + 1 AS INT) AS region,
           CASE WHEN l_returnflag = 'R' THEN 'продажа' ELSE 'rent' END AS deal_type, CASE WHEN CAST(floor(l_quantity) AS INT) % 7 <> 0 THEN CAST(floor(l_quantity) AS INT) % 7 END AS rooms,
           l_quantity + 14 AS area_total, CAST(l_linenumber AS INT) AS floor, concat('Street ', CAST(l_partkey AS VARCHAR)) AS address, 'Realtor' AS seller_type,
           55.5 AS lat, 37.5 AS lon, CAST(round(l_extendedprice * 100) AS BIGINT) * 1000.0 AS price, l_shipdate AS seen_at, l_partkey AS k
    FROM lineitem WHERE l_orderkey % 4 <> 3""")
snippet("offer_routed", """
    SELECT *, CASE WHEN k % 20 = 2 THEN 'newbuilding' WHEN area_total < 20 OR k % 10 = 1 THEN 'share' WHEN k % 10 = 0 THEN 'apartment' END AS reject_reason FROM offer_rows""")


def mapped(t):
    return offers.map_offers(offers.extract_offers(responses(t), "body"), AS_OF)


@query("offers_extracted", "SELECT l_orderkey, count(*) AS offers FROM lineitem WHERE l_orderkey % 4 <> 3 GROUP BY l_orderkey")
def _(t):
    return offers.extract_offers(responses(t), "body").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("offers"))


@query("offers_mapped", "SELECT * EXCLUDE (k) FROM offer_rows")
def _(t):
    return mapped(t).select("id", "url", "region", "deal_type", "rooms", "area_total", "floor", "address", "seller_type", "lat", "lon", "price", "seen_at")


@query("offers_routed", "SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS cnt FROM offer_routed GROUP BY 1")
def _(t):
    return val.route_counts(val.route_offers(mapped(t)))


@query("offer_filters", """
    SELECT id, k % 20 = 2 AS is_new, area_total < 20 OR k % 10 = 1 AS is_share, k % 10 = 0 AS is_apartment FROM offer_rows""")
def _(t):
    m = mapped(t)
    return m.select("id", val.is_newbuilding(m).alias("is_new"), val.is_share(m).alias("is_share"), val.is_apartment(m).alias("is_apartment"))


snippet("offer_checked", """
    SELECT *, rooms IS NULL AS bad_rooms, price < 100000 OR price > 1000000000 AS bad_price FROM offer_rows""")


@query("offers_valid", "SELECT id, CASE deal_type WHEN 'продажа' THEN 'sale' ELSE deal_type END AS deal_type, 'agent' AS seller_type, rooms FROM offer_checked WHERE NOT bad_rooms AND NOT bad_price")
def _(t):
    return val.validate_and_map(mapped(t))[0].select("id", "deal_type", "seller_type", "rooms")


@query("offers_valid_prices", "SELECT id, seen_at, price FROM offer_checked WHERE NOT bad_rooms AND NOT bad_price")
def _(t):
    return val.validate_and_map(mapped(t))[1]


@query("offers_rejected", """
    SELECT id, concat_ws(',', CASE WHEN bad_rooms THEN 'rooms' END, CASE WHEN bad_price THEN 'price' END) AS reasons FROM offer_checked WHERE bad_rooms OR bad_price""")
def _(t):
    return val.validate_and_map(mapped(t))[2].select("id", F.array_join("reasons", ",").alias("reasons"))


@query("constraint_violations", """
    SELECT id, concat_ws(',', CASE WHEN NOT region > 0 THEN 'region' END, CASE WHEN rooms IS NULL THEN 'rooms' END, CASE WHEN area_total <= 0 THEN 'area_total' END) AS violations FROM listings""")
def _(t):
    return val.check_constraints(t.listings, val.listing_rules()).select("id", F.array_join("violations", ",").alias("violations"))


@query("seller_deal_norm", """
    SELECT id, CASE seller_type WHEN 'owner' THEN 'owner' WHEN 'Realtor' THEN 'agent' ELSE 'developer' END AS seller, deal_type AS deal FROM listings""")
def _(t):
    return t.listings.select("id", val.norm_seller(F.col("seller_type")).alias("seller"), val.norm_deal(F.upper("deal_type")).alias("deal"))


@query("lots_collectable", "SELECT id, property_type IN ('apartment', 'room') AND id % 7 <> 0 AS collectable FROM auction_lots")
def _(t):
    l = t.auction_lots.withColumns({"title": F.when(F.col("id") % 14 == 0, "Доля квартиры").otherwise("Квартира"),
                                    "description": F.when(F.col("id") % 14 == 7, "1/3 доля в праве").otherwise("лот")})
    return l.select("id", val.lot_is_collectable(l).alias("collectable"))


# --- pages -------------------------------------------------------------------------------

@query("page_fields", """
    SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)([/?#]|$)', 1), '') AS BIGINT) AS offer_id, length(html) AS html_length FROM pages""")
def _(t):
    return pages.extract_from_html(t.pages).select("page_id", "offer_id", F.length("html").cast("long").alias("html_length"))


PLAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _a, _b in pages.ENTITIES:
    PLAIN = f"replace({PLAIN}, '{_a}', '{_b}')"


@query("page_plain_length", f"SELECT page_id, CAST(length(trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g'))) AS INT) AS chars FROM pages")
def _(t):
    return t.pages.select("page_id", F.length(pages.plain_text(F.col("html"))).alias("chars"))


@query("card_fields", """
    SELECT id AS offer_id, CAST(id % 6 AS INT) AS rooms, area_total, floor, total_floors, CASE WHEN id % 2 = 0 THEN (3 + id % 9) * 1000000.0 + 500000 ELSE 4000000.0 + id END AS price, 'Собственник' AS seller_type
    FROM listings""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    title = F.concat(F.when(i % 6 == 0, "Студия").otherwise(F.concat(st(i % 6), F.lit("-комн. квартира"))), F.lit(", "), F.format_string("%.0f", "area_total"), F.lit(" м², "),
                     st(F.col("floor")), F.lit("/"), st(F.col("total_floors")), F.lit(" этаж"))
    price = F.when(i % 2 == 0, F.concat(st(3 + i % 9), F.lit(",5 млн ₽"))).otherwise(F.concat(st(4000000 + i), F.lit("&nbsp;₽")))
    html = F.concat(F.lit('<article data-name="LinkArea"><span data-mark="OfferTitle">Рассрочка 0%</span><span data-mark="OfferSubtitle">'), title,
                    F.lit('</span><span data-mark="MainPrice">'), price, F.lit('</span><div data-mark="OfferCardSeller">Собственник</div></article>'))
    p = t.listings.select(F.concat(F.lit("https://example.test/sale/flat/"), st(i), F.lit("/")).alias("url"), html.alias("html"))
    return pages.extract_from_html(p).select("offer_id", "rooms", "area_total", "floor", "total_floors", "price", "seller_type")


snippet("card_rows", f"""
    SELECT id AS offer_id, id // 7 AS page, CASE WHEN id % 2 = 0 THEN concat('https://example.test/sale/flat/', CAST(id AS VARCHAR), '/') ELSE concat('https://site.test/sale/flat/', CAST(id AS VARCHAR), '/') END AS offer_url,
           CAST(CASE WHEN id % 6 = 0 THEN 0 ELSE id % 6 END AS INT) AS rooms, CASE WHEN id % 2 = 0 THEN (3 + id % 9) * 1000000.0 + 500000 ELSE 4000000.0 + id END AS price,
           CASE WHEN id % 5 < 4 THEN {CLEAN} END AS address, CASE id % 11 WHEN 0 THEN 'apartment' WHEN 1 THEN 'share' END AS property_type,
           CASE WHEN id % 13 = 0 OR id % 13 = 1 THEN 'newbuilding' END AS building_status, 'Агентство' AS seller_type
    FROM addr_parts WHERE id % 17 <> 16""")


@query("page_offers", """
    SELECT page, offer_id, offer_url, rooms, price, address, property_type, building_status, seller_type,
           row_number() OVER (PARTITION BY page ORDER BY offer_id) > 0 AS on_page FROM card_rows""")
def _(t):
    return pages.page_offers(list_pages(t), site="https://site.test").select(
        "page", "offer_id", "offer_url", "rooms", "price", "address", "property_type", "building_status", "seller_type", (F.col("card_no") >= 0).alias("on_page"))


def list_pages(t):
    """List pages of seven listings each; one card in seventeen lacks its link."""
    i = F.col("id")
    st = lambda c: c.cast("string")
    label = lambda x: F.concat(F.lit('<a data-name="GeoLabel" href="/geo/">'), x, F.lit("</a>"))
    parts = F.split("clean", ", ")
    labels = F.array_join(F.transform(parts, label), "<span>, </span>")
    holder = F.concat(F.lit('<div data-name="SpecialGeo"><span>'), F.array_join(parts, "</span><span>"), F.lit("</span></div>"))
    by_class = F.concat(F.lit('<ul class="x1--address--y2"><li>'), F.array_join(parts, "</li><li>"), F.lit("</li></ul>"))
    address = F.when(i % 5 < 2, labels).when(i % 5 == 2, holder).when(i % 5 == 3, by_class).otherwise(F.lit('<a data-name="GeoLabel">Москва</a>'))
    link = F.when(i % 17 == 16, F.lit("/about/")).when(i % 2 == 0, F.concat(F.lit("https://example.test/sale/flat/"), st(i), F.lit("/"))).otherwise(F.concat(F.lit("/sale/flat/"), st(i), F.lit("/")))
    facts = F.concat(F.when(i % 6 == 0, "Студия").otherwise(F.concat(st(i % 6), F.lit("-комн. квартира"))), F.lit(", 40,5 м², 3/9 этаж"))
    marks = F.when(i % 4 == 0, F.concat(F.lit('<span data-mark="OfferTitle">'), facts, F.lit("</span>"))).otherwise(
        F.concat(F.lit('<span data-mark="OfferTitle">Рассрочка 0%</span><span data-mark="OfferSubtitle">'), facts, F.lit("</span>")))
    price = F.when(i % 2 == 0, F.concat(F.lit('<b data-mark="MainPrice">'), st(3 + i % 9), F.lit(",5 млн ₽</b>"))).otherwise(
        F.concat(F.lit('<b data-mark="DiscountPrice">'), st(4000000 + i), F.lit("&nbsp;₽</b><s data-mark='MainPrice'>9 999 999 ₽</s>")))
    kind = F.concat(F.when(i % 11 == 0, "Апартаменты. ").when(i % 11 == 1, "Доля в праве. ").otherwise(""),
                    F.when(i % 13 == 0, "Дом строится. ").when(i % 13 == 1, "Жилой комплекс Заря. ").when(i % 13 == 2, "Жилой комплекс Заря, дом сдан. ").otherwise(""))
    card = F.concat(F.lit('<article data-name="LinkArea"><a href="'), link, F.lit('">'), marks, F.lit("</a>"), price, address, F.lit("<p>"), kind, F.lit('</p><div data-mark="OfferCardSeller">Агентство</div></article>'))
    rows = spelled(t).select("id", F.expr("id div 7").alias("page"), card.alias("card"))
    cards = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", "card"))).alias("cards"))
    return cards.select("page", F.concat(F.lit("<html><body><nav><a href='/sale/'>Все</a></nav>"), F.array_join(F.col("cards")["card"], "\n"), F.lit("</body></html>")).alias("html"))


@query("page_details", """
    SELECT id, CASE WHEN id % 3 = 0 THEN id % 30 + 10.5 WHEN id % 3 = 1 THEN id % 40 + 12.0 END AS area_living, CASE WHEN id % 3 < 2 THEN 8.5 + id % 4 END AS area_kitchen,
           CASE WHEN id % 7 <> 0 THEN CAST(1950 + id % 70 AS INT) END AS house_year, CASE WHEN id % 5 = 0 THEN 'П-44' END AS house_series, id % 2 = 0 AS balcony, id % 4 = 1 AS loggia,
           id % 6 = 0 AS house_has_elevator, id % 9 = 0 AS house_has_parking,
           CASE id % 4 WHEN 0 THEN 'евроремонт' WHEN 1 THEN 'косметический' WHEN 2 THEN 'без ремонта' END AS renovation, CASE id % 3 WHEN 0 THEN 'смежные' WHEN 1 THEN 'раздельные' END AS rooms_layout
    FROM listings""")
def _(t):
    i = F.col("id")
    st = lambda c: c.cast("string")
    fact = lambda name, value: F.concat(F.lit(f'<div data-name="ObjectFactoidsItem"><span>{name}</span><span>'), value, F.lit(" м²</span></div>"))
    say = lambda cond, text: F.when(cond, F.lit(f"<p>{text}</p>")).otherwise(F.lit(""))
    facts = F.concat(F.lit("<section>"), fact("Общая площадь", F.lit("99,9")), fact("Жилая площадь", F.concat(st(i % 30 + 10), F.lit(",5"))), fact("Площадь кухни", F.concat(st(8 + i % 4), F.lit(",5"))), F.lit("</section>"))
    plain = F.concat(F.lit("<p>Общая площадь 77 м², жилая площадь: "), st(i % 40 + 12), F.lit(" м², площадь кухни "), st(8 + i % 4), F.lit(".5 м²</p>"))
    html = F.concat(F.lit("<html><script>var балкон = 'лифт';</script>"), F.when(i % 3 == 0, facts).when(i % 3 == 1, plain).otherwise(F.lit("<p>Площадь 60 м²</p>")),
                    F.when(i % 7 != 0, F.concat(F.lit("<li>Год постройки: "), st(1950 + i % 70), F.lit("</li>"))).otherwise(F.lit("<li>Год постройки: 1066</li>")),
                    say(i % 5 == 0, "Серия: П-44"), say(i % 2 == 0, "Есть Балкон"), say(i % 4 == 1, "Лоджия"), say(i % 6 == 0, "Лифт"), say(i % 9 == 0, "подземный паркинг"),
                    say(i % 4 == 0, "Евро"), say(i % 4 == 1, "Косметический"), say(i % 4 == 2, "без ремонта, хороший вид"), say(i % 3 == 0, "комнаты смежные"), say(i % 3 == 1, "Раздельные"), F.lit("</html>"))
    return pages.page_details(t.listings.select("id", html.alias("html"))).drop("html")


@query("targets", """
    SELECT 'shop' AS source, concat('ext', CAST(p_partkey AS VARCHAR)) AS external_id, concat('https://shop.test/', CAST(p_partkey AS VARCHAR)) AS url, 3 AS priority FROM part WHERE p_partkey % 5 > 1""")
def _(t):
    k = F.col("p_partkey")
    lines = t.part.select(F.when(k % 5 == 0, "# comment").when(k % 5 == 1, "  ").otherwise(F.concat(F.lit(" https://shop.test/"), k.cast("string"), F.lit(" , ext"), k.cast("string"))).alias("value"))
    return files.parse_targets(lines, "shop", 3)


@query("ordered_details", """
    SELECT id, page, count(*) AS items, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) AS cents, arg_min(price, seen_at) AS first_price
    FROM (SELECT *, CAST((row_number() OVER (PARTITION BY id ORDER BY seen_at, price) - 1) // 20 AS BIGINT) AS page FROM listing_prices) GROUP BY id, page""")
def _(t):
    d = files.collect_ordered(t.listing_prices, ["id"], ["seen_at", "price"], ["seen_at", "price"], F.date_trunc("year", "seen_at"), 20)
    items = F.from_json("json", "array<struct<seen_at:string,price:double>>")
    return d.select("id", "page", "items", F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.round(x["price"] * 100).cast("long")).alias("cents"), F.get(items, F.lit(0))["price"].alias("first_price"))


@query("replaced_dates", """
    SELECT CAST(date_trunc('month', seen_at) AS DATE) AS date, count(*) * CASE WHEN year(seen_at) = 2000 THEN 10 ELSE 1 END AS points, max(price) AS top_price
    FROM listing_prices GROUP BY CAST(date_trunc('month', seen_at) AS DATE), year(seen_at)""")
def _(t):
    """A run writes the levels of every month, a second one replaces those of one year; read back from the files."""
    path = work_folder(t.spark)
    levels = t.listing_prices.groupBy(F.trunc("seen_at", "month").alias("date")).agg(F.count(F.lit(1)).alias("points"), F.max("price").alias("top_price"))
    files.write_snapshot(levels, path)
    files.write_snapshot(levels.where("year(date) = 2000").withColumn("points", F.col("points") * 10), path)
    return t.spark.read.schema("points long, top_price double, date date").parquet(path).select("date", "points", "top_price")
