"""Legal-risk tags in listing texts: a rule pack as data and its evaluation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RiskRule:
    kind: str
    name: str
    patterns: Sequence[str]
    negative: Sequence[str]


@dataclass(frozen=True)
class RiskPack:
    rules: Sequence[RiskRule]
    positive: Sequence[str]
    flags: str = "(?iU)"
    min_length: int = 20


# Patterns of the Russian rule pack.
RUSSIAN = RiskPack(
    rules=(
        RiskRule("registered_people", "Зарегистрированные люди", (
            r"зарегистриров\w+ \d+ чел", r"прописан\w+ \d+ чел", r"зарегистриров\w+\s+дети", r"прописан\w+\s+дети",
            r"есть прописанные", r"есть зарегистрированные", r"\d+\s+зарегистриров", r"\d+\s+прописан",
            r"проживают люди", r"живут люди", r"не выписан",
        ), (
            r"без зарегистриров", r"никто не зарегистриров", r"без прописанных", r"никто не прописан", r"прописанных нет",
            r"нет прописанных", r"выписан", r"выпишется", r"выпишутся", r"выписка до сделки", r"выписываются",
            r"снимутся с учета", r"снимется с учета", r"по факту сделки", r"до сделки", r"чистая продажа", r"обременений нет",
            r"без обременений", r"нет обременений", r"зарегистрирован\w*\s+собственник",
            r"зарегистрирован\w*\s+\d+\s+человек\s*\(собственник", r"прописан\w*\s+собственник", r"прописан\w*\s*\(собственник",
            r"\d+\s+прописан\w*\s*\(собственник", r"\d+\s+собственник", r"\d+\s+\w*собственник\w*[,\s]+\d+\s+прописан",
            r"\d+\s+взросл\w+\s+собственник",
        )),
        RiskRule("eviction_required", "Требуется выселение", (
            r"требуется выселение", r"нужно выселение", r"необходимо выселение", r"требуется снятие", r"нужно снятие",
            r"выселение через суд", r"выселение по суду", r"принудительное выселение", r"судебное выселение",
        ), (r"снятие с регистрации до сделки", r"снятие с учета до сделки", r"до сделки")),
        RiskRule("mortgage_on_property", "Залог/ипотека на объекте", (
            r"квартира в ипотеке", r"объект в залоге", r"под залогом", r"обременение ипотекой", r"ипотечное обременение",
            r"залог банка", r"не снято обременение", r"с обременением", r"банк залогодержатель", r"кредит на квартиру",
            r"ипотечный кредит на объект",
        ), (
            r"без обременений", r"нет обременений", r"обременений нет", r"нет ипотеки", r"ипотеки нет", r"без ипотеки",
            r"помощь с ипотекой", r"помогу с ипотекой", r"ипотека возможна", r"возможна ипотека", r"возможность ипотеки",
            r"подходит под ипотеку", r"одобрение ипотеки", r"оформление ипотеки", r"содействие в ипотеке", r"помогу оформить ипотеку",
            r"ипотека покупателя", r"покупка в ипотеку", r"ипотеку любого банка", r"ипотеку приветствуем", r"приветствуем ипотеку",
            r"рассмотрим ипотеку", r"под залогом до \d", r"внесли.*залог", r"залог.*внесен", r"аванс", r"задаток",
        )),
        RiskRule("legal_issues", "Юридические проблемы", (
            r"судебное разбирательство", r"судебный спор", r"находится в суде", r"рассматривается в суде", r"под арестом",
            r"находится под арестом", r"конфискация", r"наследственное дело", r"споры о наследстве", r"оспаривается",
            r"судебное производство",
        ), (
            r"без судебных", r"нет споров", r"чистая сделка", r"арестов нет", r"нет арестов", r"без арестов", r"не под арестом",
            r"не в залоге", r"залогов нет", r"обременений нет", r"без обременений", r"нет обременений", r"отсутствуют.*обременения",
        )),
    ),
    positive=(
        r"чистая продажа", r"свободная продажа", r"без обременений", r"нет обременений", r"обременений нет", r"никто не прописан",
        r"никто не зарегистрирован", r"прописанных нет", r"нет прописанных", r"собственник выписан", r"освобождена", r"свободна",
        r"прямая продажа", r"юридически чистая", r"юридически чисто", r"без проблем", r"арестов.*нет", r"нет.*арестов",
        r"залогов.*нет", r"нет.*залогов", r"ипотеки нет", r"нет ипотеки",
    ),
)


def any_of(patterns: Sequence[str], flags: str) -> str:
    return flags + "(?:" + "|".join(patterns) + ")"


def _tags(text: Column, pack: RiskPack) -> Column:
    """Array of (type, name, matches, confidence) of the rules that match."""
    out = []
    for r in pack.rules:
        # one alternation decides whether the single patterns are counted at all
        n = F.when(text.rlike(any_of(r.patterns, pack.flags)),
                   sum((F.regexp_count(text, F.lit(pack.flags + p)) for p in r.patterns), F.lit(0))).otherwise(0)
        weak = F.lit(0.3) * F.least(n / 2.0, F.lit(1.0))
        strong = F.least(F.lit(0.7) + (n - 1) * 0.1, F.lit(1.0))
        conf = F.when(text.rlike(any_of(r.negative, pack.flags)), weak).otherwise(strong)
        out.append(F.when(n > 0, F.struct(F.lit(r.kind).alias("type"), F.lit(r.name).alias("name"), n.alias("matches"), conf.alias("confidence"))))
    return F.array_compact(F.array(*out))


def tag_risks(df: DataFrame, text: str, pack: RiskPack = RUSSIAN) -> DataFrame:
    """Rows beside risks, risk_confidence, has_risk, risk_flags and positive_indicators."""
    low = F.lower(text)
    long_enough = F.coalesce(F.length(text) >= pack.min_length, F.lit(False))
    none = F.array().cast("array<struct<type:string,name:string,matches:int,confidence:double>>")
    df = df.withColumn("risks", F.when(long_enough, _tags(low, pack)).otherwise(none))
    df = df.withColumn("positive_indicators", long_enough & F.coalesce(low.rlike(any_of(pack.positive, pack.flags)), F.lit(False)))
    n = F.size("risks")
    total = F.aggregate("risks", F.lit(0.0), lambda acc, r: acc + r["confidence"])
    mean = F.when(n > 0, total / F.nullif(n, F.lit(0)) * F.when(F.col("positive_indicators"), 0.5).otherwise(1.0)).otherwise(0.0)
    df = df.withColumn("risk_confidence", mean)
    strong = F.transform(F.filter("risks", lambda r: r["confidence"] >= 0.7), lambda r: r["type"])
    return df.withColumn("has_risk", (n > 0) & (F.col("risk_confidence") >= 0.5)).withColumn("risk_flags", strong)


def risk_matches(df: DataFrame, key: str, text: str, pack: RiskPack = RUSSIAN) -> DataFrame:
    """One row per match: type, pattern, matched text and its 0-based position in the lower-cased text."""
    low = F.col("_t")
    every = any_of([p for r in pack.rules for p in r.patterns], pack.flags)

    def hit(kind: str, p: str) -> Column:
        full = pack.flags + p
        return F.when(low.rlike(full), F.struct(
            F.lit(kind).alias("type"), F.lit(p).alias("pattern"), F.regexp_extract_all(low, F.lit(full), F.lit(0)).alias("m"), F.split(low, full, -1).alias("gaps")))

    found = F.array_compact(F.array(*[hit(r.kind, p) for r in pack.rules for p in r.patterns]))
    hits = (df.where(F.length(text) >= pack.min_length).select(key, F.lower(text).alias("_t")).where(low.rlike(every))
            .select(key, F.explode(found).alias("_h")).select(key, "_h.*"))
    # a match starts after all gaps up to it and all matches before it
    start = lambda i: (F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, s: a + F.length(s))
                       + F.aggregate(F.slice("m", 1, i), F.lit(0), lambda a, s: a + F.length(s)))
    return hits.select(key, "type", "pattern", F.inline(F.transform("m", lambda m, i: F.struct(m.alias("text"), start(i).alias("position")))))


def risk_summary(risks: Column, confidence: Column, has_risk: Column, positive: Column) -> Column:
    """Short text: number of risks, confidence, one line per risk, note on positive indicators."""
    pct = lambda c: F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))
    lines = F.transform(risks, lambda r: F.concat(F.lit("- "), r["name"], F.lit(" ("), pct(r["confidence"]), F.lit(")")))
    head = F.array(F.concat(F.lit("Risks found: "), F.size(risks).cast("string")), F.concat(F.lit("Confidence: "), pct(confidence)))
    tail = F.when(positive, F.array(F.lit("Positive indicators found (possible false alarm)"))).otherwise(F.array().cast("array<string>"))
    return F.when(has_risk, F.array_join(F.concat(head, lines, tail), "\n")).otherwise("No risks found")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(text: Column, pack: RiskPack = RUSSIAN, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """HTML-escaped text with every risk wording marked."""
    every = pack.flags + "(" + "|".join(p + r"\w*" if p[-1].isalpha() else p for r in pack.rules for p in r.patterns) + ")"
    return F.regexp_replace(escape_html(text), every, open_tag + "$1" + close_tag)


def retag_all(listings: DataFrame, pack: RiskPack = RUSSIAN, min_length: int = 50) -> DataFrame:
    """Patch with fresh tags for active listings whose description is long enough to judge."""
    rows = listings.where(F.col("is_active") & (F.length("description") > min_length)).select("id", "description")
    t = tag_risks(rows, "description", pack)
    return t.select("id", F.col("has_risk"), F.transform("risks", lambda r: r["type"]).alias("risk_types"), "risk_confidence")
