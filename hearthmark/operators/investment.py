"""Purchase price at which an investment reaches its target return ("interest price")."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.operators.skew import not_above


# Rates that every row searches in a list; a larger table is joined.
MOST_RATES = 4_096


@dataclass(frozen=True)
class InvestParams:
    """Defaults of one investment; any of them may be overridden by a column ``p_<name>``."""

    bargain_discount: float = 0.07
    monthly_rate: float = 0.04
    project_period_months: int = 3
    partner_split: float = 0.5
    min_profit: float = 1_000_000
    mortgage_issue_fee: float = 0.0075
    mortgage_prepay_months: int = 3
    ltv: float = 1.0
    tax_rate: float = 0.06
    include_notary: bool = False
    notary_fee: float = 50_000
    include_state_fee: bool = False
    state_fee: float = 4_000
    include_pip: bool = False
    pip_fee: float = 1_000
    include_agency: bool = False
    agency_fee: float = 200_000
    include_utilities: bool = False
    utilities_per_month: float = 11_500
    include_eviction: bool = False
    eviction_cost: float = 150_000
    include_renovation: bool = False
    renovation_per_sqm: float = 60_000
    include_foreman: bool = False
    foreman_fee: float = 100_000
    include_financing: bool = False
    financing_rate: float = 0.30
    include_registrators_transfer: bool = False
    registrators_transfer_fee: float = 15_000
    include_registrators_mortgage: bool = False
    registrators_mortgage_fee: float = 10_000
    include_contur_registration: bool = False
    contur_registration_fee: float = 4_000
    include_serbsky: bool = True
    serbsky_fee: float = 27_000
    key_rate: float = 21.0


# Bank margin over the key rate (points), renovation mark-up, its rate and months, guaranteed share.
BANK_MARGIN = 5.5
RENOVATION_MULTIPLIER = 1.6
RENOVATION_RATE, RENOVATION_MONTHS = 0.04, 4
GUARANTEED_SHARE, GUARANTEED_AMOUNT = 0.02, 1_000_000.0
TYPES = ("own", "partner", "partner_flip", "bank_flip")
# Fixed-fee items: name -> (switch, amount).
FEES = {
    "notary": ("include_notary", "notary_fee"), "state_fee": ("include_state_fee", "state_fee"), "pip": ("include_pip", "pip_fee"),
    "agency": ("include_agency", "agency_fee"), "eviction": ("include_eviction", "eviction_cost"),
    "registrators_transfer": ("include_registrators_transfer", "registrators_transfer_fee"),
    "registrators_mortgage": ("include_registrators_mortgage", "registrators_mortgage_fee"),
    "contur_registration": ("include_contur_registration", "contur_registration_fee"), "certification": ("include_serbsky", "serbsky_fee"),
}


class _P:
    """Parameter access: a column of the table if present, else the default."""

    def __init__(self, df: DataFrame, params: InvestParams):
        self._cols, self._d = set(df.columns), asdict(params)

    def __getattr__(self, name: str) -> Column:
        v = self._d[name]
        lit = F.lit(float(v)) if isinstance(v, float) or (isinstance(v, int) and not isinstance(v, bool)) else F.lit(v)
        return F.coalesce(F.col(f"p_{name}"), lit) if f"p_{name}" in self._cols else lit


def fixed_costs(df: DataFrame, params: InvestParams = InvestParams()) -> DataFrame:
    """Rows beside ``fixed_costs`` and ``cost_items`` (only the items switched on).

    Renovation, foreman and financing are left out: they depend on the deal itself.
    """
    p = _P(df, params)
    items = [F.struct(F.lit("utilities").alias("k"), (p.utilities_per_month * p.project_period_months).alias("v"), p.include_utilities.alias("on"))]
    items += [F.struct(F.lit(n).alias("k"), getattr(p, a).alias("v"), getattr(p, s).alias("on")) for n, (s, a) in FEES.items()]
    on = F.filter(F.array(*items), lambda e: e["on"])
    return (df.withColumn("_items", on)
            .withColumn("cost_items", F.map_from_entries(F.transform("_items", lambda e: F.struct(e["k"], e["v"]))))
            .withColumn("fixed_costs", F.aggregate("_items", F.lit(0.0), lambda acc, e: acc + e["v"])).drop("_items"))


def interest_price(df: DataFrame, params: InvestParams = InvestParams(), kind: str | None = None) -> DataFrame:
    """Interest price and profit split for each row of (market_price, area_total, [project_type], [key_rate]).

    ``kind`` fixes the project type; otherwise the column ``project_type`` is read.
    Rows whose price comes out at or below zero carry ``reject_reason`` and NULL measures.
    """
    d = fixed_costs(df if kind is None else df.withColumn("project_type", F.lit(kind)), params)
    p = _P(df, params)
    t = F.col("project_type")
    bank, own, flip = t == "bank_flip", t == "own", t.isin("partner_flip", "bank_flip")
    months, at = p.project_period_months, 1 - p.tax_rate
    target = p.monthly_rate * months
    base = F.col("market_price") * (1 - p.bargain_discount)
    key_rate = F.coalesce(F.col("key_rate"), p.key_rate) if "key_rate" in df.columns else p.key_rate

    def solve(cost: Column) -> Column:
        return (base * at - cost * (1 + target)) / (at + target)

    d = d.withColumn("_fc", F.col("fixed_costs")).withColumn("_ip", solve(F.col("_fc")))
    fin = F.when(p.include_financing & (p.financing_rate > 0) & ~bank, F.col("_ip") * p.financing_rate / (1 - p.financing_rate))
    d = d.withColumn("_fin", fin).withColumn("_fc", F.col("_fc") + F.coalesce("_fin", F.lit(0.0)))
    d = d.withColumn("_ip", F.when(F.col("_fin").isNotNull(), solve(F.col("_fc"))).otherwise(F.col("_ip")))
    # short partner projects: at least the minimum profit for us
    low = (F.col("_ip") + F.col("_fc")) * p.monthly_rate * months
    floor_ip = base - (p.min_profit + F.col("_fc")) / at
    d = d.withColumn("_ip", F.when((t == "partner") & (months < 3) & (low < p.min_profit), floor_ip).otherwise(F.col("_ip")))
    bad = F.col("_ip").isNull() | (F.col("_ip") <= 0)
    d = d.withColumn("reject_reason", F.when(bad, "costs too high for the target return")).withColumn("_ip", F.when(~bad, F.col("_ip")))

    loan = F.when(bank, F.col("_ip") * p.ltv)
    monthly = loan * ((key_rate + BANK_MARGIN) / 12 / 100)
    d = d.withColumns({"_loan": loan, "_monthly": monthly, "_interest": monthly * months, "_issue": loan * p.mortgage_issue_fee})
    d = d.withColumn("_fc", F.col("_fc") + F.coalesce("_interest", F.lit(0.0)) + F.coalesce("_issue", F.lit(0.0)))

    reno_on = p.include_renovation | F.col("_force_renovation") if "_force_renovation" in df.columns else p.include_renovation
    reno = F.when(reno_on, p.renovation_per_sqm * F.col("area_total"))
    bonus = reno * RENOVATION_MULTIPLIER
    foreman = F.when(reno_on & p.include_foreman, p.foreman_fee)
    d = d.withColumns({"_reno": reno, "_bonus": bonus, "_foreman": foreman})
    d = d.withColumns({"_sale": base + F.coalesce("_bonus", F.lit(0.0)),
                       "_total": F.col("_fc") + F.coalesce("_reno", F.lit(0.0)) + F.coalesce("_foreman", F.lit(0.0))})
    d = d.withColumn("_gross", F.col("_sale") - F.col("_ip")).withColumn("_tax", F.col("_gross") * p.tax_rate)
    d = d.withColumns({"_profit": F.col("_gross") - F.col("_total") - F.col("_tax"), "_invested": F.col("_ip") + F.col("_total"),
                       "_reno_income": F.when(flip, F.col("_reno") * RENOVATION_RATE * RENOVATION_MONTHS),
                       "_inv_income": F.when(t == "partner_flip", F.col("_ip") * RENOVATION_RATE * months)})
    profit, invested = F.col("_profit"), F.col("_invested")
    # partner: half, but at least the monthly rate
    need = invested * p.monthly_rate * months
    half = profit * (1 - p.partner_split)
    partner_ours = F.when(half >= need, half).otherwise(need)
    partner_theirs = F.when(half >= need, profit * p.partner_split).otherwise(F.greatest(F.lit(0.0), profit - need))
    # flips: renovation and investment income are ours before the split; a guaranteed minimum on top
    extra = F.coalesce("_reno_income", F.lit(0.0)) + F.coalesce("_inv_income", F.lit(0.0))
    pct_min = invested * GUARANTEED_SHARE
    least = F.greatest(pct_min, F.lit(GUARANTEED_AMOUNT))
    flip_ours = (profit - extra) * (1 - p.partner_split) + extra
    flip_theirs = (profit - extra) * p.partner_split
    short = flip_ours < least
    ours = F.when(own, profit).when(t == "partner", partner_ours).otherwise(F.when(short, least).otherwise(flip_ours))
    theirs = F.when(own, F.lit(None)).when(t == "partner", partner_theirs).otherwise(
        F.when(short, F.greatest(F.lit(0.0), profit - least)).otherwise(flip_theirs))
    d = d.withColumns({"our_profit": ours, "partner_profit": theirs})
    a = F.col("area_total")
    rate = F.when(invested > 0, profit / invested).otherwise(0.0)
    extra_items = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in (
        ("financing", "_fin"), ("mortgage_interest", "_interest"), ("mortgage_issue", "_issue"), ("renovation", "_reno"), ("foreman", "_foreman"),
        ("renovation_income", "_reno_income"), ("investment_income", "_inv_income"), ("tax", "_tax"))])
    breakdown = F.map_concat("cost_items", F.map_from_entries(F.filter(extra_items, lambda e: e["v"].isNotNull())))
    ok = F.col("_ip").isNotNull()
    measures = {
        "interest_price": F.col("_ip"), "interest_price_per_sqm": F.col("_ip") / a, "expected_sale_price": F.col("_sale"),
        "expected_sale_per_sqm": F.col("_sale") / a, "renovation_cost": F.col("_reno"), "renovation_bonus": F.col("_bonus"),
        "renovation_profit": F.col("_bonus") - F.col("_reno"), "renovation_income": F.col("_reno_income"), "investment_income": F.col("_inv_income"),
        "fixed_costs_total": F.col("_total"), "variable_costs": F.col("_tax"), "total_costs": F.col("_total") + F.col("_tax"),
        "expected_profit": profit, "our_profit": F.col("our_profit"), "partner_profit": F.col("partner_profit"), "profit_rate": rate,
        "monthly_profit_rate": rate / months, "our_monthly_rate": F.when(own, rate / months).otherwise(
            F.when(invested > 0, F.col("our_profit") / invested).otherwise(0.0) / months),
        "mortgage_amount": F.col("_loan"), "mortgage_monthly_payment": F.col("_monthly"), "mortgage_total_interest": F.col("_interest"),
        "mortgage_prepayment": F.col("_monthly") * p.mortgage_prepay_months, "mortgage_issue_cost": F.col("_issue"),
        "bank_rate_yearly": F.when(bank, key_rate + BANK_MARGIN), "min_guaranteed": F.when(flip, least),
        "min_guaranteed_source": F.when(flip, F.when(pct_min >= GUARANTEED_AMOUNT, "share of investment").otherwise("fixed amount")),
        "cost_breakdown": breakdown,
    }
    keep = [c for c in df.columns if c != "project_type" and not c.startswith("_")]
    return d.select(*keep, "project_type", *[F.when(ok, v).alias(k) for k, v in measures.items()], "reject_reason")


def interest_price_all(df: DataFrame, params: InvestParams = InvestParams()) -> DataFrame:
    """Every row under all four project types; the flips always include the renovation."""
    kinds = F.array(*[F.struct(F.lit(t).alias("project_type"), F.lit(t.endswith("flip")).alias("_force_renovation")) for t in TYPES])
    return interest_price(df.withColumn("_k", F.explode(kinds)).select(*df.columns, "_k.*"), params)


def invest_rejects(result: DataFrame) -> DataFrame:
    """Rows without an interest price, and why."""
    return result.where("reject_reason IS NOT NULL")


def _instants(rates: DataFrame) -> DataFrame:
    """One row per instant; of several rates the highest holds."""
    return rates.where("valid_from IS NOT NULL").groupBy("valid_from").agg(F.max("key_rate").alias("key_rate"))


def rate_intervals(rates: DataFrame) -> DataFrame:
    """valid_from, valid_to, key_rate: when each rate is in force, open at the end."""
    by_year = _instants(rates).withColumn("_y", F.year("valid_from"))
    # the next instant of the year, or the first one of a later year; there are no more of these than years
    firsts = by_year.groupBy("_y").agg(F.min("valid_from").alias("_f")).agg(F.collect_list("_f"))
    nxt = F.lead("valid_from").over(Window.partitionBy("_y").orderBy("valid_from"))
    held = by_year.withColumns({"_next": nxt, "_firsts": firsts.scalar()})
    later = F.array_min(F.filter("_firsts", lambda f: F.year(f) > F.col("_y")))
    return held.select("valid_from", F.coalesce("_next", later).alias("valid_to"), "key_rate")


def with_key_rate(df: DataFrame, rates: DataFrame, at: str = "at", most: int = MOST_RATES) -> DataFrame:
    """Key rate in force at each row's instant; ``rates``: valid_from, key_rate. NULL before the first.

    A table of at most ``most`` rates (they are counted) becomes a sorted list that every row searches by halving: no join
    and no shuffle. A larger one is joined as intervals, cut at month borders to meet the rows by month.
    """
    found = _instants(rates).limit(most + 1).collect()
    if len(found) <= most:
        found = sorted((r.valid_from, r.key_rate) for r in found)
        kind = rates.schema["key_rate"].dataType
        if not found:
            return df.withColumn("key_rate", F.lit(None).cast(kind))
        instants, values = F.array(*[F.lit(v) for v, _ in found]), F.array(*[F.lit(k).cast(kind) for _, k in found])
        # NULL instants have no rate
        place = F.when(F.col(at).isNotNull(), not_above(instants, len(found), F.col(at).cast(rates.schema["valid_from"].dataType)))
        return df.withColumn("key_rate", F.get(values, place - 1))
    month = F.date_trunc("month", F.col(at))
    span = df.agg(F.max(at).alias("last")).collect()[0]["last"]
    held = rate_intervals(rates).where(F.col("valid_from") <= F.lit(span)).withColumn("_to", F.least(F.coalesce("valid_to", F.lit(span)), F.lit(span)))
    months = F.sequence(F.date_trunc("month", "valid_from"), F.date_trunc("month", "_to"), F.expr("INTERVAL 1 MONTH"))
    held = held.select("valid_from", "valid_to", "key_rate", F.explode(months).alias("_month"))
    inside = (F.col(at) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return df.join(held, (month == F.col("_month")) & inside, "left").drop("valid_from", "valid_to", "_month")


def interest_price_simple(psm: Column, area: Column, bargain_discount: float = 0.07, target: float = 0.12) -> Column:
    """Per-m2 short formula with average fees; never below zero."""
    fees = (50_000 + 4_000 + 200_000) / area + 1500 + (11_500 * 3) / area
    return F.greatest((psm * (1 - bargain_discount) - fees) / (1 + target / 0.94), F.lit(0.0))


@dataclass(frozen=True)
class ReportParams:
    cost_notary: float = 50_000
    cost_duty: float = 4_000
    pip_per_sqm: float = 1_500
    cost_agent: float = 200_000
    cost_registrar: float = 25_000
    cost_kontur: float = 4_000
    dynamic_costs: float = 0
    target_monthly_rate: float = 4
    project_months: int = 3
    min_profit: float = 1_000_000
    tax_rate: float = 6


def report_interest_price(market_price: Column, area: Column, p: ReportParams = ReportParams()) -> Column:
    """Market price less all costs and the gross target profit (at least the minimum)."""
    costs = p.cost_notary + p.cost_duty + area * p.pip_per_sqm + p.cost_agent + p.cost_registrar + p.cost_kontur + p.dynamic_costs
    rate = p.target_monthly_rate * p.project_months / 100
    profit = F.greatest(market_price * (rate / (1 + rate)), F.lit(float(p.min_profit)))
    return market_price - costs - profit / (1 - p.tax_rate / 100)


def with_renovation(params: InvestParams) -> InvestParams:
    return replace(params, include_renovation=True)
