"""Accounting identities, reconciliation against a second source, amendment and triage."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import dbl, drift_severity, tolerance


@dataclass(frozen=True)
class Tie:
    """total should be the signed sum of parts. skip_missing: no verdict where a side is missing; else missing parts are 0."""

    name: str
    total: str
    parts: dict[str, int]
    skip_missing: bool = True


# The identities of the vendor's statements. A balance sheet's and a cash flow's missing parts are 0.
_plus = lambda *parts: dict.fromkeys(parts, 1)
IS_TIES = [
    Tie("gross_profit", "gross_profit", {"revenue": 1, "cogs": -1}), Tie("operating_income", "operating_income", {"gross_profit": 1, "total_opex": -1}),
    Tie("continuing_ops_after_tax", "continuing_ops_after_tax", {"ebt_incl_unusual": 1, "tax": -1}), Tie("net_income", "net_income", _plus("continuing_ops_after_tax", "discontinued_ops")),
    Tie("net_income_attributable_to_parent", "net_income_attributable_to_parent", {"net_income": 1, "minority_interest": -1}),
]
BS_TIES = [
    Tie("total_current_assets", "total_current_assets", _plus("cash_and_equivalents", "short_term_investments", "accounts_receivable", "other_receivables", "inventory", "prepaid_expenses", "other_current_assets"), False),
    Tie("total_assets", "total_assets", _plus("total_current_assets", "net_ppe", "long_term_investments", "goodwill", "other_intangibles", "deferred_tax_assets_noncurrent", "other_noncurrent_assets"), False),
    Tie("total_current_liabilities", "total_current_liabilities", _plus("accounts_payable", "accrued_expenses", "current_portion_lt_debt", "current_portion_leases_operating", "deferred_revenue_current", "other_current_liabilities"), False),
    Tie("total_liabilities", "total_liabilities", _plus("total_current_liabilities", "long_term_debt", "long_term_leases_operating", "deferred_revenue_noncurrent", "deferred_tax_liability_noncurrent", "other_noncurrent_liabilities"), False),
    Tie("total_liabilities_and_equity", "total_liabilities_and_equity", _plus("total_liabilities", "total_equity"), False),
    Tie("balance", "total_assets", _plus("total_liabilities_and_equity"), False),
]
CF_TIES = [
    Tie("cfo", "cfo", _plus("net_income_start", "dna_cf", "sbc", "deferred_income_tax", "other_noncash", "change_accounts_receivable", "change_inventory", "change_accounts_payable", "change_other_working_capital"), False),
    Tie("cfi", "cfi", _plus("capital_expenditures", "acquisitions", "purchases_of_investments", "sales_of_investments", "other_investing"), False),
    Tie("cff", "cff", _plus("short_term_debt_issuance", "long_term_debt_issuance", "stock_issuance", "stock_repurchase", "common_dividends_paid", "preferred_dividends_paid", "other_financing"), False),
    Tie("net_change_in_cash", "net_change_in_cash", _plus("cfo", "cfi", "cff", "fx_effect_on_cash"), False),
    Tie("cash_roll_forward", "net_change_in_cash", {"cash_end_of_period": 1, "cash_begin_of_period": -1}, False),
]


def broken_ties(wide: DataFrame, ties: list[Tie], keys: list[str], absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """A row for each tie that misses by more than max(absolute, relative of the larger side)."""
    def told(t: Tie) -> Column:
        zero = F.lit(0).cast("decimal(38,4)")
        total, computed = F.col(t.total).cast("decimal(38,4)"), zero
        for part, sign in t.parts.items():
            computed = computed + F.coalesce(F.col(part).cast("decimal(28,4)"), F.when(F.lit(not t.skip_missing), F.lit(0).cast("decimal(28,4)"))) * sign
        total = total if t.skip_missing else F.coalesce(total, zero)
        return F.struct(F.lit(t.name).alias("tie"), dbl(total).alias("expected"), dbl(computed).alias("computed"))

    rows = wide.select(*keys, F.explode(F.array(*[told(t) for t in ties])).alias("x")).select(*keys, "x.*").where("expected IS NOT NULL AND computed IS NOT NULL")
    delta = F.abs(F.col("expected") - F.col("computed"))
    rows = rows.withColumn("delta", delta).where(F.col("delta") > tolerance(F.greatest(F.abs("expected"), F.abs("computed")), absolute, relative))
    return rows.withColumn("severity", drift_severity(F.col("delta") / F.greatest(F.abs("expected"), F.lit(1e-9))))


def period_arithmetic(facts: DataFrame, annual: DataFrame, concepts: list[str], absolute: float = 2.5e6, relative: float = 0.001) -> DataFrame:
    """Fiscal years whose four quarters miss the annual value; years with a missing quarter are skipped."""
    sums = facts.where(F.col("concept").isin(concepts)).groupBy("entity_id", "fiscal_year", "concept").agg(F.sum("value").alias("quarters"), F.countDistinct("fiscal_quarter").alias("n")).where("n = 4")
    rows = sums.join(annual, ["entity_id", "fiscal_year", "concept"]).withColumn("delta", F.abs(dbl("quarters") - dbl("annual")))
    return rows.where(F.col("delta") > tolerance(dbl("annual"), absolute, relative)).drop("n")


def cross_statement(wide: DataFrame, keys: list[str], w: WindowSpec, absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """A row for each tie between statements that misses: keys, tie, left, right, delta.

    The cash flow starts from the income statement's net income; its closing cash is the balance sheet's with restricted cash, its opening
    cash that of the balance sheet before, and its net change the difference of both. A side that is missing, the balance sheet
    before included, gives no verdict; missing restricted cash is 0. w: an entity's periods of one kind in their order.
    """
    cash = F.col("cash_and_equivalents").cast("decimal(38,4)") + F.coalesce(F.col("restricted_cash").cast("decimal(28,4)"), F.lit(0))
    df = wide.withColumn("__cash", cash).withColumn("__before", F.lag("__cash").over(w))
    ties = {"net_income": ("net_income_start", "net_income"), "cash_end": ("cash_end_of_period", "__cash"), "cash_begin": ("cash_begin_of_period", "__before")}
    told = [F.struct(F.lit(k).alias("tie"), dbl(a).alias("left"), dbl(b).alias("right")) for k, (a, b) in ties.items()]
    told.append(F.struct(F.lit("net_change").alias("tie"), dbl("net_change_in_cash").alias("left"), dbl(F.col("__cash") - F.col("__before")).alias("right")))
    rows = df.select(*keys, F.explode(F.array(*told)).alias("x")).select(*keys, "x.*").where("left IS NOT NULL AND right IS NOT NULL")
    rows = rows.withColumn("delta", F.abs(F.col("left") - F.col("right")))
    return rows.where(F.col("delta") > tolerance(F.greatest(F.abs("left"), F.abs("right")), absolute, relative))


#: Days that a quarter, a year and nine months may last.
DURATIONS = {"quarter": (80, 100), "annual": (350, 380), "nine_months": (260, 285)}


def explode_companyfacts(raw: DataFrame, body: str, tags: list[str], unit: str = "USD", taxonomy: str = "us-gaap") -> DataFrame:
    """entity_id, tag, start, end, val, accn, filed, form from a companyfacts JSON column, which is parsed once for all tags."""
    entry = "array<struct<start:date,end:date,val:decimal(28,4),accn:string,filed:date,form:string>>"
    listed = ", ".join(f"`{t}`: struct<units: struct<`{unit}`: {entry}>>" for t in tags)
    parsed = raw.select("entity_id", F.from_json(body, f"facts struct<`{taxonomy}`: struct<{listed}>>").alias("__body"))
    of_tag = lambda t: F.col("__body")["facts"][taxonomy][t]["units"][unit]
    lists = F.array(*[F.struct(F.lit(t).alias("tag"), of_tag(t).alias("e")) for t in tags])
    return parsed.select("entity_id", F.explode(lists).alias("x")).select("entity_id", "x.tag", F.explode("x.e").alias("y")).select("entity_id", "tag", "y.*")


def duration_kind(start: Column, end: Column) -> Column:
    """instant, quarter, annual or nine_months by the days between; else null."""
    days = F.date_diff(end, start)
    out = F.when(start.isNull(), "instant")
    for kind, (low, high) in DURATIONS.items():
        out = out.when(days.between(low, high), kind)
    return out


def latest_filed(entries: DataFrame) -> DataFrame:
    """By entity, concept, kind and end the value of the preferred tag (rank, if there is such a column: the lowest) that was filed last."""
    typed = entries.withColumn("kind", duration_kind(F.col("start"), F.col("end"))).where("kind IS NOT NULL")
    rank = -F.col("rank") if "rank" in entries.columns else F.lit(0)
    fields = [c for c in ("val", "accn", "filed", "tag") if c in entries.columns]
    return typed.groupBy("entity_id", "concept", "kind", "end").agg(F.max_by(F.struct(*fields), F.struct(rank, "filed", "accn")).alias("x")).select("entity_id", "concept", "kind", "end", *[F.col(f"x.{c}").alias(c) for c in fields])


def with_fourth_quarters(filed: DataFrame) -> DataFrame:
    """Adds the fourth quarter as the year less its first nine months."""
    year = filed.where("kind = 'annual'").select("entity_id", "concept", F.col("end").alias("year_end"), F.col("val").alias("fy"), "accn", "filed")
    nine = filed.where("kind = 'nine_months'").select("entity_id", "concept", F.col("end").alias("nine_end"), F.col("val").alias("ytd"))
    q4 = year.join(nine, ["entity_id", "concept"]).where(F.date_diff("year_end", "nine_end").between(*DURATIONS["quarter"]))
    q4 = q4.select("entity_id", "concept", F.lit("quarter").alias("kind"), F.col("year_end").alias("end"), (F.col("fy") - F.col("ytd")).cast("decimal(28,4)").alias("val"), "accn", "filed", F.lit(True).alias("derived"))
    direct = filed.select("entity_id", "concept", "kind", "end", "val", "accn", "filed").withColumn("derived", F.lit(False))
    have = direct.where("kind = 'quarter'").select("entity_id", "concept", "kind", "end")
    return direct.unionByName(q4.join(have, ["entity_id", "concept", "kind", "end"], "left_anti"))


def filed_values(raw: DataFrame, body: str, tags: dict[str, list[str]]) -> DataFrame:
    """entity_id, concept, kind (quarter or instant), end, val, derived, tag of companyfacts. tags: by concept, the preferred first."""
    places = [(t, c, i) for c, listed in tags.items() for i, t in enumerate(listed)]
    entries = explode_companyfacts(raw, body, sorted({t for t, _, _ in places}))
    of = F.create_map(*[x for t in sorted({t for t, _, _ in places}) for x in (F.lit(t), F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(i).alias("rank")) for t2, c, i in places if t2 == t]))])
    told = latest_filed(entries.withColumn("x", F.explode(of[F.col("tag")])).select("*", "x.concept", "x.rank").drop("x"))
    direct = told.select("entity_id", "concept", "kind", "end", "tag")
    preferred = F.element_at(F.create_map(*[F.lit(x) for c, listed in tags.items() for x in (c, listed[0])]), F.col("concept"))
    values = with_fourth_quarters(told).where("kind IN ('quarter', 'instant')")
    return values.join(direct, ["entity_id", "concept", "kind", "end"], "left").withColumn("tag", F.coalesce("tag", preferred))


def anchored(ours: DataFrame, filed: DataFrame, absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """Where current values and filed ones diverge. ours: entity_id, period_end, fiscal_year, concept, value; filed: filed_values()'s rows."""
    theirs = filed.select("entity_id", F.col("end").alias("period_end"), "concept", F.col("val").alias("other"), "derived", "tag")
    return reconcile(ours.select("entity_id", "period_end", "fiscal_year", "concept", "value"), theirs, ["entity_id", "period_end", "concept"], absolute, relative)


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """Keys whose values (value, other) diverge."""
    rows = ours.join(theirs, keys).withColumn("delta", F.abs(dbl("value") - dbl("other")))
    return rows.where(F.col("delta") > tolerance(dbl("other"), absolute, relative))


def promotable(divergences: DataFrame, allowed: list[str], since: int = 2022, least: float = 10e6, most_share: float = 0.25) -> DataFrame:
    share = F.col("delta") / F.greatest(F.abs(dbl("other")), F.lit(1e-9))
    return divergences.where((~F.col("derived")) & (F.col("fiscal_year") >= since) & F.col("concept").isin(allowed) & (F.col("delta") >= least) & (share < most_share))


def promote(facts: DataFrame, accepted: DataFrame, keys: list[str], now: Column, version: str = "xbrl-amendment-1") -> DataFrame:
    """facts with the accepted values as new current rows that name the rows they supersede. accepted: keys, other."""
    live = facts.where("superseded_at IS NULL").join(accepted.select(*keys, "other"), keys)
    new = live.withColumns({"supersedes_fact_id": F.col("id"), "id": F.xxhash64("id", F.lit(version)), "value": F.col("other").cast("decimal(28,4)"), "extraction_version": F.lit(version), "published_at": now, "supersession_reason": F.lit("xbrl_disagreement")}).drop("other")
    hit = accepted.select(*keys).distinct().withColumn("__hit", F.lit(True))
    old = facts.join(hit, keys, "left").withColumn("superseded_at", F.when(F.col("__hit") & F.col("superseded_at").isNull(), now).otherwise(F.col("superseded_at"))).drop("__hit")
    return old.unionByName(new.select(*old.columns))


def promote_verified(facts: DataFrame, accepted: DataFrame, keys: list[str], period: list[str], ties: list[Tie], flags: DataFrame, now: Column, version: str = "xbrl-amendment-1", absolute: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """promote(), and the flags with those of ties that the touched periods break now; one that is open already isn't raised again.

    flags: period's columns, flag_type, detail, resolved_at.
    """
    out = promote(facts, accepted, keys, now, version)
    touched = out.where("superseded_at IS NULL").join(accepted.select(*period).distinct(), period, "left_semi")
    concepts = sorted({t.total for t in ties} | {p for t in ties for p in t.parts})
    wide = touched.groupBy(*period).agg(*[F.expr(f"max(value) FILTER (WHERE concept = '{c}')").alias(c) for c in concepts])
    new = broken_ties(wide, ties, period, absolute).select(*period, F.lit("tie_after_promotion").alias("flag_type"), F.col("tie").alias("detail"))
    known = flags.where("resolved_at IS NULL").select(*period, "flag_type", "detail")
    fresh = new.join(known, [*period, "flag_type", "detail"], "left_anti").withColumn("resolved_at", F.lit(None).cast("timestamp"))
    return out, flags.unionByName(fresh, allowMissingColumns=True)


def sane(old: Column, new: Column, most_share: float = 0.5, above: float = 100_000) -> Column:
    """No change of sign, and of large values no change by more than most_share."""
    flips = (old * new) < 0
    leaps = (F.abs(old) > above) & (F.abs(new - old) > most_share * F.abs(old))
    return ~(flips | leaps)


def amend(wide: DataFrame, candidates: DataFrame, keys: list[str], ties: list[Tie], absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """A verdict per period: clean, amended, partially_amended or unresolved_flagged.

    Candidates (keys, concept, new) replace values of a period whose ties fail; insane ones are rejected; a period whose ties
    still fail with the rest is taken back as a whole.
    """
    failing = broken_ties(wide, ties, keys, absolute, relative).groupBy(*keys).agg(F.count("*").alias("failed"))
    concepts = sorted({t.total for t in ties} | {p for t in ties for p in t.parts})
    known = F.create_map(*[x for c in concepts for x in (F.lit(c), F.col(c).cast("decimal(28,4)"))])
    judged = candidates.where(F.col("concept").isin(concepts)).join(failing.select(*keys), keys, "left_semi").join(wide.select(*keys, known.alias("known")), keys)
    judged = judged.withColumn("ok", F.coalesce(sane(dbl(F.col("known")[F.col("concept")]), dbl("new")), F.lit(True)))
    news = judged.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("ok"), F.struct("concept", "new")))).alias("news"), F.count_if(~F.col("ok")).alias("rejected"))
    tried = wide.join(news, keys)
    tried = tried.select(*keys, "rejected", *[F.coalesce(F.col("news")[c].cast("decimal(28,4)"), F.col(c).cast("decimal(28,4)")).alias(c) for c in concepts])
    still = broken_ties(tried, ties, keys, absolute, relative).groupBy(*keys).agg(F.count("*").alias("still"))
    out = wide.select(*keys).join(failing, keys, "left").join(news.select(*keys, "rejected", F.size("news").alias("accepted")), keys, "left").join(still, keys, "left")
    status = F.when(F.col("failed").isNull(), "clean").when(F.coalesce("accepted", F.lit(0)) == 0, "unresolved_flagged").when(F.col("still").isNotNull(), "unresolved_flagged").when(F.col("rejected") > 0, "partially_amended").otherwise("amended")
    return out.select(*keys, status.alias("status"))


# What the triage of divergences goes by.
#: Concepts whose tag is plain: a material gap is a real one.
PLAIN_CONCEPTS = ("revenue", "gross_profit", "operating_income", "net_income", "net_income_attributable_to_parent", "cfo", "cfi", "cff")
#: Concepts that sources define apart, with the gap up to which that explains them (None: only the tag tells).
DEFINED_APART = {"total_equity": 0.005, "total_liabilities": 0.05, "ebt_incl_unusual": 0.25, "cash_and_equivalents": 0.05, "total_liabilities_and_equity": 0.005, "total_assets": 0.005}
PARENT_ONLY_TAG = "StockholdersEquity"
MATERIAL, MATERIAL_SHARE = 10e6, 0.005


def triage(material: float = MATERIAL) -> Column:
    """The first rule that holds, on concept, tag, derived, delta (signed or not) and other, the filed value.

    A parent-only tag or a gap within what definitions explain is DEFINITIONAL; a fourth quarter derived from the year less nine months is
    AMBIGUOUS; a plain concept with a material gap in a filed value is CORRUPTION; all else is AMBIGUOUS.
    """
    gap = F.abs(dbl("delta"))
    share = F.when(dbl("other") != 0, gap / F.abs(dbl("other")))
    within = F.lit(False)
    for concept, most in DEFINED_APART.items():
        within = within | ((F.col("concept") == concept) & F.coalesce(share < most, F.lit(False)))
    plain = F.col("concept").isin(*PLAIN_CONCEPTS)
    material_gap = (gap >= material) & (share.isNull() | (share >= MATERIAL_SHARE))
    return (
        F.when((F.col("concept") == "total_equity") & (F.col("tag") == PARENT_ONLY_TAG), "DEFINITIONAL")
        .when(within, "DEFINITIONAL")
        .when(F.coalesce(F.col("derived"), F.lit(False)), "AMBIGUOUS")
        .when(plain & material_gap, "CORRUPTION")
        .otherwise("AMBIGUOUS")
    )


def bulk_category() -> Column:
    """Whether a divergence is left open or set aside in bulk, on concept and derived."""
    return F.when(F.coalesce(F.col("derived"), F.lit(False)), "audit_derivation_artifact").when(F.col("concept").isin(*DEFINED_APART), "definitional_difference").otherwise("keep_open")


def affected_periods(failing: DataFrame, ours: DataFrame, filed: DataFrame, least: float = 1.0) -> DataFrame:
    """The quarters of failing fiscal years where the filed values differ by a currency unit or more: entity_id, fiscal_year, period_end, concepts.

    failing: entity_id, fiscal_year. ours: entity_id, concept, fiscal_year, period_end, value. filed: entity_id, concept, end, val.
    """
    rows = ours.join(failing.select("entity_id", "fiscal_year").distinct(), ["entity_id", "fiscal_year"], "left_semi")
    met = rows.join(filed.select("entity_id", "concept", F.col("end").alias("period_end"), "val"), ["entity_id", "concept", "period_end"])
    apart = met.where(F.abs(F.col("value") - F.col("val")) >= F.lit(least))
    return apart.groupBy("entity_id", "fiscal_year", "period_end").agg(F.sort_array(F.collect_set("concept")).alias("concepts"))


#: Statements that are stated anew with another: what a restated statement's periods mark besides their own.
MARKS = {"income_statement": ("cash_flow", "balance_sheet"), "cash_flow": ("balance_sheet",)}


def co_marked(marked: DataFrame) -> DataFrame:
    """The periods to refresh: entity_id, fiscal_year, fiscal_quarter, period_end, statement, period_type, direct.

    marked: the first five, of quarters with a restated value; rows may repeat. An income statement marks the period's cash flow and balance sheet,
    a cash flow its balance sheet; a balance sheet of a fourth quarter is also the year's. direct: the statement was marked itself.
    """
    statement, q4 = F.col("statement"), F.col("fiscal_quarter") == 4
    closure = reduce(lambda w, kv: w.when(statement == kv[0], F.array(*map(F.lit, (kv[0], *kv[1])))), MARKS.items(), F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array(statement))
    all_ = marked.withColumn("__to", F.explode(closure)).withColumn("direct", F.col("__to") == statement).withColumn("statement", F.col("__to"))
    types = F.when((F.col("statement") == "balance_sheet") & q4, F.array(F.lit("quarter"), F.lit("annual"))).otherwise(F.array(F.lit("quarter")))
    keys = ["entity_id", "fiscal_year", "fiscal_quarter", "period_end", "statement", "period_type"]
    return all_.withColumn("period_type", F.explode(types)).groupBy(*keys).agg(F.max("direct").alias("direct"))


def rows_to_refresh(periods: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows, of any concept, of the statements and periods that co_marked() names."""
    on = ["entity_id", "statement", "period_end", "period_type"]
    return rows.join(periods.select(*on).distinct(), on, "left_semi")


#: Concepts that follow from two others where a filing lacks them.
DERIVED_FROM = {"cogs": ("revenue", "gross_profit"), "total_opex": ("gross_profit", "operating_income")}


def derived_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """candidates (keys, concept, new) with those that follow from two of a period's, where it lacks them."""
    news = candidates.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("concept", "new"))).alias("m"))
    one = lambda c, a, b: F.when(F.col("m")[c].isNull() & F.col("m")[a].isNotNull() & F.col("m")[b].isNotNull(), F.struct(F.lit(c).alias("concept"), (F.col("m")[a] - F.col("m")[b]).cast("decimal(28,4)").alias("new")))
    found = news.select(*keys, F.explode(F.array_compact(F.array(*[one(c, *parts) for c, parts in DERIVED_FROM.items()]))).alias("x")).select(*keys, "x.*")
    return candidates.select(*keys, "concept", F.col("new").cast("decimal(28,4)").alias("new"), F.lit(False).alias("derived")).unionByName(found.withColumn("derived", F.lit(True)))


def corrected_fourth_quarter(facts: DataFrame, annual: DataFrame) -> DataFrame:
    """Fourth quarters as the annual value less the other three."""
    rest = facts.where("fiscal_quarter < 4").groupBy("entity_id", "fiscal_year", "concept").agg(F.sum("value").alias("rest"), F.countDistinct("fiscal_quarter").alias("n")).where("n = 3")
    return rest.join(annual, ["entity_id", "fiscal_year", "concept"]).select("entity_id", "fiscal_year", "concept", (F.col("annual") - F.col("rest")).cast("decimal(28,4)").alias("q4"))
