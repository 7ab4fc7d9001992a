"""Queries of the fact store, periods, windows, metrics, as-of joins and named screens; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import testkit as kit
from ..functions import columns as fn
from ..operators import asof, facts, metrics, windows
from ..schemas import CONCEPTS, FLOWS
from ..testkit import safe, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **more: str):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_(sql, **more)
        return f

    return add


def rounded(columns: dict[str, Column] | list[str], digits: int = 6) -> list[Column]:
    items = columns.items() if isinstance(columns, dict) else [(c, F.col(c)) for c in columns]
    return [F.round(c.cast("double"), digits).alias(k) for k, c in items]


def r(columns: dict[str, str] | list[str], digits: int = 6) -> str:
    """The same in SQL."""
    items = columns.items() if isinstance(columns, dict) else [(c, c) for c in columns]
    return ", ".join(f"round(CAST({x} AS DOUBLE), {digits}) AS {k}" for k, x in items)


FRAME = ["entity_id", "period_end"]


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_frame(kit.wide(spark, sf_dir), least_roiic_change=kit.LEAST_CHANGE)


# Fact store


@query("SELECT id, entity_id, concept, CAST(value AS DOUBLE) AS value, fiscal_period_label, extraction_version FROM facts WHERE superseded_at IS NULL")
def current_facts(spark, sf_dir):
    df = facts.current(kit.facts(spark, sf_dir))
    return df.select("id", "entity_id", "concept", F.col("value").cast("double"), "fiscal_period_label", "extraction_version")


@query("SELECT concept, count(*) AS n, sum(CAST(value AS DECIMAL(28,4)))::DOUBLE AS total FROM facts WHERE published_at <= TIMESTAMP '1998-06-30' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1998-06-30') GROUP BY 1")
def facts_as_of(spark, sf_dir):
    at = F.lit("1998-06-30").cast("timestamp")
    return facts.current(kit.facts(spark, sf_dir), at).groupBy("concept").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@query("SELECT id, entity_id, concept, period_end, CAST(value AS DOUBLE) AS value, extraction_version FROM cur WHERE rn = 1")
def source_priority_pick(spark, sf_dir):
    df = kit.picked(spark, sf_dir)
    return df.select("id", "entity_id", "concept", "period_end", F.col("value").cast("double"), "extraction_version")


@query(f"SELECT entity_id, period_end, fiscal_period_label, {r(list(CONCEPTS), 4)}, {r(['rd_any_version'], 4)} FROM wide")
def pivot_wide(spark, sf_dir):
    return kit.wide(spark, sf_dir).select("entity_id", "period_end", "fiscal_period_label", *rounded([*CONCEPTS, "rd_any_version"], 4))


@query(f"SELECT entity_id, period_end, asof_date, {r(['revenue', 'cfo', 'cash_and_equivalents'], 4)} FROM pit")
def pit_pivot(spark, sf_dir):
    df = facts.pit_pivot(facts.current(kit.facts(spark, sf_dir)), CONCEPTS, FRAME)
    return df.select(*FRAME, "asof_date", *rounded(["revenue", "cfo", "cash_and_equivalents"], 4))


@query("""SELECT id, lead(published_at) OVER w AS superseded_at, lag(id) OVER w AS supersedes_fact_id, CASE WHEN lag(id) OVER w IS NOT NULL THEN 'restatement' END AS supersession_reason
    FROM facts WINDOW w AS (PARTITION BY entity_id, concept, period_end, period_type ORDER BY published_at, id)""")
def supersede_scd2(spark, sf_dir):
    rows = kit.facts(spark, sf_dir).withColumn("supersedes_fact_id", F.lit(None).cast("long"))
    return facts.supersede(rows, facts.IDENTITY).select("id", "superseded_at", "supersedes_fact_id", "supersession_reason")


@query("""SELECT n_name AS k, n_nationkey AS v, 'old' AS origin FROM nation WHERE n_regionkey < 3 UNION ALL
    SELECT n_name, n_nationkey, 'new' FROM nation WHERE n_regionkey >= 3""")
def natural_key_dedup(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v"), "n_regionkey")
    old, new = rows.where("n_regionkey < 3"), rows.where("n_regionkey >= 1")
    cut = lambda df, o: df.select("k", "v", F.lit(o).alias("origin"))
    return facts.insert_ignore(cut(old, "old"), cut(new, "new"), ["k"])


@query("""SELECT p_partkey AS k, p_size * 10 AS v FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 <> 0""")
def upsert_newest_wins(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    return facts.upsert(rows, rows.where("k % 3 = 0").withColumn("v", F.col("v") * 10), ["k"])


@query("SELECT count(*) FILTER (WHERE p_partkey > 100) AS inserted, count(*) FILTER (WHERE p_partkey <= 100) AS updated FROM part")
def upsert_counts(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "part").select("p_partkey")
    return facts.upsert_counts(rows.where("p_partkey <= 100"), rows, ["p_partkey"])


@query("""SELECT l_orderkey, concept, round(sum(value)::DOUBLE, 4) AS value FROM (
    SELECT l_orderkey, 'net' AS concept, CAST(l_extendedprice AS DECIMAL(28,4)) AS value FROM lineitem UNION ALL
    SELECT l_orderkey, 'units', CAST(l_quantity AS DECIMAL(28,4)) + CAST(l_linenumber AS DECIMAL(28,4)) FROM lineitem) GROUP BY 1, 2""")
def unpivot_to_facts(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_linenumber")
    long = facts.unpivot(rows, ["l_orderkey"], {"net": ["l_extendedprice"], "units": ["l_quantity", "l_linenumber"]})
    return long.groupBy("l_orderkey", "concept").agg(F.round(F.sum("value").cast("double"), 4).alias("value"))


@query("""SELECT l_suppkey AS entity_id, p_brand AS label, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS dimension_key, round(sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE, 4) AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def segment_explode(spark, sf_dir):
    items, part = kit.table(spark, sf_dir, "lineitem"), kit.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sums = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity_id"), "p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("v"))
    maps = sums.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "v"))).alias("data"))
    return facts.explode_segments(maps, "data", ["entity_id"]).select("entity_id", "label", "dimension_key", F.round(F.col("value").cast("double"), 4).alias("value"))


# Periods


@query("SELECT DISTINCT entity_id, period_end, fiscal_year, fiscal_quarter, 'FY' || fiscal_year || ' Q' || fiscal_quarter AS fiscal_period_label FROM labelled")
def fiscal_period(spark, sf_dir):
    return kit.facts(spark, sf_dir).select("entity_id", "period_end", "fiscal_year", "fiscal_quarter", "fiscal_period_label").distinct()


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, 'CY' || year(o_orderdate) || ' Q' || quarter(o_orderdate) AS label FROM orders")
def calendar_period(spark, sf_dir):
    days = kit.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    y, q, label = fn.calendar_period(F.col("d"))
    return days.select("d", y.alias("y"), q.alias("q"), label.alias("label"))


_ENDS = """SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INTEGER) AS fy, CAST(quarter(o_orderdate) AS INTEGER) AS fq, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus <> 'F') AS stated,
    count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS n, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS trusted FROM orders GROUP BY 1, 2, 3"""


@query("SELECT entity_id, fy, fq, coalesce(CASE WHEN n = 1 THEN trusted END, stated) AS period_end, CAST(year(coalesce(CASE WHEN n = 1 THEN trusted END, stated)) AS INTEGER) AS cy FROM ends WHERE stated IS NOT NULL", ends=_ENDS)
def canonical_period_end(spark, sf_dir):
    """A trusted source's date wins where it is unique for the period; calendar columns follow."""
    rows = kit.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fq"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").alias("trust"))
    sums = rows.groupBy("entity_id", "fy", "fq").agg(F.max(F.when(~F.col("trust"), F.col("d"))).alias("stated"), F.countDistinct(F.when(F.col("trust"), F.col("d"))).alias("n"), F.max(F.when(F.col("trust"), F.col("d"))).alias("trusted"))
    end = F.coalesce(F.when(F.col("n") == 1, F.col("trusted")), F.col("stated"))
    return sums.where("stated IS NOT NULL").select("entity_id", "fy", "fq", end.alias("period_end"), F.year(end).alias("cy"))


@query("""SELECT q.entity_id, q.fiscal_year, q.fiscal_quarter, CASE WHEN q.fiscal_quarter = 4 THEN coalesce(a.e, q.period_end) ELSE q.period_end END AS period_end
    FROM (SELECT DISTINCT entity_id, fiscal_year, fiscal_quarter, period_end FROM labelled) q LEFT JOIN (SELECT entity_id, fiscal_year, period_end + 3 AS e FROM annual_wide) a USING (entity_id, fiscal_year)""")
def q4_snap(spark, sf_dir):
    """A fourth quarter takes the end of its year's annual row, here three days later."""
    one = ["revenue"]  # every period and every year has all concepts
    rows = kit.facts(spark, sf_dir, concepts=one).select("entity_id", "fiscal_year", "fiscal_quarter", "period_end").distinct()
    annual = kit.annual_facts(spark, sf_dir, one).groupBy("entity_id", "fiscal_year").agg(F.date_add(F.max("period_end"), 3).alias("annual_end"))
    end = F.when(F.col("fiscal_quarter") == 4, F.coalesce("annual_end", "period_end")).otherwise(F.col("period_end"))
    return rows.join(annual, ["entity_id", "fiscal_year"], "left").select("entity_id", "fiscal_year", "fiscal_quarter", end.alias("period_end"))


@query("""SELECT entity_id, calendar_year, calendar_quarter, round(CAST(CASE WHEN calendar_quarter = 1 THEN ytd ELSE ytd - lag(ytd) OVER (PARTITION BY entity_id, calendar_year ORDER BY calendar_quarter) END AS DOUBLE), 4) AS revenue
    FROM (SELECT *, sum(revenue) OVER (PARTITION BY entity_id, calendar_year ORDER BY calendar_quarter) AS ytd FROM wide)""")
def ytd_to_discrete(spark, sf_dir):
    w = Window.partitionBy("entity_id", "calendar_year").orderBy("calendar_quarter")
    ytd = kit.wide(spark, sf_dir).withColumn("ytd", F.sum("revenue").over(w))
    own = windows.discrete_from_ytd("ytd", "entity_id", "calendar_year", "calendar_quarter")
    return ytd.select("entity_id", "calendar_year", "calendar_quarter", F.round(own.cast("double"), 4).alias("revenue"))


# Windows and metrics


@query(f"SELECT entity_id, period_end, quarters_in_window, {r([f'{c}_ttm' for c in FLOWS], 4)} FROM mf1")
def ttm_flows(spark, sf_dir):
    return kit.wide(spark, sf_dir).withColumns(windows.trailing(FLOWS)).select(*FRAME, "quarters_in_window", *rounded([f"{c}_ttm" for c in FLOWS], 4))


PIT = ["net_income_ttm", "revenue_ttm", "cfo_ttm", "capital_expenditures_ttm", "cash_and_equivalents"]


@query(f"SELECT entity_id, period_end, asof_date, quarters_in_window, {r(PIT, 4)}, {r({'fcf_ttm': 'cfo_ttm - abs(capital_expenditures_ttm)', 'ebitda_ttm': 'operating_income_ttm + dna_cf_ttm'}, 4)} FROM pit_ttm")
def ttm_pit(spark, sf_dir):
    pit = facts.pit_pivot(facts.current(kit.facts(spark, sf_dir)), CONCEPTS, FRAME)
    return metrics.pit_ttm(pit).select(*FRAME, "asof_date", "quarters_in_window", *rounded([*PIT, "fcf_ttm", "ebitda_ttm"], 4))


def _metric(name: str, columns: list[str], sql: dict[str, str] | None = None, digits: int = 6) -> None:
    """A query of frame columns."""

    def run(spark, sf_dir):
        return frame(spark, sf_dir).select(*FRAME, *rounded(columns, digits))

    run.__name__ = name
    query(f"SELECT entity_id, period_end, {r(sql or columns, digits)} FROM mf")(run)


_metric("two_point_avg", ["avg_total_assets", "avg_total_equity"], digits=4)
_metric("prior_year_lag", ["revenue_ttm_prior_year", "total_equity_prior_year", "shares_diluted_weighted_avg_prior_year"], digits=4)
_metric("rd_capitalized", ["rd_amortization_q", "rd_asset_q", "rd_coverage"], digits=6)
_metric("tax_rate_ttm", ["tax_rate_ttm"])
_metric("adjusted_nopat", ["adjusted_oi_ttm", "adjusted_nopat_ttm", "rd_coverage_quarters"], digits=6)
_metric("invested_capital", ["reported_ic_q", "adjusted_ic_q"], digits=6)
_metric("roic_roiic", ["roic", "roiic", "adjusted_ic_q", "ic_prior_year"])


@query(f"SELECT entity_id, period_end, {r({'growth': 'pow(' + safe('revenue', 'revenue_prior_q', True) + ', 4.0) - 1'}, 5)} FROM mf")
def qoq_annualized(spark, sf_dir):
    return frame(spark, sf_dir).select(*FRAME, *rounded({"growth": metrics.quarter_metrics()["revenue_qoq_annualized"]}, 5))


_DSO, _DIO, _DPO = (f"{safe(s, f)} * 365" for s, f in (("accounts_receivable", "revenue_ttm"), ("inventory", "cogs_ttm"), ("accounts_payable", "cogs_ttm")))
_Q = {
    "gross_margin": safe("gross_profit", "revenue"), "operating_margin": safe("operating_income", "revenue"), "net_margin": safe("net_income", "revenue"), "dso": _DSO, "dio": _DIO, "dpo": _DPO,
    "ccc": f"({_DSO}) + ({_DIO}) - ({_DPO})", "working_capital_intensity": safe("accounts_receivable + inventory - accounts_payable", "revenue_ttm"), "net_debt": "net_debt", "net_debt_to_ebitda": safe("net_debt", "ebitda_ttm"), "interest_coverage_q": safe("operating_income", "interest_expense"),
}


@query(f"SELECT entity_id, period_end, {r(_Q, 9)} FROM mf")
def metrics_q(spark, sf_dir):
    values = metrics.quarter_metrics()
    return frame(spark, sf_dir).select(*FRAME, *rounded({k: values[k] for k in _Q}, 9))


_T = {
    "nopat_margin": safe("adjusted_nopat_ttm", "revenue_ttm"), "cfo_to_nopat": safe("cfo_ttm", "adjusted_nopat_ttm"), "fcf_to_nopat": safe("cfo_ttm + capital_expenditures_ttm", "adjusted_nopat_ttm"),
    "accruals_ratio": safe("net_income_ttm - cfo_ttm", "avg_total_assets"), "sbc_pct_revenue": safe("sbc_ttm", "revenue_ttm"), "interest_coverage_ttm": safe("operating_income_ttm", "interest_expense_ttm"),
    "unlevered_fcf_ttm": "CAST(cfo_ttm AS DOUBLE) + CAST(coalesce(cash_paid_for_interest_ttm, interest_expense_ttm, 0) AS DOUBLE) * (1 - tax_rate_ttm) + CAST(capital_expenditures_ttm AS DOUBLE)",
    "reinvestment_rate": safe("CAST(-capital_expenditures_ttm AS DOUBLE) + CAST((accounts_receivable - accounts_receivable_prior_year) + (inventory - inventory_prior_year) - (accounts_payable - accounts_payable_prior_year) AS DOUBLE) + coalesce(CAST(-acquisitions_ttm AS DOUBLE), 0) - CAST(dna_cf_ttm AS DOUBLE) + coalesce(rd_asset_q, 0) - coalesce(rd_asset_q_prior_year, 0)", "adjusted_nopat_ttm"),
}


@query(f"SELECT entity_id, period_end, quarters_in_window, {r(_T, 5)} FROM mf")
def metrics_ttm(spark, sf_dir):
    return frame(spark, sf_dir).select(*FRAME, "quarters_in_window", *rounded(metrics.ttm_metrics(), 5))


_Y = {
    "revenue_yoy_ttm": safe("revenue_ttm - revenue_ttm_prior_year", "revenue_ttm_prior_year", True), "gross_profit_yoy_ttm": safe("gross_profit_ttm - gross_profit_ttm_prior_year", "gross_profit_ttm_prior_year", True),
    "incremental_gross_margin": safe("gross_profit_ttm - gross_profit_ttm_prior_year", "revenue_ttm - revenue_ttm_prior_year"), "incremental_operating_margin": safe("operating_income_ttm - operating_income_ttm_prior_year", "revenue_ttm - revenue_ttm_prior_year"),
    "diluted_share_count_growth": safe("shares_diluted_weighted_avg - shares_diluted_weighted_avg_prior_year", "shares_diluted_weighted_avg_prior_year"),
}


@query(f"SELECT entity_id, period_end, {r(_Y)} FROM mf")
def metrics_yoy(spark, sf_dir):
    return frame(spark, sf_dir).select(*FRAME, *rounded(metrics.yoy_metrics()))


_CY = ["revenue_cy", "gross_profit_cy", "net_income_cy", "cfo_cy"]


@query(f"""SELECT entity_id, calendar_year, quarters_in_year, last_period_end, {r(_CY, 4)}, {r({'gross_margin_cy': safe('gross_profit_cy', 'revenue_cy'), 'sbc_pct_revenue_cy': safe('sbc_cy', 'revenue_cy')})},
    {r({'total_assets_cy_end': 'total_assets', 'net_debt_cy_end': 'current_portion_lt_debt + long_term_debt + current_portion_leases_operating + long_term_leases_operating - cash_and_equivalents - short_term_investments'}, 4)} FROM cyq""")
def metrics_cy(spark, sf_dir):
    df = metrics.calendar_year(kit.wide(spark, sf_dir))
    return df.select("entity_id", "calendar_year", "quarters_in_year", "last_period_end", *rounded(_CY, 4), *rounded(["gross_margin_cy", "sbc_pct_revenue_cy"]), *rounded(["total_assets_cy_end", "net_debt_cy_end"], 4))


_FY = ["revenue_fy", "gross_profit_fy", "operating_income_fy", "net_income_fy", "rd_fy", "sbc_fy", "cfo_fy", "capital_expenditures_fy"]
_FYM = {"gross_margin_fy": safe("gross_profit_fy", "revenue_fy"), "operating_margin_fy": safe("operating_income_fy", "revenue_fy"), "net_margin_fy": safe("net_income_fy", "revenue_fy"), "sbc_pct_revenue_fy": safe("sbc_fy", "revenue_fy")}
_FYE = {"total_assets_fy_end": "total_assets", "inventory_fy_end": "inventory", "net_debt_fy_end": "current_portion_lt_debt + long_term_debt + current_portion_leases_operating + long_term_leases_operating - cash_and_equivalents - short_term_investments"}


@query(f"SELECT entity_id, fiscal_year, fiscal_period_label, period_end, {r(_FY, 4)}, {r(_FYM, 9)}, {r(_FYE, 4)} FROM annual_wide")
def metrics_fy(spark, sf_dir):
    """The annual rows' view."""
    return kit.annual(spark, sf_dir).select("entity_id", "fiscal_year", "fiscal_period_label", "period_end", *rounded(_FY, 4), *rounded(list(_FYM), 9), *rounded(list(_FYE), 4))


@query("SELECT entity_id, date, round(CAST(close AS DOUBLE), 4) AS close FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, date_trunc('month', date) ORDER BY date) AS n FROM daily) WHERE n = 1")
def bucket_first_row(spark, sf_dir):
    return windows.first_in_bucket(kit.daily(spark, sf_dir), "entity_id", "date", "month").select("entity_id", "date", *rounded(["close"], 4))


@query("SELECT entity_id, max(period_end) AS period_end, round(CAST(arg_max(revenue, period_end) AS DOUBLE), 4) AS revenue FROM wide GROUP BY 1")
def top1_per_entity(spark, sf_dir):
    return windows.top_per(kit.wide(spark, sf_dir), ["entity_id"], [F.desc("period_end")]).select(*FRAME, *rounded(["revenue"], 4))


@query("SELECT entity_id, period_end, round(CAST(CASE WHEN n = 4 THEN s END AS DOUBLE), 6) AS eps_ttm FROM (SELECT entity_id, period_end, sum(CAST(net_income AS DOUBLE) / CAST(shares_diluted_weighted_avg AS DOUBLE)) OVER w AS s, count(*) OVER w AS n FROM wide WINDOW w AS (PARTITION BY entity_id ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))")
def eps_ttm(spark, sf_dir):
    df = kit.wide(spark, sf_dir).withColumn("eps", fn.ratio("net_income", "shares_diluted_weighted_avg")).withColumns(windows.trailing(["eps"]))
    return df.select(*FRAME, F.round(F.when(F.col("quarters_in_window") == 4, F.col("eps_ttm")), 6).alias("eps_ttm"))


# As-of joins and valuation


def _valued(spark, sf_dir):
    pit = metrics.pit_ttm(facts.pit_pivot(facts.current(kit.facts(spark, sf_dir)), CONCEPTS, FRAME))
    return asof.asof_join(kit.daily(spark, sf_dir), pit, "entity_id", "date", "asof_date", "period_end")


@query(f"SELECT entity_id, date, period_end, asof_date, quarters_in_window, {r(['revenue_ttm', 'net_income_ttm'], 4)} FROM known")
def asof_valuation(spark, sf_dir):
    return _valued(spark, sf_dir).select("entity_id", "date", "period_end", "asof_date", "quarters_in_window", *rounded(["revenue_ttm", "net_income_ttm"], 4))


_EV = "CAST(market_cap AS DOUBLE) + CAST(coalesce(long_term_debt, 0) + coalesce(current_portion_lt_debt, 0) + coalesce(noncontrolling_interest, 0) - coalesce(cash_and_equivalents, 0) - coalesce(short_term_investments, 0) AS DOUBLE)"
_V = {"ev": _EV} | {k: f"CASE WHEN quarters_in_window >= 4 THEN {x} END" for k, x in {
    "pe_ttm": safe("market_cap", "net_income_ttm", True), "ps_ttm": safe("market_cap", "revenue_ttm"), "ev_ebitda_ttm": safe(_EV, "operating_income_ttm + dna_cf_ttm", True), "fcf_yield_ttm": safe("cfo_ttm - abs(capital_expenditures_ttm)", "market_cap")}.items()}


@query(f"SELECT entity_id, date, {', '.join(f'{x} AS {k}' for k, x in _V.items())} FROM known")
def valuation_ratios(spark, sf_dir):
    """Quotients of doubles that are exact images of decimals, the same in any engine: not rounded."""
    return _valued(spark, sf_dir).select("entity_id", "date", *[x.alias(k) for k, x in metrics.valuation_ratios().items()])


@query(f"""SELECT entity_id, count(*) AS n, round(quantile_disc(ps, 0.5), 6) AS median_ps, round(min(ps), 6) AS min_ps, round(max(ps), 6) AS max_ps, round(count(*) FILTER (WHERE ps < latest) / count(*), 6) AS below FROM (
    SELECT entity_id, {_V['ps_ttm']} AS ps, last_value({_V['ps_ttm']}) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM known) WHERE ps IS NOT NULL GROUP BY 1""")
def valuation_percentile(spark, sf_dir):
    df = _valued(spark, sf_dir).select("entity_id", "date", metrics.valuation_ratios()["ps_ttm"].alias("ps"))
    df = df.withColumn("latest", F.last("ps").over(Window.partitionBy("entity_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("ps IS NOT NULL")
    return df.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY ps)"), 6).alias("median_ps"), F.round(F.min("ps"), 6).alias("min_ps"), F.round(F.max("ps"), 6).alias("max_ps"), F.round(F.count_if(F.col("ps") < F.col("latest")) / F.count("*"), 6).alias("below"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, v FROM (SELECT o_orderkey, o_orderdate, l.v, row_number() OVER (PARTITION BY o_orderkey ORDER BY l.date DESC) AS n FROM orders LEFT JOIN
    (SELECT CAST(l_shipdate AS DATE) AS date, round(CAST(max(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE), 4) AS v, l_suppkey FROM lineitem GROUP BY 1, 3) l ON l.l_suppkey = o_custkey AND l.date <= CAST(o_orderdate AS DATE)) WHERE n = 1""")
def carry_forward(spark, sf_dir):
    left = kit.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", F.to_date("o_orderdate").alias("d"))
    right = kit.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date")).agg(F.round(F.max(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double"), 4).alias("v"))
    return asof.carry_forward(left, right, "entity_id", "d", "date", "v").select("o_orderkey", "d", "v")


@query("SELECT entity_id, max(date) AS date, round(CAST(arg_max(close, date) AS DOUBLE), 4) AS close FROM daily WHERE date <= DATE '1998-06-30' GROUP BY 1")
def latest_le_date(spark, sf_dir):
    days = kit.daily(spark, sf_dir).where("date <= DATE '1998-06-30'")
    return days.groupBy("entity_id").agg(F.max("date").alias("date"), F.round(F.max_by("close", "date").cast("double"), 4).alias("close"))


_SET = "DATE '1995-01-01' + CAST(entity_id * 37 % 1200 AS INTEGER)"


@query(f"SELECT entity_id, {_SET} AS d, {r({'upside_pct': '(CAST(s_acctbal AS DOUBLE) - c) / c * 100'})} FROM (SELECT d.entity_id, CAST(arg_max(close, date) AS DOUBLE) AS c FROM daily d WHERE date <= {_SET.replace('entity_id', 'd.entity_id')} GROUP BY 1) JOIN entities USING (entity_id) WHERE c <> 0")
def target_gap(spark, sf_dir):
    """A target against the last close up to the day it was set."""
    day = F.expr("date_add(DATE '1995-01-01', cast(entity_id * 37 % 1200 as int))")
    targets = kit.entities(spark, sf_dir).select("entity_id", "s_acctbal", day.alias("d"))
    closes = kit.daily(spark, sf_dir).select("entity_id", "date", F.col("close").cast("double").alias("c"))
    at = asof.carry_forward(targets, closes, "entity_id", "d", "date", "c")
    return at.where("c <> 0").select("entity_id", "d", *rounded({"upside_pct": (F.col("s_acctbal") - F.col("c")) / F.col("c") * 100}))


# Named screens


@query(f"""SELECT entity_id, period_end, {r({'cfo_to_ni': safe('cfo_ttm', 'net_income_ttm'), 'accruals_ratio_pct': '(' + _T['accruals_ratio'] + ') * 100'}, 4)} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM mf WHERE net_income_ttm IS NOT NULL AND cfo_ttm IS NOT NULL)
    WHERE n = 1 AND net_income_ttm > 0 AND CAST(cfo_ttm AS DOUBLE) < 1.1 * CAST(net_income_ttm AS DOUBLE)""")
def accruals_negative_quality(spark, sf_dir, least=1.1):
    rows = windows.top_per(frame(spark, sf_dir).where("net_income_ttm IS NOT NULL AND cfo_ttm IS NOT NULL"), ["entity_id"], [F.desc("period_end")])
    rows = rows.where((F.col("net_income_ttm") > 0) & (fn.dbl("cfo_ttm") < least * fn.dbl("net_income_ttm")))
    return rows.select(*FRAME, *rounded({"cfo_to_ni": fn.ratio("cfo_ttm", "net_income_ttm"), "accruals_ratio_pct": metrics.ttm_metrics()["accruals_ratio"] * 100}, 4))


@query(f"""SELECT entity_id, calendar_year, period_end, round(dpo, 4) AS peak_dpo_days FROM (SELECT q.*, row_number() OVER (PARTITION BY q.entity_id, q.calendar_year ORDER BY dpo DESC NULLS LAST, period_end) AS n FROM
    (SELECT entity_id, calendar_year, period_end, {_DPO} AS dpo FROM mf) q JOIN (SELECT entity_id, max(calendar_year) AS cy FROM cyq WHERE quarters_in_year = 4 GROUP BY 1) c ON c.entity_id = q.entity_id AND c.cy = q.calendar_year WHERE dpo IS NOT NULL) WHERE n = 1""")
def dpo_top_cy(spark, sf_dir):
    """The peak quarter of each entity's last complete calendar year, in one pass over the frame."""
    year, whole = Window.partitionBy("entity_id", "calendar_year"), Window.partitionBy("entity_id")
    df = frame(spark, sf_dir).select("entity_id", "calendar_year", "period_end", metrics.quarter_metrics()["dpo"].alias("dpo")).withColumn("n", F.count("*").over(year))
    df = df.withColumn("cy", F.max(F.when(F.col("n") == 4, F.col("calendar_year"))).over(whole)).where("calendar_year = cy AND dpo IS NOT NULL")
    return windows.top_per(df, ["entity_id"], [F.desc("dpo"), F.asc("period_end")]).select("entity_id", "calendar_year", "period_end", F.round("dpo", 4).alias("peak_dpo_days"))


@query(f"""SELECT entity_id, min(period_end) AS oldest, max(period_end) AS latest, {r({'largest_fcf': 'max(fcf)'}, 4)} FROM (SELECT entity_id, period_end, fcf, lag(fcf, 4) OVER (PARTITION BY entity_id ORDER BY period_end) AS prior, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n
    FROM (SELECT entity_id, period_end, cfo_ttm + capital_expenditures_ttm AS fcf FROM mf)) WHERE n <= 4 GROUP BY 1 HAVING bool_and(prior IS NOT NULL) AND bool_and(fcf > prior)""")
def fcf_consistent_growth(spark, sf_dir):
    df = frame(spark, sf_dir).select(*FRAME, (F.col("cfo_ttm") + F.col("capital_expenditures_ttm")).alias("fcf")).where("fcf IS NOT NULL")
    df = df.withColumn("prior", F.lag("fcf", 4).over(windows.ordered())).withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("period_end")))).where("n <= 4")
    out = df.groupBy("entity_id").agg(F.min("period_end").alias("oldest"), F.max("period_end").alias("latest"), F.max("fcf").alias("x"), F.every(F.coalesce(F.col("fcf") > F.col("prior"), F.lit(False))).alias("ok"))
    return out.where("ok").select("entity_id", "oldest", "latest", *rounded({"largest_fcf": F.col("x")}, 4))


@query(f"SELECT entity_id, period_end, {r({'net_debt': 'net_debt'}, 4)}, {r({'net_debt_to_ebitda': safe('net_debt', 'ebitda_ttm')})} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM mf) WHERE n = 1 AND net_debt < 0")
def net_cash(spark, sf_dir):
    rows = windows.top_per(frame(spark, sf_dir), ["entity_id"], [F.desc("period_end")]).where("net_debt < 0")
    return rows.select(*FRAME, *rounded(["net_debt"], 4), *rounded({"net_debt_to_ebitda": fn.ratio("net_debt", "ebitda_ttm")}))


@query(f"""SELECT entity_id, period_end, {r({'roic_pct': 'roic * 100', 'roic_qm3_pct': 'q3 * 100'}, 4)} FROM (SELECT entity_id, period_end, roic, lag(roic, 1) OVER w AS q1, lag(roic, 2) OVER w AS q2, lag(roic, 3) OVER w AS q3,
    row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM mf WINDOW w AS (PARTITION BY entity_id ORDER BY period_end)) WHERE n = 1 AND roic > q1 AND q1 > q2 AND q2 > q3""")
def roic_rising_4q(spark, sf_dir):
    w = windows.ordered()
    df = frame(spark, sf_dir).select(*FRAME, "roic", *[F.lag("roic", i).over(w).alias(f"q{i}") for i in (1, 2, 3)])
    rows = windows.top_per(df, ["entity_id"], [F.desc("period_end")]).where("roic > q1 AND q1 > q2 AND q2 > q3")
    return rows.select(*FRAME, *rounded({"roic_pct": F.col("roic") * 100, "roic_qm3_pct": F.col("q3") * 100}, 4))


@query(f"SELECT entity_id, period_end, {r({'roiic_pct': 'roiic * 100', 'roic_pct': 'roic * 100'}, 3)} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM mf WHERE roiic IS NOT NULL) WHERE n = 1")
def roiic_top(spark, sf_dir):
    rows = windows.top_per(frame(spark, sf_dir).where("roiic IS NOT NULL"), ["entity_id"], [F.desc("period_end")])
    return rows.select(*FRAME, *rounded({"roiic_pct": F.col("roiic") * 100, "roic_pct": F.col("roic") * 100}, 3))
