"""Trailing-window metrics.

metric_frame() adds to a wide quarterly frame every trailing sum, lag and derived level. All its windows have one
partitioning and order, so Spark sorts once; the metrics proper are expressions on the frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import D, dbl, guarded, ratio, zero_sum
from ..schemas import FLOWS
from .windows import last_n_weighted, ordered, trailing

DEBT = ["current_portion_lt_debt", "long_term_debt", "current_portion_leases_operating", "long_term_leases_operating"]
CASH = ["cash_and_equivalents", "short_term_investments"]


def metric_frame(wide: DataFrame, least_roiic_change: float = 1_000_000.0) -> DataFrame:
    """wide: a row per entity and quarter. least_roiic_change: capital changes below this are too small for ROIIC."""
    w = ordered()
    last4 = w.rowsBetween(-3, 0)
    rd_sum, rd_weighted, rd_n = last_n_weighted("rd_any_version")
    df = wide.withColumns(trailing(FLOWS) | {"rd_sum20": rd_sum, "rd_weighted20": rd_weighted, "rd_coverage": rd_n})
    df = df.withColumns({
        "rd_amortization_q": dbl("rd_sum20") / 20,
        "rd_asset_q": dbl("rd_weighted20") / 20,
        "rd_amortization_ttm": F.sum("rd_sum20").over(last4).cast(D) / 20,
        "rd_coverage_quarters": F.min("rd_coverage").over(last4),
        "tax_rate_ttm": tax_rate(),
        "reported_ic_q": dbl(zero_sum(["total_equity", *DEBT], CASH)),
        "net_debt": dbl(zero_sum(DEBT, CASH)),
    })
    df = df.withColumn("adjusted_oi_ttm", dbl("operating_income_ttm") + dbl("rd_ttm") - F.col("rd_amortization_ttm"))
    df = df.withColumns({
        "adjusted_nopat_ttm": F.when(F.col("quarters_in_window") >= 4, F.col("adjusted_oi_ttm") * (1 - F.col("tax_rate_ttm"))),
        "adjusted_ic_q": F.col("reported_ic_q") + F.col("rd_asset_q"),
        "ebitda_ttm": dbl("operating_income_ttm") + dbl("dna_cf_ttm"),
    })
    back = lambda c, n: F.lag(c, n).over(w)
    df = df.withColumns({
        "ic_prior_q": back("adjusted_ic_q", 1), "ic_prior_year": back("adjusted_ic_q", 4), "nopat_prior_year": back("adjusted_nopat_ttm", 4), "revenue_prior_q": back("revenue", 1),
        **{f"{c}_prior_year": back(c, 4) for c in ("revenue_ttm", "gross_profit_ttm", "operating_income_ttm", "accounts_receivable", "inventory", "accounts_payable", "shares_diluted_weighted_avg", "rd_asset_q", "total_equity")},
        "avg_total_assets": (F.col("total_assets") + back("total_assets", 1)).cast(D) / 2, "avg_total_equity": (F.col("total_equity") + back("total_equity", 1)).cast(D) / 2,
    })
    average_ic = (F.col("adjusted_ic_q") + F.col("ic_prior_q")) / 2
    change = F.col("adjusted_ic_q") - F.col("ic_prior_year")
    enough = F.abs(change) >= F.greatest(F.lit(least_roiic_change), F.abs("adjusted_nopat_ttm") * 0.001)
    return df.withColumns({"roic": ratio("adjusted_nopat_ttm", average_ic, positive=True), "roiic": F.when(enough & (change != 0), (F.col("adjusted_nopat_ttm") - F.col("nopat_prior_year")) / change)})


def tax_rate(fallback: float = 0.15) -> Column:
    pretax = F.col("ebt_incl_unusual_ttm")
    return F.when((F.col("quarters_in_window") < 4) | pretax.isNull(), None).when(pretax <= 0, fallback).otherwise(dbl("tax_ttm") / dbl(pretax))


def quarter_metrics() -> dict[str, Column]:
    day = lambda stock, flow: ratio(stock, flow) * 365
    dso, dio, dpo = day("accounts_receivable", "revenue_ttm"), day("inventory", "cogs_ttm"), day("accounts_payable", "cogs_ttm")
    return {
        "gross_margin": ratio("gross_profit", "revenue"), "operating_margin": ratio("operating_income", "revenue"), "net_margin": ratio("net_income", "revenue"),
        "revenue_qoq_annualized": F.pow(ratio("revenue", "revenue_prior_q", positive=True), F.lit(4.0)) - 1,
        "dso": dso, "dio": dio, "dpo": dpo, "ccc": dso + dio - dpo,
        "working_capital_intensity": ratio(F.col("accounts_receivable") + F.col("inventory") - F.col("accounts_payable"), "revenue_ttm"),
        "net_debt": F.col("net_debt"), "net_debt_to_ebitda": ratio("net_debt", "ebitda_ttm"), "interest_coverage_q": ratio("operating_income", "interest_expense"),
    }


def ttm_metrics() -> dict[str, Column]:
    """Needs employee_count beside the frame's columns for revenue_per_employee."""
    fcf = F.col("cfo_ttm") + F.col("capital_expenditures_ttm")
    working = lambda c: F.col(c) - F.col(f"{c}_prior_year")
    reinvested = (
        dbl(-F.col("capital_expenditures_ttm")) + dbl(working("accounts_receivable") + working("inventory") - working("accounts_payable"))
        + F.coalesce(dbl(-F.col("acquisitions_ttm")), F.lit(0.0)) - dbl("dna_cf_ttm") + F.coalesce("rd_asset_q", F.lit(0.0)) - F.coalesce("rd_asset_q_prior_year", F.lit(0.0))
    )
    interest = F.coalesce(F.col("cash_paid_for_interest_ttm"), F.col("interest_expense_ttm"), F.lit(0))
    return {
        "nopat_margin": ratio("adjusted_nopat_ttm", "revenue_ttm"), "cfo_to_nopat": ratio("cfo_ttm", "adjusted_nopat_ttm"), "fcf_to_nopat": ratio(fcf, "adjusted_nopat_ttm"),
        "accruals_ratio": ratio(F.col("net_income_ttm") - F.col("cfo_ttm"), "avg_total_assets"), "sbc_pct_revenue": ratio("sbc_ttm", "revenue_ttm"),
        "interest_coverage_ttm": ratio("operating_income_ttm", "interest_expense_ttm"),
        "unlevered_fcf_ttm": guarded(dbl("cfo_ttm") + dbl(interest) * (1 - F.col("tax_rate_ttm")) + dbl("capital_expenditures_ttm"), "tax_rate_ttm"),
        "reinvestment_rate": ratio(reinvested, "adjusted_nopat_ttm"),
    }


def yoy_metrics() -> dict[str, Column]:
    prior = lambda c: F.col(f"{c}_prior_year")
    growth = lambda c: ratio(F.col(c) - prior(c), prior(c), positive=True)
    incremental = lambda c: ratio(F.col(c) - prior(c), F.col("revenue_ttm") - prior("revenue_ttm"))
    shares = "shares_diluted_weighted_avg"
    return {
        "revenue_yoy_ttm": growth("revenue_ttm"), "gross_profit_yoy_ttm": growth("gross_profit_ttm"), "incremental_gross_margin": incremental("gross_profit_ttm"),
        "incremental_operating_margin": incremental("operating_income_ttm"), "diluted_share_count_growth": ratio(F.col(shares) - prior(shares), prior(shares)),
    }


FY_FLOWS = ("revenue", "cogs", "gross_profit", "operating_income", "net_income", "rd", "sbc", "cfo", "capital_expenditures", "dna_cf", "interest_expense", "cash_paid_for_interest", "acquisitions", "tax", "ebt_incl_unusual")
FY_STOCKS = ("total_assets", "total_equity", *CASH, *DEBT, "accounts_receivable", "inventory", "accounts_payable")


def fiscal_year(wide: DataFrame) -> DataFrame:
    """The annual rows of a wide frame: levels, margins, and stocks at the year's end."""
    rows = wide.where("period_type = 'annual'")
    margins = {f"{k}_fy": ratio(v, "revenue") for k, v in {"gross_margin": "gross_profit", "operating_margin": "operating_income", "net_margin": "net_income", "sbc_pct_revenue": "sbc"}.items()}
    return rows.select(
        "entity_id", "fiscal_year", "fiscal_period_label", "period_end", *[F.col(c).alias(f"{c}_fy") for c in FY_FLOWS], *[v.alias(k) for k, v in margins.items()], *[F.col(c).alias(f"{c}_fy_end") for c in FY_STOCKS], dbl(zero_sum(DEBT, CASH)).alias("net_debt_fy_end"),
    )


def calendar_year(wide: DataFrame) -> DataFrame:
    """Flows summed, stocks as of the year's last quarter (null if that quarter has none)."""
    flows = ("revenue", "gross_profit", "operating_income", "net_income", "cfo", "capital_expenditures", "sbc")
    last = lambda c: F.max_by(c, "period_end").alias(c)
    df = wide.groupBy("entity_id", "calendar_year").agg(F.count("*").alias("quarters_in_year"), F.max("period_end").alias("last_period_end"), *[F.sum(c).alias(f"{c}_cy") for c in flows], *[last(c) for c in ("total_assets", "total_equity", *DEBT, *CASH)])
    return df.select(
        "entity_id", "calendar_year", "quarters_in_year", "last_period_end", *[f"{c}_cy" for c in flows], ratio("gross_profit_cy", "revenue_cy").alias("gross_margin_cy"), ratio("operating_income_cy", "revenue_cy").alias("operating_margin_cy"),
        ratio("net_income_cy", "revenue_cy").alias("net_margin_cy"), ratio("sbc_cy", "revenue_cy").alias("sbc_pct_revenue_cy"), F.col("total_assets").alias("total_assets_cy_end"), F.col("total_equity").alias("total_equity_cy_end"), dbl(zero_sum(DEBT, CASH)).alias("net_debt_cy_end"),
    )


def pit_ttm(pit: DataFrame) -> DataFrame:
    """Trailing sums over the point-in-time pivot, the latest stocks passed through."""
    flows = ("net_income", "revenue", "operating_income", "dna_cf", "cfo", "capital_expenditures")
    df = pit.withColumns(trailing(flows))
    ebitda, fcf = F.col("operating_income_ttm") + F.col("dna_cf_ttm"), F.col("cfo_ttm") - F.abs("capital_expenditures_ttm")
    return df.select("entity_id", "period_end", "asof_date", *[f"{c}_ttm" for c in flows], ebitda.alias("ebitda_ttm"), fcf.alias("fcf_ttm"), "long_term_debt", "current_portion_lt_debt", "noncontrolling_interest", *CASH, "quarters_in_window")


def valuation_percentile(valued: DataFrame, ratios: Sequence[str] = ("pe_ttm", "ps_ttm", "ev_ebitda_ttm", "fcf_yield_ttm"), days: int = 5 * 365) -> DataFrame:
    """Each entity's last day with its ratios and the share of the days before, within a window, that were below; days without the first ratio don't count.

    valued: entity_id, date and the ratios. The last day's row is one per entity, so it meets the history in one join.
    """
    last = valued.groupBy("entity_id").agg(F.max("date").alias("as_of"), *[F.max_by(r, "date").alias(f"now_{r}") for r in ratios])
    window = valued.where(F.col(ratios[0]).isNotNull()).join(last, "entity_id").where(F.col("date") >= F.date_sub("as_of", days))
    first, low = ratios[0], lambda r: F.count_if(F.col(r) < F.col(f"now_{r}")) / F.count("*")
    sums = window.groupBy("entity_id").agg(F.count("*").alias("n_samples"), F.min(first).alias(f"min_{first}"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {first})").alias(f"median_{first}"), F.max(first).alias(f"max_{first}"), *[low(r).alias(f"below_{r}") for r in ratios])
    rows = last.join(sums, "entity_id", "left")
    return rows.select("entity_id", "as_of", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), *[f"{x}_{first}" for x in ("min", "median", "max")], *[F.when(F.col(f"now_{r}").isNotNull(), F.col(f"below_{r}")).alias(f"below_{r}") for r in ratios])


def valuation_ratios() -> dict[str, Column]:
    """On daily rows with market_cap and the trailing sums known that day; none without four quarters."""
    cap, full = dbl("market_cap"), F.coalesce(F.col("quarters_in_window") >= 4, F.lit(False))
    ev = cap + dbl(zero_sum(["long_term_debt", "current_portion_lt_debt", "noncontrolling_interest"], CASH))
    return {
        "ev": ev, "pe_ttm": F.when(full, ratio(cap, "net_income_ttm", positive=True)), "ps_ttm": F.when(full, ratio(cap, "revenue_ttm")),
        "ev_ebitda_ttm": F.when(full, ratio(ev, "ebitda_ttm", positive=True)), "fcf_yield_ttm": F.when(full, ratio("fcf_ttm", cap)),
    }
