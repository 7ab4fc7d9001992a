"""The period grammar and the metric registry of screens and metric reads. Pure Python; nothing here touches data."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date


class PeriodError(ValueError):
    """A period that isn't understood, or that a metric can't be read at."""


@dataclass(frozen=True)
class Period:
    """kind: latest, fy, fq, window, next, forward or asof."""

    kind: str
    year: int | None = None
    quarter: int | None = None
    n: int | None = None
    unit: str | None = None  # q or y
    how: str | None = None  # avg or sum
    day: date | None = None


_FORMS: list[tuple[re.Pattern, object]] = [
    (re.compile(r"latest"), lambda m: Period("latest")),
    (re.compile(r"FY(\d{4})"), lambda m: Period("fy", year=int(m[1]))),
    (re.compile(r"(\d{4})-Q([1-4])"), lambda m: Period("fq", year=int(m[1]), quarter=int(m[2]))),
    (re.compile(r"last_(\d+)(q|y)(?:_(avg|sum))?"), lambda m: Period("window", n=int(m[1]), unit=m[2], how=m[3] or "avg")),
    (re.compile(r"next(?:_(q|fy))?"), lambda m: Period("next", n=1, unit={"q": "q", "fy": "y", None: None}[m[1]])),
    (re.compile(r"forward_(\d+)(q|y)(?:_(avg|sum))?"), lambda m: Period("forward", n=int(m[1]), unit=m[2], how=m[3] or "avg")),
    (re.compile(r"asof:(\d{4})-(\d{2})-(\d{2})"), lambda m: Period("asof", day=date(int(m[1]), int(m[2]), int(m[3])))),
]


def parse_period(text: str) -> Period:
    for form, make in _FORMS:
        if m := form.fullmatch(text.strip()):
            try:
                out = make(m)
            except ValueError as e:
                raise PeriodError(f"{text!r}: {e}") from e
            if out.n is not None and not 1 <= out.n <= 40:
                raise PeriodError(f"{text!r}: a window has 1 to 40 periods")
            return out
    raise PeriodError(f"unknown period {text!r}")


def supports(period: Period, agg: str) -> bool:
    """level goes with any period; delta and relative_change need a window of three or more."""
    return agg == "level" or (agg in ("delta", "relative_change") and period.kind in ("window", "forward") and (period.n or 0) >= 3)


@dataclass(frozen=True)
class Metric:
    """vertical: financials, estimates or valuation; grain: q or y; value: an expression on the vertical's frame."""

    name: str
    vertical: str
    value: str
    grain: str = "q"


METRICS: dict[str, Metric] = {}


def metric(name: str, vertical: str, value: str, grain: str = "q") -> None:
    if name in METRICS:
        raise ValueError(f"metric {name} exists")
    METRICS[name] = Metric(name, vertical, value, grain)


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} <> 0 THEN cast({num} as double) / cast({den} as double) END"


#: The fiscal year's columns by the metric's name.
ANNUAL = {
    "revenue": "revenue_fy", "gross_margin": "gross_margin_fy", "operating_margin": "operating_margin_fy", "net_margin": "net_margin_fy", "fcf": "cfo_fy + capital_expenditures_fy", "cfo": "cfo_fy", "net_income": "net_income_fy", "operating_income": "operating_income_fy", "rd": "rd_fy",
    "sbc_pct_revenue": "sbc_pct_revenue_fy",
}
for _name, _value in ANNUAL.items():
    metric(_name, "financials", f"cast({_value} as double)", "y")


def _growth(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN cast({now} - {before} as double) / cast({before} as double) END"


_REINVESTED = (
    "cast(-capital_expenditures_ttm as double) + cast((accounts_receivable - accounts_receivable_prior_year) + (inventory - inventory_prior_year) - (accounts_payable - accounts_payable_prior_year) as double)"
    " + coalesce(cast(-acquisitions_ttm as double), 0) - cast(dna_cf_ttm as double) + coalesce(rd_asset_q, 0) - coalesce(rd_asset_q_prior_year, 0)"
)
for _name, _value in {
    "revenue_growth_yoy": _growth("revenue_ttm", "revenue_ttm_prior_year"), "gross_profit_growth_yoy": _growth("gross_profit_ttm", "gross_profit_ttm_prior_year"),
    "incremental_gross_margin": _ratio("gross_profit_ttm - gross_profit_ttm_prior_year", "(revenue_ttm - revenue_ttm_prior_year)"), "incremental_operating_margin": _ratio("operating_income_ttm - operating_income_ttm_prior_year", "(revenue_ttm - revenue_ttm_prior_year)"),
    "interest_coverage_ttm": _ratio("operating_income_ttm", "interest_expense_ttm"), "reinvestment_rate": f"CASE WHEN adjusted_nopat_ttm <> 0 THEN ({_REINVESTED}) / adjusted_nopat_ttm END",
    "revenue_ttm": "cast(revenue_ttm as double)", "gross_profit_ttm": "cast(gross_profit_ttm as double)", "operating_income_ttm": "cast(operating_income_ttm as double)", "net_income_ttm": "cast(net_income_ttm as double)", "cfo_ttm": "cast(cfo_ttm as double)",
    "fcf_ttm": "cast(cfo_ttm + capital_expenditures_ttm as double)", "gross_margin_q": _ratio("gross_profit", "revenue"), "operating_margin_q": _ratio("operating_income", "revenue"), "net_margin_q": _ratio("net_income", "revenue"), "roic": "roic", "roiic": "roiic",
    "net_debt": "net_debt", "net_debt_to_ebitda": _ratio("net_debt", "ebitda_ttm"), "dso": f"365 * ({_ratio('accounts_receivable', 'revenue_ttm')})", "dio": f"365 * ({_ratio('inventory', 'cogs_ttm')})", "dpo": f"365 * ({_ratio('accounts_payable', 'cogs_ttm')})",
    "nopat_margin": _ratio("adjusted_nopat_ttm", "revenue_ttm"), "accruals_ratio": _ratio("net_income_ttm - cfo_ttm", "avg_total_assets"), "revenue_yoy_ttm": _ratio("revenue_ttm - revenue_ttm_prior_year", "revenue_ttm_prior_year"), "sbc_pct_revenue_ttm": _ratio("sbc_ttm", "revenue_ttm"),
}.items():
    metric(_name, "financials", _value)
metric("gross_profit", "financials", "cast(gross_profit_fy as double)", "y")
#: Consensus values, and the metrics of their growth against the same periods a year before.
CONSENSUS = ("revenue_avg", "ebitda_avg", "ebit_avg", "net_income_avg", "eps_avg")
GROWTH = {f"{_name.removesuffix('_avg')}_growth": _name for _name in CONSENSUS}
for _name in CONSENSUS:
    metric(_name, "estimates", _name)
for _name, _value in GROWTH.items():
    metric(_name, "estimates", _value)
for _name in ("ev", "pe_ttm", "ps_ttm", "ev_ebitda_ttm", "fcf_yield_ttm", "market_cap"):
    metric(_name, "valuation", f"cast({_name} as double)", "d")


def find_metric(name: str) -> Metric:
    if name not in METRICS:
        raise PeriodError(f"unknown metric {name!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name]


def quarter_concepts(metric_: Metric, concepts: tuple[str, ...]) -> list[str] | None:
    """The concepts that a metric's value reads, where it is one row's alone; None where it needs windows or derived columns."""
    names = set(re.findall(r"[a-z_]+[a-z]", metric_.value.lower())) - {"case", "when", "then", "end", "cast", "as", "double", "coalesce"}
    return sorted(names) if names <= set(concepts) else None


def check(metric_: Metric, period: Period, agg: str) -> None:
    """Raises where a metric can't be read at a period."""
    if not supports(period, agg):
        raise PeriodError(f"{agg} needs a window of three or more periods")
    allowed = {"financials": {"latest", "fy", "fq", "window"}, "estimates": {"next", "forward"}, "valuation": {"latest", "asof"}}[metric_.vertical]
    if period.kind not in allowed:
        raise PeriodError(f"{metric_.name} is read at {', '.join(sorted(allowed))}, not {period.kind}")
    if metric_.vertical == "financials" and ((metric_.grain == "y" and (period.kind == "fq" or period.unit == "q")) or (metric_.grain == "q" and period.unit == "y")):
        raise PeriodError(f"{metric_.name} has another grain than the period")
