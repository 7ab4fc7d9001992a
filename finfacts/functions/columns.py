"""Column expressions: guarded ratios, period derivation, hashes, term counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "double"


def dbl(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(D)


def ratio(num: str | Column, den: str | Column, positive: bool = False) -> Column:
    """num / den as double; null where den is null or 0 (or, if positive, not above 0)."""
    n, d = dbl(num), dbl(den)
    return F.when(d > 0 if positive else d != 0, n / d)


def zero_sum(plus: list[str], minus: list[str] = ()) -> Column:
    """Sum with missing parts as 0."""
    total = F.lit(0).cast("decimal(38,4)")
    for c in plus:
        total = total + F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)")
    for c in minus:
        total = total - F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,4)")
    return total


def guarded(value: Column, *required: str | Column) -> Column:
    """value where nothing required is null."""
    ok = F.lit(True)
    for r in required:
        ok = ok & (F.col(r) if isinstance(r, str) else r).isNotNull()
    return F.when(ok, value)


def relative_change(now: Column, before: Column, absolute_base: bool = False) -> Column:
    base = F.abs(before) if absolute_base else before
    return F.when(before != 0, (now - before) / base)


def calendar_period(end: Column) -> tuple[Column, Column, Column]:
    """Year, quarter, label of a period's end."""
    return F.year(end), F.quarter(end), F.format_string("CY%d Q%d", F.year(end), F.quarter(end))


def fiscal_period(end: Column, anchor_md: Column, period_type: Column, drift_days: int = 7) -> tuple[Column, Column, Column]:
    """Fiscal year, quarter (null unless a quarter), label. The end is moved back by drift_days first: 52/53-week years end around the anchor."""
    at = F.date_sub(end, drift_days)
    month, day = F.substring(anchor_md, 1, 2).cast("int"), F.substring(anchor_md, 4, 2).cast("int")
    after = (F.month(at) > month) | ((F.month(at) == month) & (F.dayofmonth(at) > day))
    year = F.year(at) + after.cast("int")
    start = F.pmod(month, F.lit(12)) + 1
    quarter = F.when(period_type == "quarter", (F.floor(F.pmod(F.month(at) - start, F.lit(12)) / 3) + 1).cast("int"))
    label = F.when(quarter.isNull(), F.format_string("FY%d", year)).otherwise(F.format_string("FY%d Q%d", year, quarter))
    return year, quarter, label


def source_rank(version: Column, ranks: dict[str, int], default: int = 9) -> Column:
    """The rank of a version by its prefix; lower is better."""
    out = F.lit(default)
    for prefix, rank in reversed(ranks.items()):
        out = F.when(version.startswith(prefix), rank).otherwise(out)
    return out


def fingerprint(check: str, scope: dict[str, Column], params: dict[str, Column] | None = None) -> Column:
    """SHA-256 of canonical JSON: keys in order, null values left out."""
    def part(values: dict[str, Column]) -> Column:
        return F.to_json(F.struct(*[values[k].cast("string").alias(k) for k in sorted(values)])) if values else F.lit("{}")

    return F.sha2(F.concat(F.lit(f'{{"check":"{check}","params":'), part(params or {}), F.lit(',"scope":'), part(scope), F.lit("}")), 256)


def term_count(text: Column, term: str) -> Column:
    """Whole-word occurrences, in any case."""
    return F.regexp_count(text, F.lit(rf"(?i)(?<!\w){re.escape(term)}(?!\w)"))


def drift_severity(share: Column) -> Column:
    return F.when(share < 0.01, "informational").when(share < 0.10, "warning").otherwise("investigate")


def tolerance(reference: Column, absolute: float, relative: float) -> Column:
    return F.greatest(F.lit(absolute), F.abs(reference) * relative)
