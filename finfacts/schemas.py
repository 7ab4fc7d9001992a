"""The data model: explicit schemas, concepts and row-level expectations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(28, 4)


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """A schema of `name TYPE` pairs; needs no session, unlike fromDDL."""
    out = T.StructType()
    for name, kind in re.findall(r"(\w+) ([A-Z]+(?:\([0-9,]+\)|<[A-Z]+>)?)", spec):
        out = out.add(name, T.DecimalType(*map(int, re.findall("[0-9]+", kind))) if kind.startswith("DECIMAL") else _TYPES[kind])
    return out


FACTS = _struct(
    "id BIGINT, entity_id BIGINT, statement STRING, concept STRING, value DECIMAL(28,4), unit STRING, fiscal_year INT, fiscal_quarter INT, "
    "fiscal_period_label STRING, period_end DATE, period_type STRING, calendar_year INT, calendar_quarter INT, calendar_period_label STRING, "
    "published_at TIMESTAMP, superseded_at TIMESTAMP, extraction_version STRING, dimension_type STRING, dimension_key STRING, dimension_label STRING, "
    "dimension_source STRING, supersedes_fact_id BIGINT, supersession_reason STRING"
)
ENTITIES = _struct("entity_id BIGINT, ticker STRING, fiscal_year_end_md STRING, status STRING")
PRICES = _struct("security_id BIGINT, date DATE, close DECIMAL(18,6), adj_close DECIMAL(18,6), volume BIGINT")
MARKET_CAPS = _struct("security_id BIGINT, date DATE, market_cap DECIMAL(28,2)")
ESTIMATES = _struct("security_id BIGINT, period_kind STRING, period_end DATE, revenue_avg DOUBLE, ebit_avg DOUBLE, net_income_avg DOUBLE, eps_avg DOUBLE")
FINDINGS = _struct("fingerprint STRING, source_check STRING, severity STRING, entity_id BIGINT, summary STRING, status STRING, created_at TIMESTAMP, last_seen_at TIMESTAMP, suppressed_until TIMESTAMP, closed_reason STRING, history ARRAY<STRING>")

#: Flow concepts that trailing windows sum.
FLOWS = ("revenue", "cogs", "gross_profit", "rd", "operating_income", "interest_expense", "ebt_incl_unusual", "tax", "net_income", "cfo", "capital_expenditures", "dna_cf", "sbc", "cash_paid_for_interest", "acquisitions")
#: Balance-sheet concepts.
STOCKS = ("total_assets", "total_equity", "current_portion_lt_debt", "long_term_debt", "current_portion_leases_operating", "long_term_leases_operating", "cash_and_equivalents", "short_term_investments", "accounts_receivable", "inventory", "accounts_payable", "noncontrolling_interest")
COUNTS = ("shares_diluted_weighted_avg",)
CONCEPTS = FLOWS + STOCKS + COUNTS


def fact_expectations() -> dict[str, Column]:
    """Row-level contracts of a fact; a row that breaks one gives false."""
    c, dims = F.col, [F.col(f"dimension_{x}") for x in ("type", "key", "label", "source")]
    all_set, none_set = dims[0].isNotNull(), dims[0].isNull()
    for d in dims[1:]:
        all_set, none_set = all_set & d.isNotNull(), none_set & d.isNull()
    return {
        "fiscal_label": c("fiscal_period_label").rlike("^FY[0-9]{4}( Q[1-4])?$"),
        "calendar_label": c("calendar_period_label").rlike("^CY[0-9]{4} Q[1-4]$"),
        "quarter_iff": (c("period_type") == "quarter").eqNullSafe(c("fiscal_quarter").isNotNull()) | (c("period_type") == "stub"),
        "segment_iff": F.when(c("statement") == "segment", all_set).otherwise(none_set),
        "dimension_slug": c("dimension_key").isNull() | c("dimension_key").rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"),
        "supersession": c("superseded_at").isNull() | (c("superseded_at") >= c("published_at")),
    }


def violations(df: DataFrame, expectations: dict[str, Column]) -> DataFrame:
    """Rows of (expectation, rows that break it)."""
    told = df.agg(*[F.count_if(~F.coalesce(e, F.lit(False))).alias(k) for k, e in expectations.items()])
    return told.select(F.explode(F.array(*[F.struct(F.lit(k).alias("expectation"), F.col(k).alias("violations")) for k in expectations])).alias("x")).select("x.*")
