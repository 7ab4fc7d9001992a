"""Vendor payloads as facts: explicit field maps, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import calendar_period, fiscal_period
from ..operators.facts import unpivot
from ..operators.verify import broken_ties

# Which fields of the vendor's statements make up a concept.
INCOME_STATEMENT = {
    "revenue": ["revenue"], "cogs": ["costOfRevenue"], "gross_profit": ["grossProfit"], "rd": ["researchAndDevelopmentExpenses"], "general_and_admin_expense": ["generalAndAdministrativeExpenses"],
    "selling_and_marketing_expense": ["sellingAndMarketingExpenses"], "sga": ["sellingGeneralAndAdministrativeExpenses"], "total_opex": ["operatingExpenses"], "operating_income": ["operatingIncome"],
    "interest_expense": ["interestExpense"], "interest_income": ["interestIncome"], "ebt_incl_unusual": ["incomeBeforeTax"], "tax": ["incomeTaxExpense"], "continuing_ops_after_tax": ["netIncomeFromContinuingOperations"],
    "discontinued_ops": ["netIncomeFromDiscontinuedOperations"], "net_income_attributable_to_parent": ["netIncome"], "eps_basic": ["eps"], "eps_diluted": ["epsDiluted"],
    "shares_basic_weighted_avg": ["weightedAverageShsOut"], "shares_diluted_weighted_avg": ["weightedAverageShsOutDil"],
}
BALANCE_SHEET = {
    "cash_and_equivalents": ["cashAndCashEquivalents"], "short_term_investments": ["shortTermInvestments"], "accounts_receivable": ["accountsReceivables"], "other_receivables": ["otherReceivables"], "inventory": ["inventory"],
    "prepaid_expenses": ["prepaids"], "other_current_assets": ["otherCurrentAssets"], "total_current_assets": ["totalCurrentAssets"], "net_ppe": ["propertyPlantEquipmentNet"], "long_term_investments": ["longTermInvestments"],
    "goodwill": ["goodwill"], "other_intangibles": ["intangibleAssets"], "deferred_tax_assets_noncurrent": ["taxAssets"], "other_noncurrent_assets": ["otherNonCurrentAssets"], "total_assets": ["totalAssets"],
    "accounts_payable": ["accountPayables", "otherPayables"], "accrued_expenses": ["accruedExpenses"], "current_portion_lt_debt": ["shortTermDebt"], "current_portion_leases_operating": ["capitalLeaseObligationsCurrent"],
    "deferred_revenue_current": ["deferredRevenue"], "income_taxes_payable_current": ["taxPayables"], "other_current_liabilities": ["otherCurrentLiabilities"], "total_current_liabilities": ["totalCurrentLiabilities"],
    "long_term_debt": ["longTermDebt"], "long_term_leases_operating": ["capitalLeaseObligationsNonCurrent"], "deferred_revenue_noncurrent": ["deferredRevenueNonCurrent"], "deferred_tax_liability_noncurrent": ["deferredTaxLiabilitiesNonCurrent"],
    "other_noncurrent_liabilities": ["otherNonCurrentLiabilities"], "total_liabilities": ["totalLiabilities"], "preferred_stock": ["preferredStock"], "common_stock": ["commonStock"], "additional_paid_in_capital": ["additionalPaidInCapital"],
    "retained_earnings": ["retainedEarnings"], "treasury_stock": ["treasuryStock"], "accumulated_other_comprehensive_income": ["accumulatedOtherComprehensiveIncomeLoss"], "other_equity": ["otherTotalStockholdersEquity"],
    "noncontrolling_interest": ["minorityInterest"], "total_equity": ["totalEquity"], "total_liabilities_and_equity": ["totalLiabilitiesAndTotalEquity"],
}
CASH_FLOW = {
    "net_income_start": ["netIncome"], "dna_cf": ["depreciationAndAmortization"], "sbc": ["stockBasedCompensation"], "deferred_income_tax": ["deferredIncomeTax"], "other_noncash": ["otherNonCashItems"],
    "change_accounts_receivable": ["accountsReceivables"], "change_inventory": ["inventory"], "change_accounts_payable": ["accountsPayables"], "change_other_working_capital": ["otherWorkingCapital"], "cfo": ["netCashProvidedByOperatingActivities"],
    "capital_expenditures": ["investmentsInPropertyPlantAndEquipment"], "acquisitions": ["acquisitionsNet"], "purchases_of_investments": ["purchasesOfInvestments"], "sales_of_investments": ["salesMaturitiesOfInvestments"],
    "other_investing": ["otherInvestingActivities"], "cfi": ["netCashProvidedByInvestingActivities"], "short_term_debt_issuance": ["shortTermNetDebtIssuance"], "long_term_debt_issuance": ["longTermNetDebtIssuance"],
    "stock_issuance": ["commonStockIssuance", "netPreferredStockIssuance"], "stock_repurchase": ["commonStockRepurchased"], "common_dividends_paid": ["commonDividendsPaid"], "preferred_dividends_paid": ["preferredDividendsPaid"],
    "other_financing": ["otherFinancingActivities"], "cff": ["netCashProvidedByFinancingActivities"], "fx_effect_on_cash": ["effectOfForexChangesOnCash"], "net_change_in_cash": ["netChangeInCash"],
    "cash_begin_of_period": ["cashAtBeginningOfPeriod"], "cash_end_of_period": ["cashAtEndOfPeriod"], "cash_paid_for_interest": ["interestPaid"],
}
STATEMENTS = {"income_statement": INCOME_STATEMENT, "balance_sheet": BALANCE_SHEET, "cash_flow": CASH_FLOW}
UNITS = {"eps_basic": "USD/share", "eps_diluted": "USD/share", "shares_basic_weighted_avg": "shares", "shares_diluted_weighted_avg": "shares"}
# US-GAAP tags by concept, the preferred first; units are USD but for amounts per share and numbers of shares (UNITS).
XBRL_TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "cogs": ["CostOfRevenue", "CostOfGoodsAndServicesSold"],
    "gross_profit": ["GrossProfit"],
    "rd": ["ResearchAndDevelopmentExpense"],
    "sga": ["SellingGeneralAndAdministrativeExpense"],
    "total_opex": ["OperatingExpenses", "CostsAndExpenses"],
    "operating_income": ["OperatingIncomeLoss"],
    "interest_expense": ["InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt"],
    "interest_income": ["InvestmentIncomeInterest", "InterestIncomeOperating", "InterestIncomeNonoperating", "InvestmentIncomeInterestAndDividend"],
    "ebt_incl_unusual": ["IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"],
    "tax": ["IncomeTaxExpenseBenefit"],
    "continuing_ops_after_tax": ["IncomeLossFromContinuingOperations", "ProfitLoss", "NetIncomeLoss"],
    "discontinued_ops": ["IncomeLossFromDiscontinuedOperationsNetOfTax"],
    "net_income": ["ProfitLoss", "NetIncomeLoss"],
    "net_income_attributable_to_parent": ["NetIncomeLoss"],
    "minority_interest": ["NetIncomeLossAttributableToNoncontrollingInterest"],
    "eps_basic": ["EarningsPerShareBasic"],
    "eps_diluted": ["EarningsPerShareDiluted"],
    "shares_basic_weighted_avg": ["WeightedAverageNumberOfSharesOutstandingBasic"],
    "shares_diluted_weighted_avg": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue"],
    "short_term_investments": ["MarketableSecuritiesCurrent"],
    "accounts_receivable": ["AccountsReceivableNetCurrent"],
    "other_receivables": ["OtherReceivablesNetCurrent", "NotesAndLoansReceivableNetCurrent"],
    "inventory": ["InventoryNet"],
    "prepaid_expenses": ["PrepaidExpenseCurrent"],
    "other_current_assets": ["OtherAssetsCurrent"],
    "total_current_assets": ["AssetsCurrent"],
    "net_ppe": ["PropertyPlantAndEquipmentNet"],
    "long_term_investments": ["MarketableSecuritiesNoncurrent"],
    "goodwill": ["Goodwill"],
    "other_intangibles": ["IntangibleAssetsNetExcludingGoodwill"],
    "deferred_tax_assets_noncurrent": ["DeferredTaxAssetsNet"],
    "other_noncurrent_assets": ["OtherAssetsNoncurrent"],
    "total_assets": ["Assets"],
    "accounts_payable": ["AccountsPayableCurrent"],
    "accrued_expenses": ["AccruedLiabilitiesCurrent"],
    "current_portion_lt_debt": ["LongTermDebtCurrent"],
    "current_portion_leases_operating": ["OperatingLeaseLiabilityCurrent"],
    "income_taxes_payable_current": ["AccruedIncomeTaxesCurrent"],
    "deferred_revenue_current": ["ContractWithCustomerLiabilityCurrent"],
    "other_current_liabilities": ["OtherLiabilitiesCurrent"],
    "total_current_liabilities": ["LiabilitiesCurrent"],
    "long_term_debt": ["LongTermDebtNoncurrent"],
    "long_term_leases_operating": ["OperatingLeaseLiabilityNoncurrent"],
    "deferred_revenue_noncurrent": ["ContractWithCustomerLiabilityNoncurrent"],
    "deferred_tax_liability_noncurrent": ["DeferredIncomeTaxLiabilitiesNet"],
    "other_noncurrent_liabilities": ["OtherLiabilitiesNoncurrent"],
    "total_liabilities": ["Liabilities"],
    "preferred_stock": ["PreferredStockValue"],
    "common_stock": ["CommonStockValue"],
    "additional_paid_in_capital": ["AdditionalPaidInCapital"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "treasury_stock": ["TreasuryStockValue"],
    "accumulated_other_comprehensive_income": ["AccumulatedOtherComprehensiveIncomeLossNetOfTax"],
    "noncontrolling_interest": ["MinorityInterest"],
    "total_equity": ["StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity"],
    "total_liabilities_and_equity": ["LiabilitiesAndStockholdersEquity"],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities"],
    "cfi": ["NetCashProvidedByUsedInInvestingActivities"],
    "cff": ["NetCashProvidedByUsedInFinancingActivities"],
    "net_income_start": ["ProfitLoss", "NetIncomeLoss"],
    "capital_expenditures": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements", "PaymentsToAcquireProductiveAssets"],
}

HEADER = {"symbol": "STRING", "date": "DATE", "period": "STRING", "fiscalYear": "STRING", "filingDate": "DATE", "acceptedDate": "TIMESTAMP"}
_KINDS = {"STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def payload_schema(statement: str) -> T.StructType:
    """The schema of a statement's rows; numbers are decimals."""
    out = T.StructType([T.StructField(k, _KINDS[v]) for k, v in HEADER.items()])
    for field in sorted({f for parts in STATEMENTS[statement].values() for f in parts}):
        out = out.add(field, T.DecimalType(28, 4))
    return out


def read_statement(spark: SparkSession, path: str, statement: str) -> DataFrame:
    """JSON files of a statement: arrays or lines of rows."""
    return spark.read.schema(payload_schema(statement)).option("multiLine", True).json(path)


def with_net_income(long: DataFrame, keys: list[str]) -> DataFrame:
    """Adds net income (continuing and discontinued) and the minority's share of it.

    Where both parts are 0 but the parent's income isn't, the split is missing: the parent's income counts, no minority.
    """
    parts = ["continuing_ops_after_tax", "discontinued_ops", "net_income_attributable_to_parent"]
    c, d, parent = (F.expr(f"max(value) FILTER (WHERE concept = '{p}')") for p in parts)
    sums = long.where(F.col("concept").isin(parts)).groupBy(*keys).agg(c.alias("c"), d.alias("d"), parent.alias("parent")).where("c IS NOT NULL AND d IS NOT NULL").withColumn("total", F.col("c") + F.col("d"))
    unsplit = (F.col("total") == 0) & F.coalesce(F.col("parent") != 0, F.lit(False))
    rows = F.array(F.struct(F.lit("net_income").alias("concept"), F.when(unsplit, F.col("parent")).otherwise(F.col("total")).alias("value")), F.struct(F.lit("minority_interest").alias("concept"), F.when(~unsplit, F.col("total") - F.col("parent")).alias("value")))
    new = sums.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.concept", F.col("x.value").cast("decimal(28,4)").alias("value")).where("value IS NOT NULL")
    return long.unionByName(new)


def statement_facts(rows: DataFrame, entities: DataFrame, statement: str, version: str, since: Column | None = None) -> DataFrame:
    """Facts of vendor rows, with a flag where the vendor's fiscal year isn't the derived one.

    Columns: entity_id, statement, concept, value, unit, fiscal and calendar period, period_end, period_type, published_at, extraction_version,
    fiscal_year_mismatch. entities: entity_id, ticker, fiscal_year_end_md.
    """
    known = rows.join(entities.select("entity_id", "ticker", "fiscal_year_end_md"), F.col("symbol") == F.col("ticker"))
    known = known.withColumn("period_type", F.when(F.col("period") == "FY", "annual").otherwise("quarter")).withColumnRenamed("date", "period_end")
    if since is not None:
        known = known.where(F.col("period_end") >= since)
    keys = ["entity_id", "period_end", "period_type", "fiscal_year_end_md", "fiscalYear", "published_at"]
    known = known.withColumn("published_at", F.coalesce("acceptedDate", F.col("filingDate").cast("timestamp"), F.col("period_end").cast("timestamp")))
    long = unpivot(known, keys, STATEMENTS[statement])
    if statement == "income_statement":
        long = with_net_income(long, keys)
    fy, fq, fl = fiscal_period(F.col("period_end"), F.col("fiscal_year_end_md"), F.col("period_type"))
    cy, cq, cl = calendar_period(F.col("period_end"))
    unit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.col("concept")), F.lit("USD"))
    return long.select(
        "entity_id", F.lit(statement).alias("statement"), "concept", "value", unit.alias("unit"), fy.alias("fiscal_year"), fq.alias("fiscal_quarter"), fl.alias("fiscal_period_label"), "period_end", "period_type", cy.alias("calendar_year"), cq.alias("calendar_quarter"),
        cl.alias("calendar_period_label"), "published_at", F.lit(version).alias("extraction_version"), (F.col("fiscalYear").cast("int") != fy).alias("fiscal_year_mismatch"),
    )


SEGMENTS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), T.StructField("period", T.StringType()), T.StructField("fiscalYear", T.StringType()), T.StructField("data", T.MapType(T.StringType(), T.DecimalType(28, 4)))])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a label -> value map; operators.facts.explode_segments takes them on."""
    return spark.read.schema(SEGMENTS).option("multiLine", True).json(path)


_D, _S, _N, _T = "date", "string", "decimal(28,4)", "timestamp"
#: Feeds beside the statements. The vendor's field, what it is called here and its type.
FEEDS: dict[str, list[tuple[str, str, str]]] = {
    "estimates": [("symbol", "ticker", _S), ("date", "period_end", _D), *[(f"{v}{k.capitalize()}", f"{n}_{k}", _N) for v, n in (("revenue", "revenue"), ("ebitda", "ebitda"), ("ebit", "ebit"), ("netIncome", "net_income"), ("eps", "eps")) for k in ("low", "avg", "high")], ("numAnalystsRevenue", "analysts_revenue", "int"), ("numAnalystsEps", "analysts_eps", "int")],
    "price_targets": [("symbol", "ticker", _S), ("targetHigh", "target_high", _N), ("targetLow", "target_low", _N), ("targetConsensus", "target_consensus", _N), ("targetMedian", "target_median", _N)],
    "earnings": [("symbol", "ticker", _S), ("date", "date", _D), ("epsActual", "eps_actual", _N), ("epsEstimated", "eps_estimated", _N), ("revenueActual", "revenue_actual", _N), ("revenueEstimated", "revenue_estimated", _N), ("lastUpdated", "updated_on", _D)],
    "grades": [("symbol", "ticker", _S), ("date", "date", _D), ("gradingCompany", "grading_company", _S), ("previousGrade", "previous_grade", _S), ("newGrade", "new_grade", _S), ("action", "action", _S)],
    "target_news": [("symbol", "ticker", _S), ("publishedDate", "published_at", _T), ("analystName", "analyst", _S), ("analystCompany", "analyst_company", _S), ("priceTarget", "price_target", _N), ("adjPriceTarget", "adjusted_target", _N), ("priceWhenPosted", "price_when_posted", _N), ("newsTitle", "title", _S), ("newsURL", "url", _S)],
    "prices": [("symbol", "ticker", _S), ("date", "date", _D), ("open", "open", "decimal(18,6)"), ("high", "high", "decimal(18,6)"), ("low", "low", "decimal(18,6)"), ("close", "close", "decimal(18,6)"), ("volume", "volume", "bigint")],
    "adjusted_prices": [("symbol", "ticker", _S), ("date", "date", _D), ("adjClose", "adj_close", "decimal(18,6)"), ("volume", "volume", "bigint")],
    "market_caps": [("symbol", "ticker", _S), ("date", "date", _D), ("marketCap", "market_cap", "decimal(28,2)")],
    "employees": [("symbol", "ticker", _S), ("formType", "form_type", _S), ("periodOfReport", "period_of_report", _D), ("employeeCount", "employee_count", "bigint"), ("acceptanceTime", "published_at", _T), ("filingDate", "filed_on", _D)],
    "transcripts": [("symbol", "ticker", _S), ("year", "fiscal_year", "int"), ("period", "period", _S), ("date", "date", _D), ("content", "content", _S)],
}


def read_feed(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """JSON files of a feed, arrays or lines of rows, with the names of this library. Rows without a ticker or with a broken value are left out."""
    schema = ", ".join(f"`{v}` {kind}" for v, _, kind in FEEDS[feed])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    rows = rows.select(*[F.col(f"`{v}`").alias(n) for v, n, _ in FEEDS[feed]]).where("ticker IS NOT NULL").withColumn("ticker", F.upper("ticker"))
    if feed == "employees":
        return rows.withColumn("published_at", F.coalesce("published_at", F.col("filed_on").cast("timestamp"), F.col("period_of_report").cast("timestamp")))
    if feed == "transcripts":  # period is Q1 to Q4
        return rows.withColumn("fiscal_quarter", F.nullif(F.regexp_extract("period", "Q([1-4])", 1), F.lit("")).cast("int")).where("trim(content) <> ''")
    return rows


def latest_snapshots(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Of each key the row that was fetched last."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), at).alias("x")).select(*keys, "x.*")


def load_statement(rows: DataFrame, entities: DataFrame, statement: str, version: str, ties: list, existing: DataFrame, now: Column, since: Column | None = None, absolute: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """The facts with a statement's vendor rows loaded, and the flags that this raises.

    Facts of a key (entity, concept, period, kind of period) that are there with the same value stay; those with another value of this version are
    superseded, and the new one names the old. Vendor rows whose fiscal year isn't the derived one aren't loaded; they and broken ties are
    flagged: entity_id, period_end, period_type, flag_type, detail, severity.
    existing: id, superseded_at, supersedes_fact_id beside statement_facts()'s columns.
    """
    keys = ["entity_id", "concept", "period_end", "period_type"]
    told = statement_facts(rows, entities, statement, version, since)
    wrong, good = told.where("fiscal_year_mismatch"), told.where("NOT coalesce(fiscal_year_mismatch, false)").drop("fiscal_year_mismatch").dropDuplicates(keys)
    live = existing.where(F.col("superseded_at").isNull() & (F.col("extraction_version") == version)).select(*keys, F.col("id").alias("old_id"), F.col("value").alias("old_value"))
    met = good.join(live, keys, "left").where(F.col("old_value").isNull() | (F.col("old_value") != F.col("value")))
    new = met.withColumns({"id": F.xxhash64(*keys, F.lit(version), "value", "published_at"), "superseded_at": F.lit(None).cast("timestamp"), "supersedes_fact_id": F.col("old_id")}).drop("old_id", "old_value")
    gone = new.where("supersedes_fact_id IS NOT NULL").select(F.col("supersedes_fact_id").alias("id"), F.lit(True).alias("__gone"))
    kept = existing.join(gone, "id", "left").withColumn("superseded_at", F.when(F.col("__gone"), now).otherwise(F.col("superseded_at"))).drop("__gone")
    concepts = sorted({t.total for t in ties} | {p for t in ties for p in t.parts})
    at = ["entity_id", "period_end", "period_type"]
    wide = good.groupBy(*at).agg(*[F.expr(f"max(value) FILTER (WHERE concept = '{c}')").alias(c) for c in concepts])
    broken = broken_ties(wide, ties, at, absolute).select(*at, F.lit("tie").alias("flag_type"), F.col("tie").alias("detail"), "severity")
    years = wrong.select(*at).distinct().select(*at, F.lit("fiscal_year_mismatch").alias("flag_type"), F.lit(statement).alias("detail"), F.lit("investigate").alias("severity"))
    return kept.unionByName(new.select(*kept.columns)), broken.unionByName(years)


def joined_prices(raw: DataFrame, adjusted: DataFrame) -> DataFrame:
    """Raw closes with adjusted ones by security and day; a day that one feed lacks is left out."""
    return raw.join(adjusted.select("security_id", "date", "adj_close"), ["security_id", "date"])
