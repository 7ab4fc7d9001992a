"""Queries of the data-quality checks, the findings' life, verification and reconciliation; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..functions import columns as fn
from ..operators import quality, verify, windows
from .finance import query, r, rounded

TODAY = "2024-01-31"


def _today():
    return F.lit(TODAY).cast("timestamp")


def _events(spark, sf_dir):
    return kit.table(spark, sf_dir, "events")


@query(f"SELECT event_id FROM events WHERE event_id % 3 <> 0 AND ts >= TIMESTAMP '{TODAY}' - INTERVAL 7 DAY AND coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), 0) = 0")
def zero_row_runs(spark, sf_dir):
    runs = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 != 0, "succeeded").otherwise("failed").alias("status"), F.col("ts").alias("ended_at"), "props")
    return quality.zero_row_runs(runs, "props", ["k", "missing"], _today()).select("event_id")


_FLAGS = "SELECT event_id AS id, ts AS flagged_at, CASE WHEN event_id % 2 = 0 THEN ts END AS resolved_at, user_id AS entity_id FROM events"


def _flags(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").alias("flagged_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("resolved_at"), F.col("user_id").alias("entity_id"))


@query(f"SELECT id, entity_id FROM flags WHERE resolved_at IS NULL AND flagged_at < TIMESTAMP '{TODAY}' - INTERVAL 14 DAY", flags=_FLAGS)
def unresolved_flags_aging(spark, sf_dir):
    return quality.flags_aging(_flags(spark, sf_dir), _today()).select("id", "entity_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def artifact_orphans(spark, sf_dir):
    turns = kit.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return quality.orphans(kit.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", kit.table(spark, sf_dir, "labels"), turns)


@query("SELECT lang, source, count(*) FILTER (WHERE n_chars < 300) AS n, count(*) AS total FROM documents GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n_chars < 300) > 0")
def unparsed_body_fallback(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("n_chars") < 300, "unparsed_fallback").otherwise("deterministic").alias("method"))
    return quality.fallback_counts(rows, ["lang", "source"])


@query("""SELECT * FROM (SELECT lang, count(*) FILTER (WHERE age < 30) AS recent_n, count(*) FILTER (WHERE age >= 30) AS baseline_n, round(count(*) FILTER (WHERE age < 30 AND n_chars > 1000) / count(*) FILTER (WHERE age < 30), 9) AS recent_share,
    round(count(*) FILTER (WHERE age >= 30 AND n_chars > 1000) / count(*) FILTER (WHERE age >= 30), 9) AS baseline_share FROM (SELECT *, doc_id % 90 AS age FROM documents) GROUP BY 1) WHERE recent_n >= 10 AND baseline_n >= 10 AND baseline_share - recent_share >= 0.0""")
def extraction_method_drift(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "documents").withColumn("at", F.date_sub(F.to_date(_today()), (F.col("doc_id") % 90).cast("int")))
    out = quality.method_drift(rows, "lang", F.col("n_chars") > 1000, "at", F.to_date(_today()), drop=0.0)
    return out.select("lang", "recent_n", "baseline_n", *rounded(["recent_share", "baseline_share"], 9))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars % 2 = 0) AS repaired FROM documents GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE n_chars % 2 = 0) / count(*) > 0.5")
def chunk_repair_concentration(spark, sf_dir):
    return quality.repair_concentration(kit.table(spark, sf_dir, "documents").select("source", "n_chars"), "source", F.col("n_chars") % 2 == 0)


@query("SELECT doc_id, d.lang, n_chars, median FROM documents d JOIN (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS median FROM documents GROUP BY 1) m ON m.lang = d.lang WHERE median >= 1000 AND n_chars < median * 0.1 AND n_chars < 200")
def section_text_suspicious_length(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return quality.suspicious_length(rows, "lang", "n_chars", 1000, 0.1, 200).select("doc_id", "lang", "n_chars", "median")


_COVERAGE = """SELECT 'financials' AS vertical, entity_id, period_end AS d FROM wide UNION ALL SELECT 'prices', entity_id, date FROM daily WHERE entity_id % 4 <> 0"""


def _verticals(spark, sf_dir):
    return {"financials": kit.wide(spark, sf_dir).select("entity_id", "period_end"), "prices": kit.daily(spark, sf_dir).where("entity_id % 4 <> 0").select("entity_id", F.col("date").alias("period_end"))}


def _matrix(spark, sf_dir):
    """Shipments tell the days that have a price."""
    days = kit.table(spark, sf_dir, "lineitem").where("l_suppkey % 4 <> 0").select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("period_end"))
    return quality.coverage_matrix(_verticals(spark, sf_dir) | {"prices": days}, once=["prices"])


@query("SELECT entity_id, vertical, count(*) AS n_rows, count(DISTINCT d) AS periods, min(d) AS earliest, max(d) AS latest FROM covered GROUP BY 1, 2", covered=_COVERAGE)
def coverage_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


_RULES = [("financials", "min_periods", 20), ("prices", "present", 0), ("prices", "min_periods", 600), ("prices", "recency", 5000), ("segments", "present", 0), ("segments", "recency", 100)]
_RULE_ROWS = ", ".join(f"('{v}', '{k}', {n})" for v, k, n in _RULES)


@query(f"""SELECT entity_id, vertical, rule, CAST(threshold AS INTEGER) AS threshold, CAST(CASE rule WHEN 'recency' THEN DATE '2012-01-01' - latest ELSE coalesce(periods, 0) END AS BIGINT) AS actual FROM (SELECT s_suppkey AS entity_id FROM supplier) CROSS JOIN (VALUES {_RULE_ROWS}) v(vertical, rule, threshold)
    LEFT JOIN (SELECT entity_id, vertical, count(DISTINCT d) AS periods, max(d) AS latest FROM covered GROUP BY 1, 2) c USING (entity_id, vertical)
    WHERE NOT CASE rule WHEN 'present' THEN coalesce(periods, 0) > 0 WHEN 'min_periods' THEN coalesce(periods, 0) >= threshold ELSE coalesce(DATE '2012-01-01' - latest <= threshold, false) END""", covered=_COVERAGE)  # fmt: skip
def expected_coverage(spark, sf_dir):
    return quality.expected_coverage(_matrix(spark, sf_dir), kit.entities(spark, sf_dir), F.lit("2012-01-01").cast("date"), _RULES)


@query("SELECT entity_id, vertical, CAST(date_trunc('month', d) AS DATE) AS bucket, count(*) AS n FROM covered GROUP BY 1, 2, 3", covered=_COVERAGE)
def coverage_by_month(spark, sf_dir):
    return quality.coverage_buckets(_verticals(spark, sf_dir), "month")


_PICKED = "SELECT * FROM cur WHERE rn = 1"
_ANNUAL = "SELECT entity_id, fiscal_year, concept, CAST(sum(value) * CASE WHEN entity_id % 3 = 0 THEN 1.1 ELSE 1.0 END AS DECIMAL(28,4)) AS annual FROM picked GROUP BY 1, 2, 3"


def _picked(spark, sf_dir):
    return kit.picked(spark, sf_dir)


def _annual(picked):
    factor = F.when(F.col("entity_id") % 3 == 0, F.lit(1.1).cast("decimal(2,1)")).otherwise(F.lit(1).cast("decimal(2,1)"))
    return picked.groupBy("entity_id", "fiscal_year", "concept").agg(F.sum("value").alias("s")).select("entity_id", "fiscal_year", "concept", (F.col("s") * factor).cast("decimal(28,4)").alias("annual"))


@query("""SELECT entity_id, fiscal_year, concept, round(gap, 4) AS gap FROM (SELECT entity_id, fiscal_year, concept, abs(CAST(sum(value) AS DOUBLE) - CAST(any_value(annual) AS DOUBLE)) AS gap, abs(CAST(any_value(annual) AS DOUBLE)) AS a FROM picked JOIN annual USING (entity_id, fiscal_year, concept)
    GROUP BY 1, 2, 3 HAVING count(DISTINCT fiscal_quarter) = 4) WHERE gap >= 1000 AND gap >= 0.05 * a""", picked=_PICKED, annual=_ANNUAL)
def quarterly_sum_to_annual_drift(spark, sf_dir):
    picked = _picked(spark, sf_dir)
    return quality.annual_drift(picked, _annual(picked), ["entity_id", "fiscal_year", "concept"], 1000.0).select("entity_id", "fiscal_year", "concept", *rounded(["gap"], 4))


@query("""SELECT entity_id, fiscal_year, fiscal_quarter, count(*) AS n, count(*) FILTER (WHERE v = v2) AS same FROM (SELECT entity_id, fiscal_year, concept, fiscal_quarter, v, lead(fiscal_quarter) OVER w AS q2, lead(v) OVER w AS v2 FROM
    (SELECT *, CAST(round(CAST(value AS DOUBLE) / 200000) AS BIGINT) AS v FROM picked) WINDOW w AS (PARTITION BY entity_id, fiscal_year, concept ORDER BY fiscal_quarter)) WHERE q2 = fiscal_quarter + 1 AND v <> 0 AND v2 <> 0
    GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND count(*) FILTER (WHERE v = v2) / count(*) > 0.5""", picked=_PICKED)
def quarterly_value_duplication(spark, sf_dir):
    rounded_values = _picked(spark, sf_dir).withColumn("value", F.round(fn.dbl("value") / 200000).cast("long"))
    return quality.value_duplication(rounded_values)


_QENDS = "SELECT DISTINCT entity_id, fiscal_year, fiscal_quarter, period_end FROM labelled"


@query("SELECT q.entity_id, q.fiscal_year, q.period_end, a.e AS annual_end FROM q JOIN (SELECT entity_id, fiscal_year, max(period_end) + CAST(entity_id % 2 AS INTEGER) AS e FROM q GROUP BY entity_id, fiscal_year) a USING (entity_id, fiscal_year) WHERE q.fiscal_quarter = 4 AND q.period_end <> a.e", q=_QENDS)
def q4_period_end_consistency(spark, sf_dir):
    q = kit.facts(spark, sf_dir, concepts=["revenue"]).select("entity_id", "fiscal_year", "fiscal_quarter", "period_end").distinct()
    annual = q.groupBy("entity_id", "fiscal_year").agg(F.max("period_end").alias("m")).select("entity_id", "fiscal_year", F.date_add("m", (F.col("entity_id") % 2).cast("int")).alias("period_end"))
    return quality.q4_ends(q, annual).select("entity_id", "fiscal_year", "period_end", "annual_end")


@query("SELECT entity_id, fiscal_year, fiscal_quarter, period_end, period_end + 1 AS trusted_end FROM q WHERE entity_id % 5 = 0", q=_QENDS)
def cross_endpoint_period_end_consistency(spark, sf_dir):
    q = kit.facts(spark, sf_dir, concepts=["revenue"]).select("entity_id", "fiscal_year", "fiscal_quarter", "period_end").distinct()
    trusted = q.withColumn("period_end", F.when(F.col("entity_id") % 5 == 0, F.date_add("period_end", 1)).otherwise(F.col("period_end")))
    return quality.cross_ends(q, trusted, ["entity_id", "fiscal_year", "fiscal_quarter"])


@query("SELECT DISTINCT entity_id, period_end FROM labelled WHERE entity_id % 7 = 0 OR month(period_end) = 12")
def period_end_calendar_consistency(spark, sf_dir):
    rows = kit.facts(spark, sf_dir, concepts=["revenue"]).withColumn("calendar_quarter", F.when(F.col("entity_id") % 7 == 0, 5).otherwise(F.col("calendar_quarter")))
    rows = rows.withColumn("calendar_year", F.when(F.month("period_end") == 12, F.col("calendar_year") + 1).otherwise(F.col("calendar_year")))
    return quality.calendar_ends(rows).select("entity_id", "period_end").distinct()


@query("""SELECT entity_id, count(*) AS gaps, min(date) AS first_gap, max(date) FILTER (WHERE n = 20) AS twentieth FROM (SELECT entity_id, d.date, row_number() OVER (PARTITION BY entity_id ORDER BY d.date) AS n FROM (SELECT DISTINCT date FROM daily) d
    JOIN (SELECT entity_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s ON d.date BETWEEN a AND b ANTI JOIN daily p ON p.entity_id = s.entity_id AND p.date = d.date) GROUP BY 1""")
def prices_gap_detection(spark, sf_dir):
    out = quality.price_gaps(kit.daily(spark, sf_dir))
    return out.select("entity_id", "gaps", "first_gap", F.get("sample", F.lit(19)).alias("twentieth"))


_EST = "SELECT o_orderkey AS security_id, CAST(o_orderdate AS DATE) AS period_end, o_totalprice AS revenue_avg, o_totalprice * 0.5 - 60000 AS ebit_avg, o_totalprice * 0.25 AS net_income_avg FROM orders"


def _estimates(spark, sf_dir):
    p = F.col("o_totalprice")
    return kit.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("security_id"), F.to_date("o_orderdate").alias("period_end"), p.alias("revenue_avg"), (p * 0.5 - 60000).alias("ebit_avg"), (p * 0.25).alias("net_income_avg"))


@query("SELECT security_id FROM est WHERE period_end >= DATE '1998-01-01' AND net_income_avg > 0 AND ebit_avg < 0 AND revenue_avg > 0 AND abs(net_income_avg - ebit_avg) / revenue_avg > 0.2", est=_EST)
def forward_estimate_consistency(spark, sf_dir):
    return quality.forward_consistency(_estimates(spark, sf_dir), F.lit("1998-01-01").cast("date")).select("security_id")


@query(f"SELECT event_id, {r({'share': '(value - user_id) / user_id'}, 8)} FROM events WHERE user_id <> 0 AND abs((value - user_id) / user_id) > 2.0")
def earnings_surprise_sanity(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.col("value").alias("actual"), F.col("user_id").alias("estimated"))
    return quality.surprise_sanity(rows).select("event_id", *rounded({"share": (F.col("actual") - F.col("estimated")) / F.col("estimated")}, 8))


@query("SELECT s_suppkey AS security_id, count(*) AS n FROM supplier JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_suppkey = s_suppkey WHERE s_nationkey % 4 = 0 OR s_acctbal < 0 GROUP BY 1")
def analyst_estimates_orphan(spark, sf_dir):
    securities = kit.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("security_id"), F.when(F.col("s_nationkey") % 4 == 0, "inactive").otherwise("active").alias("status"), F.when(F.col("s_acctbal") < 0, "etf").otherwise("common_stock").alias("kind"))
    estimates = kit.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("security_id"), "l_orderkey").distinct()
    return quality.estimate_orphans(estimates, securities)


@query(f"SELECT c_custkey AS security_id, t AS fetched_at FROM customer LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) ON user_id = c_custkey WHERE t IS NULL OR t < TIMESTAMP '{TODAY}' - INTERVAL 3 DAY")
def price_target_consensus_freshness(spark, sf_dir):
    targets = _events(spark, sf_dir).groupBy(F.col("user_id").alias("security_id")).agg(F.max("ts").alias("fetched_at"))
    return quality.target_freshness(kit.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("security_id")), targets, _today()).select("security_id", "fetched_at")


@query("""SELECT entity_id, fiscal_year, concept, round(CAST(delta AS DOUBLE), 4) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, fiscal_year ORDER BY abs(delta) DESC, concept) AS n FROM (
    SELECT p.entity_id, p.fiscal_year, p.concept, p.value AS delta, rank() OVER (PARTITION BY p.entity_id ORDER BY p.published_at DESC) AS k FROM picked p) x WHERE k = 1 AND concept NOT IN ('sbc') AND abs(delta) >= 1000 AND NOT (entity_id % 2 = 0 AND concept = 'revenue')) WHERE n <= 3""", picked=_PICKED)
def xbrl_audit_unresolved(spark, sf_dir):
    picked = _picked(spark, sf_dir).select("entity_id", "fiscal_year", "concept", F.col("value").alias("delta"), F.col("published_at").alias("run_at"))
    done = picked.where("entity_id % 2 = 0 AND concept = 'revenue'")
    return quality.audit_unresolved(picked, done, ["sbc"], 1000.0).select("entity_id", "fiscal_year", "concept", *rounded(["delta"], 4))


@query("""SELECT n_nationkey, sha256('{"check":"demo","params":{"limit":"5"},"scope":{"nation":"' || n_name || '","region":"' || n_regionkey || '"}}') AS fp FROM nation""")
def fingerprint(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", fn.fingerprint("demo", {"region": F.col("n_regionkey"), "nation": F.col("n_name"), "none": F.lit(None)}, {"limit": F.lit(5)}).alias("fp"))


@query("""SELECT 'F' || k AS fingerprint, CASE WHEN NOT s THEN 'open' WHEN k % 5 = 0 AND f THEN 'closed' WHEN f THEN 'open' ELSE 'closed' END AS status,
    CASE WHEN NOT s THEN 'created' WHEN f AND k % 5 = 0 THEN 'suppressed' WHEN f AND k % 2 = 0 THEN 're_observed' WHEN f THEN 'reopened' WHEN k % 2 = 0 THEN 'auto_resolved' ELSE 'kept' END AS event
    FROM (SELECT c_custkey AS k, c_custkey % 3 <> 0 AS s, c_custkey % 4 <> 0 OR c_custkey % 3 = 0 AS f FROM customer)""")
def finding_merge(spark, sf_dir):
    k = F.col("c_custkey")
    base = kit.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("F"), k.cast("string")).alias("fingerprint"), F.lit("check").alias("source_check"), F.lit("warning").alias("severity"), k.alias("entity_id"), F.lit("found").alias("summary"))
    old = F.lit("2024-01-01").cast("timestamp")
    stored = base.where("c_custkey % 3 <> 0").withColumns({"status": F.when(k % 2 == 0, "open").otherwise("closed"), "created_at": old, "last_seen_at": old, "suppressed_until": F.when(k % 5 == 0, F.lit("2030-01-01").cast("timestamp")), "closed_reason": F.lit(None).cast("string"), "history": F.array(F.lit("created"))}).drop("c_custkey")
    found = base.where("c_custkey % 4 <> 0 OR c_custkey % 3 = 0").drop("c_custkey")
    return quality.merge_findings(stored, found, _today()).select("fingerprint", "status", "event")


@query(f"""SELECT 'finding' AS source, 'F' || n_nationkey AS signal_id, 'warning' AS severity, CAST(n_nationkey AS BIGINT) AS entity_id, NULL::VARCHAR AS fiscal_period_key, 30.0::DOUBLE AS age_days FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 'flag', CAST(id AS VARCHAR), 'info', entity_id, 'FY2024-Q' || (id % 4 + 1), round(epoch(TIMESTAMP '{TODAY}' - flagged_at)::BIGINT / 86400.0, 9) FROM (SELECT id, entity_id, date_trunc('second', flagged_at) AS flagged_at, resolved_at FROM flags) WHERE resolved_at IS NULL""", flags=_FLAGS)
def quality_inbox(spark, sf_dir):
    n = F.col("n_nationkey")
    findings = kit.table(spark, sf_dir, "nation").select(F.concat(F.lit("F"), n.cast("string")).alias("fingerprint"), F.lit("warning").alias("severity"), n.cast("long").alias("entity_id"), F.lit("x").alias("summary"), F.when(n % 2 == 0, "open").otherwise("closed").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    flags = _flags(spark, sf_dir).withColumns({"severity": F.lit("info"), "fiscal_year": F.lit(2024), "fiscal_quarter": (F.col("id") % 4 + 1).cast("int"), "reason": F.lit("x")})
    return quality.inbox(findings, flags, _today()).withColumn("age_days", F.round("age_days", 9)).drop("summary", "detected_at")


_RUNS = """SELECT event_id AS run, ts, event_type AS kind, CASE WHEN event_id % 2 <> 0 THEN user_id % 4 END AS scope, CASE WHEN event_id % 5 = 0 THEN 2020 + user_id % 3 END AS fy, CASE WHEN event_id % 10 = 0 THEN user_id % 4 + 1 END AS fq FROM events WHERE event_type NOT IN ('purchase', 'view')"""


@query("""SELECT a.event_id AS finding, r.run, concat_ws(' ', r.kind, 'vendor', 'FY' || r.fy || coalesce('-Q' || r.fq, '')) AS action_label FROM events a JOIN runs r ON r.ts <= a.ts AND r.ts >= a.ts - INTERVAL 60 MINUTE WHERE a.event_type = 'purchase' AND (r.scope IS NULL OR r.scope = a.user_id % 4)
    AND (a.event_id % 3 = 0 OR r.fy IS NULL OR r.fy = 2020 + a.user_id % 3) AND (a.event_id % 3 <> 1 OR r.fq IS NULL OR r.fq = a.user_id % 4 + 1)""", runs=_RUNS)  # fmt: skip
def resolving_runs(spark, sf_dir):
    """Purchases as resolutions, all other events as runs, views as reconciliations."""
    e, user = _events(spark, sf_dir), F.col("user_id")
    year, quarter = (2020 + user % 3).cast("string"), (user % 4 + 1).cast("string")
    key = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("FY"), year, F.lit("-Q"), quarter)).when(F.col("event_id") % 3 == 2, F.concat(F.lit("FY"), year))
    resolved = e.where("event_type = 'purchase'").select(F.col("event_id").alias("finding"), F.col("ts").alias("resolved_at"), (user % 4).cast("string").alias("ticker"), key.alias("fiscal_period_key"))
    counts = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, year).alias("fiscal_year"), F.when(F.col("event_id") % 10 == 0, quarter).alias("fiscal_quarter")))
    kind = F.when(F.col("event_type") == "view", "reconciliation").otherwise(F.col("event_type"))
    runs = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("run"), F.col("ts").alias("ended_at"), F.lit("succeeded").alias("status"), kind.alias("kind"), F.lit("vendor").alias("vendor"), F.when(F.col("event_id") % 2 != 0, F.array((user % 4).cast("string"))).alias("ticker_scope"), counts.alias("counts"))
    return quality.resolving_runs(resolved, runs).select("finding", "run", "action_label")


# Verification


def _ties_sql(ties: list[verify.Tie], absolute: float) -> str:
    parts = [f"SELECT entity_id, period_end, '{t.name}' AS tie, CAST({t.total} AS DOUBLE) AS expected, CAST({' '.join(('+' if s > 0 else '-') + f' {p}' for p, s in t.parts.items())} AS DOUBLE) AS computed FROM wide" for t in ties]
    severity = "CASE WHEN d / greatest(abs(expected), 1e-9) < 0.01 THEN 'informational' WHEN d / greatest(abs(expected), 1e-9) < 0.10 THEN 'warning' ELSE 'investigate' END"
    return f"SELECT entity_id, period_end, tie, round(expected, 4) AS expected, round(computed, 4) AS computed, {severity} AS severity FROM (SELECT *, abs(expected - computed) AS d FROM ({' UNION ALL '.join(parts)})) WHERE d > greatest({absolute}, greatest(abs(expected), abs(computed)) * 0.001)"


def _ties(name: str, ties: list[verify.Tie], absolute: float) -> None:
    def run(spark, sf_dir):
        out = verify.broken_ties(kit.wide(spark, sf_dir), ties, ["entity_id", "period_end"], absolute)
        return out.select("entity_id", "period_end", "tie", *rounded(["expected", "computed"], 4), "severity")

    run.__name__ = name
    query(_ties_sql(ties, absolute))(run)


#: Identities over the concepts that the driver's tables give.
KIT_IS = [verify.IS_TIES[0], verify.Tie("pretax", "ebt_incl_unusual", {"operating_income": 1, "interest_expense": -1}), verify.Tie("net_income", "net_income", {"ebt_incl_unusual": 1, "tax": -1})]
KIT_BS = [verify.Tie("debt_cover", "total_equity", {"long_term_debt": 1, "current_portion_lt_debt": 1, "short_term_investments": 1}, False), verify.Tie("working_capital", "inventory", {"accounts_receivable": 1, "current_portion_lt_debt": 1}, False)]
KIT_CF = [verify.Tie("cfo", "cfo", {"net_income": 1, "dna_cf": 1, "sbc": 1, "acquisitions": 1}, False)]
_ties("is_ties", KIT_IS, 0.5)
_ties("bs_ties", KIT_BS, 500.0)
_ties("cf_ties", KIT_CF, 500.0)


@query("SELECT l_orderkey, round(s, 9) AS share, CASE WHEN s < 0.01 THEN 'informational' WHEN s < 0.10 THEN 'warning' ELSE 'investigate' END AS severity FROM (SELECT l_orderkey, max(l_discount + l_tax / 10) AS s FROM lineitem GROUP BY 1)")
def drift_severity(spark, sf_dir):
    share = kit.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") + F.col("l_tax") / 10).alias("s"))
    return share.select("l_orderkey", F.round("s", 9).alias("share"), fn.drift_severity(F.col("s")).alias("severity"))


@query("""SELECT entity_id, fiscal_year, concept, round(delta, 4) AS delta FROM (SELECT entity_id, fiscal_year, concept, abs(CAST(sum(value) AS DOUBLE) - CAST(any_value(annual) AS DOUBLE)) AS delta, abs(CAST(any_value(annual) AS DOUBLE)) AS a FROM picked JOIN annual USING (entity_id, fiscal_year, concept)
    WHERE concept IN ('revenue', 'cogs', 'cfo') GROUP BY 1, 2, 3 HAVING count(DISTINCT fiscal_quarter) = 4) WHERE delta > greatest(2500.0, a * 0.001)""", picked=_PICKED, annual=_ANNUAL)
def period_arithmetic(spark, sf_dir):
    picked = _picked(spark, sf_dir)
    return verify.period_arithmetic(picked, _annual(picked), ["revenue", "cogs", "cfo"], 2500.0).select("entity_id", "fiscal_year", "concept", *rounded(["delta"], 4))


_CASHED = """SELECT entity_id, period_end, net_income, net_income + CASE WHEN entity_id % 4 = 0 THEN 9000 ELSE 0 END AS net_income_start, cash_and_equivalents + coalesce(restricted, 0) AS cash, lag(cash_and_equivalents + coalesce(restricted, 0)) OVER (PARTITION BY entity_id ORDER BY period_end) AS before, restricted
    FROM (SELECT *, CASE WHEN entity_id % 3 = 0 THEN inventory END AS restricted FROM wide)"""
_CROSS = " UNION ALL ".join(f"SELECT entity_id, period_end, '{tie}' AS tie, CAST({a} AS DOUBLE) AS l, CAST({b} AS DOUBLE) AS r FROM cashed" for tie, a, b in (("net_income", "net_income_start", "net_income"), ("cash_end", "cash + CASE WHEN entity_id % 5 = 0 THEN 7000 ELSE 0 END", "cash"), ("cash_begin", "before + CASE WHEN entity_id % 6 = 0 THEN 8000 ELSE 0 END", "before"), ("net_change", "cash - before + CASE WHEN month(period_end) = 6 THEN 6000 ELSE 0 END", "cash - before")))


@query(f"SELECT entity_id, period_end, tie, round(abs(l - r), 4) AS delta FROM ({_CROSS}) WHERE abs(l - r) > greatest(5000.0, greatest(abs(l), abs(r)) * 0.001)", cashed=_CASHED)
def cross_statement(spark, sf_dir):
    """Cash flows that start, end, begin or change otherwise than the other statements say, for some entities each."""
    wide = kit.wide(spark, sf_dir).withColumn("restricted_cash", F.when(F.col("entity_id") % 3 == 0, F.col("inventory")))
    cash = F.col("cash_and_equivalents") + F.coalesce("restricted_cash", F.lit(0))
    before, by = F.lag("cash").over(windows.ordered()), lambda hit, x: F.when(hit, x).otherwise(0)
    e = F.col("entity_id")
    wide = wide.withColumn("cash", cash).withColumns({"net_income_start": F.col("net_income") + by(e % 4 == 0, 9000), "cash_end_of_period": F.col("cash") + by(e % 5 == 0, 7000), "cash_begin_of_period": before + by(e % 6 == 0, 8000), "net_change_in_cash": F.col("cash") - before + by(F.month("period_end") == 6, 6000)})
    return verify.cross_statement(wide, ["entity_id", "period_end"], windows.ordered(), 5000.0).select("entity_id", "period_end", "tie", *rounded(["delta"], 4))


# Filings: the quarters' values as JSON entries, by durations; the fourth quarter only as the year less nine months
_FILED_TAGS = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in kit.TAGS.items())
_ANCHORED = f"""SELECT entity_id, period_end, fiscal_year, concept, CAST(value AS DOUBLE) AS value, CAST(other AS DOUBLE) AS other, abs(CAST(value AS DOUBLE) - CAST(other AS DOUBLE)) AS delta, derived, tag FROM (SELECT *, CASE concept {_FILED_TAGS} END AS tag,
    CASE WHEN NOT flow THEN CAST(value * k AS DECIMAL(28,4)) WHEN fiscal_quarter < 4 THEN CAST(value * k * CASE WHEN entity_id % 7 = 0 THEN 1.1 ELSE 1 END AS DECIMAL(28,4)) WHEN n = 4 THEN CAST(fy * k AS DECIMAL(28,4)) - CAST(nine * k AS DECIMAL(28,4)) END AS other, flow AND fiscal_quarter = 4 AS derived
    FROM (SELECT *, concept IN ('revenue', 'net_income', 'cfo', 'ebt_incl_unusual') AS flow, CAST(CASE WHEN entity_id % 5 = 0 THEN 1.02 ELSE 1 END AS DECIMAL(4,2)) AS k, sum(value) OVER y AS fy, sum(value) FILTER (WHERE fiscal_quarter < 4) OVER y AS nine,
    len(list_distinct(list(fiscal_quarter) OVER y)) AS n FROM picked WHERE concept IN ({', '.join(f"'{c}'" for c in kit.TAGS)}) WINDOW y AS (PARTITION BY entity_id, fiscal_year, concept)))
    WHERE other IS NOT NULL AND abs(CAST(value AS DOUBLE) - CAST(other AS DOUBLE)) > greatest(1000.0, abs(CAST(other AS DOUBLE)) * 0.001)"""


def _filed(spark, sf_dir):
    return verify.filed_values(kit.companyfacts(spark, sf_dir), "body", {c: [t] for c, t in kit.TAGS.items()})


def _diverged(spark, sf_dir):
    return verify.anchored(_picked(spark, sf_dir), _filed(spark, sf_dir), 1000.0)


@query(f"SELECT entity_id, period_end, concept, derived, {r(['value', 'other', 'delta'], 4)} FROM anchored", picked=_PICKED, anchored=_ANCHORED)
def anchor_reconcile(spark, sf_dir):
    return _diverged(spark, sf_dir).select("entity_id", "period_end", "concept", "derived", *rounded(["value", "other", "delta"], 4))


@query("SELECT entity_id, period_end, concept FROM anchored WHERE NOT derived AND concept IN ('revenue', 'cfo') AND fiscal_year >= 1997 AND delta >= 2000 AND delta / greatest(abs(other), 1e-9) < 0.25", picked=_PICKED, anchored=_ANCHORED)
def promotion_filter(spark, sf_dir):
    return verify.promotable(_diverged(spark, sf_dir), ["revenue", "cfo"], 1997, 2000.0).select("entity_id", "period_end", "concept")


@query("""SELECT entity_id, period_end, concept, CASE WHEN concept = 'total_equity' THEN 'DEFINITIONAL' WHEN concept = 'ebt_incl_unusual' AND s < 0.25 THEN 'DEFINITIONAL' WHEN concept = 'cash_and_equivalents' AND s < 0.05 THEN 'DEFINITIONAL' WHEN concept = 'total_assets' AND s < 0.005 THEN 'DEFINITIONAL'
    WHEN derived THEN 'AMBIGUOUS' WHEN concept IN ('revenue', 'net_income', 'cfo') AND delta >= 5000 AND (s IS NULL OR s >= 0.005) THEN 'CORRUPTION' ELSE 'AMBIGUOUS' END AS verdict FROM (SELECT *, CASE WHEN other <> 0 THEN delta / abs(other) END AS s FROM anchored)""", picked=_PICKED, anchored=_ANCHORED)  # fmt: skip
def triage_classify(spark, sf_dir):
    """The rules at the scale of these tables, where 5,000 is material."""
    return _diverged(spark, sf_dir).select("entity_id", "period_end", "concept", verify.triage(5000.0).alias("verdict"))


@query("SELECT entity_id, period_end, concept, CASE WHEN derived THEN 'audit_derivation_artifact' WHEN concept IN ('total_equity', 'ebt_incl_unusual', 'cash_and_equivalents', 'total_assets') THEN 'definitional_difference' ELSE 'keep_open' END AS category FROM anchored", picked=_PICKED, anchored=_ANCHORED)
def bulk_triage(spark, sf_dir):
    return _diverged(spark, sf_dir).select("entity_id", "period_end", "concept", verify.bulk_category().alias("category"))


_AFFECTED = dict(picked=_PICKED, filed=_ANCHORED.split("WHERE other IS NOT NULL")[0].replace("CAST(other AS DOUBLE) AS other", "other", 1).replace("CAST(value AS DOUBLE) AS value", "value", 1) + "WHERE other IS NOT NULL", failing="SELECT DISTINCT entity_id, fiscal_year FROM wide WHERE abs(CAST(gross_profit - revenue + cogs AS DOUBLE)) > greatest(0.5, 0.001 * greatest(abs(CAST(gross_profit AS DOUBLE)), abs(CAST(revenue - cogs AS DOUBLE)))) OR entity_id % 2 = 0")


@query("""SELECT entity_id, fiscal_year, period_end, string_agg(concept, ',' ORDER BY concept) AS concepts FROM (SELECT p.entity_id, p.fiscal_year, p.period_end, p.concept, p.value, a.other FROM picked p JOIN filed a USING (entity_id, period_end, concept)) JOIN failing USING (entity_id, fiscal_year) WHERE abs(value - other) >= 1 GROUP BY 1, 2, 3""",
       **_AFFECTED)
def amendment_periods(spark, sf_dir):
    """Where filings differ in the fiscal years of failing ties; even entities count as failing."""
    ours = _picked(spark, sf_dir).select("entity_id", "concept", "fiscal_year", "period_end", "value")
    out = verify.affected_periods(_failing(kit.wide(spark, sf_dir)), ours, _filed(spark, sf_dir))
    return out.select("entity_id", "fiscal_year", "period_end", F.array_join("concepts", ",").alias("concepts"))


def _failing(wide):
    broken = verify.broken_ties(wide, KIT_IS[:1], ["entity_id", "fiscal_year"], 0.5).select("entity_id", "fiscal_year")
    return broken.unionByName(wide.where("entity_id % 2 = 0").select("entity_id", "fiscal_year"))


@query(
    """SELECT entity_id, fiscal_year, fiscal_quarter, period_end, statement, period_type, bool_or(direct) AS direct FROM (SELECT *, unnest(CASE WHEN statement = 'balance_sheet' AND fiscal_quarter = 4 THEN ['quarter', 'annual'] ELSE ['quarter'] END) AS period_type FROM (
        SELECT entity_id, fiscal_year, fiscal_quarter, period_end, statement, true AS direct FROM restated UNION ALL SELECT entity_id, fiscal_year, fiscal_quarter, period_end, 'cash_flow', false FROM restated WHERE statement = 'income_statement'
        UNION ALL SELECT entity_id, fiscal_year, fiscal_quarter, period_end, 'balance_sheet', false FROM restated WHERE statement IN ('income_statement', 'cash_flow'))) GROUP BY ALL""",
    **_AFFECTED,
    restated="SELECT DISTINCT p.entity_id, p.fiscal_year, p.fiscal_quarter, p.period_end, p.statement FROM picked p JOIN filed a USING (entity_id, period_end, concept) JOIN failing f ON f.entity_id = p.entity_id AND f.fiscal_year = p.fiscal_year WHERE abs(p.value - a.other) >= 1",
)
def amendment_closure(spark, sf_dir):
    """All statements and periods to refresh where filings differ in failing fiscal years."""
    ours = _picked(spark, sf_dir)
    found = verify.affected_periods(_failing(kit.wide(spark, sf_dir)), ours.select("entity_id", "concept", "fiscal_year", "period_end", "value"), _filed(spark, sf_dir))
    named = found.select("entity_id", "period_end", F.explode("concepts").alias("concept"))
    marked = ours.join(named, ["entity_id", "period_end", "concept"], "left_semi").select("entity_id", "fiscal_year", "fiscal_quarter", "period_end", "statement")
    return verify.co_marked(marked)


@query("""SELECT entity_id, period_end, concept, round(CAST(new AS DOUBLE), 4) AS new, derived FROM (SELECT entity_id, period_end, 'revenue' AS concept, revenue AS new, false AS derived FROM wide UNION ALL SELECT entity_id, period_end, 'gross_profit', gross_profit, false FROM wide WHERE entity_id % 3 <> 0
    UNION ALL SELECT entity_id, period_end, 'operating_income', operating_income, false FROM wide WHERE entity_id % 4 <> 0 UNION ALL SELECT entity_id, period_end, 'cogs', cogs, false FROM wide WHERE entity_id % 5 = 0
    UNION ALL SELECT entity_id, period_end, 'cogs', revenue - gross_profit, true FROM wide WHERE entity_id % 5 <> 0 AND entity_id % 3 <> 0 UNION ALL SELECT entity_id, period_end, 'total_opex', gross_profit - operating_income, true FROM wide WHERE entity_id % 3 <> 0 AND entity_id % 4 <> 0)""")  # fmt: skip
def amendment_derived(spark, sf_dir):
    """Candidates of filings that lack some concepts, with those that follow from others."""
    wide, e = kit.wide(spark, sf_dir), F.col("entity_id")
    has = {"revenue": F.lit(True), "gross_profit": e % 3 != 0, "operating_income": e % 4 != 0, "cogs": e % 5 == 0}
    told = F.explode(F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(c).alias("concept"), F.col(c).alias("new"))) for c, ok in has.items()]))).alias("x")
    out = verify.derived_candidates(wide.select("entity_id", "period_end", told).select("entity_id", "period_end", "x.*"), ["entity_id", "period_end"])
    return out.select("entity_id", "period_end", "concept", *rounded(["new"], 4), "derived")


@query("SELECT entity_id, fiscal_year, concept, round(CAST(any_value(annual) - sum(value) FILTER (WHERE fiscal_quarter < 4) AS DOUBLE), 4) AS q4 FROM picked JOIN annual USING (entity_id, fiscal_year, concept) GROUP BY 1, 2, 3 HAVING count(DISTINCT fiscal_quarter) FILTER (WHERE fiscal_quarter < 4) = 3", picked=_PICKED, annual=_ANNUAL)
def q4_correction(spark, sf_dir):
    picked = _picked(spark, sf_dir)
    return verify.corrected_fourth_quarter(picked, _annual(picked)).select("entity_id", "fiscal_year", "concept", *rounded(["q4"], 4))


@query("""SELECT entity_id, period_end, CASE WHEN d <= greatest(0.5, 0.001 * greatest(abs(gp), abs(c))) THEN 'clean' WHEN entity_id % 3 = 0 THEN 'amended' ELSE 'unresolved_flagged' END AS status FROM (SELECT entity_id, period_end, CAST(gross_profit AS DOUBLE) AS gp, CAST(revenue - cogs AS DOUBLE) AS c, abs(CAST(gross_profit AS DOUBLE) - CAST(revenue - cogs AS DOUBLE)) AS d FROM broken)""",
       broken="SELECT entity_id, period_end, revenue, cogs, CASE WHEN entity_id % 2 = 0 THEN CAST(gross_profit + 1000 AS DECIMAL(28,4)) ELSE gross_profit END AS gross_profit FROM wide")
def amendment(spark, sf_dir):
    """Gross profits are broken for even entities; a second source knows better of every third."""
    wide = kit.wide(spark, sf_dir)
    broken = wide.select("entity_id", "period_end", "revenue", "cogs", F.when(F.col("entity_id") % 2 == 0, (F.col("gross_profit") + 1000).cast("decimal(28,4)")).otherwise(F.col("gross_profit")).alias("gross_profit"))
    candidates = wide.where("entity_id % 3 = 0").select("entity_id", "period_end", F.lit("gross_profit").alias("concept"), F.col("gross_profit").alias("new"))
    return verify.amend(broken, candidates, ["entity_id", "period_end"], KIT_IS[:1], 0.5)

