"""Queries of reads: companies, facts, metrics, valuations, documents and transcripts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import asof, facts, metrics, quality, reads
from ..schemas import CONCEPTS
from . import screener
from .finance import _V, FRAME, frame, query, r, rounded, safe
from .retrieval import _EST, TODAY, _estimates

# Companies and facts


@query("SELECT s_suppkey AS entity_id, s_name AS ticker FROM supplier WHERE upper(s_name) IN ('SUPPLIER#000000003', 'SUPPLIER#3', upper((SELECT max(s_name) FROM supplier)))")
def company_lookup(spark, sf_dir):
    """By ticker in any case; an unknown ticker finds nothing."""
    rows = kit.entities(spark, sf_dir)
    last = rows.agg(F.max("ticker").alias("t")).first()["t"]
    return reads.companies(rows, ["Supplier#000000003", "supplier#3", last.lower()]).select("entity_id", "ticker")


@query("""SELECT k AS cik, CASE WHEN k % 3 = 0 THEN 'S' || k ELSE 'OLD' || k END AS ticker, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN '09-30' WHEN k % 4 <> 0 THEN '12-31' END AS fiscal_year_end_md FROM (SELECT c_custkey AS k FROM customer) WHERE k % 4 <> 0 OR k % 3 = 0""")
def company_seed(spark, sf_dir):
    k = F.col("c_custkey")
    rows = kit.table(spark, sf_dir, "customer")
    old = rows.where("c_custkey % 4 <> 0").select(k.alias("cik"), F.concat(F.lit("OLD"), k.cast("string")).alias("ticker"), F.col("c_name").alias("name"), F.lit("12-31").alias("fiscal_year_end_md"))
    new = rows.where("c_custkey % 3 = 0").select(k.alias("cik"), F.concat(F.lit("s"), k.cast("string")).alias("ticker"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "0930").alias("fiscal_year_end"))
    return reads.seeded(old, new).select("cik", "ticker", "fiscal_year_end_md")


@query("SELECT entity_id, id AS fact_id, concept, CAST(value AS DOUBLE) AS value FROM facts WHERE superseded_at IS NULL AND entity_id = 3 AND fiscal_year = 1997 AND fiscal_quarter = 2")
def financial_facts(spark, sf_dir):
    return reads.period_facts(kit.facts(spark, sf_dir), 3, 1997, 2).select("entity_id", "fact_id", "concept", F.col("value").cast("double"))


_SEGF = "SELECT l_suppkey AS entity_id, CAST(year(l_shipdate) AS INTEGER) AS fy, p_brand AS label, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"


def _segment_facts(spark, sf_dir):
    items, part = kit.table(spark, sf_dir, "lineitem"), kit.table(spark, sf_dir, "part").select("p_partkey", "p_brand").hint("merge")  # parts grow with the items: never broadcast
    sums = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("fiscal_year"), F.col("p_brand").alias("label")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("decimal(28,4)").alias("value"))
    return sums.select("entity_id", "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"), F.lit("annual").alias("period_type"), F.lit("segment").alias("statement"), F.lit("revenue").alias("concept"), "value", F.lit(None).cast("timestamp").alias("superseded_at"), F.lit("brand").alias("dimension_type"), facts.slug_of(F.col("label")).alias("dimension_key"), F.col("label").alias("dimension_label"), F.format_string("FY%d", "fiscal_year").alias("fiscal_period_label"), F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end"))


@query(f"SELECT a.entity_id, a.label AS dimension_label, CAST(a.value AS DOUBLE) AS value, CAST(b.value AS DOUBLE) AS prior_value, round({safe('a.value - b.value', 'b.value')}, 10) AS yoy_growth FROM segf a LEFT JOIN segf b ON a.entity_id = b.entity_id AND a.label = b.label AND b.fy = a.fy - 1 WHERE a.fy = 1997", segf=_SEGF)
def segment_facts(spark, sf_dir):
    """Every entity's segments of a fiscal year beside those of the year before."""
    out = reads.period_segments(_segment_facts(spark, sf_dir), None, 1997, None, "annual")
    return out.select("entity_id", "dimension_label", F.col("value").cast("double"), F.col("prior_value").cast("double"), F.round("yoy_growth", 10).alias("yoy_growth"))


_PM = {"revenue_fy": "revenue", "cfo_fy": "cfo", "fcf_fy": "cfo + capital_expenditures"}


@query(f"SELECT entity_id, fiscal_period_label, period_end, {r(_PM, 4)}, {r({'gross_margin_fy': safe('gross_profit', 'revenue')}, 9)} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM wide WHERE fiscal_year = 1997 AND fiscal_quarter = 3) WHERE n = 1")
def metrics_read_quarter(spark, sf_dir):
    out = reads.period_metrics(kit.wide(spark, sf_dir), None, 1997, 3)
    return out.select("entity_id", "fiscal_period_label", "period_end", *rounded(list(_PM), 4), *rounded(["gross_margin_fy"], 9))


@query(f"SELECT entity_id, fiscal_period_label, period_end, {r({'revenue_fy': 'revenue_fy', 'fcf_fy': 'cfo_fy + capital_expenditures_fy'}, 4)}, {r({'operating_margin_fy': safe('operating_income_fy', 'revenue_fy')}, 9)} FROM annual_wide WHERE fiscal_year = 1997")
def metrics_read_year(spark, sf_dir):
    out = reads.period_metrics(kit.annual(spark, sf_dir), None, 1997)
    return out.select("entity_id", "fiscal_period_label", "period_end", *rounded(["revenue_fy", "fcf_fy"], 4), *rounded(["operating_margin_fy"], 9))


@query("""SELECT entity_id, CAST(CASE WHEN make_date(1996, fm, 28) >= DATE '1996-05-15' THEN 1996 ELSE 1997 END AS INTEGER) AS first_year, CAST(CASE WHEN make_date(1998, fm, 28) <= DATE '1998-05-15' THEN 1998 ELSE 1997 END AS INTEGER) AS last_year FROM entities""")
def fiscal_year_window(spark, sf_dir):
    """The whole fiscal years within two days."""
    return reads.year_window(kit.entities(spark, sf_dir), F.lit("1996-05-15").cast("date"), F.lit("1998-05-15").cast("date"))


_REPORTS = "SELECT l_suppkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) + 14 AS period_end, l_returnflag AS form, max(l_orderkey) AS n, CAST(max(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY 1, 2, 3"


@query("""SELECT entity_id, period_end, CAST(year(period_end - 7) + CASE WHEN month(period_end - 7) > fm OR (month(period_end - 7) = fm AND day(period_end - 7) > 28) THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST((array_agg(n ORDER BY shipped DESC, form DESC))[1] AS DOUBLE) AS value
    FROM reports JOIN entities USING (entity_id) WHERE form <> 'R' GROUP BY ALL HAVING CAST(year(period_end - 7) + CASE WHEN month(period_end - 7) > fm OR (month(period_end - 7) = fm AND day(period_end - 7) > 28) THEN 1 ELSE 0 END AS INTEGER) >= 1996""", reports=_REPORTS)  # fmt: skip
def employees_load(spark, sf_dir):
    """Head counts of annual reports and their amendments, from 1996 on; the form's name breaks ties of the day."""
    items = kit.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity_id"), F.date_add(F.trunc("l_shipdate", "month"), 14).alias("period_of_report"), F.col("l_returnflag").alias("form")).agg(F.max("l_orderkey").alias("employee_count"), F.to_date(F.max("l_shipdate")).alias("at"))
    form = F.when(F.col("form") == "A", "10-K").when(F.col("form") == "N", "10-K/A").otherwise("10-Q")
    rows = items.select("entity_id", "period_of_report", "employee_count", form.alias("form_type"), F.struct("at", "form").alias("published_at"))
    return reads.employees(rows, kit.entities(spark, sf_dir), 1996).select("entity_id", "period_end", "fiscal_year", F.col("value").cast("double"))


# Metrics at periods, valuations


_LONG = lambda rows, names: " UNION ALL ".join(f"SELECT entity_id, period_end, '{k}' AS metric, round(CAST({x} AS DOUBLE), 8) AS value FROM {rows}" for k, x in names.items())
_AN = {"revenue": "revenue_fy", "fcf": "cfo_fy + capital_expenditures_fy", "net_margin": safe("net_income_fy", "revenue_fy")}
_QN = {"roic": "roic", "revenue_growth_yoy": safe("revenue_ttm - revenue_ttm_prior_year", "revenue_ttm_prior_year", True), "net_debt_to_ebitda": safe("net_debt", "ebitda_ttm")}


def _read(spark, sf_dir, names, period):
    frames = {"financials": frame(spark, sf_dir), "annual": kit.annual(spark, sf_dir)}
    return screener.read_metrics(frames, None, names, period).select("entity_id", "period_end", "metric", F.round("value", 8).alias("value"))


@query(f"{_LONG('annual_wide', _AN)} UNION ALL {_LONG('anchored', _QN)}".replace("FROM annual_wide", "FROM annual_wide WHERE fiscal_year = 1997"),
       anchored="SELECT mf.*, row_number() OVER (PARTITION BY mf.entity_id ORDER BY mf.period_end DESC) AS k FROM mf JOIN (SELECT entity_id, period_end AS e FROM annual_wide WHERE fiscal_year = 1997) a ON a.entity_id = mf.entity_id AND mf.period_end <= a.e QUALIFY k = 1")
def metrics_at_fiscal_year(spark, sf_dir):
    """Annual metrics of a year beside quarterly ones as of its end, for every entity."""
    return _read(spark, sf_dir, [*_AN, *_QN], "FY1997")


@query(_LONG("q", _QN), q="SELECT * FROM mf WHERE fiscal_year = 1997 AND fiscal_quarter = 2 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) = 1")
def metrics_at_fiscal_quarter(spark, sf_dir):
    return _read(spark, sf_dir, list(_QN), "1997-Q2")


@query(_LONG("q", _QN), q="SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) <= 3")
def metrics_at_window(spark, sf_dir):
    return _read(spark, sf_dir, list(_QN), "last_3q")


@query("SELECT entity_id, period_end, 'revenue_avg' AS metric, round(revenue_avg, 4) AS value FROM est WHERE period_end >= DATE '" + TODAY + "' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY period_end) <= 2", est=_EST)
def estimates_at_forward(spark, sf_dir):
    out = screener.read_metrics({"estimates": _estimates(spark, sf_dir)}, None, ["revenue_avg"], "forward_2q", TODAY)
    return out.select("entity_id", "period_end", "metric", F.round("value", 4).alias("value"))


def _known(spark, sf_dir):
    return metrics.pit_ttm(facts.pit_pivot(facts.current(kit.facts(spark, sf_dir)), CONCEPTS, FRAME))


def _valuation(daily, known):
    rows = asof.asof_join(daily, known, "entity_id", "date", "asof_date", "period_end")
    return rows.withColumns(metrics.valuation_ratios())


def _valuation_sql(where: str) -> str:
    return f"SELECT entity_id, date, round(v, 10) AS value FROM (SELECT entity_id, date, {_V['ps_ttm']} AS v FROM known WHERE {where}) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) = 1 ORDER BY v DESC, entity_id LIMIT 20"


@query(_valuation_sql("true"))
def screen_valuation_latest(spark, sf_dir):
    """The last day of each entity is valued, not its history."""
    out = screener.valuation_screen(kit.daily(spark, sf_dir), _known(spark, sf_dir), _valuation, "ps_ttm")
    return out.select("entity_id", "date", F.round("value", 10).alias("value"))


@query(_valuation_sql("date <= DATE '1997-06-30'"))
def screen_valuation_asof(spark, sf_dir):
    out = screener.valuation_screen(kit.daily(spark, sf_dir), _known(spark, sf_dir), _valuation, "ps_ttm", "asof:1997-06-30")
    return out.select("entity_id", "date", F.round("value", 10).alias("value"))


@query(f"SELECT entity_id, date AS period_end, k AS metric, v AS value FROM (SELECT entity_id, date, {_V['pe_ttm']} AS pe_ttm, {_V['ps_ttm']} AS ps_ttm FROM known WHERE date <= DATE '1997-06-30' AND coalesce({_V['pe_ttm']}, {_V['ps_ttm']}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) = 1), LATERAL (SELECT 'pe_ttm' AS k, pe_ttm AS v UNION ALL SELECT 'ps_ttm', ps_ttm)")
def valuation_at_day(spark, sf_dir):
    frames = {"valuation": _valuation(kit.daily(spark, sf_dir), _known(spark, sf_dir))}
    return screener.read_metrics(frames, None, ["pe_ttm", "ps_ttm"], "asof:1997-06-30").select("entity_id", "period_end", "metric", "value")


@query("""SELECT entity_id, date, round(CAST(close AS DOUBLE), 4) AS close FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, date_trunc('week', date) ORDER BY date) AS k FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) <= 100""")
def price_series(spark, sf_dir):
    """The first day of each week, 100 newest rows of each entity."""
    day = lambda x: F.lit(x).cast("date")
    return reads.daily_closes(kit.daily(spark, sf_dir), None, day("1996-01-01"), day("1998-12-31"), "week", 100).select("entity_id", "date", *rounded(["close"], 4))


_BELOW = ", ".join(f"CASE WHEN any_value(l.{k}) IS NOT NULL THEN round(count(*) FILTER (WHERE v.{k} < l.{k}) / count(*), 9) END AS below_{k}" for k in ("pe_ttm", "ps_ttm", "ev_ebitda_ttm", "fcf_yield_ttm"))


@query(f"""SELECT entity_id, as_of, coalesce(n, 0) AS n_samples, min_pe_ttm, median_pe_ttm, below_pe_ttm, below_ps_ttm, below_ev_ebitda_ttm, below_fcf_yield_ttm FROM (SELECT entity_id, max(date) AS as_of FROM known GROUP BY 1) LEFT JOIN
    (SELECT v.entity_id, count(*) AS n, min(v.pe_ttm) AS min_pe_ttm, quantile_disc(v.pe_ttm, 0.5) AS median_pe_ttm, {_BELOW} FROM valued v JOIN last_ l ON v.entity_id = l.entity_id WHERE v.pe_ttm IS NOT NULL AND v.date >= l.date - 730 GROUP BY 1) USING (entity_id)""",
       valued=f"SELECT entity_id, date, {', '.join(f'{x} AS {k}' for k, x in _V.items())} FROM known", last_="SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) = 1")
def valuation_percentiles(spark, sf_dir):
    """Two years' window."""
    out = metrics.valuation_percentile(_valuation(kit.daily(spark, sf_dir), _known(spark, sf_dir)), days=730)
    below = [f"below_{k}" for k in ("pe_ttm", "ps_ttm", "ev_ebitda_ttm", "fcf_yield_ttm")]
    return out.select("entity_id", "as_of", "n_samples", "min_pe_ttm", "median_pe_ttm", *[F.round(c, 9).alias(c) for c in below])


# Findings and flags


@query("SELECT event_id AS id, user_id AS entity_id FROM events WHERE event_id % 3 = 0 AND event_type IN ('click', 'purchase')")
def estimate_warnings(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "forward_estimate_consistency").when(F.col("event_type") == "purchase", "earnings_surprise_sanity").otherwise("zero_row_runs")
    rows = kit.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), name.alias("source_check"), F.when(F.col("event_id") % 3 == 0, "open").otherwise("closed").alias("status"))
    return quality.estimate_warnings(rows).select("id", "entity_id")


_FLAG_SQL = "SELECT event_id AS id, user_id AS entity_id, ts AS flagged_at, CASE WHEN event_id % 2 = 0 THEN ts END AS resolved_at, CAST(2020 + event_id % 5 AS INTEGER) AS fiscal_year, event_type FROM events"


def _flags(spark, sf_dir):
    i, null = F.col("event_id"), F.lit(None).cast("string")
    severity = F.when(F.col("event_type") == "click", "investigate").when(F.col("event_type") == "view", "warning").otherwise("informational")
    return kit.table(spark, sf_dir, "events").select(i.alias("id"), F.col("user_id").alias("entity_id"), F.col("ts").alias("flagged_at"), F.when(i % 2 == 0, F.col("ts")).alias("resolved_at"), (2020 + i % 5).cast("int").alias("fiscal_year"), severity.alias("severity"), F.col("event_type").alias("flag_type"), null.alias("resolution"), null.alias("resolution_note"))


@query("SELECT id, CASE WHEN id % 2 <> 0 AND entity_id % 3 = 0 AND fiscal_year BETWEEN 2021 AND 2023 THEN 'superseded_by_reingest' END AS resolution, resolved_at IS NOT NULL OR (entity_id % 3 = 0 AND fiscal_year BETWEEN 2021 AND 2023) AS closed FROM f", f=_FLAG_SQL)
def flags_closed_by_reingest(spark, sf_dir):
    out = quality.close_by_reingest(_flags(spark, sf_dir), F.col("entity_id") % 3 == 0, F.lit(2021), F.lit(2023), 7, F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "resolution", F.col("resolved_at").isNotNull().alias("closed"))


@query("SELECT id, entity_id FROM f WHERE resolved_at IS NULL AND id NOT IN (1, 3, 5, 8) ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, flagged_at, id LIMIT 100", f=_FLAG_SQL)
def flags_to_review(spark, sf_dir):
    """The first hundred after some were accepted."""
    left = quality.review_flag(_flags(spark, sf_dir), [1, 3, 5, 8], "accept_as_is", "seen", F.lit("2024-02-01").cast("timestamp"))
    return quality.open_flags(left).select("id", "entity_id").limit(100)


# Documents: the driver's documents as filings and transcripts, their lines as sections, units and chunks
_DOCS = """SELECT doc_id AS artifact_id, doc_id % 20 AS entity_id, CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE 'transcript' END AS artifact_type, CAST(2020 + doc_id % 4 AS INTEGER) AS fiscal_year, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id // 4 % 4 + 1 AS INTEGER) END AS fiscal_quarter,
    CAST(make_date(2020 + doc_id % 4, CASE WHEN doc_id % 3 = 0 THEN 12 ELSE 3 * (doc_id // 4 % 4 + 1) END, 28) AS DATE) AS period_end, doc_id % 11 = 0 AS gone, text FROM documents"""
_ART = "SELECT *, period_end + CAST(artifact_id % 60 AS INTEGER) AS published, 'FY' || fiscal_year || coalesce(' Q' || fiscal_quarter, '') AS k FROM docs_"
_LINES = "SELECT artifact_id, CAST(i AS INTEGER) AS i, lines[i] AS line FROM (SELECT artifact_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT artifact_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM docs_))"


def _artifacts(spark, sf_dir):
    d = F.col("doc_id")
    annual = d % 3 == 0
    quarter = F.when(~annual, (F.floor(d / 4) % 4 + 1).cast("int"))
    year = (2020 + d % 4).cast("int")
    end = F.make_date(year, F.when(annual, F.lit(12)).otherwise(3 * quarter), F.lit(28))
    docs = kit.table(spark, sf_dir, "documents").select(d.alias("artifact_id"), (d % 20).alias("entity_id"), F.when(annual, "10-K").when(d % 3 == 1, "10-Q").otherwise("transcript").alias("artifact_type"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"), F.when(annual, "annual").otherwise("quarter").alias("period_type"), end.alias("period_end"), F.date_add(end, (d % 60).cast("int")).alias("published_at"), F.when(d % 11 == 0, end).alias("superseded_at"))
    return docs.withColumn("fiscal_period_key", F.when(F.col("fiscal_quarter").isNull(), F.format_string("FY%d", "fiscal_year")).otherwise(F.format_string("FY%d Q%d", "fiscal_year", "fiscal_quarter")))


def _parts(spark, sf_dir, name):
    """name_id, artifact_id, i, line: the lines of texts as sections or units, and as their only chunk."""
    lines = kit.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    return lines.select((F.col("artifact_id") * 1_000_000 + F.col("i") + 1).alias(f"{name}_id"), "artifact_id", (F.col("i") + 1).alias("i"), "line")


def _sections(spark, sf_dir):
    rows = _parts(spark, sf_dir, "section")
    key = F.when(F.col("i") % 3 == 1, "item_1_business").when(F.col("i") % 3 == 2, reads.FIRST_SECTION).otherwise("item_1a_risk_factors")
    return rows.select("section_id", "artifact_id", key.alias("section_key")), rows.select("section_id", F.lit(1).alias("chunk_ordinal"), F.col("line").alias("text"))


def _units(spark, sf_dir):
    rows = _parts(spark, sf_dir, "unit")
    return rows.select("unit_id", "artifact_id", F.lit("transcript").alias("unit_type"), F.col("i").alias("unit_ordinal"), F.concat(F.lit("turn_"), F.col("i").cast("string")).alias("unit_key")), rows.select("unit_id", F.lit(1).alias("chunk_ordinal"), F.col("line").alias("text"))


@query("SELECT artifact_id, entity_id, artifact_type, k AS fiscal_period_key FROM art WHERE NOT gone AND fiscal_year = 2021", docs_=_DOCS, art=_ART)
def list_documents(spark, sf_dir):
    """All entities' documents of a fiscal year."""
    return reads.list_documents(_artifacts(spark, sf_dir), None, 2021).select("artifact_id", "entity_id", "artifact_type", "fiscal_period_key")


@query("SELECT artifact_id, CASE i % 3 WHEN 1 THEN 'item_1_business' ELSE 'item_7_mda' END AS section_key, i, sha256(line) AS text_sha256 FROM lines_ JOIN art USING (artifact_id) WHERE NOT gone AND k = 'FY2022' AND i % 3 IN (1, 2)", docs_=_DOCS, art=_ART, lines_=_LINES)
def section_chunks(spark, sf_dir):
    sections, chunks = _sections(spark, sf_dir)
    out = reads.section_chunks(_artifacts(spark, sf_dir), sections, chunks, None, "FY2022", ["item_1_business", reads.FIRST_SECTION])
    return out.select("artifact_id", "section_key", (F.col("section_id") % 1_000_000).cast("int").alias("i"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT artifact_id, i, k = 'FY2021' AS exact FROM lines_ JOIN art USING (artifact_id) WHERE NOT gone AND (k = 'FY2021' OR (fiscal_year = 2021 AND fiscal_quarter = 4))", docs_=_DOCS, art=_ART, lines_=_LINES)
def unit_chunks(spark, sf_dir):
    """A year's units, and those of its fourth quarter."""
    units, chunks = _units(spark, sf_dir)
    out = reads.unit_chunks(_artifacts(spark, sf_dir), units, chunks, None, "FY2021", "transcript", (2021, F.lit("2021-12-28").cast("date")))
    return out.select("artifact_id", F.col("unit_ordinal").alias("i"), "exact")


@query("SELECT source, count(*) AS n, count(DISTINCT artifact_id) AS artifacts FROM (SELECT 'section' AS source, artifact_id FROM lines_ UNION ALL SELECT 'unit', artifact_id FROM lines_) JOIN art USING (artifact_id) WHERE NOT gone GROUP BY 1", docs_=_DOCS, art=_ART, lines_=_LINES)
def chunk_sources(spark, sf_dir):
    (sections, a), (units, b) = _sections(spark, sf_dir), _units(spark, sf_dir)
    return reads.all_chunks(_artifacts(spark, sf_dir), sections, a, units, b).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("artifacts"))


_LAST = "SELECT artifact_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC, published DESC, artifact_id DESC) AS n FROM art WHERE NOT gone AND artifact_type = 'transcript' AND published <= DATE '2023-06-30'"


@query("SELECT artifact_id, entity_id, n, c AS turn_count, c AS chunk_count FROM last_ JOIN (SELECT artifact_id, count(*) AS c FROM lines_ GROUP BY 1) USING (artifact_id) WHERE n <= 4", docs_=_DOCS, art=_ART, lines_=_LINES, last_=_LAST)
def latest_transcripts(spark, sf_dir):
    units, chunks = _units(spark, sf_dir)
    out = reads.latest_transcripts(_artifacts(spark, sf_dir), units, chunks, None, 4, F.lit("2023-06-30").cast("date"))
    return out.select("artifact_id", "entity_id", F.col("n").cast("long"), "turn_count", "chunk_count")


@query("SELECT artifact_id, entity_id, n, i FROM last_ JOIN lines_ USING (artifact_id) WHERE n <= 2", docs_=_DOCS, art=_ART, lines_=_LINES, last_=_LAST)
def transcript_turns(spark, sf_dir):
    units, _ = _units(spark, sf_dir)
    out = reads.transcript_turns(_artifacts(spark, sf_dir), units, None, 2, F.lit("2023-06-30").cast("date"))
    return out.select("artifact_id", "entity_id", F.col("n").cast("long"), F.col("unit_ordinal").alias("i"))


@query(r"""SELECT doc_id, regexp_replace(regexp_extract(text, '(?is)(?:^|\W)(.{0,60}\b(?:apache|license)\b.{0,60})', 1), '(?i)\b(apache|license)\b', '<b>\1</b>', 'g') AS headline FROM documents WHERE regexp_extract(text, '(?is)(?:^|\W)(.{0,60}\b(?:apache|license)\b.{0,60})', 1) <> '' AND source <> 'x'""")
def search_headlines(spark, sf_dir):
    rows = kit.table(spark, sf_dir, "documents").select("doc_id", reads.highlighted(F.col("text"), ["apache", "license"]).alias("headline"))
    return rows.where("headline IS NOT NULL")
