"""Queries of XBRL filings: the driver's facts written out as instance documents and linkbases, and read back; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import scan
from ..sources import xbrl
from .finance import query

# Element names of the taxonomy.
TAGS = {
    "revenue": "Revenues", "cogs": "CostOfRevenue", "gross_profit": "GrossProfit", "rd": "ResearchAndDevelopmentExpense", "operating_income": "OperatingIncomeLoss", "interest_expense": "InterestExpense", "ebt_incl_unusual": "IncomeLossBeforeIncomeTaxes", "tax": "IncomeTaxExpenseBenefit", "net_income": "NetIncomeLoss",
    "total_assets": "Assets", "cash_and_equivalents": "CashAndCashEquivalentsAtCarryingValue", "accounts_receivable": "AccountsReceivableNetCurrent", "inventory": "InventoryNet",
}
#: Calculation arcs of the filings: role, parent, child, weight. Operating income has another sum than its children, as have assets.
NETWORK = [
    ("income", "net_income", "ebt_incl_unusual", 1), ("income", "net_income", "tax", -1), ("income", "ebt_incl_unusual", "operating_income", 1), ("income", "ebt_incl_unusual", "interest_expense", -1), ("income", "operating_income", "gross_profit", 1), ("income", "operating_income", "rd", -1),
    ("income", "gross_profit", "revenue", 1), ("income", "gross_profit", "cogs", -1), ("balance", "total_assets", "cash_and_equivalents", 1), ("balance", "total_assets", "accounts_receivable", 1), ("balance", "total_assets", "inventory", 1),
]
#: The arc that closes a cycle in the filings of every tenth entity.
CLOSING = ("income", "revenue", "net_income", 1)
STOCKS = [c for r, p, c, _ in NETWORK if r == "balance"] + ["total_assets"]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, instance, linkbase: a filing of all quarters per entity. Every seventh entity doesn't report interest."""
    rows = kit.picked(spark, sf_dir, list(TAGS)).where("NOT (concept = 'interest_expense' AND entity_id % 7 = 0)")
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv]), F.col("concept"))
    instant = F.col("concept").isin(STOCKS)
    ref = F.concat(F.when(instant, "i").otherwise("d"), F.col("period_end").cast("string"))
    period = F.when(instant, F.concat(F.lit("<instant>"), "period_end", F.lit("</instant>"))).otherwise(F.concat(F.lit("<startDate>"), F.trunc("period_end", "quarter"), F.lit("</startDate><endDate>"), "period_end", F.lit("</endDate>")))
    context = F.concat(F.lit('<context id="'), ref, F.lit('"><entity><identifier scheme="x">'), "entity_id", F.lit("</identifier></entity><period>"), period, F.lit("</period></context>"))
    fact = F.concat(F.lit("<us-gaap:"), tag, F.lit(' contextRef="'), ref, F.lit('" unitRef="u1" decimals="4">'), F.col("value").cast("string"), F.lit("</us-gaap:"), tag, F.lit(">"))
    joined = lambda c: F.array_join(F.sort_array(c), "\n")
    said = rows.groupBy("entity_id").agg(joined(F.collect_set(context)).alias("contexts"), joined(F.collect_list(fact)).alias("facts"))
    instance = F.concat(F.lit('<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2024"><unit id="u1"><measure>iso4217:USD</measure></unit>'), "contexts", "facts", F.lit("</xbrl>"))

    def link(role: str, arcs: list[tuple]) -> str:
        names = sorted({c for _, p, c, _ in arcs} | {p for _, p, _, _ in arcs})
        locs = "".join(f'<loc xlink:type="locator" xlink:href="x.xsd#us-gaap_{TAGS[c]}" xlink:label="loc_{c}"/>' for c in names)
        ends = "".join(f'<calculationArc xlink:from="loc_{p}" xlink:to="loc_{c}" weight="{w}" order="{i}"/>' for i, (_, p, c, w) in enumerate(arcs))
        return f'<calculationLink xlink:role="{role}">{locs}{ends}</calculationLink>'

    def base(arcs: list[tuple]) -> str:
        return '<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink">' + "".join(link(r, [a for a in arcs if a[0] == r]) for r in ("income", "balance")) + "</linkbase>"

    linkbase = F.when(F.col("entity_id") % 10 == 3, base([*NETWORK, CLOSING])).otherwise(base(NETWORK))
    return said.select("entity_id", instance.alias("instance"), linkbase.alias("linkbase"))


def _arcs_sql() -> str:
    rows = ", ".join(f"({cyc}, '{r}', '{p}', '{c}', {w})" for cyc in (False, True) for r, p, c, w in [*NETWORK, *([CLOSING] if cyc else [])])
    return f"SELECT * FROM (VALUES {rows}) t(cyc, role, parent, child, w)"


_NAMES = ", ".join(f"('{c}', '{t}')" for c, t in TAGS.items())
_SQL = {
    "vals": f"SELECT entity_id, entity_id % 10 = 3 AS cyc, concept, period_end, value AS v FROM cur WHERE rn = 1 AND concept IN ({', '.join(repr(c) for c in TAGS)}) AND NOT (concept = 'interest_expense' AND entity_id % 7 = 0)",
    "arcs": _arcs_sql(),
    "ways": """SELECT * FROM (WITH RECURSIVE w(cyc, role, top, node, w, path, closed) AS (SELECT cyc, role, parent, child, CAST(w AS BIGINT), [parent, child], parent = child FROM arcs
        UNION ALL SELECT w.cyc, w.role, w.top, a.child, w.w * a.w, list_append(w.path, a.child), list_contains(w.path, a.child) FROM w JOIN arcs a ON a.cyc = w.cyc AND a.role = w.role AND a.parent = w.node WHERE NOT w.closed) SELECT * FROM w)""",
    "leaves": "SELECT cyc, role, top, node, sum(w) AS w FROM ways WHERE NOT closed AND (cyc, role, node) NOT IN (SELECT (cyc, role, parent) FROM arcs) AND (cyc, role, top) NOT IN (SELECT (cyc, role, top) FROM ways WHERE closed) GROUP BY ALL",
    "near": "SELECT p.entity_id, a.role, a.parent, p.period_end, count(*) AS children, count(c.v) AS seen, sum(a.w * c.v) AS s FROM vals p JOIN arcs a ON a.cyc = p.cyc AND a.parent = p.concept LEFT JOIN vals c ON c.entity_id = p.entity_id AND c.period_end = p.period_end AND c.concept = a.child GROUP BY ALL",
    "deep": "SELECT p.entity_id, a.role, a.top AS parent, p.period_end, CASE WHEN count(*) = count(c.v) THEN sum(a.w * c.v) END AS s FROM vals p JOIN leaves a ON a.cyc = p.cyc AND a.top = p.concept LEFT JOIN vals c ON c.entity_id = p.entity_id AND c.period_end = p.period_end AND c.concept = a.node GROUP BY ALL",
    "names": f"SELECT * FROM (VALUES {_NAMES}) t(concept, tag)",
}


@query(
    """SELECT p.entity_id, n.role, t.tag AS parent, count(*) AS n, CAST(sum(n.children - n.seen) AS BIGINT) AS missing, count(*) FILTER (WHERE abs(p.v - n.s) <= greatest(1, abs(p.v) * 1e-4)) AS ties, count(d.s) AS deep, count(*) FILTER (WHERE abs(p.v - d.s) <= greatest(1, abs(p.v) * 1e-4)) AS deep_ties,
    CAST(round(max(abs(p.v - n.s)), 3) AS DOUBLE) AS worst FROM near n JOIN vals p ON p.entity_id = n.entity_id AND p.concept = n.parent AND p.period_end = n.period_end JOIN names t ON t.concept = n.parent
    LEFT JOIN deep d ON d.entity_id = n.entity_id AND d.role = n.role AND d.parent = n.parent AND d.period_end = n.period_end GROUP BY 1, 2, 3""",
    **_SQL,
)
def xbrl_calculations(spark, sf_dir):
    """Every reported parent of the filings' calculation networks against its children and its leaves."""
    found = filings(spark, sf_dir)
    out = xbrl.check(xbrl.facts(found, "entity_id", "instance"), xbrl.network(xbrl.arcs(found, "entity_id", "linkbase"), "entity_id"), "entity_id")
    return out.groupBy("entity_id", "role", "parent").agg(
        F.count("*").alias("n"), F.sum("missing").alias("missing"), F.count_if("ties").alias("ties"), F.count("from_leaves").alias("deep"), F.count_if("leaves_tie").alias("deep_ties"), F.round(F.max(F.abs(F.col("value") - F.col("from_children"))), 3).cast("double").alias("worst")
    )


@query("SELECT DISTINCT entity_id, 'income' AS role, array_to_string(['GrossProfit', 'Revenues', 'NetIncomeLoss', 'IncomeLossBeforeIncomeTaxes', 'OperatingIncomeLoss'], ' > ') AS members FROM vals WHERE cyc", **_SQL)
def xbrl_cycles(spark, sf_dir):
    """Cycles of the calculation networks."""
    net = xbrl.network(xbrl.arcs(filings(spark, sf_dir), "entity_id", "linkbase"), "entity_id")
    return xbrl.cycles(xbrl.walks(net, "entity_id"), "entity_id").select("entity_id", "role", F.array_join("members", " > ").alias("members"))


@query("SELECT v.entity_id, t.tag AS concept, 'USD' AS unit, count(*) AS n, CAST(sum(v.v) AS DOUBLE) AS total, min(CASE WHEN t.concept NOT IN ('total_assets', 'cash_and_equivalents', 'accounts_receivable', 'inventory') THEN CAST(date_trunc('quarter', v.period_end) AS DATE) END) AS first_start, max(v.period_end) AS last_end FROM vals v JOIN names t USING (concept) GROUP BY ALL", **_SQL)
def xbrl_facts(spark, sf_dir):
    """Facts of the filings by concept, with what their contexts and units say."""
    rows = xbrl.facts(filings(spark, sf_dir), "entity_id", "instance")
    return rows.groupBy("entity_id", "concept", "unit").agg(F.count("*").alias("n"), F.sum("number").cast("double").alias("total"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


_HEADS = ("Item 2. Management's Discussion and Analysis of Financial Condition", "Item 3. Quantitative and Qualitative Disclosures About Market Risk", "Item 1A. Risk Factors")
_FRONT = ["TABLE OF CONTENTS", "Item 2. Management's Discussion and Analysis ........ 12", "Item 1A. Risk Factors ........ 42", "Part I"]


def quarterly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, form, body: every document's words as the three sections of a quarterly report, by thirds, after a table of contents."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    third = F.floor(F.length(said) / 3).cast("int")
    parts = [F.concat(F.substring(said, F.lit(i) * third + 1, third), F.lit(" and so it went on for us all.")) for i in range(3)]
    lines = [*map(F.lit, _FRONT), F.lit(_HEADS[0]), parts[0], F.lit(_HEADS[1]), parts[1], F.lit("17"), F.lit("Part II - Other Information"), F.lit(_HEADS[2]), parts[2], F.lit("Item 6. Exhibits"), F.lit("The exhibits of this report."), F.lit("SIGNATURES")]
    return kit.table(spark, sf_dir, "documents").select("doc_id", F.lit("10-Q").alias("form"), F.array_join(F.array(*lines), "\n").alias("body"))


@query(
    f"""SELECT doc_id, section, part, "start", "end", words, round(CASE WHEN sure THEN conf ELSE greatest(0.01, least(0.84, conf - 0.2)) END, 3) AS confidence, CASE WHEN sure THEN 'deterministic' ELSE 'repair' END AS method FROM (
        SELECT *, 1.0 - 0.15 * CAST("start" < size // 20 AS INTEGER) - 0.05 * CAST(words < 15 AS INTEGER) AS conf, min(1.0 - 0.15 * CAST("start" < size // 20 AS INTEGER) - 0.05 * CAST(words < 15 AS INTEGER)) OVER (PARTITION BY doc_id) >= 0.85 AS sure FROM (
            SELECT doc_id, 'mdna' AS section, 'i' AS part, s0 AS "start", e0 AS "end", w[1] + {len(_HEADS[0].split())} AS words, size FROM placed UNION ALL SELECT doc_id, 'market_risk', 'i', e0 + 1, e1, w[2] + {len(_HEADS[1].split())}, size FROM placed
            UNION ALL SELECT doc_id, 'risk_factors', 'ii', e1 + {len('17') + len('Part II - Other Information') + 3}, e2, w[3] + {len(_HEADS[2].split())}, size FROM placed))""",
    thirds="SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS said, length(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))) // 3 AS n FROM documents",
    parts="SELECT doc_id, [substr(said, 1, n) || ' and so it went on for us all.', substr(said, n + 1, n) || ' and so it went on for us all.', substr(said, 2 * n + 1, n) || ' and so it went on for us all.'] AS p FROM thirds",
    placed=f"""SELECT doc_id, {sum(map(len, _FRONT)) + len(_FRONT)} AS s0, s0 + {len(_HEADS[0]) + 1} + length(p[1]) AS e0, e0 + {len(_HEADS[1]) + 2} + length(p[2]) AS e1, e1 + {len('17') + len('Part II - Other Information') + len(_HEADS[2]) + 4} + length(p[3]) AS e2,
        e2 + {len('Item 6. Exhibits') + len('The exhibits of this report.') + len('SIGNATURES') + 3} AS size, [CAST(len(list_filter(string_split(x, ' '), lambda y: y <> '')) AS INTEGER) FOR x IN p] AS w FROM parts""",
)
def filing_scan(spark, sf_dir):
    """Sections found in quarterly reports; the SQL says where they were put."""
    return scan.filing_sections(quarterly_reports(spark, sf_dir), "doc_id", "body", "form").select("doc_id", "section", "part", "start", "end", "words", "confidence", "method")
