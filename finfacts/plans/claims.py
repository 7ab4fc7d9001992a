"""Queries of answers' claims, calls' turns and roles, and co-marked periods; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import calls, grounding
from .finance import query

_WS = r"[\x20\x09-\x0D\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PLAIN = f"trim(regexp_replace(lower(%s), '{_WS}+', ' ', 'g'))"
_CLAIMS = {
    "quoted": """SELECT doc_id, text, substr(regexp_replace(coalesce(text, ''), '["\\[\\]]', '~', 'g'), CAST(length(coalesce(text, '')) // 2 AS BIGINT) + 1, 60) AS q, CASE WHEN doc_id % 7 = 0 THEN 'S:none' || doc_id WHEN doc_id % 5 = 0 THEN 'T:d' || (doc_id + 1) ELSE 'T:d' || doc_id END AS tc FROM documents""",
    "told": f"SELECT *, regexp_replace(q, '^{_WS}+|{_WS}+$', '', 'g') AS said, (doc_id * 7919) % 500000 AS x, (doc_id * 31) % 1000 AS p, 'F:c' || doc_id AS fc, 'M:c' || doc_id AS mc FROM quoted",
    "amounts": "SELECT doc_id, 'money' AS kind, fc AS cite, CASE WHEN doc_id % 2 = 1 THEN '$' || x ELSE '$' || x // 1000 || ' thousand' END AS said, CAST(CASE WHEN doc_id % 2 = 1 THEN x ELSE x // 1000 * 1000 END AS DOUBLE) AS value FROM (SELECT * FROM told UNION ALL SELECT * REPLACE (mc AS fc) FROM told) UNION ALL SELECT doc_id, 'percent', mc, (p // 10) || '.' || (p % 10) || '%', CAST((p // 10) || '.' || (p % 10) AS DOUBLE) / 100 FROM told",
    "numbers": "SELECT 'F:c' || o_custkey AS cite, o_totalprice AS number FROM orders UNION ALL SELECT 'M:c' || o_custkey, o_totalprice / 5e5 FROM orders",
    "passages": "SELECT 'T:d' || doc_id AS cite, text FROM documents",
    "near": "SELECT a.doc_id, a.kind, a.cite, min({'d': abs(value - number), 'n': number}) FILTER (WHERE abs(value - number) <= CASE kind WHEN 'money' THEN 0.5 ELSE 0.005 END OR abs(value - number) <= 0.05 * greatest(abs(value), abs(number))).n AS nearest, count(number) AS seen FROM amounts a LEFT JOIN numbers n ON n.cite = a.cite GROUP BY 1, 2, 3",
    "checked": f"""SELECT doc_id, 'citation' AS kind, cite, CASE WHEN cite IN (SELECT cite FROM passages UNION ALL SELECT cite FROM numbers) THEN 'known' ELSE 'unknown' END AS verdict, CAST(NULL AS DOUBLE) AS nearest FROM (SELECT doc_id, tc AS cite FROM told UNION ALL SELECT doc_id, fc FROM told UNION ALL SELECT doc_id, mc FROM told)
        UNION ALL SELECT t.doc_id, 'quote', tc, CASE WHEN count(s.text) = 0 THEN 'unchecked' WHEN bool_or(contains({_PLAIN % 's.text'}, {_PLAIN % 't.said'})) THEN 'found' ELSE 'missing' END, NULL FROM told t LEFT JOIN passages s ON s.cite = t.tc WHERE length(q) >= 4 AND length(said) >= 6 GROUP BY ALL
        UNION ALL SELECT doc_id, kind, cite, CASE WHEN seen = 0 THEN 'unchecked' WHEN nearest IS NULL THEN 'far' ELSE 'near' END, nearest FROM amounts JOIN near USING (doc_id, kind, cite)""",
}


def answers(spark, sf_dir):
    """An answer per document: a quotation of it (some cite another document or none there is), an amount and a percentage of a customer's orders."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    said = F.substring(F.regexp_replace(text, r'["\[\]]', "~"), F.floor(F.length(text) / 2).cast("int") + 1, F.lit(60))
    cite = F.when(d % 7 == 0, F.concat(F.lit("S:none"), d)).when(d % 5 == 0, F.concat(F.lit("T:d"), d + 1)).otherwise(F.concat(F.lit("T:d"), d))
    x, p = d * 7919 % 500000, d * 31 % 1000
    amount = F.when(d % 2 == 1, F.concat(F.lit("$"), x)).otherwise(F.concat(F.lit("$"), F.floor(x / 1000), F.lit(" thousand")))
    share = F.concat(F.floor(p / 10), F.lit("."), p % 10, F.lit("%"))
    return kit.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('They say "'), said, F.lit('" ['), cite, F.lit("]. Sales were "), amount, F.lit(" [F:c"), d, F.lit("], a share of "), share, F.lit(" [M:c"), d, F.lit("].")).alias("answer"))


def _checked(spark, sf_dir, asked):
    found = grounding.claims(asked, "doc_id", "answer")
    orders = kit.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    number = lambda kind, scale: orders.select(F.concat(F.lit(kind), "o_custkey").alias("cite"), (F.col("o_totalprice") / scale).alias("number"))
    passages = kit.table(spark, sf_dir, "documents").select(F.concat(F.lit("T:d"), "doc_id").alias("cite"), "text")
    return grounding.grounded(found, passages, number("F:c", 1.0).unionByName(number("M:c", 5e5)), shared=True, key="doc_id")


@query("SELECT * FROM checked", **_CLAIMS)
def grounded_claims(spark, sf_dir):
    """Every claim of the answers with its verdict."""
    return _checked(spark, sf_dir, answers(spark, sf_dir)).select("doc_id", "kind", "cite", "verdict", "nearest")


@query("""SELECT doc_id, count(*) FILTER (WHERE kind = 'citation') AS citations, count(*) FILTER (WHERE verdict = 'unknown') AS unknown, count(*) FILTER (WHERE verdict = 'missing') AS missing, count(*) FILTER (WHERE verdict = 'far') AS far,
    CASE WHEN count(*) FILTER (WHERE verdict = 'unknown') > 0 THEN 'unverified' ELSE 'verified' END AS status FROM checked GROUP BY 1""", **_CLAIMS)  # fmt: skip
def graded_answers(spark, sf_dir):
    """A row per answer."""
    asked = answers(spark, sf_dir)
    return grounding.graded(asked, _checked(spark, sf_dir, asked), "doc_id")


_STAMP = "format('[{:02d}:{:02d}-{:02d}:{:02d}] Speaker {}', (37 * k // 60) % 90, 37 * k % 60, (37 * k // 60) % 90 + 1, 37 * k % 60, k % 4)"


@query(
    """SELECT doc_id, CAST(k AS INTEGER) AS ordinal, 'Speaker ' || k % 4 AS speaker, CAST((37 * k // 60) % 90 * 60 + 37 * k % 60 AS INTEGER) AS start_sec, CAST((37 * k // 60) % 90 * 60 + 60 + 37 * k % 60 AS INTEGER) AS end_sec, sha256(coalesce(string_agg(line, ' ' ORDER BY i) FILTER (WHERE line <> ''), '')) AS text_sha256
    FROM (SELECT doc_id, i, i // 3 AS k, trim(line) AS line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[^\\x21-\\x7E\\x{C0}-\\x{FF}\\n]+', ' ', 'g'), chr(10)) AS ls FROM documents))) GROUP BY doc_id, k"""
)
def timed_turns(spark, sf_dir):
    """The documents as scripts, a header before every third line."""
    clean = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7E\x{C0}-\x{FF}\n]+", " "), "\n")

    def headed(line, i):
        k = F.floor(i / 3)
        minute = F.floor(37 * k / 60) % 90
        return F.when(i % 3 == 0, F.concat(F.format_string("[%02d:%02d-%02d:%02d] Speaker %d\n", minute, 37 * k % 60, minute + 1, 37 * k % 60, k % 4), line)).otherwise(line)

    scripts = kit.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(clean, headed), "\n").alias("script"))
    return calls.timed_turn_documents(scripts, ["doc_id"], "script").select("doc_id", "ordinal", "speaker", "start_sec", "end_sec", F.sha2("text", 256).alias("text_sha256"))


_SAID = """coalesce(text, '') || CASE n % 5 WHEN 2 THEN ' Here are Ann Berg, our Chair and CEO, and Lu Chen, Executive Vice President, CFO.' WHEN 3 THEN ' I now hand the call over to Lu.' WHEN 0 THEN ' Our next question comes from the line of Bo Lund with Acme Bank.' ELSE '' END"""


@query(
    """SELECT conv_id, l.label, CASE WHEN l.label = l.op THEN 'operator' WHEN o.role IS NOT NULL THEN o.role WHEN a.label IS NOT NULL THEN 'analyst' ELSE 'other' END AS role,
        CASE WHEN l.label = l.op THEN 'Operator' WHEN o.role = 'ir' THEN 'Investor Relations' WHEN o.role = 'ceo' THEN CASE WHEN o.told THEN 'Ann Berg' END WHEN o.role = 'cfo' THEN CASE WHEN o.told THEN 'Lu Chen' END WHEN a.label IS NOT NULL THEN 'Bo Lund with Acme Bank' ELSE l.label END AS name,
        CASE WHEN l.label = l.op OR o.role IS NOT NULL OR a.label IS NOT NULL THEN 'structural' ELSE 'unknown' END AS source
    FROM (SELECT DISTINCT conv_id, label, op FROM segs) l LEFT JOIN officers o USING (conv_id, label) LEFT JOIN analysts a USING (conv_id, label)""",
    numbered="SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations",
    segs=f"SELECT *, first(label) OVER (PARTITION BY conv_id ORDER BY n) AS op, lag(label) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM (SELECT conv_id, n, 'SPK_' || (conv_id + CASE n % 4 WHEN 1 THEN 0 ELSE n END) % 7 AS label, {_SAID} AS said FROM numbered)",
    runs="SELECT *, sum(CASE WHEN label = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY n) AS island FROM segs",
    blocks="SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY island) AS k FROM (SELECT conv_id, island, label, bool_or(contains(said, 'hand the call over')) AS handed, bool_or(contains(said, 'Chair and CEO')) AS told FROM runs WHERE label <> op GROUP BY ALL)",
    first_blocks="SELECT conv_id, label, min(k) AS k FROM blocks GROUP BY ALL",
    turning="SELECT conv_id, min(k) FILTER (WHERE handed AND k > 1) AS h, bool_or(told) FILTER (WHERE k = 1) AS told FROM blocks GROUP BY 1",
    officers="SELECT * FROM (SELECT conv_id, label, told, CASE WHEN k = 1 THEN 'ir' WHEN h IS NULL OR k <= h THEN 'ceo' WHEN k = h + 1 THEN 'cfo' END AS role FROM first_blocks JOIN turning USING (conv_id)) WHERE role IS NOT NULL",
    analysts="SELECT DISTINCT conv_id, label FROM (SELECT s.conv_id, f.label, row_number() OVER (PARTITION BY s.conv_id, s.n ORDER BY f.n) AS c FROM segs s JOIN segs f ON f.conv_id = s.conv_id AND f.n BETWEEN s.n + 1 AND s.n + 7 WHERE contains(s.said, 'question comes from') AND f.label <> f.op AND (f.conv_id, f.label) NOT IN (SELECT (conv_id, label) FROM officers)) WHERE c = 1",
)
def call_roles(spark, sf_dir):
    """Conversations as calls of seven voices, with names, a handing over and announced questions said."""
    c = kit.table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(kit.Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    n = F.col("n")
    more = F.when(n % 5 == 2, " Here are Ann Berg, our Chair and CEO, and Lu Chen, Executive Vice President, CFO.").when(n % 5 == 3, " I now hand the call over to Lu.").when(n % 5 == 0, " Our next question comes from the line of Bo Lund with Acme Bank.").otherwise("")
    segments = c.select("conv_id", "n", F.concat(F.lit("SPK_"), (F.col("conv_id") + F.when(n % 4 == 1, 0).otherwise(n)) % 7).alias("label"), F.concat(F.coalesce("text", F.lit("")), more).alias("said"))
    return calls.speaker_roles(segments, "conv_id", "n", "label", "said")
