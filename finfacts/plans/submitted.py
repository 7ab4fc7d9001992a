"""Query of submission lists and file indexes: the driver's orders as filings, their items as files; with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..sources import submissions
from .finance import query

_FORM = ["10-K", "10-Q", "8-K", "10-K/A", "4", "8-K/A"]
_NAME = {1: "'d' || k || '.htm'", 2: "'g' || k || 'ex99_1.htm'", 3: "'q2fy24pr' || k || '.htm'", 4: "'pressrelease' || k || '.pdf'", 5: "'other' || k || '.htm'", 6: "'ex9912' || k || '.htm'", 7: "'Exhibit99-' || k || '.TXT'"}


def lists(spark, sf_dir):
    """A list of each customer's orders and an older part of it; the older part repeats some under another form."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    form = lambda n: F.element_at(F.array(*[F.lit(f) for f in _FORM]), (n % 6 + 1).cast("int"))
    o = kit.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), k.alias("k"), day.alias("day"), F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array((k % 2).cast("int")))).alias("shard"))
    k = F.col("k")
    row = F.struct(
        k, F.concat(F.lit("a"), k).alias("accessionNumber"), form(F.when((F.col("shard") == 1) & (k % 10 == 0), k + 1).otherwise(k)).alias("form"), F.col("day").cast("string").alias("filingDate"), F.when(k % 11 == 0, "").otherwise(F.date_sub("day", 30).cast("string")).alias("reportDate"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("d"), k, F.lit(".htm"))).alias("primaryDocument"), F.when(k % 4 < 2, "5.02").otherwise("9.01, 2.02").alias("items"),
    )
    groups = o.groupBy("entity_id", "shard").agg(F.sort_array(F.collect_list(row)).alias("r"))
    table = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "items")])
    return groups.select("entity_id", "shard", F.when(F.col("shard") == 0, F.to_json(F.struct(F.struct(table.alias("recent")).alias("filings")))).otherwise(F.to_json(table)).alias("body"))


def indexes(spark, sf_dir):
    items, orders = kit.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")), kit.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", F.col("l_orderkey"))
    name = F.expr("CASE l_linenumber " + " ".join(f"WHEN {n} THEN {x}" for n, x in _NAME.items()) + " END")
    file = F.struct(F.col("l_linenumber").alias("n"), name.alias("name"), F.when(F.col("l_suppkey") % 3 == 0, "EX-99.1").alias("type"), F.when(F.col("l_suppkey") % 5 == 0, "The Press Release").alias("description"))
    files = rows.groupBy("o_custkey", "k").agg(F.sort_array(F.collect_list(file)).alias("item"))
    return files.select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("a"), "k").alias("accession_number"), F.to_json(F.struct(F.struct("item").alias("directory"))).alias("body"))


_EFF = "(day - 37)"
_YEAR = f"CAST(year({_EFF}) + CASE WHEN month({_EFF}) > fm OR (month({_EFF}) = fm AND day({_EFF}) > 28) THEN 1 ELSE 0 END AS INTEGER)"


@query(
    """SELECT entity_id, 'a' || k AS document_id, CASE WHEN form LIKE '10-K%' THEN '10k' WHEN form LIKE '10-Q%' THEN '10q' ELSE '8k' END AS artifact_type, 'd' || k || '.htm' AS filename, form LIKE '%/A' AS amended, fiscal_year, NULL AS reason FROM taken
    UNION ALL SELECT entity_id, 'a' || k || ':' || name, 'press_release', name, form LIKE '%/A', NULL, reason FROM taken JOIN files_ USING (k) WHERE form LIKE '8-K%' AND reason IS NOT NULL AND l_linenumber <> 1""",
    listed=f"SELECT o_custkey AS entity_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, {_FORM!r}[o_orderkey % 6 + 1] AS form, o_custkey % 12 + 1 AS fm FROM orders WHERE o_orderkey % 13 <> 0",
    told_=f"SELECT *, CASE WHEN form LIKE '10-%' AND k % 11 <> 0 THEN {_YEAR} END AS fiscal_year, CASE WHEN make_date(1996, fm, 28) >= DATE '1996-05-15' THEN 1996 ELSE 1997 END AS y0, CASE WHEN make_date(1998, fm, 28) <= DATE '1998-05-15' THEN 1998 ELSE 1997 END AS y1 FROM listed",
    taken="SELECT * FROM told_ WHERE (form LIKE '10-%' AND fiscal_year BETWEEN y0 AND y1) OR (form LIKE '8-K%' AND k % 4 >= 2 AND day BETWEEN DATE '1996-05-15' AND DATE '1998-05-15')",
    files_="SELECT *, CASE WHEN l_linenumber = 4 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'type_ex99' WHEN l_suppkey % 5 = 0 THEN 'description_press_release' WHEN l_linenumber IN (2, 7) THEN 'filename_ex99_1' WHEN l_linenumber = 3 THEN 'filename_quarterly_pr' END AS reason FROM (SELECT l_orderkey AS k, l_linenumber, min(l_suppkey) AS l_suppkey, CASE l_linenumber " + " ".join(f"WHEN {n} THEN {x.replace('k ', 'l_orderkey ')}" for n, x in _NAME.items()) + " END AS name FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def filing_documents(spark, sf_dir):
    """Reports of whole fiscal years within two years, and current reports on results with their press releases."""
    day = lambda x: F.lit(x).cast("date")
    entities = kit.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.format_string("%02d-28", F.col("c_custkey") % 12 + 1).alias("fiscal_year_end_md"))
    wanted = submissions.wanted_filings(submissions.submission_filings(lists(spark, sf_dir)), entities, day("1996-05-15"), day("1998-05-15"))
    out = submissions.filing_documents(wanted, submissions.index_files(indexes(spark, sf_dir)))
    return out.select("entity_id", "document_id", "artifact_type", "filename", "amended", "fiscal_year", "reason")
