"""Coverage of all eight verticals at both levels; with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import facts, quality
from .finance import query

_STATEMENTS = ("income_statement", "balance_sheet", "cash_flow")
_SQL = {
    "papers": "SELECT doc_id, doc_id % 10 AS entity_id, ['10k', '10q', 'press_release', 'transcript', 'exhibit'][doc_id % 5 + 1] AS kind, 'FY' || (2018 + doc_id % 6) || ' Q' || (1 + doc_id % 4) AS key, DATE '2018-02-01' + CAST(doc_id % 2000 AS INTEGER) AS held FROM documents WHERE doc_id % 9 <> 4",
    "brands": "SELECT DISTINCT l_suppkey AS entity_id, year(l_shipdate) AS y, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "seen": f"""SELECT 'financials' AS vertical, entity_id, CAST(period_end AS VARCHAR) AS period, period_end AS held, fiscal_period_label || ' quarter' AS bucket FROM facts WHERE superseded_at IS NULL AND statement IN {_STATEMENTS}
        UNION ALL SELECT 'employees', entity_id, CAST(period_end AS VARCHAR), period_end, fiscal_period_label || ' quarter' FROM facts WHERE superseded_at IS NULL AND statement = 'metrics'
        UNION ALL SELECT 'segments', entity_id, CAST(y AS VARCHAR), make_date(y, 12, 31), 'FY' || y || ' annual' FROM brands
        UNION ALL SELECT CASE WHEN kind IN ('10k', '10q') THEN 'sec_qual' ELSE kind END, entity_id, key, held, kind || ' ' || doc_id FROM papers WHERE kind <> 'exhibit'
        UNION ALL SELECT 'prices', entity_id, CAST(date AS VARCHAR), date, strftime(date, '%Y-%m') FROM daily
        UNION ALL SELECT 'estimates', user_id, CAST(last_day(ts) AS VARCHAR), last_day(ts), event_type || ' ' || last_day(ts) FROM events""",
    "levels": "SELECT entity_id, vertical, 'vertical' AS level, NULL AS bucket, count(*) AS n_rows, count(DISTINCT period) AS periods, min(held) AS earliest, max(held) AS latest FROM seen GROUP BY 1, 2 UNION ALL SELECT entity_id, vertical, 'bucket', bucket, count(*), count(DISTINCT period), min(held), max(held) FROM seen GROUP BY 1, 2, 4",
}


def verticals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Current facts by statement, annual segments, documents as papers of ten entities, shipments as prices of their day by month, events as estimates."""

    def now(*statements: str) -> DataFrame:
        rows = kit.facts(spark, sf_dir, dealt=False, concepts=[c for c, s in kit.STATEMENT.items() if s in statements], valued=False)
        return facts.current(rows).select("entity_id", F.col("period_end").alias("period"), F.col("period_end").alias("at"), F.concat("fiscal_period_label", F.lit(" "), "period_type").alias("bucket"))

    day = F.to_date("l_shipdate")
    d = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("10k", "10q", "press_release", "transcript", "exhibit"))), (d % 5).cast("int"))
    papers = kit.table(spark, sf_dir, "documents").where("doc_id % 9 <> 4").select(
        (d % 10).alias("entity_id"), kind.alias("kind"), F.concat(F.lit("FY"), 2018 + d % 6, F.lit(" Q"), 1 + d % 4).alias("period"), F.date_add(F.lit("2018-02-01").cast("date"), (d % 2000).cast("int")).alias("at"), F.concat(kind, F.lit(" "), d).alias("bucket")
    )
    items = kit.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("period"), "l_partkey")
    brands = items.join(kit.table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("entity_id", "period", "p_brand").distinct()
    month_end = F.last_day("ts")
    return {
        "financials": now(*_STATEMENTS),
        "segments": brands.select("entity_id", "period", F.make_date("period", F.lit(12), F.lit(31)).alias("at"), F.format_string("FY%d annual", "period").alias("bucket")),
        "employees": now("metrics"),
        "sec_qual": papers.where("kind IN ('10k', '10q')"),
        "press_release": papers.where("kind = 'press_release'"),
        "transcript": papers.where("kind = 'transcript'"),
        "prices": kit.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), day.alias("period"), day.alias("at"), F.date_format(day, "yyyy-MM").alias("bucket")),
        "estimates": kit.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), month_end.alias("period"), month_end.alias("at"), F.concat("event_type", F.lit(" "), month_end.cast("string")).alias("bucket")),
    }


@query(
    """SELECT s_suppkey AS entity_id, v.vertical, coalesce(level, 'vertical') AS level, bucket, coalesce(n_rows, 0) AS n_rows, coalesce(periods, 0) AS periods, earliest, latest FROM supplier CROSS JOIN (SELECT unnest(['financials', 'segments', 'employees', 'sec_qual', 'press_release', 'transcript', 'prices', 'estimates']) AS vertical) v
    LEFT JOIN levels ON levels.entity_id = s_suppkey AND levels.vertical = v.vertical""",
    **_SQL,
)
def coverage_levels(spark, sf_dir):
    """The matrix of all companies and verticals, and every company's detail."""
    return quality.coverage_levels(verticals(spark, sf_dir), kit.entities(spark, sf_dir), once=["prices"])
