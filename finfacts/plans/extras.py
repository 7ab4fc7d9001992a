"""Queries of filters, repairs, deltas and stores; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import testkit as kit
from ..functions import columns as fn
from ..operators import asof, repair
from .finance import query, safe


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31' AND o_orderstatus IN ('F', 'P') AND (o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%')")
def filtered_range(spark, sf_dir):
    """BETWEEN, IN and LIKE ANY reach the scan."""
    return kit.table(spark, sf_dir, "orders").where("o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31' AND o_orderstatus IN ('F', 'P') AND o_orderpriority LIKE ANY ('1-%', '2-%')").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))


@query("SELECT a.doc_id, a.l, count(*) AS n FROM (SELECT doc_id, NULLIF(lang, 'en') AS l FROM documents WHERE doc_id % 20 = 0) a JOIN (SELECT NULLIF(lang, 'en') AS l FROM documents) b ON a.l IS NOT DISTINCT FROM b.l GROUP BY 1, 2")
def null_safe_join(spark, sf_dir):
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("l"))
    sizes = docs.groupBy("l").agg(F.count("*").alias("n")).withColumnRenamed("l", "r")
    return docs.where("doc_id % 20 = 0").join(sizes, F.col("l").eqNullSafe(F.col("r"))).select("doc_id", "l", "n")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) FILTER (WHERE json_extract_string(props, '$.absent') IS NOT NULL) AS absent FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    get = lambda p: F.get_json_object("props", p)
    return kit.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(get("$.k").cast("long")).alias("k"), F.count(get("$.absent")).alias("absent"))


@query("SELECT user_id, d FROM (SELECT user_id, CAST(ts AS DATE) AS d, array_agg(DISTINCT event_type) AS t FROM events GROUP BY 1, 2) WHERE list_has_any(t, ['click', 'purchase']) AND NOT list_contains(t, 'view')")
def array_predicates(spark, sf_dir):
    sets = kit.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.collect_set("event_type").alias("t"))
    return sets.where(F.arrays_overlap("t", F.array(F.lit("click"), F.lit("purchase"))) & ~F.array_contains("t", "view")).select("user_id", "d")


@query(f"""SELECT entity_id, period_end, round({safe('revenue - p', 'abs(p)')}, 10) AS change, round((CAST(gross_profit AS DOUBLE) / CAST(revenue AS DOUBLE) - CAST(gp AS DOUBLE) / CAST(p AS DOUBLE)) * 10000, 5) AS margin_bps
    FROM (SELECT *, lag(revenue) OVER (PARTITION BY entity_id ORDER BY period_end) AS p, lag(gross_profit) OVER (PARTITION BY entity_id ORDER BY period_end) AS gp FROM wide) WHERE revenue <> 0 AND p <> 0""")
def dashboard_deltas(spark, sf_dir):
    w = Window.partitionBy("entity_id").orderBy("period_end")
    df = kit.wide(spark, sf_dir).withColumns({"p": F.lag("revenue").over(w), "gp": F.lag("gross_profit").over(w)}).where("revenue <> 0 AND p <> 0")
    change = fn.ratio(F.col("revenue") - F.col("p"), F.abs("p"))
    return df.select("entity_id", "period_end", F.round(change, 10).alias("change"), F.round((fn.ratio("gross_profit", "revenue") - fn.ratio("gp", "p")) * 10000, 5).alias("margin_bps"))


@query(f"SELECT entity_id, period_end, round(f * {safe('cfo_ttm + capital_expenditures_ttm', 'revenue_ttm')}, 4) AS implied_fcf FROM (SELECT *, CAST(lead(revenue_ttm, 4) OVER (PARTITION BY entity_id ORDER BY period_end) AS DOUBLE) AS f FROM mf1) WHERE f IS NOT NULL")
def implied_forward_fcf(spark, sf_dir):
    """Forward revenue at the trailing cash conversion; here the revenue of four quarters on."""
    from ..operators.windows import ordered, trailing

    df = kit.wide(spark, sf_dir).withColumns(trailing(["revenue", "cfo", "capital_expenditures"])).withColumn("f", fn.dbl(F.lead("revenue_ttm", 4).over(ordered()))).where("f IS NOT NULL")
    return df.select("entity_id", "period_end", F.round(F.col("f") * fn.ratio(F.col("cfo_ttm") + F.col("capital_expenditures_ttm"), "revenue_ttm"), 4).alias("implied_fcf"))


@query(f"""SELECT entity_id, period_end, employees, round({safe('revenue_ttm', 'employees')}, 6) AS revenue_per_employee FROM (SELECT w.entity_id, w.period_end, w.revenue_ttm, (SELECT arg_max(e.n, e.d) FROM emp e WHERE e.entity_id = w.entity_id AND e.d <= w.period_end) AS employees FROM mf1 w)""",
       emp="SELECT entity_id, period_end AS d, 100 + entity_id % 50 + calendar_year - 1990 AS n FROM wide WHERE calendar_quarter = 2")
def revenue_per_employee(spark, sf_dir):
    """The latest head count known by a quarter's end, carried forward."""
    from ..operators.windows import trailing

    wide = kit.wide(spark, sf_dir)
    counts = wide.where("calendar_quarter = 2").select("entity_id", F.col("period_end").alias("d"), (100 + F.col("entity_id") % 50 + F.col("calendar_year") - 1990).alias("employees"))
    left = wide.withColumns(trailing(["revenue"])).select("entity_id", "period_end", "revenue_ttm")
    out = asof.carry_forward(left, counts, "entity_id", "period_end", "d", "employees")
    return out.select("entity_id", "period_end", "employees", F.round(fn.ratio("revenue_ttm", "employees"), 6).alias("revenue_per_employee"))


@query("SELECT entity_id, date, pow(2.0, coalesce(count(*) FILTER (WHERE month(date) = 1 AND day(date) = 1) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS factor FROM daily")
def split_normalize(spark, sf_dir):
    """Every New Year's Day with a price is a 2-for-1 split."""
    days = kit.daily(spark, sf_dir).withColumn("ratio", F.when((F.month("date") == 1) & (F.dayofmonth("date") == 1), 2.0))
    return days.select("entity_id", "date", repair.split_factor("ratio", "entity_id", "date").alias("factor"))


@query("SELECT entity_id, date, round(CAST(last_value(c IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 4) AS close FROM (SELECT *, CASE WHEN day(date) % 5 = 0 THEN close END AS c FROM daily)")
def forward_fill(spark, sf_dir):
    days = kit.daily(spark, sf_dir).withColumn("c", F.when(F.dayofmonth("date") % 5 == 0, F.col("close")))
    return days.select("entity_id", "date", F.round(repair.forward_filled("c", "entity_id", "date").cast("double"), 4).alias("close"))


@query("SELECT entity_id, period_end, CAST(quarter(period_end) AS INTEGER) AS calendar_quarter, entity_id % 4 = 0 AS repaired FROM wide")
def calendar_repair(spark, sf_dir):
    wrong = kit.wide(spark, sf_dir).withColumn("calendar_quarter", F.when(F.col("entity_id") % 4 == 0, F.col("calendar_quarter") + 4).otherwise(F.col("calendar_quarter")))
    return repair.repaired_calendar(wrong).select("entity_id", "period_end", "calendar_quarter", "repaired")


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN 'facts' WHEN n > 1 THEN 'ambiguous' WHEN o_orderkey % 2 = 0 THEN 'derived' ELSE 'unknown' END AS anchor FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def transcript_anchor(spark, sf_dir):
    ends = kit.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("period_end"))
    derived = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))
    return repair.transcript_anchor(kit.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ends, ["o_orderkey"], derived).select("o_orderkey", "anchor")


@query("""SELECT k, CASE WHEN o IS NULL THEN 'only_ours' WHEN v IS NULL THEN 'only_theirs' WHEN k % 5 = 1 THEN 'sign_flip' WHEN k % 5 = 2 THEN 'unit_scale' WHEN k % 5 = 3 THEN 'mismatch' ELSE 'match' END AS verdict FROM
    (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS v, CASE WHEN p_partkey % 11 <> 0 THEN 1 END AS o FROM part) WHERE v IS NOT NULL OR o IS NOT NULL""")
def store_cross_check(spark, sf_dir):
    k, v = F.col("k"), F.col("p_retailprice") * 1e6
    part = kit.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_retailprice")
    other = F.when(k % 5 == 1, -v).when(k % 5 == 2, v / 1e6).when(k % 5 == 3, v * 3).otherwise(v)
    return repair.cross_check(part.where(k % 7 != 0).select("k", v.alias("value")), part.where(k % 11 != 0).select("k", other.alias("other")), ["k"], 1.0).select("k", "verdict")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'press_release' WHEN page_id % 3 = 1 THEN 'maybe' ELSE 'other' END AS kind FROM pages")
def press_release_exhibits(spark, sf_dir):
    i = F.col("page_id") % 3
    pages = kit.table(spark, sf_dir, "pages").select("page_id", F.when(i == 2, "EX-10.1").otherwise("EX-99.1").alias("t"), F.when(i == 0, "Press  release of the company").otherwise("Exhibit").alias("d"), F.lit("d1.htm").alias("f"))
    return pages.select("page_id", repair.exhibit_kind(F.col("t"), F.col("d"), F.col("f")).alias("kind"))


@query("""SELECT conv_id AS session_id, CAST(len(list_intersect(ids, [1, 2, 3])) AS INTEGER) AS shared FROM (SELECT conv_id, list(turn) AS ids, string_agg(role, ' ') AS intent, max(turn) AS latest FROM conversations GROUP BY 1) WHERE len(list_intersect(ids, [1, 2, 3])) > 0 ORDER BY shared DESC, latest DESC, session_id LIMIT 10""")
def session_precedents(spark, sf_dir):
    turns = kit.table(spark, sf_dir, "conversations")
    sessions = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.collect_list("turn").alias("finding_ids"), F.array_join(F.collect_list("role"), " ").alias("intent"), F.max("turn").alias("at"))
    return repair.precedents(sessions, [1, 2, 3], []).select("session_id", "shared")


@query("SELECT l_returnflag, round(median(l_extendedprice), 6) AS median, quantile_disc(l_quantity, 0.9) AS p90, bool_and(l_quantity > 0) AS positive, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def ordered_set_aggregates(spark, sf_dir):
    return kit.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", F.lit(0.5)), 6).alias("median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"), F.every(F.col("l_quantity") > 0).alias("positive"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))

