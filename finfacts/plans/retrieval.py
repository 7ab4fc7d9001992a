"""Queries of screens, metric reads, estimates and events; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..functions import columns as fn
from ..operators import text
from ..schemas import CONCEPTS
from . import screener
from .finance import frame, query, r, rounded, safe
from .grammar import METRICS, find_metric, quarter_concepts

TODAY = "1998-01-01"
_GM = safe("gross_profit", "revenue")


def _screened(df, digits: int = 8):
    return df.select("rank", "entity_id", *rounded(["value"], digits), "coverage")


def _screen(name: str, sql: str, metric: str, period: str, agg: str = "level", limit: int = 100, vertical: str = "financials", sort: str = "desc") -> None:
    def run(spark, sf_dir):
        concepts = quarter_concepts(find_metric(metric), CONCEPTS)
        frames = {"financials": lambda: kit.wide(spark, sf_dir, concepts) if concepts else frame(spark, sf_dir), "estimates": lambda: _estimates(spark, sf_dir)}
        return _screened(screener.screen({vertical: frames[vertical]()}, metric, period, agg, sort, limit, TODAY))

    run.__name__ = name
    query(f"SELECT CAST(row_number() OVER (ORDER BY value DESC, entity_id) AS INTEGER) AS rank, entity_id, round(value, 8) AS value, coverage FROM ({sql}) WHERE value IS NOT NULL QUALIFY rank <= {limit}", est=_EST)(run)


_EST = "SELECT s_suppkey AS entity_id, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue_avg FROM orders JOIN supplier ON o_custkey % 100 = s_suppkey % 100 GROUP BY 1, 2"


def _estimates(spark, sf_dir):
    end = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    sums = kit.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("k"), end.alias("period_end")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).cast("double").alias("revenue_avg"))
    return kit.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_suppkey") % 100).alias("k")).join(sums, "k").drop("k")


_RANKED = f"(SELECT entity_id, v AS value, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM (SELECT *, {_GM} AS v FROM mf) WHERE v IS NOT NULL)"
_screen("screen_latest", f"SELECT entity_id, value, CAST(1 AS BIGINT) AS coverage FROM {_RANKED} WHERE n = 1", "gross_margin_q", "latest")
_screen("screen_fiscal_quarter", f"SELECT entity_id, {_GM} AS value, CAST(1 AS BIGINT) AS coverage FROM mf WHERE fiscal_year = 1997 AND fiscal_quarter = 2", "gross_margin_q", "1997-Q2", limit=10)
_screen("screen_window_avg", f"SELECT entity_id, avg(value) AS value, count(*) AS coverage FROM {_RANKED} WHERE n <= 8 GROUP BY 1 HAVING count(*) >= 4", "gross_margin_q", "last_8q_avg")
_THIRDS = f"SELECT entity_id, avg(value) FILTER (WHERE n <= 3) AS late, avg(value) FILTER (WHERE n > 6) AS early, count(*) AS coverage FROM {_RANKED} WHERE n <= 9 GROUP BY 1 HAVING count(*) >= 8"
_screen("screen_delta", f"SELECT entity_id, late - early AS value, coverage FROM ({_THIRDS})", "gross_margin_q", "last_9q", "delta")
_screen("screen_relative_change", f"SELECT entity_id, (late - early) / abs(early) AS value, coverage FROM ({_THIRDS})", "gross_margin_q", "last_9q", "relative_change")
_FORWARD = f"(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end) AS n FROM est WHERE period_end >= DATE '{TODAY}')"
_screen("screen_forward", f"SELECT entity_id, sum(revenue_avg) AS value, count(*) AS coverage FROM {_FORWARD} WHERE n <= 4 GROUP BY 1 HAVING count(*) >= 2", "revenue_avg", "forward_4q_sum", vertical="estimates", limit=50)


@query(f"SELECT entity_id, round((a - b) / abs(b), 8) AS growth FROM (SELECT f.entity_id, avg(f.revenue_avg) AS a, avg(p.revenue_avg) AS b FROM {_FORWARD} f LEFT JOIN est p ON p.entity_id = f.entity_id AND p.period_end = last_day(f.period_end - INTERVAL 1 YEAR) WHERE n <= 4 GROUP BY 1) WHERE b <> 0", est=_EST)
def screen_forward_growth(spark, sf_dir):
    return screener.growth_screen(_estimates(spark, sf_dir), "revenue_avg", 4, TODAY).select("entity_id", *rounded(["growth"], 8))


@query("SELECT count(DISTINCT entity_id) FILTER (WHERE roic IS NOT NULL) AS entities FROM mf")
def universe_size(spark, sf_dir):
    return screener.universe_size(frame(spark, sf_dir), "roic")


@query(f"SELECT entity_id, period_end, {r({'gross_margin_q': _GM, 'roic': 'roic', 'net_debt': 'net_debt'}, 8)} FROM mf WHERE entity_id = 7 ORDER BY period_end DESC LIMIT 6")
def multi_metric(spark, sf_dir):
    names = ["gross_margin_q", "roic", "net_debt"]
    assert set(names) <= set(METRICS)
    return screener.metric_values(frame(spark, sf_dir), 7, names, 6).select("entity_id", "period_end", *rounded(names, 8))


_SEG = "SELECT l_suppkey AS entity_id, p_brand AS segment, CAST(year(l_shipdate) AS INTEGER) AS fy, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"


@query(f"SELECT a.entity_id, a.segment, a.fy, round({safe('a.value - b.value', 'b.value')}, 10) AS growth FROM seg a JOIN seg b ON a.entity_id = b.entity_id AND a.segment = b.segment AND a.fy = b.fy + 1", seg=_SEG)
def segment_yoy(spark, sf_dir):
    items, part = kit.table(spark, sf_dir, "lineitem"), kit.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    seg = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("entity_id"), F.col("p_brand").alias("segment"), F.year("l_shipdate").alias("fy")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("value"))
    prior = seg.select("entity_id", "segment", (F.col("fy") + 1).alias("fy"), F.col("value").alias("prior"))
    return seg.join(prior, ["entity_id", "segment", "fy"]).select("entity_id", "segment", "fy", F.round(fn.ratio(F.col("value") - F.col("prior"), "prior"), 10).alias("growth"))


@query(f"SELECT entity_id, period_end, CASE WHEN period_end < DATE '{TODAY}' THEN 'past' ELSE 'forward' END AS side, round(revenue_avg, 4) AS revenue_avg FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, period_end < DATE '{TODAY}' ORDER BY abs(period_end - DATE '{TODAY}')) AS n FROM est) WHERE n <= 4", est=_EST)
def consensus_union(spark, sf_dir):
    """The four periods before and the four after a day."""
    from pyspark.sql import Window

    day, est = F.lit(TODAY).cast("date"), _estimates(spark, sf_dir)
    near = lambda df, order: df.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(order))).where("n <= 4").drop("n")
    past = near(est.where(F.col("period_end") < day), F.desc("period_end")).withColumn("side", F.lit("past"))
    both = past.unionByName(near(est.where(F.col("period_end") >= day), F.asc("period_end")).withColumn("side", F.lit("forward")))
    return both.select("entity_id", "period_end", "side", F.round("revenue_avg", 4).alias("revenue_avg"))


@query("SELECT user_id AS entity_id, event_id, round((value - user_id) / abs(user_id) * 100, 6) AS surprise_pct FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'purchase' AND user_id <> 0) WHERE n <= 4")
def surprise_history(spark, sf_dir):
    from ..operators.windows import top_per

    rows = top_per(kit.table(spark, sf_dir, "events").where("event_type = 'purchase' AND user_id <> 0"), ["user_id"], [F.desc("ts"), F.asc("event_id")], 4)
    return rows.select(F.col("user_id").alias("entity_id"), "event_id", F.round((F.col("value") - F.col("user_id")) / F.abs("user_id") * 100, 6).alias("surprise_pct"))


@query("SELECT * FROM (SELECT 'grade' AS kind, event_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT 'target', event_id, ts FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-20') ORDER BY ts DESC, event_id LIMIT 50")
def analyst_events(spark, sf_dir):
    e = kit.table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    pick = lambda kind, of: e.where(F.col("event_type") == of).select(F.lit(kind).alias("kind"), "event_id", "ts")
    return pick("grade", "click").unionByName(pick("target", "purchase")).orderBy(F.desc("ts"), "event_id").limit(50)


@query("SELECT n_name FROM nation WHERE n_name LIKE 'NATION_1%' OR starts_with('NATION_1', n_name) ORDER BY length(n_name), n_name LIMIT 5")
def prefix_suggest(spark, sf_dir):
    return text.suggestions(kit.table(spark, sf_dir, "nation").select("n_name"), "n_name", "nation_1")
