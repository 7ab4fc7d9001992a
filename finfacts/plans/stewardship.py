"""Queries of incremental runs and of facts as a stream of versions; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import testkit as kit
from ..functions.lineage import own_folder
from ..operators import facts as ops
from ..operators import runs
from .finance import query
from .quality import _PICKED, _filed, _picked


def _loss(facts: DataFrame) -> DataFrame:
    bad = ops.pick_source(ops.current(facts)).where("concept = 'net_income' AND value < 10000")
    return bad.select("entity_id", "period_end", F.concat_ws(":", F.lit("loss"), "entity_id", "period_end").alias("fingerprint"), F.lit("warning").alias("severity"), F.col("value").cast("string").alias("summary"))


def _swing(facts: DataFrame) -> DataFrame:
    years = ops.pick_source(ops.current(facts)).where("concept = 'gross_profit'").groupBy("entity_id", "fiscal_year").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return years.where("high > 3 * low").select("entity_id", "fiscal_year", F.concat_ws(":", F.lit("swing"), "entity_id", "fiscal_year").alias("fingerprint"), F.lit("investigate").alias("severity"), F.col("high").cast("string").alias("summary"))


CHECKS = [runs.Check("loss", _loss), runs.Check("swing", _swing, ("entity_id", "fiscal_year"), "periods")]


@query(
    """SELECT 'loss' AS "check", 'loss:' || entity_id || ':' || period_end AS fingerprint, 'warning' AS severity FROM cur WHERE rn = 1 AND concept = 'net_income' AND value < 10000
    UNION ALL SELECT 'swing', 'swing:' || entity_id || ':' || fiscal_year, 'investigate' FROM cur WHERE rn = 1 AND concept = 'gross_profit' GROUP BY entity_id, fiscal_year HAVING max(value) > 3 * min(value)"""
)
def steward_runs(spark, sf_dir):
    """Findings after runs over three batches of facts, one of them of some entities only: those of one run over all facts.

    Versions of one value come in different batches, so later ones change what earlier runs found.
    """
    folder = own_folder(spark, "finfacts-runs")
    store = runs.Store(spark, f"{folder}/store")
    runner = runs.Runner(store, f"{folder}/runs", CHECKS)
    made = kit.facts(spark, sf_dir, concepts=["net_income", "gross_profit"]).withColumn("part", (F.col("calendar_year") + F.col("id") % 7) % 3)
    made.write.partitionBy("part").parquet(f"{folder}/rows")  # once for all batches
    rows = spark.read.schema(made.schema).parquet(f"{folder}/rows")
    for batch, scope in enumerate((runs.Scope(), runs.Scope(entities=frozenset(range(1, 4))), runs.Scope())):
        store.land(rows.where(F.col("part") == batch).drop("part"), batch)
        failed = runner.run(scope).failed
        if failed:
            raise RuntimeError(f"checks failed: {failed}")
    return runner.findings().select("check", "fingerprint", "severity")


@query(
    f"""SELECT entity_id, statement, count(*) AS stored, count(other) AS checked, count(*) FILTER (WHERE abs(v - other) <= greatest(1000.0, abs(other) * 0.001)) AS matched, count(*) FILTER (WHERE abs(v - other) > greatest(1000.0, abs(other) * 0.001)) AS diverging FROM (
        SELECT *, CAST(value AS DOUBLE) AS v, CAST(CASE WHEN NOT flow THEN CAST(value * k AS DECIMAL(28,4)) WHEN fiscal_quarter < 4 THEN CAST(value * k * CASE WHEN entity_id % 7 = 0 THEN 1.1 ELSE 1 END AS DECIMAL(28,4)) WHEN n = 4 THEN CAST(fy * k AS DECIMAL(28,4)) - CAST(nine * k AS DECIMAL(28,4)) END AS DOUBLE) AS other
        FROM (SELECT *, concept IN ('revenue', 'net_income', 'cfo', 'ebt_incl_unusual') AS flow, CAST(CASE WHEN entity_id % 5 = 0 THEN 1.02 ELSE 1 END AS DECIMAL(4,2)) AS k, sum(value) OVER y AS fy, sum(value) FILTER (WHERE fiscal_quarter < 4) OVER y AS nine, len(list_distinct(list(fiscal_quarter) OVER y)) AS n
            FROM picked WHERE concept IN ({', '.join(f"'{c}'" for c in kit.TAGS)}) WINDOW y AS (PARTITION BY entity_id, fiscal_year, concept))) GROUP BY 1, 2""",
    picked=_PICKED,
)
def reconcile_counts(spark, sf_dir):
    """How many values of each statement have a filed one, and how many of these match."""
    ours = _picked(spark, sf_dir).where(F.col("concept").isin(list(kit.TAGS)))
    return runs.anchor_counts(ours, _filed(spark, sf_dir), 1000.0)


@query(
    """SELECT id, entity_id, period_end, published_at, lead(published_at) OVER w AS superseded_at, lag(id) OVER w AS supersedes_fact_id FROM (SELECT CAST(((entity_id * 10000 + year(period_end) * 4 + quarter(period_end)) * 6 + flag * 2 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS id, entity_id, period_end,
    CAST(period_end AS TIMESTAMP) + to_days(CAST(10 + entity_id % 30 + 3 * flag AS INTEGER)) AS published_at FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM groups)) WINDOW w AS (PARTITION BY entity_id, period_end ORDER BY published_at, id)"""
)
def stream_versions(spark, sf_dir):
    """Every entity's quarters as versions that arrive in three batches, the last published first, each taken in by a restarted stream."""
    from ..streaming import facts as stream

    flag = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")
    number = ((F.col("entity_id") * 10000 + F.year("period_end") * 4 + F.quarter("period_end")) * 6 + F.col("flag") * 2 + (F.col("l_linestatus") == "O").cast("int")).cast("long")
    published = F.timestamp_add("DAY", (10 + F.col("entity_id") % 30 + 3 * F.col("flag")).cast("int"), F.col("period_end").cast("timestamp"))
    rows = kit.groups(spark, sf_dir).withColumn("flag", flag).select(number.alias("id"), "entity_id", "period_end", published.alias("published_at"), "flag")
    folder, key = own_folder(spark, "finfacts-stream"), ("entity_id", "period_end")
    for flag in (2, 1, 0):
        rows.where(F.col("flag") == flag).drop("flag").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.drop("flag").schema).parquet(f"{folder}/in")
        stream.append_versions(source, f"{folder}/out", f"{folder}/progress", key).awaitTermination()
    return stream.latest_links(spark.read.parquet(f"{folder}/out").drop("batch"))
