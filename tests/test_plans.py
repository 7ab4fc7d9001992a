"""Plans: what reaches the scan, how often data is shuffled, what isn't there."""

import re

from pyspark.sql import functions as F

from finfacts import testkit
from finfacts.operators import facts, metrics, windows
from finfacts.operators import text as text_ops
from finfacts.plans import catalog


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_entity_filter_reaches_the_scan(spark, sf):
    frame = metrics.metric_frame(testkit.wide(spark, sf)).where(F.col("entity_id") == 7).select("roic")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_suppkey,7\)", plan(frame))


def test_columns_are_pruned(spark, sf):
    text = plan(testkit.daily(spark, sf).select("entity_id", "date", "close"))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp(_ntz)?>", text)


def test_metric_stack_shuffles_once_after_the_pivot(spark, sf):
    wide, frame = testkit.wide(spark, sf), metrics.metric_frame(testkit.wide(spark, sf))
    count = lambda df: plan(df).count("Arguments: hashpartitioning")
    assert count(frame) == count(wide) + 1


def test_the_wide_pivot_is_a_hash_aggregate(spark, sf):
    text = plan(testkit.wide(spark, sf))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and "HashAggregate" in text


def test_row_wise_metrics_read_their_concepts_only(spark, sf, tmp_path):
    testkit.land(spark, sf, str(tmp_path / "facts"))
    try:
        text = plan(catalog.QUERIES["screen_latest"](spark, sf))
        assert re.search(r"PushedFilters: \[[^\]]*In\(concept, \[gross_profit,revenue\]\)", text) and text.count("lineitem.parquet") == 0
        assert catalog.QUERIES["metrics_q"](spark, sf).count() == 270
    finally:
        testkit.LANDED.clear()


def test_a_search_reads_its_words_only(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 50} rising margins") for i in range(200)], "k int, t string")
    text_ops.write_index(text_ops.token_index(df, "k", "t"), str(tmp_path / "index"))
    found = text_ops.search(spark.read.parquet(str(tmp_path / "index")), "k", "word7 margins")
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[margin,word7\]\)", plan(found)) and found.count() == 4


def test_no_query_crosses_tables(spark, sf):
    for name in ("asof_valuation", "carry_forward", "resolving_runs", "interval_overlap_speaker", "prices_gap_detection", "roic_roiic", "screen_delta", "screen_valuation_latest", "metrics_at_fiscal_year", "anchor_reconcile", "unit_chunks"):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(catalog.QUERIES[name](spark, sf))), name


def test_top_one_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(windows.top_per(testkit.daily(spark, sf), ["entity_id"], [F.desc("date")]))


def test_facts_are_not_shuffled_for_what_is_keyed_by_the_entity(spark, sf):
    """The exchanges stand below the explosion into concepts, not above it."""
    for name in ("metrics_fy", "metrics_read_year", "source_priority_pick"):
        text = plan(catalog.QUERIES[name](spark, sf)).split("\n\n")[0]
        assert "Generate" in text and "Exchange" not in text[: text.index("Generate")], name


def test_versions_are_picked_before_they_become_a_row_per_concept(spark, sf):
    for name in ("source_priority_pick", "q4_snap", "quarterly_value_duplication"):
        text = plan(catalog.QUERIES[name](spark, sf)).split("\n\n")[0]
        assert re.search(r"Generate[^$]*Window", text), name
    rows, best = facts.pick_source(facts.current(testkit.facts(spark, sf))), testkit.picked(spark, sf)
    assert rows.columns == best.columns and rows.exceptAll(best).isEmpty() and best.exceptAll(rows).isEmpty()
    some = testkit.picked(spark, sf, ["revenue", "inventory"])
    assert some.exceptAll(rows.where("concept IN ('revenue', 'inventory')")).isEmpty() and some.count() * 14 == rows.count()


def test_packets_broadcast_neither_questions_nor_parts(spark, sf):
    """Both grow with the tables, and Spark takes their exploded rows for as small as the table that they come from."""
    for name, keys in (("driver_packets", "question_id|period_key|fiscal_year|call|p_partkey"), ("segment_facts", "p_partkey")):
        text = plan(catalog.QUERIES[name](spark, sf))
        assert "SortMergeJoin" in text and not re.search(rf"BroadcastHashJoin[^\n]*\nLeft keys[^\n]*\nRight keys[^\n]*\b(?:{keys})#", text), name


def test_runs_meet_the_resolutions_of_their_ticker_only(spark, sf):
    text = plan(catalog.QUERIES["resolving_runs"](spark, sf))
    assert re.search(r"Left keys \[2\]: \[b#\d+L?, .*whose", text)


def test_pairs_of_runs_and_resolutions_are_made_in_many_tasks(spark, sf):
    text = plan(catalog.QUERIES["resolving_runs"](spark, sf))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text and text.count("REPARTITION_BY_NUM") == 1


def test_coverage_groups_no_single_days_and_makes_no_sums_of_values(spark, sf):
    text = plan(catalog.QUERIES["coverage_levels"](spark, sf))
    assert "bit_or" in text and "Expand" not in text and "l_extendedprice" not in text
    for name in ("coverage_matrix", "expected_coverage"):
        assert "bit_or" in plan(catalog.QUERIES[name](spark, sf)), name
