"""Driver packets, answers made of them and transcript briefs, by hand."""

import datetime
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from finfacts.operators import packets, search, text

DAY = datetime.date(2024, 12, 31)
GROWTH = "Revenue growth was driven by demand from customers."
FULL = "question_id long, entity_id long, fiscal_year int, fiscal_quarter int"


@pytest.fixture(scope="module")
def store(spark):
    """Entity 1 has all of 2023 and 2024; entity 2 has metrics, a document and weak texts; entity 3 has no document; entity 4 has nothing."""
    frame = spark.createDataFrame
    label = lambda y, q=None: f"FY{y}" + (f" Q{q}" if q else "")
    metrics = [(e, label(y, q), datetime.date(y, 12, 31), Decimal(v)) for e, y, q, v in [(1, 2023, None, "2000000000"), (1, 2024, None, "2500000000"), (1, 2024, 4, "700000000"), (2, 2024, 2, "5000"), (3, 2024, None, "1")]]
    facts = [(10, 1, "revenue", "FY2024", Decimal("2500000000")), (11, 1, "revenue", "FY2023", Decimal("2000000000")), (12, 1, "rd", "FY2024", Decimal(1)), (13, 1, "cfo", "FY2024", None)]
    segments = [(20, 1, "FY2024", "region", "us", "US", Decimal(150)), (21, 1, "FY2023", "region", "us", "US", Decimal(100)), (22, 1, "FY2024", "region", "eu", "EU", Decimal(50)), (23, 1, "FY2023", "region", "asia", "Asia", Decimal(9)), (24, 2, "FY2024 Q2", "region", "us", "US", Decimal(5))]
    documents = [(100, 1, 2024, "FY2024"), (101, 1, 2024, "FY2024 Q4"), (102, 2, 2024, "FY2024 Q2"), (103, 3, 2024, "FY2024 Q1")]
    when = datetime.date(2025, 2, 1)
    chunk = lambda i, a, e, key, kind, place, depth, text, end=DAY: (i, a, e, key, end, kind, place, "Results", depth, when, text)
    chunks = [
        chunk(200, 100, 1, "FY2024", "discussion", 1, 2, GROWTH + " [F:999]"), chunk(201, 100, 1, "FY2024", "discussion", 2, 1, GROWTH), chunk(202, 100, 1, "FY2024", "discussion", 3, 2, "Liquidity and capital resources."), chunk(203, 100, 1, "FY2024", "discussion", 4, 2, GROWTH + " " + GROWTH),
        chunk(204, 101, 1, "FY2024 Q4", "release", 1, 0, GROWTH), chunk(205, 101, 1, "FY2024 Q4", "release", 2, 0, GROWTH, datetime.date(2023, 12, 31)), chunk(206, 102, 2, "FY2024 Q2", "discussion", 1, 2, "Nothing of note."), chunk(207, 102, 2, "FY2024 Q2", "discussion", 2, None, None),
    ]
    turn = lambda i, e, key, n, text: (i, e, key, DAY, datetime.datetime(2025, 2, 1), None, n, "CEO", text)
    turns = [turn(300, 1, "FY2024 Q4", 1, "Demand was strong."), turn(301, 1, "FY2024 Q4", 2, "Nothing to add."), turn(302, 1, "FY2024 Q4", 3, "Demand, demand and customers."), turn(303, 1, "FY2024 Q3", 1, "Demand.")]
    said = frame(turns, "turn_id long, entity long, period string, period_end date, published_at timestamp, superseded_at timestamp, ordinal int, speaker string, text string")
    return {
        "metrics": frame(metrics, "entity_id long, period_key string, period_end date, revenue decimal(28,4)"), "facts": frame(facts, "fact_id long, entity_id long, concept string, period_key string, value decimal(28,4)"),
        "segments": frame(segments, "fact_id long, entity_id long, period_key string, dimension_type string, dimension_key string, dimension_label string, value decimal(28,4)"), "documents": frame(documents, "artifact_id long, entity_id long, fiscal_year int, period_key string"),
        "chunks": frame(chunks, "chunk_id long, artifact_id long, entity_id long, period_key string, period_end date, kind string, place int, title string, depth int, published_at date, text string"), "turns": said, "index": search.postings(said, "turn_id", "text"),
    }


@pytest.fixture(scope="module")
def asked(spark, store):
    rows = [(1, 1, 2024, None), (2, 2, 2024, 2), (3, 3, 2024, None), (4, 4, 2024, None), (5, 1, 2024, 4), (6, None, None, None)]
    return packets.driver_packets(spark.createDataFrame(rows, FULL), **store)


def test_packets_reach_every_status(asked):
    got = {r.question_id: r for r in asked.collect()}
    assert {k: (r.status, r.checks, r.gaps) for k, r in got.items()} == {
        1: ("PASS", [], []),
        2: ("SOFT_GAP", [], ["no_prior_metrics", "no_prior_segments", "weak_discussion", "no_release", "no_turns"]),
        3: ("HARD_FAIL", ["no_document"], []),
        4: ("HARD_FAIL", ["no_metrics", "no_document"], []),
        5: ("SOFT_GAP", [], ["no_prior_metrics", "no_segments"]),  # a fourth quarter has no discussion of its own
        6: ("HARD_FAIL", ["no_metrics", "no_document"], []),
    }
    r = got[1]
    assert r.revenue_growth == 0.25 and r.fact_ids == [10, 11, 13, 20, 22] and r.artifact_ids == [100, 101] and r.document_count == 1
    assert [(s.dimension_key, s.prior_value, s.growth) for s in r.segments] == [("eu", None, None), ("us", Decimal(100), 0.5)]
    assert [c.chunk_id for c in r.discussion] == [203, 200] and [c.chunk_id for c in r.releases] == [204]
    assert [t.turn_id for t in r.turns] == [302, 300] and r.chunk_ids == [200, 203, 204, 300, 302]
    assert got[2].discussion == [] and got[2].document_count == 1 and got[4].facts == []


def test_worth_of_texts(spark):
    said = [(GROWTH, 12 + 4 + 3 + 3 + 3), ("Growth in cloud was helped, driven by price", 12 + 3), ("increased 12.5% year over year", 8 + 3), ("liquidity and capital resources", -12), ("x" * 2400 + " revenue", 0), (None, 0), ("data centers and segments", 0)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    got = [r.w for r in rows.select("i", packets.worth(F.col("t"), F.lit(None).cast("string"), F.lit(False)).alias("w")).orderBy("i").collect()]
    assert got == [w for _, w in said]


def test_limits_take_the_newest_documents_first_and_keep_the_best(spark, store):
    rows = [(i, 500 + i // 10, 1, "FY2024", DAY, "discussion", i % 10, "", 2, datetime.date(2025, 1, 1 + i // 10), GROWTH * (1 + (i % 7 == 0))) for i in range(40)]
    some = store | {"chunks": spark.createDataFrame(rows, store["chunks"].schema)}
    r = packets.driver_packets(spark.createDataFrame([(1, 1, 2024, None)], FULL), **some).collect()[0]
    # 24 chunks: documents 503 and 502 whole, 501 up to place 3; multiples of 7 say it twice
    assert [c.chunk_id for c in r.discussion] == [21, 35, 28] and "no_release" in r.gaps


def test_whole_packets_choose_among_all_chunks_and_whole_texts(spark, store):
    """The best is the oldest of 40 and says so at its end only; a release says it once, after 40 that don't."""
    rows = [(i, 500 + i, 1, "FY2024", DAY, kind, 0, "", 2, datetime.date(2025, 1, 1) + datetime.timedelta(i), "x " * 2000 + GROWTH * (3 if i == 0 else kind == "discussion")) for i in range(41) for kind in ("discussion", "release")]
    rows = [(r[0] + 1000 * (r[5] == "release"), *r[1:]) for r in rows]
    rows[1] = (*rows[1][:-1], GROWTH)
    some = store | {"chunks": spark.createDataFrame(rows, store["chunks"].schema)}
    r = packets.driver_packets(spark.createDataFrame([(1, 1, 2024, None)], FULL), **some, whole=True).collect()[0]
    assert [(c.chunk_id, c.score) for c in r.discussion] == [(0, 75), (1, 25), (2, 25)] and [c.chunk_id for c in r.releases] == [1000]


def test_worth_holds_what_evidence_scores_hold(spark):
    """Patterns that are left out for want of a piece of their phrases have no match."""
    said = [" ".join(p.replace("...", "of it").replace("#", "7.5") + end for _, *phrases in groups for p in phrases) for groups in (packets.WORTH, packets.AGAINST) for end in ("", "x", ".")] + ["Growth\nwas DRIVEN BY demand", "increased 3 % year over year"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    pattern = lambda p: re.escape(p).replace(r"\ \.\.\.\ ", " .* ").replace(r"\#", r"\d+(?:\.\d+)?")
    patterns = lambda groups: {r"\b(?:" + "|".join(map(pattern, phrases)) + r")\b": worth for worth, *phrases in groups}
    plain = text.evidence_score(F.lower("t"), patterns(packets.WORTH), patterns(packets.AGAINST))
    got = rows.select(packets.worth(F.col("t"), F.lit(None).cast("string"), F.lit(False), None).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a > 50


def test_answers_cite_what_their_packets_hold(asked):
    got = {r.question_id: r for r in packets.driver_answers(asked).collect()}
    assert got[1].answer.split("\n")[0] == "Entity 1 FY2024: revenue grew 25.0%, from $2.00B [F:11] to $2.50B [F:10]." and got[1].status == "verified"
    assert got[1].citations == ["[F:10]", "[F:11]", "[F:20]", "[F:22]", "[S:200]", "[S:203]", "[S:204]", "[T:300]", "[T:302]"]
    assert "- region / US: $150 after $100 (50.0%) [F:20]\n- region / EU: $50 after NA (NA) [F:22]" in got[1].answer
    assert got[2].answer.startswith("Entity 2 FY2024 Q2: revenue was $5,000 [M:revenue]; the year before is not comparable.\nSegments:\n") and got[2].answer.endswith("Discussion: none found\nReleases: none found\nCalls: none found")
    assert "no metrics" in got[4].answer and {r.status for r in got.values()} == {"verified"}
    wrong = asked.withColumn("fact_ids", F.array(F.lit(1).cast("long"))).where("question_id = 1")
    assert [(r.status, r.issues) for r in packets.driver_answers(wrong).collect()] == [("unverified", ["unknown_fact"])]


def test_money_and_shares(spark):
    values = [("1500000000", "$1.50B"), ("-2500000", "-$2.50M"), ("1234.5", "$1,234"), ("1235.5", "$1,236"), ("0", "$0"), (None, "NA")]
    rows = spark.createDataFrame([(i, v and Decimal(v)) for i, (v, _) in enumerate(values)], "i int, v decimal(28,4)")
    assert [r.m for r in rows.select("i", packets.money(F.col("v")).alias("m")).orderBy("i").collect()] == [m for _, m in values]
    assert [r.m for r in spark.createDataFrame([(0.1234,), (None,), (-0.5,)], "v double").select(packets.share(F.col("v")).alias("m")).collect()] == ["12.3%", "NA", "-50.0%"]


def test_briefs(spark):
    long = "a " * 300 + "Margins rose " + "b " * 300
    turn = lambda i, e, m, n, text, gone=None: (i, e, f"FY2024 Q{m}", datetime.date(2024, 3 * m, 28), None, gone, n, "CFO", text)
    rows = [turn(1, 1, 4, 1, long), turn(2, 1, 4, 2, "Margin,\n margin"), turn(3, 1, 4, 3, "profitability"), turn(4, 1, 3, 1, "none"), turn(5, 1, 2, 1, "margins", datetime.datetime(2024, 1, 1)), turn(6, 1, 1, 1, "margins"), turn(7, 2, 1, 1, None), turn(8, None, 1, 1, "a margin")]
    turns = spark.createDataFrame(rows, "turn_id long, entity long, period string, period_end date, published_at timestamp, superseded_at timestamp, ordinal int, speaker string, text string")
    got = {r.entity: r for r in packets.transcript_briefs(turns, search.postings(turns, "turn_id", "text"), "margins", 2, 2).collect()}
    one = got[1]
    assert (one.n_calls, one.n_matched, one.n_matches, one.gap) == (2, 1, 2, None) and [(c.period, c.turns) for c in one.calls] == [("FY2024 Q4", 3), ("FY2024 Q3", 1)]
    first, second = one.calls[0].matches
    assert (first.turn_id, first.excerpt) == (2, "Margin, margin") and second.turn_id == 1 and second.excerpt.startswith("...") and second.excerpt.endswith("...") and "Margins rose" in second.excerpt and len(second.excerpt) <= 426
    assert (got[2].n_matches, got[2].gap) == (0, "no_match") and got[None].n_matches == 1
    nothing = packets.transcript_briefs(turns.limit(0), search.postings(turns.limit(0), "turn_id", "text"), "margins")
    assert nothing.collect() == []


def test_empty_tables(spark, store):
    none = {k: v.limit(0) for k, v in store.items()}
    one = packets.driver_packets(spark.createDataFrame([(1, 1, 2024, None)], FULL), **none).collect()
    assert [(r.status, r.checks) for r in one] == [("HARD_FAIL", ["no_metrics", "no_document"])]
    assert packets.driver_packets(spark.createDataFrame([], FULL), **store).collect() == []
