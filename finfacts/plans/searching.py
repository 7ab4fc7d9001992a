"""Queries of the positional search; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import search
from .finance import query

_STEM = "regexp_replace(regexp_replace(regexp_replace(w, '([a-z]{3})ies$', '\\1y'), '([a-z]{3})(?:ing|edly|ed|ly)$', '\\1'), '([a-z]{2}[^s])s$', '\\1')"


def _placed(key: str, source: str) -> str:
    """Words with their places, in SQL."""
    return f"SELECT {key}, pos - 1 AS pos, {_STEM} AS term FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source}))"


@query(
    """SELECT doc_id, count(*) AS covers, round(sum(0.1 / (1 + noise)), 9) AS score FROM (
        SELECT c.doc_id, c.s, c.e, (c.e - c.s + 1) - (SELECT count(*) FROM placed h WHERE h.doc_id = c.doc_id AND h.pos BETWEEN c.s AND c.e AND h.term IN ('licen', 'under', 'apache', 'permission', 'software', 'warranty')) AS noise FROM small c)
    GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""",
    placed=_placed("doc_id", "documents"),
    hits="SELECT * FROM placed WHERE term IN ('licen', 'under', 'apache', 'permission', 'software', 'warranty')",
    phrase="SELECT a.doc_id, a.pos AS s, a.pos + 1 AS e FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'licen' AND b.term = 'under'",
    first="SELECT p.doc_id, least(p.s, h.pos) AS s, greatest(p.e, h.pos) AS e FROM phrase p JOIN hits h ON h.doc_id = p.doc_id AND h.term = 'apache'",
    second="SELECT a.doc_id, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) AS e FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.term = 'permission' AND b.term = 'software' WHERE a.doc_id NOT IN (SELECT doc_id FROM hits WHERE term = 'warranty')",
    stretches="SELECT * FROM first UNION SELECT * FROM second",
    small="SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.doc_id = a.doc_id AND b.s >= a.s AND b.e <= a.e AND (b.s > a.s OR b.e < a.e))",
)
def phrase_search(spark, sf_dir):
    """A phrase beside a word, or two words without a third; the best 50 documents."""
    index = search.postings(kit.table(spark, sf_dir, "documents"), "doc_id", "text")
    out = search.ranked(index, "doc_id", '"licensed under" apache or permission software -warranty')
    return out.select("doc_id", "covers", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


def conversation_turns(spark, sf_dir):
    """Conversations as transcripts: one entity for every eight of them, a quarter each; every ninth is superseded."""
    c = kit.table(spark, sf_dir, "conversations")
    number = F.row_number().over(kit.Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    conv = F.col("conv_id")
    end = F.last_day(F.add_months(F.lit("2020-01-15").cast("date"), ((conv % 8) * 3).cast("int")))
    return c.withColumn("ordinal", number).select(
        (conv * 1000 + F.col("ordinal")).alias("turn_id"), F.floor(conv / 8).alias("entity"), F.format_string("FY%d Q%d", F.year(end), F.quarter(end)).alias("period"), end.alias("period_end"), F.date_add(end, 40).cast("timestamp").alias("published_at"),
        F.when(conv % 9 == 4, F.lit("2030-01-01").cast("timestamp")).alias("superseded_at"), "ordinal", F.col("role").alias("speaker"), "text",
    )


_CALLS = """SELECT conv_id * 1000 + ordinal AS turn_id, conv_id // 8 AS entity, 'FY' || year(pe) || ' Q' || quarter(pe) AS period, pe AS period_end, pe + 40 AS published, conv_id % 9 = 4 AS old, ordinal, role AS speaker, text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal, last_day(CAST(DATE '2020-01-15' + to_months(CAST(conv_id % 8 * 3 AS INTEGER)) AS DATE)) AS pe FROM conversations)"""


@query(
    """SELECT turn_id, entity, period, speaker, covers, round(score, 9) AS score FROM (SELECT turn_id, count(*) AS covers, sum(0.1 / (1 + e - s - (SELECT count(*) - 1 FROM placed h WHERE h.turn_id = c.turn_id AND h.pos BETWEEN c.s AND c.e AND h.term IN ('the', 'that')))) AS score
        FROM (SELECT * FROM pairs a WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE b.turn_id = a.turn_id AND b.s >= a.s AND b.e <= a.e AND (b.s > a.s OR b.e < a.e))) c GROUP BY 1)
    JOIN (SELECT * FROM calls WHERE NOT old AND published <= DATE '2021-09-30' AND (contains(lower(text), 'the') OR contains(lower(text), 'that'))) USING (turn_id) ORDER BY score DESC, period_end DESC, ordinal, turn_id LIMIT 40""",
    calls=_CALLS,
    placed=_placed("turn_id", "calls"),
    pairs="SELECT DISTINCT a.turn_id, least(a.pos, b.pos) AS s, greatest(a.pos, b.pos) AS e FROM placed a JOIN placed b ON a.turn_id = b.turn_id AND a.term = 'the' AND b.term = 'that'",
)
def turn_search(spark, sf_dir):
    """The best turns of current calls that were out by a day."""
    turns = conversation_turns(spark, sf_dir)
    out = search.search_turns(turns, search.postings(turns, "turn_id", "text"), "the that", 40, asof="2021-09-30")
    return out.select("turn_id", "entity", "period", "speaker", "covers", F.round("score", 9).alias("score"))


@query(
    """SELECT entity, period, period_end, turns, n_the, n_la_la FROM (SELECT entity, period, period_end, count(*) AS turns, CAST(sum(len(regexp_extract_all(lower(text), '\\bthe\\b'))) AS BIGINT) AS n_the, CAST(sum(len(regexp_extract_all(lower(text), '\\ble la\\b'))) AS BIGINT) AS n_la_la,
        row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS k FROM calls WHERE NOT old GROUP BY entity, period, period_end) WHERE k <= 3""",
    calls=_CALLS,
)
def latest_mentions(spark, sf_dir):
    """Mentions in the three latest current calls of every entity."""
    return search.latest_mentions(conversation_turns(spark, sf_dir), ["the", "le la"], 3).withColumnRenamed("n_le_la", "n_la_la")
