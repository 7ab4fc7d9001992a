"""Queries of driver packets and transcript briefs; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import facts as ops
from ..operators import packets, search
from .finance import query
from .reads import _SEGF, _segment_facts
from .searching import _CALLS, _placed, conversation_turns

#: Periods of the driver's documents, by (doc_id // 20) % 5, and those asked about: fiscal year and quarter.
SLOTS = [(1996, None), (1996, 4), (1997, None), (1997, 2), (1997, 3)]
ASKED = [*SLOTS, (1998, 1)]
_KEY = [f"FY{y}" + (f" Q{q}" if q else "") for y, q in SLOTS]
_SAYS = " Revenue growth was driven by demand."


def questions(spark, sf_dir):
    """Every entity and period: what drove its revenue?"""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(y).alias("fiscal_year"), F.lit(q).cast("int").alias("fiscal_quarter")) for n, (y, q) in enumerate(ASKED)])
    rows = kit.entities(spark, sf_dir).select("entity_id", F.explode(pairs).alias("p"))
    return rows.select((F.col("entity_id") * 10 + F.col("p.n")).alias("question_id"), "entity_id", "p.fiscal_year", "p.fiscal_quarter")


def _facts(spark, sf_dir):
    quarters = kit.picked(spark, sf_dir, packets.CONCEPTS)
    years = kit.annual_facts(spark, sf_dir, packets.CONCEPTS)
    return quarters.select(*years.columns).unionByName(years)


def _filed(spark, sf_dir):
    """The documents as filings of 20 entities; a line says now and then what drove revenue."""
    d, i = F.col("doc_id"), F.col("i")
    slot = (F.floor(d / 20) % 5).cast("int")
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), slot + 1)
    docs = kit.table(spark, sf_dir, "documents").select(d.alias("artifact_id"), (d % 20).alias("entity_id"), at([y for y, _ in SLOTS]).alias("fiscal_year"), at(_KEY).alias("period_key"), F.lit("1996-12-31").cast("date").alias("period_end"), F.date_add(F.lit("1997-01-01").cast("date"), (d % 9).cast("int")).alias("published_at"), "text", d.alias("doc_id"))
    lines = docs.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("line", F.concat("line", F.when((d + i) % 4 == 0, _SAYS).otherwise("")))
    chunk = d * 1_000_000 + i
    chunks = lines.where(i % 3 < 2).select(chunk.alias("chunk_id"), "artifact_id", "entity_id", "period_key", "period_end", F.when(i % 3 == 0, "discussion").otherwise("release").alias("kind"), i.alias("place"), F.lit("Results").alias("title"), F.when(i % 2 == 0, 2).otherwise(1).alias("depth"), "published_at", F.col("line").alias("text"))
    said = lines.where(i % 3 == 2).select(chunk.alias("turn_id"), F.col("entity_id").alias("entity"), F.col("period_key").alias("period"), "period_end", "published_at", F.lit(None).cast("timestamp").alias("superseded_at"), i.alias("ordinal"), F.lit("CEO").alias("speaker"), F.col("line").alias("text"))
    return docs.select("artifact_id", "entity_id", "fiscal_year", "period_key"), chunks, said


def built(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    facts = rows.select(F.col("id").alias("fact_id"), "entity_id", "concept", F.col("fiscal_period_label").alias("period_key"), "value")
    metrics = ops.pivot_wide(rows, list(packets.CONCEPTS), kit.KEYS).select("entity_id", F.col("fiscal_period_label").alias("period_key"), "period_end", *packets.CONCEPTS)
    segments = _segment_facts(spark, sf_dir).select(((F.col("entity_id") * 10_000 + F.col("fiscal_year")) * 100 + F.regexp_extract("dimension_label", "([0-9]+)$", 1).cast("int")).alias("fact_id"), "entity_id", F.col("fiscal_period_label").alias("period_key"), "dimension_type", "dimension_key", "dimension_label", "value")
    documents, chunks, turns = _filed(spark, sf_dir)
    return packets.driver_packets(questions(spark, sf_dir), metrics, facts, segments, documents, chunks, turns, search.postings(turns, "turn_id", "text"), query='"driven by" or demand', whole=True)


_SLOT = "CASE doc_id // 20 % 5 " + " ".join(f"WHEN {n} THEN {{{n}}}" for n in range(5)) + " END"
_LIST = "array_to_string(list(%s ORDER BY %s), ',')"


@query(
    """SELECT q.question_id, CASE WHEN now_.revenue IS NULL OR coalesce(n_docs, 0) = 0 THEN 'HARD_FAIL' WHEN g <> '' THEN 'SOFT_GAP' ELSE 'PASS' END AS status, concat_ws(',', CASE WHEN now_.revenue IS NULL THEN 'no_metrics' END, CASE WHEN coalesce(n_docs, 0) = 0 THEN 'no_document' END) AS checks,
        CASE WHEN now_.revenue IS NULL OR coalesce(n_docs, 0) = 0 THEN '' ELSE g END AS gaps, round((CAST(now_.revenue AS DOUBLE) - CAST(now_.before AS DOUBLE)) / CAST(now_.before AS DOUBLE), 9) AS revenue_growth, CAST(5 * ((now_.revenue IS NOT NULL)::INT + (now_.before IS NOT NULL)::INT) AS INTEGER) AS n_facts, CAST(coalesce(n_seg, 0) AS INTEGER) AS n_segments,
        CAST(coalesce(n_docs, 0) AS BIGINT) AS document_count, coalesce(discussion, '') AS discussion, coalesce(release, '') AS releases, coalesce(turns, '') AS turns, coalesce(ids, '') AS artifact_ids
    FROM q JOIN graded USING (question_id) LEFT JOIN now_ USING (question_id)""",
    segf=_SEGF,
    q="SELECT entity_id * 10 + n AS question_id, entity_id, y AS fy, fq, 'FY' || y || coalesce(' Q' || fq, '') AS k, 'FY' || (y - 1) || coalesce(' Q' || fq, '') AS pk, 'FY' || y || ' Q' || coalesce(fq, 4) AS ck FROM entities, (VALUES " + ", ".join(f"({n}, {y}, {q or 'NULL'})" for n, (y, q) in enumerate(ASKED)) + ") t(n, y, fq)",
    figures="SELECT entity_id, fiscal_period_label AS k, arg_max(revenue, period_end) AS revenue, max(period_end) AS period_end FROM wide GROUP BY 1, 2 UNION ALL SELECT entity_id, fiscal_period_label, revenue_fy, period_end FROM annual_wide",
    now_="SELECT question_id, a.revenue, a.period_end, b.revenue AS before FROM q LEFT JOIN figures a ON a.entity_id = q.entity_id AND a.k = q.k LEFT JOIN figures b ON b.entity_id = q.entity_id AND b.k = q.pk",
    segs="SELECT question_id, count(*) AS n_seg, count(b.value) AS n_prior FROM q JOIN segf a ON q.fq IS NULL AND a.entity_id = q.entity_id AND a.fy = q.fy LEFT JOIN segf b ON b.entity_id = a.entity_id AND b.label = a.label AND b.fy = a.fy - 1 GROUP BY 1",
    filed=f"SELECT doc_id, doc_id % 20 AS entity_id, {_SLOT.format(*[str(y) for y, _ in SLOTS])} AS fy, {_SLOT.format(*[repr(k) for k in _KEY])} AS k, doc_id % 9 AS published FROM documents",
    listed="SELECT question_id, count(*) FILTER (WHERE f.k = q.k) AS n_docs, " + _LIST % ("doc_id", "doc_id") + " AS ids FROM q JOIN filed f ON f.entity_id = q.entity_id AND f.fy = q.fy AND (q.fq IS NULL OR f.k = q.k) GROUP BY 1",
    said_="SELECT doc_id, entity_id, k, published, i - 1 AS i, doc_id * 1000000 + i - 1 AS id, (doc_id + i - 1) % 4 = 0 AS says FROM (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents) JOIN filed USING (doc_id)",
    nearby="SELECT question_id, s.*, CASE i % 3 WHEN 0 THEN 'discussion' ELSE 'release' END AS kind, s.k = q.k AS own, CASE WHEN says THEN 22 ELSE 0 END - CASE WHEN i % 3 = 0 AND i % 2 = 1 THEN 60 ELSE 0 END AS score FROM q JOIN now_ USING (question_id) JOIN said_ s ON s.entity_id = q.entity_id AND i % 3 < 2 AND (s.k = q.k OR (q.fq IS NULL AND s.k = q.ck AND i % 3 = 1 AND now_.period_end = DATE '1996-12-31'))",
    best="SELECT *, row_number() OVER (PARTITION BY question_id, kind ORDER BY score DESC, i, id) AS n FROM nearby",
    texts="SELECT question_id, " + ", ".join(f"array_to_string(list(id ORDER BY n) FILTER (WHERE kind = '{k}' AND n <= 3 AND score >= 12), ',') AS {k}, max(score) FILTER (WHERE kind = '{k}') AS {k}_score" for k in ("discussion", "release")) + " FROM best GROUP BY 1",
    heard="SELECT question_id, " + _LIST % ("id", "n") + " AS turns FROM (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY i, id) AS n FROM q JOIN said_ s ON s.entity_id = q.entity_id AND s.k = q.ck AND i % 3 = 2 AND says) WHERE n <= 3 GROUP BY 1",
    graded="""SELECT question_id, n_docs, ids, n_seg, discussion, release, turns, concat_ws(',', CASE WHEN before IS NULL THEN 'no_prior_metrics' END, CASE WHEN n_seg IS NULL THEN 'no_segments' WHEN n_prior = 0 THEN 'no_prior_segments' END,
        CASE WHEN fq = 4 OR discussion <> '' THEN NULL WHEN discussion_score IS NULL THEN 'no_discussion' ELSE 'weak_discussion' END, CASE WHEN release <> '' THEN NULL WHEN release_score IS NULL THEN 'no_release' ELSE 'weak_release' END, CASE WHEN turns IS NULL THEN 'no_turns' END) AS g
        FROM q LEFT JOIN now_ USING (question_id) LEFT JOIN segs USING (question_id) LEFT JOIN listed USING (question_id) LEFT JOIN texts USING (question_id) LEFT JOIN heard USING (question_id)""",
)
def driver_packets(spark, sf_dir):
    """A packet per entity and period."""
    ids = lambda c, name: F.array_join(F.transform(c, lambda x: x[name].cast("string")), ",")
    joined = lambda c: F.array_join(c, ",")
    return built(spark, sf_dir).select(
        "question_id", "status", joined("checks").alias("checks"), joined("gaps").alias("gaps"), F.round("revenue_growth", 9).alias("revenue_growth"), F.size("facts").alias("n_facts"), F.size("segments").alias("n_segments"),
        "document_count", ids("discussion", "chunk_id").alias("discussion"), ids("releases", "chunk_id").alias("releases"), ids("turns", "turn_id").alias("turns"), joined(F.transform("artifact_ids", lambda x: x.cast("string"))).alias("artifact_ids"),
    )


_BRIEF = {
    "calls": _CALLS,
    "placed": _placed("turn_id", "calls"),
    "held": "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS nth FROM (SELECT entity, period_end, count(*) AS turns FROM calls WHERE NOT old GROUP BY 1, 2) QUALIFY nth <= 4",
    "hit": "SELECT turn_id, count(*) AS c FROM (SELECT a.turn_id FROM placed a JOIN placed b ON b.turn_id = a.turn_id AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the' UNION ALL SELECT turn_id FROM placed WHERE term = 'with') GROUP BY 1",
    "flat": "SELECT c.*, hit.c, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM calls c JOIN hit USING (turn_id) WHERE NOT old AND (contains(lower(text), 'of the') OR contains(lower(text), 'with'))",
    "spot": "SELECT *, greatest(0, least(nullif(instr(lower(t), 'of the'), 0), nullif(instr(lower(t), 'with'), 0)) - 141) AS s, row_number() OVER (PARTITION BY entity, period_end ORDER BY c DESC, ordinal, turn_id) AS rank FROM flat",
}


@query(
    """SELECT h.entity, h.period_end, CAST(h.nth AS INTEGER) AS nth, h.turns, CAST(s.rank AS INTEGER) AS rank, s.turn_id, sha256(CASE WHEN length(t) <= 420 THEN t ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(t, CAST(s + 1 AS BIGINT), 420)) || CASE WHEN s + 420 < length(t) THEN '...' ELSE '' END END) AS excerpt_sha256
    FROM held h LEFT JOIN (SELECT * FROM spot WHERE rank <= 3) s ON s.entity = h.entity AND s.period_end = h.period_end""",
    **_BRIEF,
)
def transcript_brief(spark, sf_dir):
    """The briefs of all entities, a row per match; calls without one have a row of nulls."""
    turns = conversation_turns(spark, sf_dir)
    out = packets.transcript_briefs(turns, search.postings(turns, "turn_id", "text"), '"of the" or with')
    calls = out.select("entity", F.explode("calls").alias("c")).select("entity", "c.*").select("entity", "period_end", "nth", "turns", F.explode_outer("matches").alias("m"))
    return calls.select("entity", "period_end", "nth", "turns", "m.rank", "m.turn_id", F.sha2("m.excerpt", 256).alias("excerpt_sha256"))
