"""Queries of documents, turns, search and vectors; with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import testkit as kit
from ..operators import text, vectors
from .finance import query


def _docs(spark, sf_dir):
    return kit.table(spark, sf_dir, "documents")


def _turns(spark, sf_dir):
    return kit.table(spark, sf_dir, "conversations")


@query()
def html_normalize(spark, sf_dir):
    body = text.mapped(text.normalize_html, "html")
    return kit.table(spark, sf_dir, "pages").select("page_id", body.alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query()
def chunk_documents(spark, sf_dir):
    return text.chunk_documents(_docs(spark, sf_dir), ["doc_id"], "text", target=200, most=250)


@query()
def section_extract(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("form", F.when(F.col("doc_id") % 2 == 0, "10-K").otherwise("10-Q"))
    return text.section_documents(docs, ["doc_id"], "text", "form")


@query()
def chunk_warnings(spark, sf_dir):
    pieces = text.chunk_documents(_docs(spark, sf_dir), ["doc_id"], "text", with_text=True, target=200, most=250)
    return pieces.select("doc_id", "ordinal", text.chunk_warning(F.col("text"), F.col("heading")).alias("warning"))


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM conversations")
def turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.length("text").cast("long").alias("n"))


@query("""SELECT conv_id, CAST(sum(CASE WHEN role = before THEN 0 ELSE 1 END) AS BIGINT) AS runs FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""")
def merged_turns(spark, sf_dir):
    return text.merged_turns(_turns(spark, sf_dir), "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.count("*").alias("runs"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def transcript_rebuild(spark, sf_dir):
    return text.rebuilt(_turns(spark, sf_dir), "conv_id", "turn", "text")


@query(r"SELECT lang, CAST(sum(len(regexp_extract_all(lower(text), '\b(the)\b'))) AS BIGINT) AS n_the, CAST(sum(len(regexp_extract_all(lower(text), '\b(license)\b'))) AS BIGINT) AS n_license FROM documents GROUP BY 1")
def mention_counts(spark, sf_dir):
    return text.mention_counts(_docs(spark, sf_dir), "lang", "text", ["the", "license"])


_STEMMED = "regexp_replace(regexp_replace(regexp_replace(w, '([a-z]{3})ies$', '\\1y'), '([a-z]{3})(?:ing|edly|ed|ly)$', '\\1'), '([a-z]{2}[^s])s$', '\\1')"


@query(f"""SELECT doc_id, round(sum(ln(1 + n)), 9) AS score FROM (SELECT doc_id, {_STEMMED} AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents) GROUP BY 1, 2) WHERE term IN ('licen', 'under', 'apache')
    GROUP BY 1 HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 50""")
def token_search(spark, sf_dir):
    return text.search(text.token_index(_docs(spark, sf_dir), "doc_id", "text"), "doc_id", "licensed under apache", 50).withColumn("score", F.round("score", 9))


@query(r"""SELECT conv_id, count(*) AS turns, min(speaker) AS first_name, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT conv_id, unnest(regexp_extract_all(t, '(?m)^([A-Z][A-Za-z.''\- ]{1,60}):[ \t]+', 1)) AS speaker, 0 AS n FROM said UNION ALL
    SELECT conv_id, NULL, length(regexp_replace(t, '(?m)^([A-Z][A-Za-z.''\- ]{1,60}):[ \t]+', '', 'g')) FROM said) WHERE true GROUP BY 1""".replace("count(*) AS turns", "count(speaker) AS turns"),
       said="SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'), chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY 1")
def speaker_turns(spark, sf_dir):
    """Conversations written out as transcripts and parsed back into turns."""
    said = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text"), said.alias("said")))), lambda x: x["said"])
    scripts = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(lines, "\n").alias("t"))
    out = text.transcript_units(scripts, "conv_id", "t")
    return out.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("speaker").alias("first_name"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


@query()
def release_units(spark, sf_dir):
    """The driver's documents as releases: every seventh line becomes a unit's heading."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 3, "Business Outlook").when(i % 7 == 5, "About Acme Corporation").otherwise(x))
    return text.release_units(_docs(spark, sf_dir).select("doc_id", F.array_join(line, "\n").alias("text")), "doc_id", "text").select("doc_id", "ordinal", "unit_key", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'quarter' END AS period_type, CASE WHEN doc_id % 3 < 2 THEN CAST(year(e) + CASE WHEN month(e) > 9 THEN 1 ELSE 0 END AS INTEGER) END AS fiscal_year, CASE WHEN doc_id % 3 = 1 THEN CAST(((month(e) - 10 + 12) % 12) // 3 + 1 AS INTEGER) END AS fiscal_quarter
    FROM (SELECT doc_id, DATE '2020-01-15' + CAST(doc_id % 1500 AS INTEGER) - 7 AS e FROM documents)""")
def filing_periods(spark, sf_dir):
    """Forms and report dates of a filer whose year ends in September."""
    d = F.col("doc_id")
    form = F.when(d % 3 == 0, "10-K/A").when(d % 3 == 1, "10-Q").otherwise("8-K")
    told = text.filing_period(form, F.date_add(F.lit("2020-01-15").cast("date"), (d % 1500).cast("int")), F.lit("09-30"))
    return _docs(spark, sf_dir).select("doc_id", *[told[k].alias(k) for k in ("period_type", "fiscal_year", "fiscal_quarter")])


@query("SELECT doc_id, CAST(12 * len(regexp_extract_all(text, 'Licen[sc]e')) + 5 * len(regexp_extract_all(text, '[0-9]{4}')) - 7 * len(regexp_extract_all(text, '###')) AS INTEGER) AS score FROM documents WHERE 12 * len(regexp_extract_all(text, 'Licen[sc]e')) + 5 * len(regexp_extract_all(text, '[0-9]{4}')) - 7 * len(regexp_extract_all(text, '###')) >= 12 ORDER BY score DESC, doc_id LIMIT 40")
def evidence_score(spark, sf_dir):
    score = text.evidence_score(F.col("text"), {"Licen[sc]e": 12, "[0-9]{4}": 5}, {"###": 7})
    return _docs(spark, sf_dir).select("doc_id", score.alias("score")).where("score >= 12").orderBy(F.desc("score"), "doc_id").limit(40)


@query("SELECT lang, count(*) AS n, CAST(quantile_disc(n_chars, 0.05) AS DOUBLE) AS p05, CAST(quantile_disc(n_chars, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95, count(*) FILTER (WHERE n_chars < 500) AS tiny FROM documents GROUP BY 1")
def length_percentiles(spark, sf_dir):
    return text.windowed_health(_docs(spark, sf_dir), "lang", "n_chars")


@query("SELECT doc_id, lag(doc_id) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS amends FROM documents")
def amends_artifact(spark, sf_dir):
    return text.latest_before(_docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars", "doc_id").select("doc_id", "amends")


@query("SELECT doc_id, CASE WHEN text IS NULL OR lang IS NULL THEN 'HARD_FAIL' WHEN n_chars < 200 OR l IS NULL THEN 'SOFT_GAP' ELSE 'PASS' END AS grade FROM (SELECT d.*, (SELECT any_value(quality) FROM labels WHERE labels.doc_id = d.doc_id) AS l FROM documents d)")
def readiness(spark, sf_dir):
    docs = _docs(spark, sf_dir).join(kit.table(spark, sf_dir, "labels"), "doc_id", "left")
    grade, _ = text.readiness({"text": F.col("text").isNull(), "lang": F.col("lang").isNull()}, {"short": F.col("n_chars") < 200, "label": F.col("quality").isNull()})
    return docs.select("doc_id", grade.alias("grade"))


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


@query(f"SELECT id, match, label, round(c, 6) AS cosine FROM (SELECT q.vec_id AS id, e.vec_id AS match, e.label, {_COS} AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 10 <> 0 AND e.vec_id % 10 = 0) WHERE n = 1 AND c >= 0.2")
def cosine_best_match(spark, sf_dir):
    e = kit.table(spark, sf_dir, "embeddings")
    out = vectors.best_match(e.where("vec_id % 10 <> 0"), e.where("vec_id % 10 = 0"), "vec_id", "embedding", "label", 0.2)
    return out.select("id", "match", "label", F.round("cosine", 6).alias("cosine"))


_SEGS = "SELECT user_id AS key, event_id AS seg_id, epoch(date_trunc('second', ts))::DOUBLE AS s, epoch(date_trunc('second', ts))::DOUBLE + 5000 AS e FROM events WHERE event_id % 2 = 0"
_SPKS = "SELECT user_id AS key, event_type AS label, epoch(date_trunc('second', ts))::DOUBLE - 2500 AS s, epoch(date_trunc('second', ts))::DOUBLE + 7500 AS e FROM events WHERE event_id % 2 = 1"


@query("""SELECT segs.key, segs.seg_id, label, seconds FROM segs LEFT JOIN (SELECT key, seg_id, label, sum(least(e, e2) - greatest(s, s2)) AS seconds, row_number() OVER (PARTITION BY key, seg_id ORDER BY sum(least(e, e2) - greatest(s, s2)) DESC, label DESC) AS n
    FROM (SELECT segs.*, spks.label, spks.s AS s2, spks.e AS e2 FROM segs JOIN spks ON segs.key = spks.key AND spks.s < segs.e AND spks.e > segs.s) GROUP BY key, seg_id, label) m ON m.key = segs.key AND m.seg_id = segs.seg_id AND m.n = 1""", segs=_SEGS, spks=_SPKS)
def interval_overlap_speaker(spark, sf_dir):
    e = kit.table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts").cast("double"))
    segs = e.where("event_id % 2 = 0").select(F.col("user_id").alias("key"), F.col("event_id").alias("seg_id"), F.col("t").alias("start"), (F.col("t") + 5000).alias("end"))
    spks = e.where("event_id % 2 = 1").select(F.col("user_id").alias("key"), F.col("event_type").alias("label"), (F.col("t") - 2500).alias("start"), (F.col("t") + 7500).alias("end"))
    return vectors.dominant_overlap(segs, spks, "key", 5000.0).select("key", "seg_id", "label", "seconds")

