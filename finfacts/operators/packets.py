"""Driver packets and transcript briefs: what a store holds on many questions at once, one nested row per question, with its gaps graded.

Every kind of evidence meets the questions in one equi-join on entity and period. What is found goes into one tagged union that a single
aggregation folds by question. Texts are cut to the best few of an entity's period before they are shuffled: row numbers under a bound are limited where
the rows are read. A question's facts, segments and ids of documents are kept whole. The questions are as many as the entities and are never broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search

# Concepts and sections that a packet reads, its search, what phrases of a text are worth, the score of strong evidence.
CONCEPTS = ("revenue", "gross_profit", "operating_income", "cfo", "capital_expenditures")
SECTIONS = ("item_7_mda", "part1_item2_mda")
SEARCH = '"revenue growth" or "year over year" or "driven by" or demand or customers or commercial or government or "data center"'
STRONG = 12
LEAD = 2400
FLAT = 60
#: Phrases by worth; ` ... ` stands for any words of the line, `#` for a number.
WORTH = (
    (12, "growth was driven", "growth ... driven by", "driven by"), (7, "primarily due to", "attributable to"), (8, "increased #% year over year"), (4, "revenue"), (3, "growth", "grew", "increase", "increased", "increases"), (3, "customer", "customers"),
    (4, "commercial"), (4, "government"), (3, "u.s.", "united states"), (4, "data center"), (3, "demand"), (2, "segment"), (2, "full year", "full-year", "fiscal year"),
)
AGAINST = (
    (8, "forward-looking statement", "forward-looking statements"), (5, "risks and uncertainties"), (4, "annual report on form 10-k"), (4, "quarterly report on form 10-q"), (4, "should be read in conjunction"), (10, "intended to help the reader", "provided as a supplement"), (4, "table of contents"), (5, "safe harbor"),
    (10, "non-gaap", "about non-gaap", "constant currency"), (5, "reconciliation table", "reconciliation of"), (3, "financial measure"), (14, "cost of revenue", "cost of revenues", "costs of revenue", "costs of revenues", "operating expense", "operating expenses"), (9, "provision for income taxes", "effective tax rate"),
    (9, "changes in assets and liabilities", "accounts receivable", "income taxes"), (12, "liquidity and capital resources", "cash flow information"), (25, "capital expenditures", "critical accounting estimates", "critical accounting policies"), (18, "contract liabilities", "geopolitical tensions"), (9, "research and development expenses", "expenses include"),
    (25, "economic conditions, challenges, and risks", "adversely affect"), (7, "stock-based compensation"), (10, "unfavorably affected"),
)
#: Searches by topic.
TOPICS = {
    "margins": 'margin or margins or profitability or "gross margin" or "operating margin"',
    "ai demand": 'ai or "data center" or demand or "accelerated computing"',
    "demand": "demand or customer or customers or bookings or backlog",
    "capex": 'capex or "capital expenditures" or infrastructure or "data center"',
    "guidance": "guidance or outlook or forecast or expect or expects",
}
EXCERPT = 420


def _worth(text: Column, groups: tuple) -> Column:
    """Whole words of each group, by their worth. A pattern is run on texts that hold the longest sure piece of one of its phrases: the others have no match."""
    pattern = lambda p: re.escape(p).replace(r"\ \.\.\.\ ", " .* ").replace(r"\#", r"\d+(?:\.\d+)?")
    total = F.lit(0)
    for worth, *phrases in groups:
        pieces = {max(re.split(r" \.\.\. |#", p), key=len) for p in phrases}
        held = reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in sorted(pieces) if not any(q != p and q in p for q in pieces)])
        total = total + F.when(held, F.regexp_count(text, F.lit(r"\b(?:" + "|".join(map(pattern, phrases)) + r")\b")) * worth).otherwise(0)
    return total


def worth(text: Column, title: Column, flat: Column, lead: int | None = LEAD) -> Column:
    """What a text's first `lead` characters (None: all of them) and its title say of growth, less what is boilerplate; flat takes 60 off."""
    text = F.coalesce(text, F.lit(""))
    said = F.lower(F.concat_ws(" ", title, text if lead is None else F.substring(text, 1, lead)))
    return _worth(said, WORTH) - _worth(said, AGAINST) - F.when(flat, FLAT).otherwise(0)


def period_key(year: Column, quarter: Column) -> Column:
    return F.when(quarter.isNull(), F.concat(F.lit("FY"), year.cast("string"))).otherwise(F.concat(F.lit("FY"), year.cast("string"), F.lit(" Q"), quarter.cast("string")))


def _best(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def driver_packets(questions: DataFrame, metrics: DataFrame, facts: DataFrame, segments: DataFrame, documents: DataFrame, chunks: DataFrame, turns: DataFrame, index: DataFrame, limit: int = 3, query: str = SEARCH, whole: bool = False) -> DataFrame:
    """A row per question on what drove an entity's revenue in a fiscal year or quarter.

    questions: question_id (once each), entity_id, fiscal_year, fiscal_quarter (null: the year). metrics: entity_id, period_key, period_end, revenue and others.
    facts: fact_id, entity_id, concept, period_key, value. segments: fact_id, entity_id, period_key, dimension_type, dimension_key, dimension_label, value.
    documents: artifact_id, entity_id, fiscal_year, period_key. chunks: chunk_id, artifact_id, entity_id, period_key, period_end, kind (discussion or
    release), place (the lowest first within a document), title, depth (of its headings), published_at, text. turns and index: as for search_turns.
    All tables hold current rows only. Of several metrics of a period the last one counts, of several segment facts of one dimension that with the largest id.

    A year's releases are its own, then those of the fourth quarter that ends with it; its turns are the fourth quarter's. whole: of all chunks of a kind, by their
    whole texts, the best of STRONG or more stay; else of the first 8 * limit chunks (12 or more), the newest documents' first, by the first 2,400 characters. Columns: the question's, status, checks (what failed hard), gaps, metric, prior_metric,
    revenue_growth, facts, segments, discussion, releases, turns, document_count, and the ids of all facts, chunks and documents in it.
    Without metrics or a document of the period the status is HARD_FAIL and no gaps are told; with gaps it is SOFT_GAP, else PASS.
    """
    annual = F.col("fiscal_quarter").isNull()
    asked = questions.select("question_id", "entity_id", F.col("fiscal_year").cast("int").alias("fiscal_year"), F.col("fiscal_quarter").cast("int").alias("fiscal_quarter"))
    asked = asked.withColumns({"key": period_key(F.col("fiscal_year"), F.col("fiscal_quarter")), "before": period_key(F.col("fiscal_year") - 1, F.col("fiscal_quarter")), "call": period_key(F.col("fiscal_year"), F.coalesce("fiscal_quarter", F.lit(4)))})
    both = asked.select("question_id", "entity_id", F.explode(F.array(F.struct(F.col("key").alias("period_key"), F.lit(True).alias("now")), F.struct(F.col("before").alias("period_key"), F.lit(False).alias("now")))).alias("p")).select("question_id", "entity_id", "p.*")
    now, on = F.col("now"), ["entity_id", "period_key"]
    asked, both = asked.hint("merge"), both.hint("merge")

    metric = F.struct(*[c for c in metrics.columns if c != "entity_id"])
    last = lambda when: F.max_by(F.when(when, metric), F.when(when, F.col("period_end")))
    base = asked.join(both.join(metrics, on).groupBy("question_id").agg(last(now).alias("metric"), last(~now).alias("prior_metric")), "question_id", "left")

    fact = F.struct("fact_id", "concept", "period_key", "value")
    told = both.join(facts.where(F.col("concept").isin(list(CONCEPTS))), on).select("question_id", fact.alias("fact"))
    newest = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("fact_id")))
    parts = both.join(segments, on).groupBy("question_id", "dimension_type", "dimension_key").agg(newest("dimension_label", now).alias("dimension_label"), F.max(F.when(now, F.col("fact_id"))).alias("fact_id"), newest("value", now).alias("value"), newest("value", ~now).alias("prior_value"))
    grown = lambda a, b: F.when(b != 0, (a.cast("double") - b.cast("double")) / b.cast("double"))
    segment = F.struct("dimension_type", "dimension_key", "dimension_label", "fact_id", "value", "prior_value", grown(F.col("value"), F.col("prior_value")).alias("growth"))
    parts = parts.where("fact_id IS NOT NULL").select("question_id", segment.alias("segment"))

    listed = asked.join(documents.select("entity_id", "fiscal_year", "artifact_id", F.col("period_key").alias("filed")), ["entity_id", "fiscal_year"]).where(annual | (F.col("filed") == F.col("key")))
    listed = listed.select("question_id", F.struct("artifact_id", (F.col("filed") == F.col("key")).alias("own")).alias("document"))

    place = lambda kind, key, own, end: F.struct(F.lit(kind).alias("kind"), key.alias("period_key"), F.lit(own).alias("own"), end.alias("ends"))
    none = F.lit(None).cast("date")
    places = F.array_compact(F.array(place("discussion", F.col("key"), True, none), place("release", F.col("key"), True, none), F.when(annual & F.col("metric").isNotNull(), place("release", F.col("call"), False, F.col("metric.period_end")))))
    wanted = base.select("question_id", "entity_id", F.explode(places).alias("p")).select("question_id", "entity_id", "p.*")
    kept = ["question_id", "kind"]
    flat = (F.col("kind") == "discussion") & (F.coalesce("depth", F.lit(0)) <= 1)
    scored = chunks.withColumn("score", worth(F.col("text"), F.col("title"), flat, None if whole else LEAD))
    best = [F.desc("score"), F.asc("place"), F.asc("chunk_id")]
    newest_first = [F.desc_nulls_last("published_at"), F.asc("artifact_id"), F.asc("place"), F.asc("chunk_id")]
    order, most = (best, limit) if whole else (newest_first, max(8 * limit, 12))
    few = _best(scored, ["entity_id", "period_key", "kind", "period_end"], order, most, "nth")  # all questions order a period's chunks alike
    found = wanted.hint("merge").join(few, ["entity_id", "period_key", "kind"]).where(F.col("own") | (F.col("period_end") == F.col("ends")))
    found = _best(found, kept, order if whole else [F.desc("own"), *order], most, "nth")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*kept).orderBy(*best)))
    good = (F.col("rank") <= limit) & (F.col("score") >= STRONG)
    chunk = F.struct("kind", "score", F.when(good, F.struct("rank", "chunk_id", "artifact_id", "score", "text")).alias("best"))
    found = found.select("question_id", chunk.alias("chunk"))

    hits = search.matching_turns(turns, index, query).withColumnsRenamed({"entity": "entity_id", "period": "call"}).select("entity_id", "call", "turn_id", "score", "period_end", "ordinal", "speaker", "text")
    heard = _best(hits, ["entity_id", "call"], [F.desc("score"), F.desc_nulls_last("period_end"), F.asc("ordinal"), F.asc("turn_id")], limit, "rank")
    heard = asked.join(heard, ["entity_id", "call"]).select("question_id", F.struct("rank", "turn_id", "score", "speaker", "text").alias("turn"))

    question = F.struct("entity_id", "fiscal_year", "fiscal_quarter", "key", "metric", "prior_metric")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [base.select("question_id", question.alias("q")), told, parts, listed, found, heard])
    listing = lambda c: F.sort_array(F.collect_list(c))
    of = lambda kind, what: F.when(F.col("chunk.kind") == kind, F.col(what))
    folded = rows.groupBy("question_id").agg(
        F.first("q", ignorenulls=True).alias("q"), listing("fact").alias("facts"), listing("segment").alias("segments"), listing("turn").alias("turns"), F.array_sort(F.collect_set("document.artifact_id")).alias("listed"), F.count_if(F.col("document.own")).alias("document_count"),
        *[x for kind in ("discussion", "release") for x in (listing(of(kind, "chunk.best")).alias(kind), F.max(of(kind, "chunk.score")).alias(f"{kind}_score"))],
    ).select("question_id", "q.*", *[c for c in ("facts", "segments", "turns", "listed", "document_count", "discussion", "release", "discussion_score", "release_score")])

    checks = F.array_compact(F.array(F.when(F.col("metric").isNull(), F.lit("no_metrics")), F.when(F.col("document_count") == 0, F.lit("no_document"))))
    empty = lambda c: F.size(c) == 0
    lacking = lambda kind: F.when(empty(kind), F.when(F.col(f"{kind}_score").isNull(), F.lit(f"no_{kind}")).otherwise(F.lit(f"weak_{kind}")))
    gaps = F.array_compact(F.array(
        F.when(F.col("prior_metric").isNull(), F.lit("no_prior_metrics")), F.when(empty("segments"), F.lit("no_segments")).when(~F.exists("segments", lambda s: s["prior_value"].isNotNull()), F.lit("no_prior_segments")),
        F.when(~F.col("fiscal_quarter").eqNullSafe(F.lit(4)), lacking("discussion")), lacking("release"), F.when(empty("turns"), F.lit("no_turns")),
    ))
    ids = lambda c, name: F.transform(c, lambda x: x[name])
    out = folded.withColumn("checks", checks).withColumn("gaps", F.when(F.size("checks") > 0, F.array().cast("array<string>")).otherwise(gaps))
    return out.select(
        "question_id", "entity_id", "fiscal_year", "fiscal_quarter", F.col("key").alias("period_key"), F.when(F.size("checks") > 0, "HARD_FAIL").when(F.size("gaps") > 0, "SOFT_GAP").otherwise("PASS").alias("status"), "checks", "gaps", "metric", "prior_metric",
        grown(F.col("metric.revenue"), F.col("prior_metric.revenue")).alias("revenue_growth"), "facts", F.sort_array("segments").alias("segments"), "discussion", F.col("release").alias("releases"), "turns", "document_count",
        F.array_sort(F.array_distinct(F.concat(ids("facts", "fact_id"), ids("segments", "fact_id")))).alias("fact_ids"), F.array_sort(F.array_distinct(F.concat(ids("discussion", "chunk_id"), ids("release", "chunk_id"), ids("turns", "turn_id")))).alias("chunk_ids"),
        F.array_sort(F.array_distinct(F.concat("listed", ids("discussion", "artifact_id"), ids("release", "artifact_id")))).alias("artifact_ids"),
    )


def money(value: Column) -> Column:
    """Dollars in billions, millions or whole; NA for null."""
    size = F.abs(value).cast("decimal(28,4)")
    scaled = lambda by, unit: F.concat(F.bround(size / F.lit(by).cast("decimal(10,0)"), 2).cast("decimal(28,2)").cast("string"), F.lit(unit))
    told = F.when(size >= 10**9, scaled(10**9, "B")).when(size >= 10**6, scaled(10**6, "M")).otherwise(F.format_number(F.bround(size, 0), 0))
    return F.when(value.isNull(), "NA").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), F.lit("$"), told))


def share(value: Column) -> Column:
    return F.when(value.isNull(), "NA").otherwise(F.concat(F.bround(value * 100, 1).cast("decimal(28,1)").cast("string"), F.lit("%")))


def driver_answers(packets: DataFrame, most_segments: int = 8, most_texts: int = 2, chars: int = 360) -> DataFrame:
    """question_id, answer, citations, issues, status: an answer put together from a packet, every part with the id of what it says.

    It is verified if all cited ids are the packet's and it names the revenue of both years where there are any.
    """
    name = F.concat(F.lit("Entity "), F.col("entity_id").cast("string"), F.lit(" "), F.col("period_key"))

    def cite(key: Column) -> Column:
        fact = F.get(F.filter("facts", lambda f: (f["concept"] == "revenue") & (f["period_key"] == key)), F.lit(0))["fact_id"]
        return F.when(fact.isNull(), F.lit("[M:revenue]")).otherwise(F.concat(F.lit("[F:"), fact.cast("string"), F.lit("]")))

    revenue, before = F.col("metric.revenue"), F.col("prior_metric.revenue")
    ours, theirs = F.concat(money(revenue), F.lit(" "), cite(F.col("period_key"))), F.concat(money(before), F.lit(" "), cite(F.col("prior_metric.period_key")))
    summary = F.when(F.col("metric").isNull(), F.concat(name, F.lit(": no metrics of the period.")))
    summary = summary.when(F.col("revenue_growth").isNull(), F.concat(name, F.lit(": revenue was "), ours, F.lit("; the year before is not comparable."), F.when(before.isNotNull(), F.concat(F.lit(" It was "), theirs, F.lit("."))).otherwise("")))
    summary = summary.otherwise(F.concat(name, F.lit(": revenue grew "), share(F.col("revenue_growth")), F.lit(", from "), theirs, F.lit(" to "), ours, F.lit(".")))
    largest = F.slice(F.array_sort("segments", lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0)), 1, most_segments)
    line = lambda s: F.concat(F.lit("- "), s["dimension_type"], F.lit(" / "), s["dimension_label"], F.lit(": "), money(s["value"]), F.lit(" after "), money(s["prior_value"]), F.lit(" ("), share(s["growth"]), F.lit(") [F:"), s["fact_id"].cast("string"), F.lit("]"))
    said = lambda mark, id_: lambda x: F.concat(F.lit("- "), _cut(F.regexp_replace(F.trim(_flat(x["text"])), r"\[[FSTM]:", "("), chars), F.lit(f" [{mark}:"), x[id_].cast("string"), F.lit("]"))
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array(F.lit(f"{title} none found")))
    texts = lambda c: F.slice(c, 1, most_texts)
    details = F.concat(part("Segments:", F.transform(largest, line)), part("Discussion:", F.transform(texts("discussion"), said("S", "chunk_id"))), part("Releases:", F.transform(texts("releases"), said("S", "chunk_id"))), part("Calls:", F.transform(texts("turns"), said("T", "turn_id"))))
    out = packets.select("*", F.array_join(F.concat(F.array(summary), details), "\n").alias("answer"))
    cited = lambda kind: F.transform(F.regexp_extract_all("answer", F.lit(rf"\[{kind}:(-?\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    strange = lambda kind, known: F.size(F.array_except(cited(kind), F.transform(known, lambda x: x.cast("long")))) > 0
    unsaid = lambda value: value.isNotNull() & ~F.contains(F.col("answer"), money(value))
    issues = F.array_compact(F.array(F.when(strange("F", "fact_ids"), F.lit("unknown_fact")), F.when(strange("[ST]", "chunk_ids"), F.lit("unknown_chunk")), F.when(unsaid(revenue), F.lit("revenue_unsaid")), F.when(unsaid(before), F.lit("prior_revenue_unsaid"))))
    out = out.withColumn("issues", issues).withColumn("citations", F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[[FSTM]:[^\]]+\]"), F.lit(0)))))
    return out.select("question_id", "answer", "citations", "issues", F.when(F.size("issues") == 0, "verified").otherwise("unverified").alias("status"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _cut(text: Column, chars: int) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, chars - 3)), F.lit("...")))


def excerpt(text: Column, terms: list[str], chars: int = EXCERPT) -> Column:
    """A text in one line; of a longer one the surroundings of the first term in it, or its beginning."""
    flat = _flat(text)
    places = [F.when(F.contains(F.lower(flat), F.lit(t)), F.instr(F.lower(flat), t)) for t in terms]
    at = F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), at - 1 - chars // 3)
    piece = F.trim(F.substring(flat, start + 1, F.lit(chars)))
    around = F.concat(F.when(start > 0, "...").otherwise(""), piece, F.when(start + chars < F.length(flat), "...").otherwise(""))
    return F.when((F.length(flat) <= chars) | at.isNull(), _cut(flat, chars)).otherwise(around)


def transcript_briefs(turns: DataFrame, index: DataFrame, query: str, calls: int = 4, per_call: int = 3) -> DataFrame:
    """A row per entity: its latest current calls, newest first, each with its number of turns and the best of those that match.

    query: words, or a topic of TOPICS. Columns: entity, calls (period_end, period, turns, matches: rank, turn_id, speaker, excerpt), n_calls, n_matched (calls with a
    match), n_matches, gap (no_match or null). An entity without a current call has no row. The index holds postings by turn_id.
    """
    asked = TOPICS.get(query.lower(), query)
    current = turns.where("superseded_at IS NULL")
    newest = [F.desc_nulls_last("period_end"), F.desc("period")]
    held = _best(current.groupBy("entity", "period", "period_end").agg(F.count("*").alias("turns")), ["entity"], newest, calls, "nth")
    hits = search.matching_turns(turns, index, asked).select("entity", "period", "period_end", "turn_id", "ordinal", "score", "speaker", "text")
    same = ["entity", "period", "period_end"]
    best = _best(hits, same, [F.desc("score"), F.asc("ordinal"), F.asc("turn_id")], per_call, "rank")
    match = F.struct("rank", "turn_id", "speaker", excerpt(F.col("text"), list(search.query_of(asked).literals)).alias("excerpt"))
    matched = best.groupBy(*same).agg(F.sort_array(F.collect_list(match)).alias("matches"))
    rows = held.alias("h").join(matched.alias("m"), [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in same], "left").select("h.*", "m.matches")
    nothing = F.array().cast(dict(matched.dtypes)["matches"])
    call = F.struct("nth", "period_end", "period", "turns", F.coalesce("matches", nothing).alias("matches"))
    folded = rows.groupBy("entity").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    total = F.aggregate("calls", F.lit(0), lambda n, c: n + F.size(c["matches"]))
    return folded.select("entity", "calls", F.size("calls").alias("n_calls"), F.size(F.filter("calls", lambda c: F.size(c["matches"]) > 0)).alias("n_matched"), total.alias("n_matches"), F.when(total == 0, "no_match").alias("gap"))
