"""Sections of annual and quarterly reports, found by what a line is and by what stands around it.

Every line gets a one-letter code; the lines before and after it are then a short word of codes, on which the tests for tables of contents,
page lists and cross-reference indexes are patterns. All of it is windows in one partitioning by document; no document is handled as
one string beyond its lines.

Codes: P prose, D a line with leader dots or a page at its end, I an item's number alone, J an item with its title, T a part, N a page
number, R a reference to pages, H a heading, x anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Items that are kept, by form, part (quarterly reports) and number, with the words a title of theirs has.
ITEMS = {
    "10-K": {"1": ("business", "business"), "1a": ("risk_factors", "risk factors"), "1c": ("cybersecurity", "cyber"), "3": ("legal_proceedings", "legal"), "7": ("mdna", "management"), "7a": ("market_risk", "quantitative"), "8": ("financial_statements", "financial"), "9a": ("controls", "controls"), "9b": ("other_information", "other information")},
    "10-Q i": {"1": ("financial_statements", "financial"), "2": ("mdna", "management"), "3": ("market_risk", "quantitative"), "4": ("controls", "controls")},
    "10-Q ii": {"1a": ("risk_factors", "risk factors"), "5": ("other_information", "other information")},
}
# Headings that name a section without its item, as letters only; those that end in a blank may go on.
ALONE = {
    "management s discussion and analysis": "mdna", "management s discussion and analysis of ": "mdna", "quantitative and qualitative disclosures about market risk": "market_risk", "controls and procedures": "controls", "disclosure controls and procedures": "controls", "risk factors": "risk_factors",
    "other information": "other_information", "legal proceedings": "legal_proceedings", "business": "business", "our business": "business",
}
ITEM = r"(?i)^\s*(?:part\s+[ivx]+\b[\s.,:\-–—]*)?item\s+(\d{1,2}[a-c]?)\b[\s.:\-–—]*(.*)$"
PART = r"(?i)^\s*part\s+(iv|i{1,3})\b"
SCHEMA = ("key", "part", "item", "title", "start", "end", "words", "confidence", "method")
#: Shares of a document, from its start and to its end, in which lists of items are told from sections.
HEAD, FOOT, EDGE = 0.15, 0.90, 0.05
#: From this confidence on the first pass counts; what the second one finds stays below.
SURE, UNSURE = 0.85, 0.84


def _coded(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """Lines that aren't blank: key, family, size (of the text), i, line, start, end, words, item, title, part, plain, code."""
    body = F.coalesce(F.col(text), F.lit(""))
    family = F.when(F.upper(form).startswith("10-K"), "10-K").when(F.upper(form).startswith("10-Q"), "10-Q")
    lines = df.select(key, family.alias("family"), F.length(body).alias("size"), F.posexplode(F.split(body, "\n")).alias("i", "line"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")).where("trim(line) <> ''")
    tidy = F.trim(F.regexp_replace("line", r"\s+", " "))
    words = F.size(F.split(tidy, " "))
    short = (F.length(tidy) <= 160) & (words <= 14)
    names = F.regexp_count(tidy, F.lit(r"[A-Za-z][A-Za-z&/'’\-]*"))
    capital = F.regexp_count(tidy, F.lit(r"(?<![A-Za-z&/'’\-])[A-Z][A-Za-z&/'’\-]*"))
    item, title = F.lower(F.regexp_extract("line", ITEM, 1)), F.trim(F.regexp_extract("line", ITEM, 2))
    closed = tidy.rlike(r"[.?!;”\"]$")
    code = (
        F.when(tidy.rlike(r"\.{3,}|(?:\. ){3,}"), "D").when((item != "") & title.rlike(r"\S\s+\d{1,3}$"), "D").when((item != "") & (title == ""), "I").when((item != "") & short, "J").when(tidy.rlike(PART) & short, "T").when(tidy.rlike(r"^-?\s?\d{1,3}\s?-?$"), "N")
        .when(tidy.rlike(r"(?i)^(?:pages?\s+\d{1,4}(?:\s*[-–,]\s*\d{1,4})*|none)$"), "R").when((words >= 6) & tidy.rlike(r"[.?!”\"]$"), "P").when(short & ~closed & (names > 0) & (capital * 2 >= names), "H").otherwise("x")
    )
    plain = F.trim(F.regexp_replace(F.lower(tidy), "[^a-z]+", " "))
    return lines.select(
        key, "family", "size", "i", "start", (F.col("start") + F.length(F.rtrim("line"))).alias("end"), words.alias("words"), F.when(item != "", item).alias("item"), F.when(title != "", title).alias("title"),
        F.when(tidy.rlike(PART) & short, F.lower(F.regexp_extract(tidy, PART, 1))).alias("part"), F.when(short, plain).alias("plain"), tidy.rlike("(?i)^table of contents$").alias("furniture"), tidy.rlike(r"(?i)^signatures?\b").alias("signed"), code.alias("code"),
    )


def _listed(key: str) -> Column:
    """Whether a line stands in a table of contents, a page list or an index."""
    order = Window.partitionBy(key).orderBy("i")
    said = lambda a, b: F.array_join(F.collect_list("code").over(order.rowsBetween(a, b)), "")
    ahead = F.regexp_extract(said(1, 9), "^[^P]*", 0)  # up to the next prose
    behind = F.regexp_extract(said(-8, -1), "[^PDT]*$", 0)  # since the last prose, part or dotted line
    count = lambda where, what: F.regexp_count(where, F.lit(what))
    top, bottom = F.col("start") <= F.col("size") * HEAD, F.col("start") >= F.col("size") * FOOT
    near = F.concat(F.substring(behind, -5, 5), "code", F.substring(ahead, 1, 7))
    return (
        (F.col("code") == "D")
        | (count(F.concat("code", ahead), "[IJH]") >= 5)
        | ((count(ahead, "N") >= 2) & (count(ahead, "[IJHD]") >= 2))
        | F.contains(ahead, F.lit("R"))
        | (top & (count(behind, "[IJH]") >= 4))
        | ((top | bottom) & (count(near, "[IJ]") >= 3))
    )


def _keyed(lines: DataFrame, key: str) -> DataFrame:
    """Adds section (the key a line may start), part_of (the section's part) and listed."""
    part = F.last("part", ignorenulls=True).over(Window.partitionBy(key).orderBy("i"))
    lines = lines.withColumn("now", part).withColumn("listed", _listed(key))
    fits = lambda word: F.col("title").isNull() | F.contains(F.lower("title"), F.lit(word))
    place = F.when(F.col("family") == "10-K", "10-K").otherwise(F.concat_ws(" ", "family", "now"))
    by_item, by_name = F.when(F.lit(False), "x"), F.when(F.lit(False), "x")
    for kind, items in ITEMS.items():
        for n, (name, word) in items.items():
            by_item = by_item.when((place == kind) & (F.col("item") == n) & fits(word), name)
    for said, name in ALONE.items():
        hit = F.startswith("plain", F.lit(said)) if said.endswith(" ") else F.col("plain") == said
        for kind, items in ITEMS.items():
            if name in {x for x, _ in items.values()}:
                where = F.col("family") == kind[:4]
                where = where if kind == "10-K" else where & (F.col("now").isNull() | (F.col("now") == kind[5:]))
                by_name = by_name.when(hit & where & (F.col("code") != "D"), name)
    lines = lines.withColumn("section", F.when(F.col("item").isNotNull(), by_item).when(F.col("family").isNotNull(), by_name))
    parts = {name: kind[5:] for kind, items in ITEMS.items() if kind != "10-K" for name, _ in items.values()}
    of = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("section"))
    return lines.withColumn("part_of", F.when((F.col("family") == "10-Q") & F.col("section").isNotNull(), of))


def filing_sections(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """key and the columns of SCHEMA (the section's name as `section`): the sections of each filing, by place. key is unique.

    Headings in lists don't count. The first pass takes each section's first heading; if any section found so is unsure, or none is found, a second
    one takes the last headings, at less confidence. A section ends at the next one, at an item that isn't kept, at a part's heading (quarterly
    reports), at the signatures or with the text; page numbers, parts and running heads at its end are cut. No heading, no such form, or no text:
    the whole body, at confidence 0. Offsets are code points, end exclusive.
    """
    lines = _keyed(_coded(df, key, text, form), key)
    may = F.col("section").isNotNull() & ~F.col("listed")
    same = Window.partitionBy(key, "section")
    pick = lambda f: may & (F.col("i") == f(F.when(may, F.col("i"))).over(same))
    lines = lines.withColumns({"first_one": pick(F.min), "last_one": pick(F.max)})
    ends = (F.col("item").isNotNull() & ~may) | F.col("signed") | ((F.col("family") == "10-Q") & (F.col("code") == "T"))
    order = Window.partitionBy(key).orderBy("i")
    at = lambda taken: F.last(F.when(F.col(taken), F.col("i")).when(ends, -1), ignorenulls=True).over(order)
    lines = lines.withColumns({"deterministic": at("first_one"), "repair": at("last_one")})
    passes = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("at")) for m in ("deterministic", "repair")])
    inside = lines.withColumn("x", F.explode(passes)).where("x.at >= 0")
    own = F.col("i") == F.col("x.at")
    of = lambda c: F.max(F.when(own, F.col(c))).alias(c)
    kept = ~(F.col("code").isin("N", "T") | F.col("furniture"))
    found = inside.groupBy(key, F.col("x.method").alias("method"), F.col("x.at").alias("at")).agg(of("section"), of("part_of"), of("item"), of("title"), of("start"), of("size"), F.max(F.when(kept, F.col("end"))).alias("end"), F.sum(F.when(kept, F.col("words"))).cast("int").alias("words"))
    whole = Window.partitionBy(key, "method")
    loss = 0.15 * (F.col("start") < F.floor(F.col("size") * EDGE)).cast("int") + 0.05 * (F.col("words") < 15).cast("int") + 0.15 * (F.count("*").over(whole) < 2).cast("int")
    base = F.when(F.col("method") == "deterministic", 1.0).otherwise(0.8)
    found = found.withColumn("confidence", F.round(base - loss, 3))
    found = found.withColumn("confidence", F.when(F.col("method") == "repair", F.greatest(F.lit(0.01), F.least(F.lit(UNSURE), "confidence"))).otherwise(F.col("confidence")))
    sure = F.min(F.when(F.col("method") == "deterministic", F.col("confidence"))).over(Window.partitionBy(key)) >= SURE
    found = found.withColumn("sure", sure).where(F.col("sure") == (F.col("method") == "deterministic"))
    columns = [F.col(key), "section", F.col("part_of").alias("part"), "item", "title", "start", "end", "words", "confidence", "method"]
    body = F.coalesce(F.col(text), F.lit(""))
    none = lambda t: F.lit(None).cast(t)
    rest = df.join(found.select(key).distinct(), key, "left_anti").select(key, F.lit("full_body").alias("section"), none("string").alias("part"), none("string").alias("item"), none("string").alias("title"), F.lit(0).alias("start"), F.length(body).alias("end"), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("words"), F.lit(0.0).alias("confidence"), F.lit("unparsed_fallback").alias("method"))
    return found.select(*columns).unionByName(rest)
