"""Filers' submission lists and filings' file indexes as JSON: filings wanted, their documents, and why an exhibit counts as a press release."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import reads
from ..operators.text import filing_period

# Forms read by default, the item of results of operations, file types, and names that tell a press release.
FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A")
RESULTS_ITEM = "2.02"
TEXT_FILES = (".htm", ".html", ".txt")
EXHIBIT_TYPES = ("EX-99", "EX-991", "EX-99.1")
DESCRIPTIONS = {"press release": "description_press_release", "earnings release": "description_earnings_release"}
NAMES = {"filename_earnings_release": r"earnings-?release", "filename_earnings_press": "earningspress", "filename_press_release": r"press-?release", "filename_ex99_1": r"(?:ex|exhibit)99(?:_?1)?(?![0-9])|exhbit991(?![0-9])", "filename_quarter_991": r"q[1-4][0-9]{4}991", "filename_quarterly_pr": r"q[1-4](?:fy)?[0-9]{2}pr"}

_FIELDS = {"accessionNumber": "accession_number", "form": "form_type", "filingDate": "filing_date", "reportDate": "report_date", "acceptanceDateTime": "accepted_at", "primaryDocument": "primary_document", "primaryDocDescription": "title", "items": "items", "isXBRL": "is_xbrl", "isInlineXBRL": "is_inline_xbrl"}
_LIST = "struct<" + ",".join(f"{k}:array<string>" for k in _FIELDS) + ">"


def submission_filings(raw: DataFrame, body: str = "body") -> DataFrame:
    """A row per filing of lists of submissions, each known by its accession number.

    raw: entity_id, body, and perhaps shard (0 for the list itself, then its older parts, which have no `filings`). Of a number listed twice the first
    place of the lowest shard counts. Rows without form, number, filing date or document are left out, as is a body that isn't JSON. Short columns read as nulls.
    """
    shard = F.col("shard").cast("int") if "shard" in raw.columns else F.lit(0)
    told = F.from_json(body, f"struct<filings:struct<recent:{_LIST}>,{_LIST[7:]}")
    lists = raw.select("entity_id", shard.alias("shard"), told.alias("j")).select("entity_id", "shard", *[F.coalesce(f"j.filings.recent.{k}", f"j.{k}", F.array().cast("array<string>")).alias(v) for k, v in _FIELDS.items()])
    rows = lists.select("entity_id", "shard", F.posexplode(F.arrays_zip(*_FIELDS.values())).alias("at", "f")).select("entity_id", "shard", "at", "f.*")
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    named = reduce(lambda a, b: a & b, [given(c).isNotNull() for c in ("accession_number", "form_type", "filing_date", "primary_document")])
    date = lambda c: F.try_to_timestamp(given(c), F.lit("yyyy-MM-dd")).cast("date")
    accepted = F.coalesce(F.try_to_timestamp(given("accepted_at"), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(given("accepted_at")))
    items = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    flag = lambda c: F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))
    rows = rows.where(named).withColumns({"filing_date": date("filing_date"), "report_date": date("report_date"), "accepted_at": accepted, "items": items, "title": given("title"), "is_xbrl": flag("is_xbrl"), "is_inline_xbrl": flag("is_inline_xbrl")})
    fields = F.struct(*[c for c in _FIELDS.values() if c != "accession_number"])
    return rows.where("filing_date IS NOT NULL").groupBy("entity_id", "accession_number").agg(F.min_by(fields, F.struct("shard", "at")).alias("f")).select("entity_id", "accession_number", "f.*")


def wanted_filings(filings: DataFrame, entities: DataFrame, since: Column | None = None, until: Column | None = None, forms: Sequence[str] = FORMS, results_only: bool = True) -> DataFrame:
    """Filings of some forms with their fiscal and calendar periods.

    Annual and quarterly reports are taken by whole fiscal years within the days, and never without a report date; current reports by the day they were filed,
    with results_only those on results of operations alone. entities: entity_id, fiscal_year_end_md; others' filings are left out.
    """
    form, filed = F.upper("form_type"), F.col("filing_date")
    rows = filings.where(form.isin([f.upper() for f in forms])).join(entities.select("entity_id", "fiscal_year_end_md"), "entity_id")
    rows = rows.withColumns(filing_period(F.col("form_type"), F.col("report_date"), F.col("fiscal_year_end_md")))
    if results_only:
        rows = rows.where(~form.startswith("8-K") | F.exists("items", lambda x: x.startswith(RESULTS_ITEM)))
    since, until = (F.lit("0001-01-01").cast("date") if since is None else since), (F.lit("9999-12-31").cast("date") if until is None else until)
    rows = rows.join(reads.year_window(entities, since, until), "entity_id")
    report = form.startswith("10-K") | form.startswith("10-Q")
    within = F.when(report, F.coalesce(F.col("fiscal_year").between(F.col("first_year"), F.col("last_year")), F.lit(False))).otherwise(filed.between(since, until))
    return rows.where(within).drop("first_year", "last_year", "fiscal_year_end_md")


def index_files(raw: DataFrame, body: str = "body") -> DataFrame:
    """The files of filings' indexes: entity_id, accession_number, at (place), name, type, description. Files without a name are left out."""
    told = F.from_json(body, "struct<directory:struct<item:array<struct<name:string,type:string,description:string>>>>")
    rows = raw.select("entity_id", "accession_number", F.posexplode(told["directory"]["item"]).alias("at", "f")).select("entity_id", "accession_number", "at", "f.*")
    return rows.where("name IS NOT NULL AND name <> ''")


def release_reason(name: Column, kind: Column, description: Column) -> Column:
    """Why a file is likely a press release: the first of its type, its description, its name; null if it isn't or is no text."""
    low, said = F.lower(name), F.lower(F.coalesce(description, F.lit("")))
    text = reduce(lambda a, b: a | b, [low.endswith(x) for x in TEXT_FILES])
    reason = F.when(~F.coalesce(text, F.lit(False)), F.lit(None)).when(F.upper(F.coalesce(kind, F.lit(""))).isin(*EXHIBIT_TYPES), "type_ex99")
    for phrase, why in DESCRIPTIONS.items():
        reason = reason.when(F.contains(said, F.lit(phrase)), why)
    for why, pattern in NAMES.items():
        reason = reason.when(low.rlike(pattern), why)
    return reason


def filing_documents(filings: DataFrame, files: DataFrame) -> DataFrame:
    """The documents of filings: each one's primary document, and of current reports the press releases among their files.

    Adds document_id, artifact_type (10k, 10q, 8k, press_release), filename, title, amended and reason (of a press release). A file listed twice counts once.
    """
    form = F.upper("form_type")
    kind = F.when(form.startswith("10-K"), "10k").when(form.startswith("10-Q"), "10q").otherwise("8k")
    base = filings.withColumn("amended", form.endswith("/A"))
    own = base.select("*", F.col("accession_number").alias("document_id"), kind.alias("artifact_type"), F.col("primary_document").alias("filename"), F.lit(None).cast("string").alias("reason"))
    told = files.withColumn("reason", release_reason(F.col("name"), F.col("type"), F.col("description"))).where("reason IS NOT NULL")
    once = told.groupBy("entity_id", "accession_number", F.col("name").alias("filename")).agg(F.min_by(F.struct("reason", "description"), "at").alias("f")).select("entity_id", "accession_number", "filename", "f.reason", F.col("f.description").alias("said"))
    current = base.where(~form.startswith("10-K") & ~form.startswith("10-Q")).join(once, ["entity_id", "accession_number"]).where("filename <> primary_document")
    exhibits = current.withColumn("title", F.coalesce("said", F.lit("press release"))).drop("said").withColumns({"document_id": F.concat_ws(":", "accession_number", "filename"), "artifact_type": F.lit("press_release")})
    return own.unionByName(exhibits)


def numbered(filings: DataFrame, most: int) -> DataFrame:
    """The newest filings of each entity, at most so many."""
    newest = Window.partitionBy("entity_id").orderBy(F.desc("filing_date"), F.desc("accession_number"))
    return filings.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most).drop("nth")
