"""Reads of companies, facts, documents and transcripts: filters and equi-joins whose keys reach the scans.

Every read takes one entity, or all of them where entity is None; none collects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The section that comes first among a filing's chunks, and the documents that are listed by default.
FIRST_SECTION = "item_7_mda"
DOCUMENT_TYPES = ("10-K", "10-Q", "8-K", "press_release", "transcript")


def _own(df: DataFrame, entity: int | None) -> DataFrame:
    return df if entity is None else df.where(F.col("entity_id") == entity)


def companies(entities: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    """Companies by their tickers in any case; all of them if None."""
    rows = entities if tickers is None else entities.where(F.upper("ticker").isin([t.upper() for t in tickers]))
    return rows.orderBy("entity_id")


def seeded(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Companies with seeds by cik in place of those there are; fiscal year ends come as MMDD. A null end keeps the known one."""
    md = F.when(F.col("fiscal_year_end").rlike("^[0-9]{4}$"), F.concat(F.substring("fiscal_year_end", 1, 2), F.lit("-"), F.substring("fiscal_year_end", 3, 2)))
    new = incoming.select("cik", F.upper("ticker").alias("n_ticker"), F.col("name").alias("n_name"), md.alias("n_md"))
    return existing.join(new, "cik", "full").select("cik", F.coalesce("n_ticker", "ticker").alias("ticker"), F.coalesce("n_name", "name").alias("name"), F.coalesce("n_md", "fiscal_year_end_md").alias("fiscal_year_end_md"))


def _at(facts: DataFrame, entity: int | None, year: int, quarter: int | None, kind: str) -> DataFrame:
    return _own(facts, entity).where((F.col("fiscal_year") == year) & F.col("fiscal_quarter").eqNullSafe(F.lit(quarter).cast("int")) & (F.col("period_type") == kind) & F.col("superseded_at").isNull())


def period_facts(facts: DataFrame, entity: int | None, year: int, quarter: int | None, kind: str = "quarter", concepts: Sequence[str] | None = None) -> DataFrame:
    """Current facts of a period without dimensions."""
    rows = _at(facts, entity, year, quarter, kind).where(F.col("dimension_type").isNull())
    rows = rows if concepts is None else rows.where(F.col("concept").isin(list(concepts)))
    return rows.select("entity_id", F.col("id").alias("fact_id"), "statement", "concept", "value", "unit", "fiscal_period_label", "period_end").orderBy("entity_id", "concept")


def period_segments(facts: DataFrame, entity: int | None, year: int, quarter: int | None, kind: str = "quarter") -> DataFrame:
    """Segment revenues of a period with those of the year before, the largest first."""
    keys = ["entity_id", "dimension_type", "dimension_key"]
    of = lambda y: _at(facts, entity, y, quarter, kind).where("statement = 'segment' AND concept = 'revenue'")
    before = of(year - 1).groupBy(*keys).agg(F.max("value").alias("prior_value"))
    rows = of(year).select(*keys, "dimension_label", "value", "fiscal_period_label", "period_end").join(before, keys, "left")
    growth = F.when(F.col("prior_value") != 0, (F.col("value").cast("double") - F.col("prior_value").cast("double")) / F.col("prior_value").cast("double"))
    return rows.withColumn("yoy_growth", growth).orderBy("entity_id", "dimension_type", F.desc("value"), "dimension_key")


def period_metrics(frame: DataFrame, entity: int | None, year: int, quarter: int | None = None) -> DataFrame:
    """One row of an entity's quarter (wide frame) or fiscal year (annual frame): levels, margins and free cash flow."""
    rows = _own(frame, entity).where(F.col("fiscal_year") == year)
    if quarter is None:
        columns = ["revenue_fy", "gross_margin_fy", "operating_margin_fy", "cfo_fy", "capital_expenditures_fy"]
        rows = rows.select("entity_id", "fiscal_year", "fiscal_period_label", "period_end", *columns)
    else:
        margin = lambda c: F.when(F.col("revenue") != 0, F.col(c).cast("double") / F.col("revenue").cast("double"))
        rows = rows.where(F.col("fiscal_quarter") == quarter).select(
            "entity_id", "fiscal_year", "fiscal_period_label", "period_end", F.col("revenue").alias("revenue_fy"), margin("gross_profit").alias("gross_margin_fy"), margin("operating_income").alias("operating_margin_fy"), F.col("cfo").alias("cfo_fy"), F.col("capital_expenditures").alias("capital_expenditures_fy"),
        )
    last = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("period_end")))
    return rows.withColumn("n", last).where("n = 1").drop("n").withColumn("fcf_fy", F.col("cfo_fy") + F.col("capital_expenditures_fy"))


def employees(rows: DataFrame, entities: DataFrame, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Annual head counts of annual reports, amended ones included: entity_id, fiscal_year, period_end, value, published_at.

    rows: entity_id, form_type, period_of_report, employee_count, published_at. Of several reports of a period the latest counts.
    """
    from ..functions.columns import fiscal_period

    known = rows.where(F.col("form_type").startswith("10-K") & F.col("employee_count").isNotNull()).join(entities.select("entity_id", "fiscal_year_end_md"), "entity_id")
    year, _, label = fiscal_period(F.col("period_of_report"), F.col("fiscal_year_end_md"), F.lit("annual"))
    known = known.withColumns({"fiscal_year": year, "fiscal_period_label": label})
    known = known if first_year is None else known.where(F.col("fiscal_year") >= first_year)
    known = known if last_year is None else known.where(F.col("fiscal_year") <= last_year)
    return known.groupBy("entity_id", "fiscal_year", "fiscal_period_label", F.col("period_of_report").alias("period_end")).agg(F.max_by("employee_count", "published_at").cast("decimal(28,4)").alias("value"), F.max("published_at").alias("published_at"))


def year_window(entities: DataFrame, since: Column, until: Column) -> DataFrame:
    """entity_id with the first fiscal year that ends on or after since, and the last that ends on or before until."""
    end = lambda year: F.make_date(year, F.substring("fiscal_year_end_md", 1, 2).cast("int"), F.substring("fiscal_year_end_md", 4, 2).cast("int"))
    first, last = F.year(since), F.year(until)
    return entities.select("entity_id", F.when(end(first) >= since, first).otherwise(first + 1).alias("first_year"), F.when(end(last) <= until, last).otherwise(last - 1).alias("last_year"))


# Documents. artifacts: artifact_id, entity_id, artifact_type, fiscal_year, fiscal_quarter, period_type, fiscal_period_key, period_end, published_at, superseded_at


def list_documents(artifacts: DataFrame, entity: int | None, year: int | None = None, key: str | None = None, types: Sequence[str] = DOCUMENT_TYPES) -> DataFrame:
    """Current documents of a fiscal year, its quarters' included, or of one period's key; annual ones first, then the newest."""
    rows = _own(artifacts, entity).where(F.col("superseded_at").isNull() & F.col("artifact_type").isin(list(types)))
    rows = rows.where(F.col("fiscal_year") == year) if key is None else rows.where(F.col("fiscal_period_key") == key)
    return rows.orderBy("entity_id", F.when(F.col("period_type") == "annual", 0).otherwise(1), F.desc_nulls_last("published_at"), F.desc("artifact_id"))


def section_chunks(artifacts: DataFrame, sections: DataFrame, chunks: DataFrame, entity: int | None, key: str, section_keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Chunks of some sections of a period's current documents: the newest document first, in it the discussion of management first.

    sections: section_id, artifact_id, section_key. chunks: section_id, chunk_ordinal, text.
    """
    docs = _own(artifacts, entity).where((F.col("fiscal_period_key") == key) & F.col("superseded_at").isNull()).select("artifact_id", "entity_id", "published_at")
    rows = sections.where(F.col("section_key").isin(list(section_keys))).join(docs, "artifact_id").join(chunks, "section_id")
    rows = rows.orderBy(F.desc_nulls_last("published_at"), F.when(F.col("section_key") == FIRST_SECTION, 0).otherwise(1), "artifact_id", "chunk_ordinal")
    return rows if limit is None else rows.limit(limit)


def unit_chunks(artifacts: DataFrame, units: DataFrame, chunks: DataFrame, entity: int | None, key: str, unit_type: str, year_end: tuple[int, Column] | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of text units of a period; with year_end (fiscal year, its end) also those of the fourth quarter that ends then, after the others.

    units: unit_id, artifact_id, unit_type, unit_ordinal, unit_key (perhaps its own fiscal_period_key). chunks: unit_id, chunk_ordinal, text.
    """
    own_key = F.col("unit_period_key") if "unit_period_key" in units.columns else F.lit(None).cast("string")
    told = units.where(F.col("unit_type") == unit_type).withColumn("unit_period_key", own_key)
    rows = told.join(_own(artifacts, entity).where(F.col("superseded_at").isNull()), "artifact_id")
    exact = F.coalesce("unit_period_key", "fiscal_period_key") == key
    fallback = F.lit(False) if year_end is None else (F.col("period_type") == "quarter") & (F.col("fiscal_year") == year_end[0]) & (F.col("fiscal_quarter") == 4) & (F.col("period_end") == year_end[1])
    rows = rows.withColumn("exact", F.coalesce(exact, F.lit(False))).where(F.col("exact") | F.coalesce(fallback, F.lit(False))).join(chunks, "unit_id")
    rows = rows.orderBy(F.desc("exact"), F.desc_nulls_last("published_at"), "artifact_id", "unit_ordinal", "chunk_ordinal")
    return rows if limit is None else rows.limit(limit)


def all_chunks(artifacts: DataFrame, sections: DataFrame, section_texts: DataFrame, units: DataFrame, unit_texts: DataFrame) -> DataFrame:
    """Chunks of sections and of text units as one table: source, artifact_id, entity_id, key, ordinal, text."""
    docs = artifacts.where("superseded_at IS NULL").select("artifact_id", "entity_id")
    a = sections.join(section_texts, "section_id").select(F.lit("section").alias("source"), "artifact_id", F.col("section_key").alias("key"), F.col("chunk_ordinal").alias("ordinal"), "text")
    b = units.join(unit_texts, "unit_id").select(F.lit("unit").alias("source"), "artifact_id", F.col("unit_key").alias("key"), F.col("chunk_ordinal").alias("ordinal"), "text")
    return a.unionByName(b).join(docs, "artifact_id")


def latest_transcripts(artifacts: DataFrame, units: DataFrame, chunks: DataFrame, entity: int | None, n: int = 4, asof: Column | None = None) -> DataFrame:
    """The last n current transcripts of an entity (of each entity), with the numbers of their turns and chunks."""
    rows = _own(artifacts, entity).where("artifact_type = 'transcript' AND superseded_at IS NULL")
    rows = rows if asof is None else rows.where(F.col("published_at") <= asof)
    order = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("period_end"), F.desc_nulls_last("published_at"), F.desc("artifact_id"))
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    pieces = chunks.groupBy("unit_id").agg(F.count("*").alias("chunks"))
    counts = units.where("unit_type = 'transcript'").join(pieces, "unit_id", "left").groupBy("artifact_id").agg(F.count("*").alias("turn_count"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(counts, "artifact_id", "left").select("artifact_id", "entity_id", "fiscal_period_key", "period_end", "published_at", "n", zero("turn_count"), zero("chunk_count"))


def transcript_turns(artifacts: DataFrame, units: DataFrame, entity: int | None, n: int = 1, before: Column | None = None) -> DataFrame:
    """The turns of the last n transcripts in their order."""
    rows = _own(artifacts, entity).where("artifact_type = 'transcript' AND superseded_at IS NULL")
    rows = rows if before is None else rows.where(F.col("published_at") <= before)
    order = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("period_end"), F.desc_nulls_last("published_at"), F.desc("artifact_id"))
    last = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("artifact_id", "entity_id", "n")
    return units.where("unit_type = 'transcript'").join(last, "artifact_id").orderBy("entity_id", "n", "unit_ordinal")


def highlighted(text: Column, terms: Sequence[str], width: int = 60) -> Column:
    """The first term's surroundings, with all terms in <b>; null where none occurs."""
    import re

    some = "|".join(re.escape(t) for t in terms)
    around = F.regexp_extract(text, rf"(?is)(?:^|\W)(.{{0,{width}}}(?<!\w)(?:{some})(?!\w).{{0,{width}}})", 1)
    return F.when(around != "", F.regexp_replace(around, rf"(?i)(?<!\w)({some})(?!\w)", "<b>$1</b>"))


def daily_closes(prices: DataFrame, entity: int | None, since: Column, until: Column, grain: str | None = None, most: int = 400) -> DataFrame:
    """An entity's days between two dates; grain takes the first of each week, month or quarter. most: rows of an entity, the newest."""
    rows = _own(prices, entity).where(F.col("date").between(since, until))
    if grain is not None:
        first = Window.partitionBy("entity_id", F.date_trunc(grain, F.col("date"))).orderBy("date")
        rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    newest = Window.partitionBy("entity_id").orderBy(F.desc("date"))
    return rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most).drop("n")
