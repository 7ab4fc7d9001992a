"""Repairs and anchors: splits, gaps, calendar columns, transcript periods, cross-checks against another store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import calendar_period, dbl, tolerance


def split_factor(ratio: str, entity: str, date: str) -> Column:
    """What a value of a day is multiplied by for later splits: the product of all later ratios."""
    later = Window.partitionBy(entity).orderBy(date).rowsBetween(1, Window.unboundedFollowing)
    return F.coalesce(F.product(F.coalesce(F.col(ratio), F.lit(1.0))).over(later), F.lit(1.0))


def likely_split(column: str, entity: str, date: str, up: float = 1.5, down: float = 0.67) -> Column:
    """The jump of a share count that looks like a split, else null."""
    jump = dbl(column) / dbl(F.lag(column).over(Window.partitionBy(entity).orderBy(date)))
    return F.when((jump >= up) | (jump <= down), jump)


def forward_filled(column: str, entity: str, date: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))


def repaired_calendar(facts: DataFrame) -> DataFrame:
    """Calendar columns that follow from the period's end; repaired tells which rows changed."""
    y, q, label = calendar_period(F.col("period_end"))
    changed = ~(F.col("calendar_year").eqNullSafe(y) & F.col("calendar_quarter").eqNullSafe(q))
    return facts.withColumn("repaired", changed).withColumns({"calendar_year": y, "calendar_quarter": q, "calendar_period_label": label})


def transcript_anchor(transcripts: DataFrame, ends: DataFrame, keys: list[str], derived: Column) -> DataFrame:
    """The period end of a transcript: the only end that its facts have, else the derived one; several ends are an error."""
    known = ends.groupBy(*keys).agg(F.countDistinct("period_end").alias("n_ends"), F.max("period_end").alias("fact_end"))
    out = transcripts.join(known, keys, "left")
    status = F.when(F.col("n_ends") == 1, "facts").when(F.col("n_ends") > 1, "ambiguous").when(derived.isNotNull(), "derived").otherwise("unknown")
    return out.withColumn("anchor", status).withColumn("period_end", F.when(F.col("anchor") == "facts", F.col("fact_end")).when(F.col("anchor") == "derived", derived)).drop("n_ends", "fact_end")


def cross_check(ours: DataFrame, theirs: DataFrame, keys: list[str], absolute: float = 2e6, relative: float = 0.001) -> DataFrame:
    """Agreement with another store: match, sign_flip, unit_scale (a factor of a million), mismatch, only_ours, only_theirs."""
    a, b = dbl("value"), dbl("other")
    near = lambda x, y: F.abs(x - y) <= tolerance(y, absolute, relative)
    verdict = F.when(b.isNull(), "only_ours").when(a.isNull(), "only_theirs").when(near(a, b), "match").when(near(-a, b), "sign_flip").when(near(a / 1e6, b) | near(a * 1e6, b), "unit_scale").otherwise("mismatch")
    return ours.join(theirs, keys, "full").withColumn("verdict", verdict)


def exhibit_kind(kind: Column, description: Column, filename: Column) -> Column:
    """Whether an exhibit of a current report is its press release, by its type, description or file name."""
    typed = F.upper(kind).rlike(r"^EX-99(\.0?1)?$")
    said = description.rlike(r"(?i)press\s+release|earnings\s+release|news\s+release")
    named = filename.rlike(r"(?i)(?:ex(?:hibit)?[-_]?99|press|earnings).*\.(?:htm|html|txt)$")
    return F.when(said | (typed & named), "press_release").when(typed, "maybe").otherwise("other")


def record_session(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """The store of triage sessions with new ones; a session id is kept once."""
    return sessions.unionByName(new.dropDuplicates(["session_id"]).join(sessions.select("session_id"), "session_id", "left_anti"))


def precedents(sessions: DataFrame, finding_ids: list[int], words: list[str], limit: int = 10) -> DataFrame:
    """Sessions that share findings or all words of their intent; shared findings first, then the newest."""
    shared = F.size(F.array_intersect("finding_ids", F.array(*[F.lit(i).cast("long") for i in finding_ids]))) if finding_ids else F.lit(0)
    spoken = F.lit(bool(words))
    for w in words:
        spoken = spoken & F.lower("intent").contains(w.lower())
    return sessions.withColumn("shared", shared).where((F.col("shared") > 0) | spoken).orderBy(F.desc("shared"), F.desc("at"), "session_id").limit(limit)
