"""Data-quality checks and the life of a finding.

A check is a function of DataFrames that returns drafts (fingerprint, source_check, severity, entity_id, summary); merge_findings() takes the
drafts of a sweep to the stored findings in one keyed full outer join.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fingerprint

CHECKS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in CHECKS:
            raise ValueError(f"check {name} exists")
        CHECKS[name] = f
        return f

    return add


def drafts(rows: DataFrame, check: str, severity: str | Column, entity: str, scope: dict[str, Column], summary: Column, params: dict[str, Column] | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(fingerprint(check, scope, params).alias("fingerprint"), F.lit(check).alias("source_check"), level.alias("severity"), F.col(entity).alias("entity_id"), summary.alias("summary"))


# Checks; each returns the offending rows, drafts() turns them into findings.


@register("zero_row_runs")
def zero_row_runs(runs: DataFrame, counts: str, keys: list[str], today: Column, days: int = 7) -> DataFrame:
    """Runs that succeeded of late and whose counters, a JSON object, sum to 0."""
    total = reduce(lambda a, k: a + F.coalesce(F.get_json_object(counts, f"$.{k}").cast("double"), F.lit(0.0)), keys, F.lit(0.0))
    return runs.where((F.col("status") == "succeeded") & (F.col("ended_at") >= today - F.expr(f"INTERVAL {days} DAY")) & (total == 0))


@register("unresolved_flags_aging")
def flags_aging(flags: DataFrame, today: Column, days: int = 14) -> DataFrame:
    return flags.where(F.col("resolved_at").isNull() & (F.col("flagged_at") < today - F.expr(f"INTERVAL {days} DAY")))


@register("artifact_orphans")
def orphans(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents without a row in any child table."""
    return reduce(lambda df, c: df.join(c.select(key).distinct(), key, "left_anti"), children, parents)


@register("unparsed_body_fallback")
def fallback_counts(sections: DataFrame, by: list[str], method: str = "method", fallback: str = "unparsed_fallback") -> DataFrame:
    return sections.groupBy(*by).agg(F.count_if(F.col(method) == fallback).alias("n"), F.count("*").alias("total")).where("n > 0")


@register("extraction_method_drift")
def method_drift(sections: DataFrame, group: str, good: Column, at: str, today: Column, recent: int = 30, baseline: int = 60, least: int = 10, drop: float = 0.15) -> DataFrame:
    """Groups whose share of good rows fell from the baseline window to the recent one; one pass."""
    age = F.date_diff(today, F.to_date(at))
    new, old = (age >= 0) & (age < recent), (age >= recent) & (age < recent + baseline)
    sums = sections.groupBy(group).agg(F.count_if(new).alias("recent_n"), F.count_if(old).alias("baseline_n"), F.count_if(new & good).alias("r"), F.count_if(old & good).alias("b")).where(f"recent_n >= {least} AND baseline_n >= {least}")
    sums = sums.withColumns({"recent_share": F.col("r") / F.col("recent_n"), "baseline_share": F.col("b") / F.col("baseline_n")})
    return sums.where(F.col("baseline_share") - F.col("recent_share") >= drop).drop("r", "b")


@register("chunk_repair_concentration")
def repair_concentration(sections: DataFrame, by: str, repaired: Column, least: int = 3, share: float = 0.5) -> DataFrame:
    return sections.groupBy(by).agg(F.count("*").alias("n"), F.count_if(repaired).alias("repaired")).where((F.col("n") >= least) & (F.col("repaired") / F.col("n") > share))


@register("section_text_suspicious_length")
def suspicious_length(sections: DataFrame, group: str, length: str, least_median: float = 10_000, share: float = 0.01, most: int = 200) -> DataFrame:
    """Rows far shorter than their group's median."""
    medians = sections.groupBy(group).agg(F.percentile(length, F.lit(0.5)).alias("median")).where(F.col("median") >= least_median)
    return sections.join(medians, group).where((F.col(length) < F.col("median") * share) & (F.col(length) < most))


#: What is expected of each entity: vertical, rule, threshold (periods, or days of age).
STANDARD = [
    ("financials", "min_periods", 20), ("segments", "present", 0), ("employees", "recency", 400), ("sec_qual", "min_periods", 20), ("transcript", "present", 0), ("transcript", "min_periods", 20), ("transcript", "recency", 150), ("prices", "present", 0), ("prices", "recency", 5),
    ("estimates", "present", 0), ("estimates", "recency", 3),
]


@register("expected_coverage")
def expected_coverage(coverage: DataFrame, entities: DataFrame, today: Column, rules: list[tuple[str, str, int]] = STANDARD) -> DataFrame:
    """The rules that entities fall short of: entity_id, vertical, rule, threshold, actual (periods, or days of age).

    Without rows a vertical is neither present nor recent. The rules are constants of each entity's row.
    """
    listed = F.array(*[F.struct(F.lit(v).alias("vertical"), F.lit(k).alias("rule"), F.lit(n).alias("threshold")) for v, k, n in rules])
    wanted = entities.select("entity_id", F.explode(listed).alias("x")).select("entity_id", "x.*")
    joined = wanted.join(coverage.select("entity_id", "vertical", "periods", "latest"), ["entity_id", "vertical"], "left")
    periods, age = F.coalesce("periods", F.lit(0)).cast("long"), F.date_diff(today, F.col("latest")).cast("long")
    met = F.when(F.col("rule") == "present", periods > 0).when(F.col("rule") == "min_periods", periods >= F.col("threshold")).when(F.col("rule") == "recency", F.coalesce(age <= F.col("threshold"), F.lit(False)))
    actual = F.when(F.col("rule") == "recency", age).otherwise(periods)
    return joined.where(~met).select("entity_id", "vertical", "rule", "threshold", actual.alias("actual"))


@register("quarterly_sum_to_annual_drift")
def annual_drift(quarters: DataFrame, annual: DataFrame, keys: list[str], absolute: float = 50e6, relative: float = 0.05) -> DataFrame:
    """Years whose four quarters don't sum to the annual value."""
    sums = quarters.groupBy(*keys).agg(F.sum("value").alias("quarter_sum"), F.countDistinct("fiscal_quarter").alias("n")).where("n = 4")
    gap = F.abs(F.col("quarter_sum").cast("double") - F.col("annual").cast("double"))
    return sums.join(annual, keys).withColumn("gap", gap).where((F.col("gap") >= absolute) & (F.col("gap") >= relative * F.abs(F.col("annual").cast("double"))))


@register("quarterly_value_duplication")
def value_duplication(facts: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """Consecutive quarters of a fiscal year with the same non-zero values."""
    w = Window.partitionBy("entity_id", "fiscal_year", "concept").orderBy("fiscal_quarter")
    pairs = facts.select("entity_id", "fiscal_year", "concept", "fiscal_quarter", "value", F.lead("fiscal_quarter").over(w).alias("next_q"), F.lead("value").over(w).alias("next_value"))
    pairs = pairs.where("next_q = fiscal_quarter + 1 AND value <> 0 AND next_value <> 0")
    sums = pairs.groupBy("entity_id", "fiscal_year", "fiscal_quarter").agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("next_value")).alias("same"))
    return sums.where((F.col("n") >= least) & (F.col("same") / F.col("n") > share))


@register("q4_period_end_consistency")
def q4_ends(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    return quarters.where("fiscal_quarter = 4").join(annual.select("entity_id", "fiscal_year", F.col("period_end").alias("annual_end")), ["entity_id", "fiscal_year"]).where("period_end <> annual_end")


@register("cross_endpoint_period_end_consistency")
def cross_ends(rows: DataFrame, trusted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose end differs from the trusted source's only one; null keys match."""
    one = trusted.groupBy(*keys).agg(F.countDistinct("period_end").alias("n"), F.max("period_end").alias("trusted_end")).where("n = 1")
    one = one.select(*[F.col(k).alias(f"t_{k}") for k in keys], "trusted_end")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys])
    return rows.join(one, same).where("period_end <> trusted_end").select(*rows.columns, "trusted_end")


@register("period_end_calendar_consistency")
def calendar_ends(facts: DataFrame) -> DataFrame:
    return facts.where((F.col("calendar_year") != F.year("period_end")) | (F.col("calendar_quarter") != F.quarter("period_end")))


@register("prices_gap_detection")
def price_gaps(prices: DataFrame, least_holders: int = 1, sample: int = 20) -> DataFrame:
    """Days on which others traded, within a security's first and last day, without a price; at most `sample` are listed.

    Days are numbered over the market; a security's gaps are jumps in the numbers of its own days, so the calendar is
    never crossed with the securities.
    """
    days = prices.groupBy("date").agg(F.countDistinct("entity_id").alias("holders")).where(F.col("holders") >= least_holders).select("date")
    number = F.row_number().over(Window.orderBy("date"))  # one row per day of the calendar
    numbered = days.withColumn("no", number)
    w = Window.partitionBy("entity_id").orderBy("no")
    jumps = prices.select("entity_id", "date").distinct().join(numbered, "date").withColumn("before", F.lag("no").over(w)).where("no > before + 1")
    missing = jumps.select("entity_id", F.explode(F.sequence(F.col("before") + 1, F.col("no") - 1)).alias("no")).join(numbered, "no")
    ranked = missing.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy("date")))
    return ranked.groupBy("entity_id").agg(F.count("*").alias("gaps"), F.min("date").alias("first_gap"), F.sort_array(F.collect_list(F.when(F.col("n") <= sample, F.col("date")))).alias("sample"))


@register("forward_estimate_consistency")
def forward_consistency(estimates: DataFrame, today: Column, share: float = 0.2) -> DataFrame:
    gap = F.abs(F.col("net_income_avg") - F.col("ebit_avg")) / F.col("revenue_avg")
    return estimates.where((F.col("period_end") >= today) & (F.col("net_income_avg") > 0) & (F.col("ebit_avg") < 0) & (F.col("revenue_avg") > 0) & (gap > share))


@register("earnings_surprise_sanity")
def surprise_sanity(surprises: DataFrame, most: float = 2.0) -> DataFrame:
    return surprises.where((F.col("estimated") != 0) & (F.abs((F.col("actual") - F.col("estimated")) / F.col("estimated")) > most))


@register("analyst_estimates_orphan")
def estimate_orphans(estimates: DataFrame, securities: DataFrame) -> DataFrame:
    return estimates.join(securities, "security_id").where("status <> 'active' OR kind <> 'common_stock'").groupBy("security_id").agg(F.count("*").alias("n"))


@register("price_target_consensus_freshness")
def target_freshness(securities: DataFrame, targets: DataFrame, today: Column, days: int = 3) -> DataFrame:
    return securities.join(targets, "security_id", "left").where(F.col("fetched_at").isNull() | (F.col("fetched_at") < today - F.expr(f"INTERVAL {days} DAY")))


@register("xbrl_audit_unresolved")
def audit_unresolved(runs: DataFrame, resolved: DataFrame, skip: list[str], absolute: float = 50e6, per_year: int = 3) -> DataFrame:
    """The latest run's divergences (exploded), but for resolved, skipped and small ones; the largest few per entity and year."""
    latest = runs.withColumn("n", F.rank().over(Window.partitionBy("entity_id").orderBy(F.desc("run_at")))).where("n = 1").drop("n")
    left = latest.join(resolved.select("entity_id", "concept", "fiscal_year").distinct(), ["entity_id", "concept", "fiscal_year"], "left_anti").where(~F.col("concept").isin(skip) & (F.abs("delta") >= absolute))
    return left.withColumn("n", F.row_number().over(Window.partitionBy("entity_id", "fiscal_year").orderBy(F.desc(F.abs("delta")), "concept"))).where(F.col("n") <= per_year)


# Findings


def merge_findings(stored: DataFrame, found: DataFrame, now: Column, checks_run: list[str] | None = None) -> DataFrame:
    """A sweep's drafts against the stored findings, in one full outer join.

    New drafts open; drafts of open findings are seen again; suppressed ones stay closed; open findings of the checks that ran and weren't
    found again are closed as resolved. found repeats no fingerprint after this; history grows by a word for each change.
    """
    drafted = found.dropDuplicates(["fingerprint"]).select("fingerprint", *[F.col(c).alias(f"new_{c}") for c in ("source_check", "severity", "entity_id", "summary")], F.lit(True).alias("found"))
    both = stored.join(drafted, "fingerprint", "full")
    is_new, is_open = F.col("status").isNull(), F.col("status") == "open"
    suppressed = F.col("suppressed_until").isNotNull() & (F.col("suppressed_until") > now)
    seen = F.coalesce("found", F.lit(False))
    ran = F.col("source_check").isin(checks_run) if checks_run is not None else F.lit(True)
    event = (
        F.when(is_new, "created").when(seen & suppressed, "suppressed").when(seen & is_open, "re_observed").when(seen, "reopened").when(is_open & ran, "auto_resolved").otherwise("kept")
    )
    status = F.when(event.isin("created", "re_observed", "reopened"), "open").when(event.isin("suppressed", "auto_resolved"), "closed").otherwise(F.col("status"))
    history = F.coalesce("history", F.array().cast("array<string>"))
    pick = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c)
    return both.select(
        "fingerprint", pick("source_check"), pick("severity"), pick("entity_id"), pick("summary"), status.alias("status"), F.when(event.isin("created", "reopened"), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(seen & (event != "suppressed"), now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), "suppressed_until", F.when(event == "auto_resolved", "resolved").when(status == "open", None).otherwise(F.col("closed_reason")).alias("closed_reason"),
        F.when(event == "kept", history).otherwise(F.concat(history, F.array(event))).alias("history"), event.alias("event"),
    )


#: What may happen to a finding by hand.
TRANSITIONS = {"close": ("open", "closed"), "resolve": ("open", "closed"), "dismiss": ("open", "closed"), "suppress": ("open", "closed")}


def transition(stored: DataFrame, fingerprints: list[str], action: str, now: Column, until: Column | None = None) -> DataFrame:
    """Close, resolve, dismiss or suppress findings; others are left as they are."""
    before, after = TRANSITIONS[action]
    if (action == "suppress") != (until is not None):
        raise ValueError("suppress, and only that, needs an end")
    hit = F.col("fingerprint").isin(fingerprints) & (F.col("status") == before)
    new = {"status": F.lit(after), "closed_reason": F.lit(action), "history": F.concat("history", F.array(F.lit(action)))} | ({} if until is None else {"suppressed_until": until})
    return stored.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in new.items()})


@dataclass
class Sweep:
    """Runs checks apart from each other: one that fails, in its plan or when it runs, is reported, the others count.

    keep: writes a check's findings and returns their reader, so that each check runs for itself; without it only plans are checked.
    """

    keep: Callable[[str, DataFrame], DataFrame] | None = None
    failed: dict[str, str] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    def run(self, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
        found = None
        for name, check in checks.items():
            try:
                df = check()
                df.schema  # noqa: B018  a check with a wrong plan fails here
                df = self.keep(name, df) if self.keep else df
            except Exception as e:  # noqa: BLE001  any failure is the check's own
                self.failed[name] = str(e)[:500]
                continue
            self.ran.append(name)
            found = df if found is None else found.unionByName(df)
        return found


def inbox(findings: DataFrame, flags: DataFrame, now: Column) -> DataFrame:
    """Open findings and unresolved flags with their age in days."""
    age = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 86400.0
    period = F.when(F.col("fiscal_quarter").isNotNull(), F.format_string("FY%d-Q%d", "fiscal_year", "fiscal_quarter")).when(F.col("fiscal_year").isNotNull(), F.format_string("FY%d", "fiscal_year"))
    a = findings.where("status = 'open'").select(F.lit("finding").alias("source"), F.col("fingerprint").alias("signal_id"), "severity", "entity_id", F.lit(None).cast("string").alias("fiscal_period_key"), "summary", F.col("created_at").alias("detected_at"), age("created_at").alias("age_days"))
    b = flags.where("resolved_at IS NULL").select(F.lit("flag").alias("source"), F.col("id").cast("string").alias("signal_id"), "severity", "entity_id", period.alias("fiscal_period_key"), F.col("reason").alias("summary"), F.col("flagged_at").alias("detected_at"), age("flagged_at").alias("age_days"))
    return a.unionByName(b)


def _part(df: DataFrame) -> tuple[Column, Column]:
    """What a period is told by: a date by its month and its day's bit, so that a month's days are one number; others by themselves and bit 1."""
    if df.schema["period"].dataType.typeName() != "date":
        return F.col("period").cast("string").alias("part"), F.when(F.col("period").isNotNull(), F.lit(1)).alias("bit")
    return F.trunc("period", "month").cast("string").alias("part"), F.call_function("shiftleft", F.lit(1), F.dayofmonth("period") - 1).alias("bit")


def _counts(verticals: dict[str, DataFrame], once: Collection[str], *more: Column) -> DataFrame:
    """Rows counted by entity, vertical, what more there is, and part, map-side: n, bits (of the part's periods), first, last. Each frame: entity_id, period, at."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("vertical"), "entity_id", *_part(df), "at", *more) for k, df in verticals.items()])
    told = F.bit_or("bit")
    n = F.when(F.col("vertical").isin(list(once)), F.coalesce(F.bit_count(told), F.lit(1))).otherwise(F.count("*"))  # a null period is a row too
    return rows.groupBy(*[c for c in rows.columns if c not in ("bit", "at")]).agg(n.alias("n"), told.alias("bits"), F.min("at").alias("first"), F.max("at").alias("last"))


def _range() -> list[Column]:
    """Rows, periods and their range, from counts by part."""
    return [F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("periods"), F.min("first").alias("earliest"), F.max("last").alias("latest")]


def coverage_matrix(verticals: dict[str, DataFrame], once: Collection[str] = ()) -> DataFrame:
    """Rows, periods and their range per entity and vertical. Each frame: entity_id, period_end. once: verticals that count a period as one row.

    Rows are counted by part first, map-side, so that one small shuffle more does the distinct count of all verticals; the days of a month are one part.
    """
    counts = _counts({k: df.select("entity_id", F.col("period_end").alias("period"), F.col("period_end").alias("at")) for k, df in verticals.items()}, once)
    return counts.groupBy("entity_id", "vertical").agg(*_range())


def coverage_levels(verticals: dict[str, DataFrame], companies: DataFrame, once: Collection[str] = ()) -> DataFrame:
    """Coverage of each entity and vertical, and of each of its buckets: entity_id, vertical, level, bucket, n_rows, periods, earliest, latest.

    Each frame has entity_id, period (what is counted as one), at (a date, for the range) and bucket (a line of the detail); a null period or date
    counts as none. Level `vertical` has a row for every company and vertical, of zeros where there is no data; level `bucket` those with data;
    rows of an entity that is no company are left out. once: verticals that count a period of a bucket as one row, however many rows tell it.
    Rows are counted by bucket and part map-side, where the days of a month are one part, held as bits; both levels come from those counts.
    """
    ids = ["entity_id", "vertical"]
    counts = _counts({k: df.withColumn("at", F.to_date("at")) for k, df in verticals.items()}, once, F.col("bucket").cast("string").alias("bucket"))
    parts = counts.groupBy(*ids, "part").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"))
    whole = parts.groupBy(*ids).agg(*_range()).withColumns({"level": F.lit("vertical"), "bucket": F.lit(None).cast("string")})
    both = counts.groupBy(*ids, "bucket").agg(*_range()).withColumn("level", F.lit("bucket")).unionByName(whole)
    due = companies.select("entity_id").distinct().select("entity_id", F.explode(F.array(*map(F.lit, verticals))).alias("vertical"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return due.join(both, ids, "left").select(*ids, F.coalesce("level", F.lit("vertical")).alias("level"), "bucket", zero("n_rows"), zero("periods"), "earliest", "latest")


def coverage_buckets(verticals: dict[str, DataFrame], grain: str) -> DataFrame:
    """Rows per entity, vertical and month, quarter or year."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("vertical"), "entity_id", F.trunc("period_end", grain).alias("bucket")) for k, df in verticals.items()])
    return rows.groupBy("entity_id", "vertical", "bucket").agg(F.count("*").alias("n"))


def fiscal_key(key: Column) -> tuple[Column, Column]:
    """Year and quarter of FY2024, FY2024-Q1 or FY2024 Q1; null where there is none."""
    number = lambda group: F.nullif(F.regexp_extract(key, r"^FY(\d{4})(?:[- ]Q([1-4]))?$", group), F.lit("")).cast("int")
    return number(1), number(2)


#: Slices of a window of time that its range join is keyed by.
SLICES = 4


def resolving_runs(resolved: DataFrame, runs: DataFrame, minutes: int = 60) -> DataFrame:
    """Succeeded runs that ended within the minutes before a finding was resolved, of its ticker or of all, with a label of what they did.

    Where the finding's fiscal_period_key and the run's counts both name a fiscal year or quarter, these must agree. The range join is an
    equi-join on the ticker (or all) and on slices of time: a resolution looks at those that its window touches. Pairs are many times the rows they come from, so
    neither side is broadcast and the keys stay in as many tasks as Spark has partitions for shuffles, however small the tables are.
    """
    length = 60 * minutes / SLICES
    slice_of = lambda c: F.floor(F.unix_timestamp(c) / length)
    whose = lambda every, t: F.struct(F.lit(every).alias("every"), t.cast("string").alias("t"))
    year, quarter = fiscal_key(F.col("fiscal_period_key"))
    tickers = F.array_compact(F.array(whose(True, F.lit("")), F.when(F.col("ticker").isNotNull(), whose(False, F.col("ticker")))))
    left = resolved.withColumns({"f_year": year, "f_quarter": quarter}).withColumn("whose", F.explode(tickers)).withColumn("b", F.explode(F.sequence(slice_of("resolved_at") - SLICES, slice_of("resolved_at"))))
    right = runs.where("status = 'succeeded' AND kind <> 'reconciliation'").withColumns({"r_year": F.get_json_object("counts", "$.fiscal_year").cast("int"), "r_quarter": F.get_json_object("counts", "$.fiscal_quarter").cast("int")})
    period = F.when(F.col("r_year").isNotNull(), F.concat(F.lit("FY"), F.col("r_year").cast("string"), F.when(F.col("r_quarter").isNotNull(), F.concat(F.lit("-Q"), F.col("r_quarter").cast("string"))).otherwise("")))
    scope = F.when(F.col("ticker_scope").isNull(), F.array(whose(True, F.lit("")))).otherwise(F.transform(F.array_distinct(F.array_compact("ticker_scope")), lambda t: whose(False, t)))
    right = right.withColumns({"action_label": F.concat_ws(" ", "kind", "vendor", period), "b": slice_of("ended_at"), "whose": F.explode(scope)})
    within = (F.col("ended_at") <= F.col("resolved_at")) & (F.col("ended_at") >= F.col("resolved_at") - F.expr(f"INTERVAL {minutes} MINUTE"))
    agrees = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    tasks = int(resolved.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, "b", "whose").hint("merge").join(right, ["b", "whose"]).where(within & agrees("f_year", "r_year") & agrees("f_quarter", "r_quarter")).drop("b", "whose", "f_year", "f_quarter", "r_year", "r_quarter")


def close_by_reingest(flags: DataFrame, entity: Column, first_year: Column, last_year: Column | None, run_id: int, now: Column) -> DataFrame:
    """flags with the open ones of an entity's re-ingested fiscal years closed."""
    hit = F.col("resolved_at").isNull() & entity & F.col("fiscal_year").isNotNull() & (F.col("fiscal_year") >= first_year)
    if last_year is not None:
        hit = hit & (F.col("fiscal_year") <= last_year)
    hit = F.coalesce(hit, F.lit(False))
    new = {"resolved_at": now, "resolution": F.lit("superseded_by_reingest"), "resolution_note": F.lit(f"closed by ingest run {run_id}")}
    return flags.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in new.items()})


def open_flags(flags: DataFrame, entity: int | None = None, kind: str | None = None) -> DataFrame:
    """Flags to review: severe ones first, then the oldest."""
    rows = flags.where("resolved_at IS NULL")
    rows = rows if entity is None else rows.where(F.col("entity_id") == entity)
    rows = rows if kind is None else rows.where(F.col("flag_type") == kind)
    rank = F.when(F.col("severity") == "investigate", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.orderBy(rank, "flagged_at", "id")


def review_flag(flags: DataFrame, ids: list[int], resolution: str, note: str, now: Column) -> DataFrame:
    """flags with the open ones of these ids resolved; resolution is one of approve_suggested, override, accept_as_is, dismiss."""
    if resolution not in ("approve_suggested", "override", "accept_as_is", "dismiss"):
        raise ValueError(f"unknown resolution {resolution!r}")
    hit = F.col("resolved_at").isNull() & F.col("id").isin(ids)
    new = {"resolved_at": now, "resolution": F.lit(resolution), "resolution_note": F.lit(note)}
    return flags.withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in new.items()})


def estimate_warnings(findings: DataFrame, entity: int | None = None) -> DataFrame:
    """Open findings of the checks on estimates."""
    rows = findings.where("status = 'open' AND source_check IN ('forward_estimate_consistency', 'earnings_surprise_sanity')")
    return rows if entity is None else rows.where(F.col("entity_id") == entity)
