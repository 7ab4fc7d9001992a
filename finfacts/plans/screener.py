"""Universe screens and metric reads over the frames of the verticals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grammar import GROWTH, METRICS, Metric, Period, PeriodError, check, find_metric, parse_period

LIMITS = (1, 100)


def _per_entity(df: DataFrame, order: Column) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("entity_id").orderBy(order)))


def _at(df: DataFrame, period: Period, agg: str, date: str) -> DataFrame:
    """entity_id, value, from, to, coverage. df: entity_id, date, value, perhaps fiscal_year and fiscal_quarter."""
    d = F.col(date)
    one = lambda x: x.select("entity_id", "value", d.alias("from"), d.alias("to"), F.lit(1).cast("long").alias("coverage"))
    if period.kind == "fy":
        rows = df.where(F.col("fiscal_year") == period.year)
        return one(_per_entity(rows, F.desc(date)).where("n = 1"))
    if period.kind == "fq":
        return one(df.where((F.col("fiscal_year") == period.year) & (F.col("fiscal_quarter") == period.quarter)))
    if period.kind in ("latest", "asof"):
        rows = df if period.day is None else df.where(d <= F.lit(period.day))
        return one(_per_entity(rows.where("value IS NOT NULL"), F.desc(date)).where("n = 1"))
    n = period.n or 1
    ranked = _per_entity(df.where("value IS NOT NULL"), F.desc(date) if period.kind == "window" else F.asc(date)).where(F.col("n") <= n)
    if agg == "level":
        value = F.sum("value") if period.how == "sum" else F.avg("value")
        least = max(1, n // 2)
    else:  # thirds: the newest against the oldest
        third = max(1, n // 3)
        late, early = (F.col("n") <= third), (F.col("n") > n - third)
        if period.kind == "forward":
            late, early = early, late
        late, early = F.avg(F.when(late, F.col("value"))), F.avg(F.when(early, F.col("value")))
        value = late - early if agg == "delta" else F.when(early != 0, (late - early) / F.abs(early))
        least = max(3, n - 1)
    out = ranked.groupBy("entity_id").agg(value.alias("value"), F.min(date).alias("from"), F.max(date).alias("to"), F.count("*").alias("coverage"))
    return out.where(F.col("coverage") >= least)


def screen(frames: dict[str, DataFrame], metric: str, period: str = "latest", agg: str = "level", sort: str = "desc", limit: int = 20, today: str | None = None) -> DataFrame:
    """Entities ranked by a metric: rank, entity_id, value, from, to, coverage, citation. frames by vertical; today bounds forward periods."""
    spec, at = find_metric(metric), parse_period(period)
    check(spec, at, agg)
    if metric in GROWTH:
        raise PeriodError(f"{metric} is ranked by growth_screen")
    if sort not in ("asc", "desc"):
        raise PeriodError("sort is asc or desc")
    limit = min(max(limit, LIMITS[0]), LIMITS[1])
    date = {"financials": "period_end", "estimates": "period_end", "valuation": "date"}[spec.vertical]
    df = frames[spec.vertical if spec.grain != "y" or spec.vertical != "financials" else "annual"]
    if spec.vertical == "estimates":
        df = df.where(F.col(date) >= F.lit(today).cast("date"))
    rows = _at(df.withColumn("value", F.expr(spec.value)), at, agg, date).where("value IS NOT NULL")
    order = [F.asc("value") if sort == "asc" else F.desc("value"), F.asc("entity_id")]
    top = rows.orderBy(*order).limit(limit)  # top-k per task first, so the global rank is over `limit` rows
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rank", "entity_id", "value", "from", "to", "coverage", citation(spec.vertical, F.col("entity_id"), F.col("from"), F.col("to")).alias("citation"))


def citation(vertical: str, entity: Column, start: Column, end: Column) -> Column:
    """M:vertical:entity, with the period or the range of periods that is known."""
    a, b = start.cast("string"), end.cast("string")
    period = F.when(a.isNull() | (a == b), b).when(b.isNull(), a).otherwise(F.concat(a, F.lit("_to_"), b))
    return F.concat_ws(":", F.lit("M"), F.lit(vertical), entity.cast("string"), period)


def valuation_screen(daily: DataFrame, known: DataFrame, valued: Callable[[DataFrame, DataFrame], DataFrame], metric: str, period: str = "latest", sort: str = "desc", limit: int = 20) -> DataFrame:
    """A valuation screen that values one day per entity.

    The last day of each entity (up to the day asked for) is valued first. Only entities without a value on that day have their whole
    history valued for the last day that has one. daily: entity_id, date; known: what valued() joins by what was known.
    """
    spec, at = find_metric(metric), parse_period(period)
    check(spec, at, "level")
    days = daily if at.day is None else daily.where(F.col("date") <= F.lit(at.day))
    value = F.expr(spec.value).alias("value")
    last = days.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in days.columns if c != "entity_id"]), "date").alias("x")).select("entity_id", "x.*")
    probed = valued(last, known).select("entity_id", "date", value)
    hit = probed.where("value IS NOT NULL")
    rest = days.join(probed.where("value IS NULL").select("entity_id"), "entity_id", "left_semi")
    late = valued(rest, known).select("entity_id", "date", value).where("value IS NOT NULL").groupBy("entity_id").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))
    rows = hit.unionByName(late)
    order = [F.asc("value") if sort == "asc" else F.desc("value"), F.asc("entity_id")]
    top = rows.orderBy(*order).limit(min(max(limit, LIMITS[0]), LIMITS[1]))
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rank", "entity_id", "value", "date", citation("valuation", F.col("entity_id"), F.col("date"), F.col("date")).alias("citation"))


def universe_size(df: DataFrame, metric: str) -> DataFrame:
    return df.where(F.expr(find_metric(metric).value).isNotNull()).agg(F.countDistinct("entity_id").alias("entities"))


def growth_screen(estimates: DataFrame, metric: str, n: int, today: str) -> DataFrame:
    """Mean of the next n periods against the mean of the same periods a year before. metric: a growth metric, or the value that it grows."""
    value = F.expr(find_metric(GROWTH.get(metric, metric)).value)
    rows = estimates.select("entity_id", "period_end", value.alias("value"))
    forward = _per_entity(rows.where(F.col("period_end") >= F.lit(today).cast("date")), F.asc("period_end")).where(F.col("n") <= n)
    prior = rows.select("entity_id", F.col("period_end").alias("prior_end"), F.col("value").alias("prior"))
    both = forward.withColumn("prior_end", F.add_months("period_end", -12)).join(prior, ["entity_id", "prior_end"], "left")
    sums = both.groupBy("entity_id").agg(F.avg("value").alias("now"), F.avg("prior").alias("before"))
    return sums.where("before IS NOT NULL AND before <> 0").select("entity_id", ((F.col("now") - F.col("before")) / F.abs("before")).alias("growth"))


def metric_values(df: DataFrame, entity: int, metrics: list[str], n: int = 1) -> DataFrame:
    """An entity's last n rows of several metrics of one frame; the entity filter reaches the scan."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise PeriodError(f"unknown metrics {unknown}")
    rows = df.where(F.col("entity_id") == entity).orderBy(F.desc("period_end")).limit(n)
    return rows.select("entity_id", "period_end", *[F.expr(METRICS[m].value).alias(m) for m in metrics])


def at_period(frame: DataFrame, specs: list[Metric], period: Period, annual: DataFrame) -> DataFrame:
    """Each entity's rows of a financial frame for a period. annual: the fiscal years' frame, which tells when a year ended.

    latest: the newest row that has any of the metrics. A fiscal year of quarters: the newest row up to the year's end; none where the
    year's end isn't known. A quarter: that quarter's row. A window: the last n rows.
    """
    date = "period_end"
    if period.kind == "latest":
        some = F.coalesce(*[F.expr(m.value) for m in specs]).isNotNull()
        return _per_entity(frame.where(some), F.desc(date)).where("n = 1").drop("n")
    if period.kind == "fy" and specs[0].grain == "y":
        return _per_entity(frame.where(F.col("fiscal_year") == period.year), F.desc(date)).where("n = 1").drop("n")
    if period.kind == "fy":
        ends = annual.where(F.col("fiscal_year") == period.year).groupBy("entity_id").agg(F.max(date).alias("year_end"))
        rows = frame.join(ends, "entity_id").where(F.col(date) <= F.col("year_end")).drop("year_end")
        return _per_entity(rows, F.desc(date)).where("n = 1").drop("n")
    if period.kind == "fq":
        rows = frame.where((F.col("fiscal_year") == period.year) & (F.col("fiscal_quarter") == period.quarter))
        return _per_entity(rows, F.desc(date)).where("n = 1").drop("n")
    return _per_entity(frame, F.desc(date)).where(F.col("n") <= (period.n or 1)).drop("n")


def read_metrics(frames: dict[str, DataFrame], entity: int | None, metrics: list[str], period: str = "latest", today: str | None = None) -> DataFrame:
    """Several metrics of an entity (all entities if None) at a period: entity_id, vertical, period_end, metric, value, citation.

    Metrics of one vertical and grain are read from one row. frames: financials, annual, estimates, valuation, as far as they are asked for.
    """
    at, groups = parse_period(period), {}
    for name in metrics:
        spec = find_metric(name)
        if name in GROWTH:
            raise PeriodError(f"{name} is ranked by growth_screen")
        check(spec, at, "level")
        groups.setdefault((spec.vertical, spec.grain), []).append(spec)
    own = lambda df: df if entity is None else df.where(F.col("entity_id") == entity)
    out = None
    for (vertical, grain), specs in groups.items():
        if vertical == "financials":
            frame = own(frames["annual" if grain == "y" else "financials"])
            rows = at_period(frame, specs, at, own(frames["annual"]) if "annual" in frames else frame)
        elif vertical == "valuation":
            frame = own(frames["valuation"]).withColumn("period_end", F.col("date"))
            some = F.coalesce(*[F.expr(m.value) for m in specs]).isNotNull()
            rows = frame.where(some) if at.day is None else frame.where(some & (F.col("date") <= F.lit(at.day)))
            rows = _per_entity(rows, F.desc("date")).where("n = 1")
        else:
            rows = own(frames["estimates"]).where(F.col("period_end") >= F.lit(today).cast("date"))
            rows = _per_entity(rows, F.asc("period_end")).where(F.col("n") <= (at.n or 1))
        values = F.explode(F.array(*[F.struct(F.lit(m.name).alias("metric"), F.expr(m.value).cast("double").alias("value")) for m in specs])).alias("x")
        long = rows.select("entity_id", "period_end", values).select("entity_id", F.lit(vertical).alias("vertical"), "period_end", "x.metric", "x.value", citation(vertical, F.col("entity_id"), F.col("period_end"), F.col("period_end")).alias("citation"))
        out = long if out is None else out.unionByName(long)
    return out
