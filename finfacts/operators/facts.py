"""The fact store: current rows, source priority, pivots, supersession, keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import source_rank

#: The version classes in their order of trust.
SOURCE_RANKS = {"human-verified": 1, "xbrl-amendment": 2, "fmp": 3}
IDENTITY = ["entity_id", "concept", "period_end", "period_type"]


def current(facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows not superseded; with as_of, the rows that were published and not yet superseded then."""
    if as_of is None:
        return facts.where(F.col("superseded_at").isNull())
    return facts.where((F.col("published_at") <= as_of) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > as_of)))


def priority() -> Column:
    """Sorts the best version last: class rank, newest publication (unknown ones first), largest id.

    Packed in one decimal of 38 digits (1, 17 and 20 of them), which a hash aggregate can keep in its buffer; a struct it can't. Publications
    are counted in microseconds from the year 1 on.
    """
    digits = lambda c, n: c.cast(f"decimal({n},0)")
    at = F.coalesce(digits(F.unix_micros(F.col("published_at").cast("timestamp")), 18) + F.expr("62135596800000000BD"), F.lit(0).cast("decimal(18,0)"))
    rank = digits(F.lit(9) - source_rank(F.col("extraction_version"), SOURCE_RANKS), 1)
    number = digits(F.col("id"), 20) + F.expr("9223372036854775808BD")
    head = digits(rank * F.expr("100000000000000000BD") + at, 18)
    return digits(head * F.expr("100000000000000000000BD") + number, 38)


def pick_source(facts: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """One row per identity, the best version's."""
    return newest_wins(facts, keys, [priority().desc()])


def newest_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pivot_wide(facts: DataFrame, concepts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long to wide in one aggregation: for each concept the best version's value. rd_any_version: the largest rd of any version."""
    best = priority()
    plain = facts.where(F.col("dimension_type").isNull()).withColumn("__best", best)
    columns = [F.expr(f"max_by(value, __best) FILTER (WHERE concept = '{c}')").alias(c) for c in concepts]
    return plain.groupBy(*keys).agg(*columns, F.expr("max(value) FILTER (WHERE concept = 'rd')").alias("rd_any_version"))


def pit_pivot(facts: DataFrame, concepts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long to wide by the largest value of any version, with the day on which all of it was known."""
    columns = [F.expr(f"max(value) FILTER (WHERE concept = '{c}')").alias(c) for c in concepts]
    return facts.groupBy(*keys).agg(F.max("published_at").cast("date").alias("asof_date"), *columns)


def supersede(versions: DataFrame, keys: Sequence[str], order: Sequence[str] = ("published_at", "id")) -> DataFrame:
    """Chain versions of a key: each is superseded when the next is published, and names the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("id").over(w)
    return versions.withColumns({
        "superseded_at": F.lead("published_at").over(w),
        "supersedes_fact_id": before,
        "supersession_reason": F.when(before.isNotNull(), F.lit("restatement")),
    })


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with the incoming rows whose key is new; nulls in keys are equal."""
    once = incoming.dropDuplicates(list(keys))
    same = None
    a, b = once.alias("a"), existing.select(*keys).distinct().alias("b")
    for k in keys:
        here = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = here if same is None else same & here
    return existing.unionByName(a.join(b, same, "left_anti"), allowMissingColumns=True)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with incoming rows in place of those of the same key. incoming has one row per key."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """inserted, updated."""
    seen = existing.select(*keys).distinct().withColumn("__old", F.lit(1))
    return incoming.select(*keys).distinct().join(seen, list(keys), "left").agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old").isNotNull()).alias("updated"))


def unpivot(wide: DataFrame, ids: Sequence[str], fields: dict[str, Sequence[str]]) -> DataFrame:
    """Wide vendor rows to long facts: a concept is the sum of its source fields, left out where all are null; a zero is kept."""
    def total(parts: Sequence[str]) -> Column:
        out = F.lit(0).cast("decimal(38,4)")
        for p in parts:
            out = out + F.coalesce(F.col(p), F.lit(0)).cast("decimal(28,4)")
        return F.when(F.coalesce(*[F.col(p) for p in parts]).isNotNull(), out.cast("decimal(28,4)"))

    pairs = F.array(*[F.struct(F.lit(c).alias("concept"), total(parts).alias("value")) for c, parts in fields.items()])
    return wide.select(*ids, F.explode(pairs).alias("x")).select(*ids, "x.*").where("value IS NOT NULL")


#: Letters with marks and the plain ones that compatibility decomposition leaves of them.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def slug_of(label: Column) -> Column:
    """Lower-case letters and digits joined by underscores; letters lose their marks first."""
    plain = F.translate(F.lower(label), MARKED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def explode_segments(rows: DataFrame, data: str, ids: Sequence[str]) -> DataFrame:
    """A label -> value map to dimensioned rows with slug keys."""
    slug = slug_of(F.col("label"))
    return rows.select(*ids, F.explode(data).alias("label", "value")).withColumn("dimension_key", slug)


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")
