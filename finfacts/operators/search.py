"""Ranked full-text search with positions: phrases, alternatives, exclusions, cover density.

The index is a table of postings (key, term, positions). A query's words are filtered before anything else, so that a landed index is read by
row groups; what follows are windows over one document's hits in one partitioning by key. No pair of hits is ever formed.

Query language: words (all must be there), "phrases" (word after word), a minus before either (must not be there), `or` between
alternatives (binds weaker than words side by side).

Rank: a cover is a smallest stretch of a document that satisfies the query; it gives 0.1 / (1 + noise), noise being the words
inside it that the query doesn't name, and a document gets the sum over all its covers (they may overlap).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import stem, stemmed

WORD = r"[\p{L}\p{N}]+"
#: What a cover without noise gives.
COVER = 0.1


@dataclass(frozen=True)
class Query:
    """Alternatives, each of units that must and units that must not be there; a unit is a tuple of stemmed words."""

    alternatives: tuple[tuple[frozenset[tuple[str, ...]], frozenset[tuple[str, ...]]], ...]
    literals: tuple[str, ...]

    @property
    def units(self) -> list[tuple[str, ...]]:
        return sorted({u for must, no in self.alternatives for u in must | no})

    @property
    def terms(self) -> list[str]:
        return sorted({w for u in self.units for w in u})


def query_of(text: str) -> Query:
    """A query's units. An alternative that only excludes finds nothing. literals: phrases and words as written, in lower case."""
    found: list[tuple[set, set]] = [(set(), set())]
    literals = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text.lower()):
        if word == "or" and not minus:
            found.append((set(), set()))
            continue
        unit = tuple(stemmed(w) for w in re.findall(r"[^\W_]+", phrase or word))
        if unit:
            found[-1][bool(minus)].add(unit)
            if not minus:
                literals.append(phrase or word)
    return Query(tuple((frozenset(a), frozenset(b)) for a, b in found if a), tuple(literals))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, positions: places of a document's stemmed words, from 0, in order. A null text has none.

    A document's words are gathered within the task that reads it, so what is shuffled is a row per document and term.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    placed = df.select(key, F.posexplode(words).alias("at", "w")).select(key, stem(F.col("w")).alias("term"), "at")
    return placed.groupBy(key, "term").agg(F.sort_array(F.collect_list("at")).alias("positions"))


def write_postings(index: DataFrame, key: str, path: str) -> None:
    """Sorted by term and key: a search reads the row groups of its terms, and a common term is spread over ranges of keys."""
    index.repartitionByRange("term", key).sortWithinPartitions("term", key).write.mode("overwrite").parquet(path)


def occurrences(index: DataFrame, key: str, query: Query) -> DataFrame:
    """key, unit (its number in query.units), start and end (position, index among the document's hits)."""
    units = query.units
    place = lambda u, i, w: F.struct(F.lit(u).alias("unit"), F.lit(i).alias("i"), F.lit(w).alias("w"))
    places = F.array(*[place(u, i, w) for u, words in enumerate(units) for i, w in enumerate(words)])
    hits = index.where(F.col("term").isin(query.terms)).repartition(key).select(key, "term", F.explode("positions").alias("at"))
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    spot = F.struct("at", "nth")
    named = hits.select(key, spot.alias("spot"), F.explode(F.filter(places, lambda p: p["w"] == F.col("term"))).alias("p"))
    length = F.element_at(F.array(*[F.lit(len(u)) for u in units]), F.col("unit") + 1)
    runs = named.groupBy(key, F.col("p.unit").alias("unit"), (F.col("spot.at") - F.col("p.i")).alias("from")).agg(F.count("*").alias("n"), F.min("spot").alias("start"), F.max("spot").alias("end"))
    return runs.where(F.col("n") == length).select(key, "unit", "start", "end")


def covers(index: DataFrame, key: str, query: Query) -> DataFrame:
    """key, start, end, noise: the smallest stretches that satisfy the query."""
    units = {u: i for i, u in enumerate(query.units)}
    if not query.alternatives:
        return index.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("noise")).where("false")
    found = occurrences(index, key, query)
    so_far = Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    before, whole = so_far.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy(key)
    found = found.withColumn("at", F.col("end.at"))
    latest = {u: F.max(F.when(F.col("unit") == i, F.col("start"))).over(so_far) for u, i in units.items()}
    absent = {u: F.max((F.col("unit") == i).cast("int")).over(whole) == 0 for u, i in units.items()}
    found = found.select(key, "at", "end", *[latest[u].alias(f"u{i}") for u, i in units.items()], *[absent[u].alias(f"no{i}") for u, i in units.items()])

    def begin(must: frozenset, no: frozenset) -> Column:
        """Where the stretch that ends here must begin to hold all units of an alternative."""
        named = [F.col(f"u{units[u]}") for u in sorted(must)]
        first = F.least(*named) if len(named) > 1 else named[0]
        ok = reduce(lambda a, b: a & b, [c.isNotNull() for c in named] + [F.col(f"no{units[u]}") for u in sorted(no)])
        return F.when(ok, first)

    begins = [begin(must, no) for must, no in query.alternatives]
    found = found.withColumn("begin", F.greatest(*begins) if len(begins) > 1 else begins[0]).withColumn("earlier", F.max("begin").over(before))
    small = found.where(F.col("begin").isNotNull() & (F.col("earlier").isNull() | (F.col("begin") > F.col("earlier")))).dropDuplicates([key, "at"])
    noise = (F.col("end.at") - F.col("begin.at")) - (F.col("end.nth") - F.col("begin.nth"))
    return small.select(key, F.col("begin.at").alias("start"), F.col("end.at").alias("end"), noise.alias("noise"))


def ranked(index: DataFrame, key: str, query: str | Query) -> DataFrame:
    """key, covers, score of all documents that satisfy a query."""
    asked = query_of(query) if isinstance(query, str) else query
    return covers(index, key, asked).groupBy(key).agg(F.count("*").alias("covers"), F.sum(COVER / (1 + F.col("noise"))).alias("score"))


def search_turns(turns: DataFrame, index: DataFrame, query: str, top: int = 10, entity: str | None = None, period: str | None = None, asof: str | None = None) -> DataFrame:
    """The best turns of current transcripts for a query, with speaker and period.

    turns: turn_id, entity, period, period_end, published_at, superseded_at, ordinal, speaker, text; index: postings by turn_id. A turn must hold one of
    the query's words or phrases as written. Order: rank, the newest period, the turn's place. Each filter holds where given.
    """
    if not query.strip():
        raise ValueError("an empty query")
    for column, wanted in (("entity", entity), ("period", period)):
        turns = turns if wanted is None else turns.where(F.col(column) == wanted)
    turns = turns if asof is None else turns.where(F.col("published_at") <= F.lit(asof).cast("timestamp"))
    hits = matching_turns(turns, index, query)
    return hits.orderBy(F.desc("score"), F.desc_nulls_last("period_end"), "ordinal", "turn_id").limit(max(top, 0))


def matching_turns(turns: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """All current turns that satisfy a query and hold one of its words or phrases as written, with covers and score."""
    asked = query_of(query)
    written = [F.contains(F.lower("text"), F.lit(x)) for x in asked.literals if len(x) >= 3] or [F.lit(True)]
    current = turns.where("superseded_at is null").where(reduce(lambda a, b: a | b, written))
    return ranked(index, "turn_id", asked).join(current, "turn_id")


def latest_mentions(turns: DataFrame, terms: list[str], latest: int = 4) -> DataFrame:
    """Counts of terms over the current transcripts of each entity's latest periods: entity, period, period_end, turns, one column per term."""
    from ..functions.columns import term_count

    counts = [F.sum(term_count(F.col("text"), t)).cast("long").alias(f"n_{re.sub(r'[^a-z0-9]+', '_', t.lower())}") for t in terms]
    periods = turns.where("superseded_at is null").groupBy("entity", "period", "period_end").agg(F.count("*").alias("turns"), *counts)
    newest = Window.partitionBy("entity").orderBy(F.desc_nulls_last("period_end"), F.desc("period"))
    return periods.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= latest).drop("__n")
