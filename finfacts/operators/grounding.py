"""What answers claim against the evidence they cite: citations, quotations, numbers.

An answer cites evidence in brackets, `[T:call-7]`, several by commas. A quotation is held against the text of the citation that follows it,
an amount or a percentage against the numbers of the citation right behind it. Finding the claims of one answer is a small function; all
that meets evidence is a join: citations by their id, quotations by their id and what they say, numbers by their id and a bucket of their size,
sorted within it, so that no claim meets all numbers of its evidence.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import exploded

# Kinds of evidence (facts, metrics, transcripts, sections), how far before a citation its number may stand, lengths of a quotation, tolerances.
NUMBERED, SAID, WITH_RATIOS = ("F", "M"), ("T", "S"), ("M",)
REACH = 160
QUOTE_LENGTHS = (4, 400)
LEAST_QUOTE = 6
RELATIVE, ABSOLUTE, ABSOLUTE_RATIO = 0.05, 0.5, 0.005
SCALES = {"b": 1e9, "billion": 1e9, "m": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3}

#: White space, as a class that Java, Python and RE2 read alike.
SPACE = r"[\x20\x09-\x0D\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLANK = "".join(map(chr, [0x20, *range(9, 14), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_OPEN = re.compile(r"\[([A-Z]):")
_QUOTED = re.compile('"([^"]{%d,%d})"' % QUOTE_LENGTHS)
_MONEY = re.compile(r"\$\s*(-?\d[\d,]*(?:\.\d+)?)(?:\s*(billion|million|thousand|[bmk])(?![a-z]))?", re.IGNORECASE)
_PERCENT = re.compile(r"(-?\d+(?:\.\d+)?)\s*%")
CLAIM = "claim int, kind string, cite string, said string, value double, at int"


def citations(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and ids of each bracket. A part without a kind of its own takes the bracket's. One pass; an open bracket ends it."""
    out, at = [], 0
    while (m := _OPEN.search(text, at)) and (end := text.find("]", m.end())) >= 0:
        parts = [p for p in (x.strip(_BLANK) for x in text[m.end() : end].split(",")) if p]
        if parts:
            out.append((m.start(), end + 1, [p if ":" in p and p[0].isupper() else f"{m[1]}:{p}" for p in parts]))
        at = end + 1
    return out


def claims_of(text: str | None) -> list[dict]:
    """Claims of one answer, in order: claim, kind (citation, quote, money, percent), cite, said, value, at.

    Null and empty answers have none. A quotation without a citation after it, and a number with none behind it, is no claim. An amount is
    taken with its scale; a repeated pair of number and citation counts once, at its first place.
    """
    text = text or ""
    found = citations(text)
    starts = [s for s, _, _ in found]
    rows, seen = [(s, 0, "citation", c, f"[{c}]", None) for s, _, ids in found for c in ids], set()
    for m in _QUOTED.finditer(text) if found else ():
        said, i = m[1].strip(_BLANK), bisect_left(starts, m.end())
        if len(said) >= LEAST_QUOTE and i < len(found):
            rows += [(m.start(), 1, "quote", c, said, None) for c in found[i][2] if c[0] in SAID]
    for start, _, ids in found:
        before = text[max(0, start - REACH) : start]
        money, percent = ([*p.finditer(before)][-1:] for p in (_MONEY, _PERCENT))
        for kind, matches, kinds in (("money", money, NUMBERED), ("percent", percent, WITH_RATIOS)):
            for m in matches:
                number = float(m[1].replace(",", ""))
                value = number * SCALES.get((m[2] or "").lower(), 1.0) if kind == "money" else number / 100.0
                for c in ids:
                    if c[0] in kinds and (m[0].strip(), c) not in seen:
                        seen.add((m[0].strip(), c))
                        rows.append((start, 2, kind, c, m[0].strip(_BLANK), value))
    rows.sort(key=lambda r: r[:2])
    return [{"claim": i, "kind": k, "cite": c, "said": s, "value": v, "at": at} for i, (at, _, k, c, s, v) in enumerate(rows)]


def claims(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, claim, kind, cite, said, value, at."""
    return exploded(answers, [key], [text], claims_of, CLAIM)


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def check_quotes(quotes: DataFrame, passages: DataFrame, on: list[str]) -> DataFrame:
    """on, said, found: whether any passage of a citation has what was said, case and white space apart.

    Quotations are made distinct first and the answer is combined where the join runs, so texts go over the wire once and never come back.
    """
    asked = quotes.select(*on, "said").distinct().withColumn("__said", plain(F.col("said")))
    texts = passages.where("text IS NOT NULL").select(*on, plain(F.col("text")).alias("__text"))
    return asked.join(texts, on).groupBy(*on, "said").agg(F.max(F.contains("__text", "__said")).alias("found"))


def bucket(value: Column) -> Column:
    """Numbers within the tolerances of each other are in the same bucket or in neighbouring ones: steps of 0.5 up to 10, then of 6 percent."""
    size = F.abs(value)
    step = F.when(size <= 10, F.least(F.floor(size * 2), F.lit(19))).otherwise(20 + F.floor(F.log(size / 10) / 0.06)).cast("long")
    return F.when(value < 0, -1 - step).otherwise(step)


def check_numbers(asked: DataFrame, numbers: DataFrame, on: list[str]) -> DataFrame:
    """on, kind, value, nearest: of a citation's numbers the nearest one in reach of a claim's, the smaller of two; null where none is.

    The tolerance grows with the distance from a claim's number on both sides, so its neighbours by size decide. Numbers are made distinct and
    sorted within citation and bucket; a claim asks three buckets. Numbers that aren't finite are left out.
    """
    part, finite = [*on, "__b"], lambda c: F.abs(F.col(c)) < float("inf")
    b = bucket(F.col("value"))
    mine = asked.where(finite("value")).select(*on, "kind", "value").distinct().withColumn("__b", F.explode(F.array(b - 1, b, b + 1)))
    theirs = numbers.where(finite("number")).select(*on, F.col("number").cast("double").alias("value")).distinct().withColumns({"__b": bucket(F.col("value")), "kind": F.lit(None).cast("string")})
    both = mine.select(*part, "kind", "value").unionByName(theirs.select(*part, "kind", "value")).withColumn("number", F.when(F.col("kind").isNull(), F.col("value")))
    first = F.col("kind").isNotNull()
    below = F.last("number", ignorenulls=True).over(Window.partitionBy(*part).orderBy("value", first))
    above = F.last("number", ignorenulls=True).over(Window.partitionBy(*part).orderBy(F.desc("value"), first))
    met = both.withColumn("__below", below).withColumn("__above", above).where("kind IS NOT NULL")
    one = met.select(*on, "kind", "value", F.explode(F.array_compact(F.array("__below", "__above"))).alias("number"))
    apart = F.abs(F.col("value") - F.col("number"))
    absolute = F.when(F.col("kind") == "percent", ABSOLUTE_RATIO).otherwise(ABSOLUTE)
    near = (apart <= absolute) | (apart <= RELATIVE * F.greatest(F.abs("value"), F.abs("number")))
    return one.where(near).groupBy(*on, "kind", "value").agg(F.min(F.struct(apart.alias("d"), F.col("number").alias("n")))["n"].alias("nearest"))


def grounded(found: DataFrame, passages: DataFrame, numbers: DataFrame, shared: bool = False, key: str = "key") -> DataFrame:
    """The claims with nearest and verdict.

    passages: key, cite, text. numbers: key, cite, number. shared: evidence belongs to all answers and has no key.
    A citation is known or unknown. A quotation is found or missing, a number near or far; either is unchecked where its citation has no text
    or no numbers. Nulls in the ids of evidence match nothing; rows of evidence may repeat.
    """
    on = ["cite"] if shared else [key, "cite"]
    known = passages.select(*on).unionByName(numbers.select(*on)).distinct().withColumn("__known", F.lit(True))
    has_text = passages.where("text IS NOT NULL").select(*on).distinct().withColumn("__text", F.lit(True))
    has_number = numbers.where("number IS NOT NULL").select(*on).distinct().withColumn("__number", F.lit(True))
    evidence = known.join(has_text, on, "left").join(has_number, on, "left")
    quotes = check_quotes(found.where("kind = 'quote'"), passages, on)
    near = check_numbers(found.where("value IS NOT NULL"), numbers, on)
    out = found.join(evidence, on, "left").join(quotes, [*on, "said"], "left").join(near, [*on, "kind", "value"], "left")
    kind = F.col("kind")
    verdict = (
        F.when(kind == "citation", F.when(F.col("__known"), "known").otherwise("unknown"))
        .when(kind == "quote", F.when(F.col("__text").isNull(), "unchecked").when(F.col("found"), "found").otherwise("missing"))
        .otherwise(F.when(F.col("__number").isNull(), "unchecked").when(F.col("nearest").isNotNull(), "near").otherwise("far"))
    )
    return out.select(key, "claim", "kind", "cite", "said", "value", "at", "nearest", verdict.alias("verdict"))


def graded(answers: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """A row per answer: its citations, unknown ones, missing quotations, numbers far off; verified where no citation is unknown. Warnings don't change that."""
    count = lambda c: F.count_if(F.col("verdict") == c)
    sums = checked.groupBy(key).agg(F.count_if(F.col("kind") == "citation").alias("citations"), count("unknown").alias("unknown"), count("missing").alias("missing"), count("far").alias("far"))
    names = ("citations", "unknown", "missing", "far")
    out = answers.select(key).distinct().join(sums, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return out.withColumn("status", F.when(F.col("unknown") > 0, "unverified").otherwise("verified"))
