"""Character spans of regular-expression matches with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._shared import let

#: A text's last word; a match can only start where a word does, so the search is linear.
LAST_WORD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
#: Values folded at once: a fold copies what it has so far at each step, so it goes by blocks and over the blocks' totals.
BLOCK = 512
SPAN = "array<struct<s:int,e:int,v:string,left:string>>"


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running sum (or largest value, by join) of an array of integers, each with its own; in time in proportion to the array for all sizes met in texts."""

    def fold(some: Column) -> Column:
        last = lambda acc: F.get(acc, F.size(acc) - 1)
        return F.aggregate(some, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.when(F.size(acc) == 0, x).otherwise(join(last(acc), x))))

    def over(held: Column) -> Column:
        n = F.size(held)
        begins = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(begins, lambda b: fold(F.slice(held, b + 1, BLOCK)))

        def carry(inner: Column) -> Column:
            totals = fold(F.transform(inner, lambda block: F.get(block, F.size(block) - 1)))
            return let(totals, lambda done: F.flatten(F.transform(inner, lambda block, i: F.when(i == 0, block).otherwise(F.transform(block, lambda v: join(F.get(done, i - 1), v))))))

        return let(blocks, carry)

    return let(values, over)


def spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, v, left): code points, end exclusive.

    The pieces between the matches and the matches themselves give the offsets by a running sum. left is the last
    word before the match, which may be the end of the match before. gate: a cheap test that a text with a match passes.
    """
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def left(x: Column, i: Column) -> Column:
        piece = F.get(x["p"], i)
        blank = piece.rlike(r"^[\x20\x09-\x0D]*+$")
        return F.regexp_extract(F.when(blank, F.coalesce(F.get(x["m"], i - 1), F.lit(""))).otherwise(piece), LAST_WORD, 1)

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["m"], lambda m, i: F.length(F.get(x["p"], i)) + F.length(m)), lambda a, b: a + b)
        return let(ends, lambda e: F.transform(x["m"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("v"), left(x, i).alias("left"))))

    all_ = let(found, placed)
    return all_ if gate is None else F.when(gate, all_).otherwise(F.from_json(F.lit("[]"), SPAN))


def apart(candidates: Column, *others: Column) -> Column:
    """Those of an array of non-overlapping spans that overlap none of the others, by one sort: of the others that begin before a span's end, the furthest end counts."""
    asks = F.transform(candidates, lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("other"), c["s"].alias("s"), F.lit(0).alias("reach"), c.alias("span")))
    tells = F.transform(F.flatten(F.array(*others)), lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("other"), F.lit(0).alias("s"), b["e"].alias("reach"), F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit("").alias("v"), F.lit("").alias("left")).alias("span")))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda x: x["reach"]), F.greatest)
        return let(reach, lambda r: F.transform(F.filter(events, lambda x, i: (x["other"] == 0) & (F.get(r, i) <= x["s"])), lambda x: x["span"]))

    return F.when(F.size(candidates) == 0, candidates).otherwise(let(F.array_sort(F.concat(asks, tells)), free))


def listed(kind: str, found: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
