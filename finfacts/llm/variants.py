"""Spelling variants: exact neighbours at one edit by a dictionary of trie-node pairs.

All words are numbered into a forward trie and, reversed, into a second one. A word is then a row of integer pairs (prefix node, suffix
node): skipping position i gives (node of the i letters before, node of the letters behind), and two words that give the same pair differ in that
position only; a word that is the bare join of such a prefix and suffix is the other one with the letter deleted. Words
that share a pair differ in one letter, so no pair has more words than there are letters, and one row for a bare join.

The tries are numbered without any task seeing more than its part: words are sorted by ranges; a task walks its part and opens a node
for each letter beyond what a word shares with the one before; the driver gets each part's first and last word only and tells
the parts their offsets and the nodes that they share with the part before. A letter is skipped only where another word shares the nodes on both
sides, so words without neighbours cost nothing further, and the work is linear in the words' letters.

Defined results: a null text has no words, a null id counts as empty; rows that repeat a document count again; ties go to the word that
is first in code-point order; no documents give no rows; words of any length; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from .url_filter import LOWER, UPPER

RUN = r"[A-Za-zÀ-ÿ]++"
SCANNED = "part int, idx long, key string, tag string, nodes array<long>, shared int, opened long"


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case; of every `every`-th (by crc32 of id and run) one letter is deleted."""
    lower = F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    """Letters that two words share from the start on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[:mid]):
            low = mid
        else:
            high = mid - 1
    return low


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted part of the words: the trie nodes along each, numbered from 1 in the order they are opened (0 is the root)."""
    last, nodes, opened, idx, held = "", [0], 0, 0, None
    for pdf in batches:
        rows = []
        for part, key, tag in zip(pdf["part"].tolist(), pdf["key"].tolist(), pdf["tag"].tolist()):
            same = _common(last, key)
            if held is not None:
                held[5] = max(held[5], same)
                rows.append(held)
            fresh = len(key) - same
            nodes = nodes[: same + 1] + list(range(opened + 1, opened + fresh + 1))
            opened += fresh
            held, last, idx = [part, idx, key, tag, nodes, same, opened], key, idx + 1
        yield pd.DataFrame(rows, columns=["part", "idx", "key", "tag", "nodes", "shared", "opened"])
    if held is not None:
        yield pd.DataFrame([held], columns=["part", "idx", "key", "tag", "nodes", "shared", "opened"])


def number_trie(words: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """words (key, distinct; tag) with rank (0.. in order), nodes (of each prefix, the empty one first) and shared: the longest prefix that another word has."""
    ordered = words.repartitionByRange("key").sortWithinPartitions("key").select(F.spark_partition_id().alias("part"), "key", "tag")
    scanned = scratch.table(ordered.mapInPandas(_scan, SCANNED), name)
    ends = scanned.groupBy("part").agg(F.min_by("key", "idx").alias("first"), F.max_by(F.struct("key", "nodes"), "idx").alias("last"), F.max("idx").alias("top"), F.max("opened").alias("opened"))
    ranks = offset = 0
    before, edges, cross = None, [], []
    for e in ends.orderBy("part").collect():  # two words a part
        # Nodes shared with the part before keep the number they have there.
        carried = before[1][: _common(before[0], e["first"]) + 1] if before else [0]
        edges.append([e["part"], ranks, offset, carried, e["top"]])
        cross.append(len(carried) - 1)
        resolve = lambda k, c=carried, o=offset: c[k] if k < len(c) else o + k
        before = (e["last"]["key"], [resolve(k) for k in e["last"]["nodes"]])
        ranks, offset = ranks + e["top"] + 1, offset + e["opened"]
    rows = [(*e, c, after) for e, c, after in zip(edges, cross, [*cross[1:], 0])]
    table = words.sparkSession.createDataFrame(rows, "part int, ranks long, offset long, carried array<long>, top long, cross int, after int")
    met = scanned.join(F.broadcast(table), "part")  # as many rows as parts
    node = lambda k: F.when(k < F.size("carried"), F.get("carried", k.cast("int"))).otherwise(F.col("offset") + k)
    edge = F.greatest("shared", F.when(F.col("idx") == 0, F.col("cross")).otherwise(0), F.when(F.col("idx") == F.col("top"), F.col("after")).otherwise(0))
    return met.select("key", "tag", (F.col("ranks") + F.col("idx")).alias("rank"), F.transform("nodes", node).alias("nodes"), edge.alias("shared"))


def neighbours(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(words with their rank: rank, word, n; one row per word that has neighbours: rank, n_near, best_n, best)."""
    fore = number_trie(words.select(F.col("word").alias("key"), F.col("n").cast("string").alias("tag")), scratch, "forward")
    fore = scratch.table(fore.select("rank", F.col("key").alias("word"), F.col("tag").cast("long").alias("n"), "nodes", "shared"), "prefixes")
    back = number_trie(fore.select(F.reverse("word").alias("key"), F.col("rank").cast("string").alias("tag")), scratch, "backward")
    back = back.select(F.col("tag").cast("long").alias("rank"), F.col("nodes").alias("behind"), F.col("shared").alias("shared_behind"))
    both = fore.join(back, "rank").withColumn("len", F.length("word")).withColumn("letters", F.split("word", ""))
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    skips = span(F.greatest(zero, F.col("len") - 1 - F.col("shared_behind")), F.least(F.col("shared"), F.col("len") - 1))
    joins = span(F.greatest(zero, F.col("len") - F.col("shared_behind")), F.least(F.col("shared"), F.col("len")))
    pair = lambda i, j: (F.get("nodes", i).alias("p"), F.get("behind", j).alias("s"))
    # once: of a run of equal letters, only the first stands for its deletion; all the others give the same word.
    once = lambda i: (i == 0) | (F.get("letters", i - 1) != F.get("letters", i))
    skipped = F.transform(skips, lambda i: F.struct(*pair(i, F.col("len") - i - 1), F.lit(False).alias("bare"), once(i).alias("once")))
    joined = F.transform(joins, lambda i: F.struct(*pair(i, F.col("len") - i), F.lit(True).alias("bare"), F.lit(False).alias("once")))
    pairs = both.select("rank", "n", F.inline(F.concat(skipped, joined)))
    # The words of one pair: at most one for each letter, and one bare join. Each gets the count and the best of its neighbours there.
    entry = F.struct((-F.col("n")).alias("n"), "rank", "bare", "once")
    held = pairs.groupBy("p", "s").agg(F.array_sort(F.collect_list(entry)).alias("m")).where(F.size("m") > 1)
    near = lambda x: F.filter("m", lambda y: (y["rank"] != x["rank"]) & ((~x["bare"] & ~y["bare"]) | (x["bare"] & y["once"]) | (x["once"] & y["bare"])))
    found = held.select(F.explode(F.transform("m", lambda x: F.struct(x["rank"].alias("rank"), near(x).alias("near")))).alias("x")).where(F.size("x.near") > 0)
    best = F.min(F.struct(F.get("x.near", zero)["n"].alias("n"), F.get("x.near", zero)["rank"].alias("rank"))).alias("best")
    found = found.groupBy(F.col("x.rank").alias("rank")).agg(F.sum(F.size("x.near")).cast("long").alias("n_near"), best)
    return fore.select("rank", "word", "n"), scratch.table(found.select("rank", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.rank").alias("best")), "near")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, root) for links (rank, form) that lead to a form that has no form, by pointer doubling until nothing moves.

    A form has at least twice the count of its word, so a chain has at most 63 links and 6 rounds are enough.
    """
    now, moved = links.select("rank", F.col("form").alias("root")), 1
    while moved:
        step = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        now = scratch.table(now.join(step, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = now.where("moved").count()
        now = now.select("rank", "root")
    return now


def group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ratio: int = 2, **words) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession)
    named, near = neighbours(scratch.table(vocabulary(docs, id_column, text_column, **words), "words"), scratch)
    links = scratch.table(named.join(near, "rank").where(F.col("best_n") >= ratio * F.col("n")).select("rank", F.col("best").alias("form"), F.col("best_n").alias("form_n")), "links")
    ends = roots(links, scratch)
    word = lambda column: named.select(F.col("rank").alias(column), F.col("word").alias(f"{column}_word"))
    out = links.join(ends, "rank").join(word("form"), "form").join(word("root"), "root").select("rank", "form_word", "root_word", "form_n")
    out = named.join(near.select("rank", "n_near"), "rank", "left").join(out, "rank", "left")
    return scratch.finish(out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
