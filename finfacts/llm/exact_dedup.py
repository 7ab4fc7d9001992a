"""Exact dedup by an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised form. The directory starts with one bucket of depth 0 and doubles while a bucket holds
more keys than its capacity, so its depth follows the counts; a bucket is a range of keys. All rows of a bucket go to its owner
task, which compares the texts themselves, byte by byte, and chains the different texts of one key. Its result, the
index, is a file of (bucket, key, chain) in the shared folder; an entry of a chain has the text's SHA-256, the row that stays and the
group's size. Every document then asks its bucket and walks its key's chain. Built-in functions only.

A key that holds over 1/4096 of the rows is merged map-side before it goes to its owner; there are fewer than 4096 of them.

Defined results: a null text counts as empty, all texts of white space only are equal; a null id stays only where no
other row has the text; ids may be of any type that has an order; rows that repeat the id and text of the row that stays count in
group_size and are all marked kept, and keep_rows() returns one of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACES, Scratch, free_name, text_of

#: Keys that hold more than this part of all rows are hot.
HOT = 4096
#: The directory's largest depth. Mixed keys need more only beyond CAPACITY << DEEPEST texts, from where on buckets hold more.
DEEPEST = 17
CAPACITY = 4096


def normalised(text: Column) -> Column:
    """The text without white space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


class Directory:
    """Buckets by the leading bits of a key. Slot k holds the number of the bucket of the keys that begin with k."""

    def __init__(self) -> None:
        self.depth = 0
        self.slots = [0]
        self.prefix, self.local = [0], [0]  # by bucket: its first bits and how many they are

    def split(self, bucket: int) -> tuple[int, int]:
        """Split a bucket by its next bit; where that is beyond the directory's depth, the directory doubles first."""
        if self.local[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in (0, 1)]
            self.depth += 1
        self.prefix[bucket] *= 2
        self.local[bucket] += 1
        self.prefix.append(self.prefix[bucket] + 1)
        self.local.append(self.local[bucket])
        new, width = len(self.local) - 1, 1 << (self.depth - self.local[bucket])
        at = self.prefix[new] * width
        self.slots[at : at + width] = [new] * width
        return bucket, new

    def grow(self, counts: dict[int, int], bits: int, capacity: int) -> None:
        """Split until no bucket holds more than capacity, by counts of keys by their first `bits` bits."""
        sums = [dict(counts)]
        for _ in range(bits):
            up: dict[int, int] = {}
            for k, n in sums[-1].items():
                up[k >> 1] = up.get(k >> 1, 0) + n
            sums.append(up)
        todo = list(range(len(self.local)))
        while todo:
            b = todo.pop()
            if self.local[b] < bits and sums[bits - self.local[b]].get(self.prefix[b], 0) > capacity:
                todo += self.split(b)

    def bucket(self, key: Column) -> Column:
        if not self.depth:
            return F.lit(0)
        return F.get(F.split(F.lit(",".join(map(str, self.slots))), ","), F.shiftrightunsigned(key, 64 - self.depth).cast("int")).cast("int")


def directory_of(keys: DataFrame, capacity: int, deepest: int = DEEPEST) -> Directory:
    """The directory of a table of distinct keys. What is collected are counts by leading bits, 2 ** deepest at most."""
    total = keys.count()
    capacity = max(capacity, total >> (deepest - 1))
    found, bits = Directory(), min(deepest, max(0, (4 * total // capacity).bit_length()))
    while True:
        lead = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        counts = {r["b"]: r["n"] for r in keys.groupBy(lead.alias("b")).agg(F.count("*").alias("n")).collect()}
        found.grow(counts, bits, capacity)
        if bits == deepest or max(counts.values(), default=0) <= capacity:
            return found
        bits = min(deepest, bits + 3)


def build_index(docs: DataFrame, scratch: Scratch, id_column: str, text_column: str, capacity: int = CAPACITY, key_of: Callable[[Column], Column] = F.xxhash64) -> tuple[Directory, DataFrame]:
    """The directory and the index: bucket, key, chain (array of sha256, keep_id, size). capacity: keys that a bucket holds before it splits."""
    text = text_of(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.length(text).alias("n"), normalised(text).alias("norm")).withColumn("key", key_of(F.col("norm")))
    keys = scratch.table(rows.groupBy("key").agg(F.count("*").alias("rows")), "keys")
    held = directory_of(keys, capacity)
    best = lambda n, i: F.min(F.struct((-n).alias("n"), i.isNull().alias("no"), i.alias("id")))
    share = (keys.agg(F.sum("rows")).first()[0] or 0) / HOT
    hot = F.broadcast(keys.where(F.col("rows") > F.lit(share)).select("key"))  # fewer than HOT keys, by their definition
    few = rows.select("id", "n", "norm", "key", F.lit(1).cast("long").alias("size"))
    merged = few.join(hot, "key", "left_semi").groupBy("key", "norm").agg(best(F.col("n"), F.col("id")).alias("b"), F.sum("size").alias("size"))
    owned = few.join(hot, "key", "left_anti").unionByName(merged.select("b.id", (-F.col("b.n")).alias("n"), "norm", "key", "size"))
    owned = owned.withColumn("bucket", held.bucket(F.col("key"))).repartition("bucket")
    entries = owned.groupBy("bucket", "key", "norm").agg(best(F.col("n"), F.col("id")).alias("b"), F.sum("size").alias("size"))
    entry = F.struct(F.sha2("norm", 256).alias("sha256"), F.col("b.id").alias("keep_id"), F.col("size").alias("size"))
    chains = entries.select("bucket", "key", entry.alias("entry")).groupBy("bucket", "key").agg(F.sort_array(F.collect_list("entry")).alias("chain"))
    return held, scratch.table(chains.sortWithinPartitions("bucket", "key"), "index")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **index) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession)
    held, entries = build_index(docs, scratch, id_column, text_column, **index)
    norm = normalised(text_of(text_column))
    asked = docs.select(F.col(id_column).alias("doc_id"), index.get("key_of", F.xxhash64)(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"))
    asked = asked.withColumn("bucket", held.bucket(F.col("key")))
    walked = F.get(F.filter("chain", lambda e: e["sha256"] == F.col("text_sha256")), F.lit(0))
    found = asked.join(entries, ["bucket", "key"]).select("doc_id", "text_sha256", walked.alias("entry"))
    columns = ["doc_id", F.col("entry.keep_id").alias("keep_id"), F.col("entry.size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("entry.keep_id")).alias("kept"), "text_sha256"]
    return scratch.finish(found.select(*columns))


def keep_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **index) -> DataFrame:
    """The rows that stay, with all columns of docs. Rows meet the index by their id too, so a hot key's rows stay spread."""
    scratch = Scratch(docs.sparkSession)
    held, entries = build_index(docs, scratch, id_column, text_column, **index)
    bucket, key, sha, tag, once = names = [free_name(docs, x) for x in ("bucket", "key", "sha", "tag", "once")]
    norm = normalised(text_of(text_column))
    tag_of = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c.cast("string"), F.lit("")))
    asked = docs.withColumns({key: index.get("key_of", F.xxhash64)(norm), sha: F.sha2(norm, 256), tag: tag_of(F.col(id_column))}).withColumn(bucket, held.bucket(F.col(key)))
    stay = entries.select("bucket", "key", F.inline("chain")).select(F.col("bucket").alias(bucket), F.col("key").alias(key), F.col("sha256").alias(sha), tag_of(F.col("keep_id")).alias(tag))
    first = F.row_number().over(Window.partitionBy(*names[:4]).orderBy(F.desc(F.length(text_of(text_column)))))
    return asked.join(stay, names[:4], "left_semi").withColumn(once, first).where(F.col(once) == 1).select(*docs.columns)
