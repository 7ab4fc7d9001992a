"""Near duplicates by an LSH forest, confirmed on the full shingle sets.

Documents with equal shingle sets are one node. Each tree of the forest has its own order of the MinHash values; Spark sorts all nodes of
all trees by (tree, signature), split where it likes, so a hot run of equal signatures spreads over tasks. A pass over the
sorted partitions takes each node's longest common prefix with its neighbour; what sits on both sides of a partition's border is met in a
second, small pass. Nodes that share the first `depth` values are a region, a run of the order. A node is a candidate
with its neighbour and with the first node of its region if their signatures are alike; where the first node is unlike, the region of the
next depth asks again, so regions that hold unlike nodes get deeper. Neighbours that share all of the deepest prefix are linked
unseen. Connected candidates form classes.

Classes are confirmed exactly: a class is dealt out in blocks of bounded size, and a block intersects all its full sets by
a product of 0/1 matrices. Where a class has several blocks, a leader of each local cluster is compared with the other
leaders, and then every document outside the class's largest cluster with all of the class, block by block. No link
between two documents of a class is lost, and no pair within a group is emitted.

A pair of similarity 0.85 shares 5 values in one of 28 trees but for a chance of 8e-8, one of 0.80 but for 2e-5.

Defined results: a null or blank text has no shingles, n_shingles 0, and is its own component; ids are whole numbers or their texts (others
fail when they are read); rows that repeat a doc_id are one document; a null doc_id is linked with nothing and has a null
component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._shared import Scratch, free_name

TREES, DEPTH, DEEPEST = 28, 5, 8
VALUES = TREES * DEPTH
SLACK = 0.15  #: how far below the wanted similarity the share of equal MinHash values of a candidate may be: 4 to 5 standard deviations
BLOCK_DOCS, BLOCK_SHINGLES = 256, 2_000_000

_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words; emptied when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: _Words, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(n, width)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = out * _P + h[i : n - size + 1 + i]
    out += np.uint64(size)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for i in range(0, len(items), 512):
        np.minimum(least, (_A[:, None] * items[None, i : i + 512] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = _Words()
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["text"]):
            items = shingles(text, words)
            rows.append((i, len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), signature(items).tobytes() if len(items) else b""))
        yield pd.DataFrame(rows, columns=["id", "n", "key", "sig"])


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node's place in each tree's order: 16 bits of the tree's first DEEPEST values in two numbers."""
    at = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEEPEST)) % VALUES
    for pdf in batches:
        for i in range(0, len(pdf), 1024):
            part = pdf.iloc[i : i + 1024]
            values = np.frombuffer(b"".join(part["sig"]), "<u4").reshape(-1, VALUES)[:, at].astype(np.uint64) & np.uint64(0xFFFF)
            lanes = values.reshape(-1, 2, 4)
            packed = ((lanes[..., 0] << np.uint64(48)) | (lanes[..., 1] << np.uint64(32)) | (lanes[..., 2] << np.uint64(16)) | lanes[..., 3]).view(np.int64)
            yield pd.DataFrame({"tree": np.tile(np.arange(TREES), len(part)), "p0": packed[:, 0], "p1": packed[:, 1], "id": np.repeat(part["id"].to_numpy(np.int64), TREES)})


def common_prefix(tree: np.ndarray, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Of each row but the first how many leading values it shares with the row before."""
    lead = lambda x: sum((x >> np.uint64(k)) == 0 for k in (48, 32, 16)) + (x == 0)
    a, b = (lead(x[1:].view(np.uint64) ^ x[:-1].view(np.uint64)) for x in (p0, p1))
    return np.where(tree[1:] == tree[:-1], np.where(a == 4, a + b, a), 0)


DEPTHS = range(DEPTH, DEEPEST)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a sorted partition the nodes that share DEPTH values with the node before: that node, how many, the regions' first nodes. side: the partition's ends."""
    task = TaskContext.get()
    part, last, heads = task.partitionId() if task else 0, None, None
    columns = ["part", "side", "tree", "p0", "p1", "id", "prev", "lcp", *[f"head{d}" for d in DEPTHS]]
    for pdf in batches:
        if not len(pdf):
            continue
        started = last is not None
        if started:
            pdf = pd.concat([last, pdf], ignore_index=True)
        n, ids = len(pdf), pdf["id"].to_numpy()
        lcp = np.append(0, common_prefix(pdf["tree"].to_numpy(), pdf["p0"].to_numpy(), pdf["p1"].to_numpy()))
        first = {}
        for d in DEPTHS:
            place = np.maximum.accumulate(np.where(lcp < d, np.arange(n), 0))
            first[f"head{d}"] = np.where((place == 0) & started, heads[d] if started else ids[0], ids[place])
        out = pdf.assign(part=part, side=0, prev=np.append(-1, ids[:-1]), lcp=lcp, **first)
        if not started:
            yield out.iloc[:1].assign(side=1)[columns]
        yield out[(lcp >= DEPTH) & (np.arange(n) > 0)][columns]
        last, heads, end = pdf.iloc[-1:], {d: int(first[f"head{d}"][-1]) for d in DEPTHS}, out.iloc[-1:]
    if last is not None:
        yield end.assign(side=2)[columns]


def _alike(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), "<u4").reshape(-1, VALUES) for c in ("sig", "other_sig"))
                yield pdf[(x == y).mean(axis=1) >= least][["id", "other"]]

    return run


def _links(sets: list[np.ndarray], percent: int, rows: int | None = None) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union. rows: only the first so many against all."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    items, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    first = np.concatenate([[True], items[1:] != items[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1  # an item of one set is in no intersection
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    m, common = n if rows is None else rows, None
    common = np.zeros((m, n), np.float64)
    total = int(shared.sum())
    cuts = np.searchsorted(column, np.arange(0, total + 4096, 4096))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            dense = np.zeros((n, 4096), np.float32)
            dense[owner[a:b], column[a:b] - 4096 * k] = 1
            common += dense[:m] @ dense.T
    common = np.rint(common).astype(np.int64)
    return 100 * common >= percent * (sizes[:m, None] + sizes[None, :] - common)


def _clusters(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each row's smallest reachable id."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1))
        if (new == label).all():
            return label
        label = new


def _block(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        words = _Words()
        sets = [shingles(t, words) for t in pdf["text"]]
        linked = _links(sets, percent)
        out = pdf[["id", "component", "blocks"]].assign(cluster=_clusters(linked, pdf["id"].to_numpy(np.int64)), degree=linked.sum(axis=1))
        many = out["blocks"].iloc[0] > 1
        out["leader"] = many & ~out.sort_values(["degree", "id"], ascending=[False, True]).duplicated("cluster").sort_index()
        return out.assign(items=[s.tobytes() if many else b"" for s in sets])[["id", "component", "blocks", "cluster", "leader", "items"]]

    return run


def _leaders(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cluster").sort_values("cluster")
        ids = pdf["cluster"].to_numpy(np.int64)
        to = _clusters(_links([np.frombuffer(x, np.uint64) for x in pdf["items"]], percent), ids)
        return pd.DataFrame({"a": ids, "b": to})

    return run


def _across(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["asks", "id"]).sort_values(["asks", "id"], ascending=[False, True])
        rows = int(pdf["asks"].sum())
        if not rows or rows == len(pdf):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        linked = _links([np.frombuffer(x, np.uint64) for x in pdf["items"]], percent, rows)[:, rows:]
        cluster = pdf["cluster"].to_numpy(np.int64)
        x, y = np.nonzero(linked)
        return pd.DataFrame({"a": cluster[x], "b": cluster[rows + y]}).drop_duplicates()

    return run


def _candidates(nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Candidate edges (a, b) of the forest. nodes: id, sig."""
    order = ["tree", "p0", "p1", "id"]
    places = nodes.mapInPandas(_orders, "tree int, p0 long, p1 long, id long")
    heads = [f"head{d}" for d in DEPTHS]
    fields = "part int, side int, tree int, p0 long, p1 long, id long, prev long, lcp int, " + ", ".join(f"{h} long" for h in heads)
    met = scratch.table(places.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_neighbours, fields), "neighbours")
    # The ends of partitions, two rows each, in their order: a first row's neighbour is the last row of the partition before.
    ends = met.where("side > 0").select("tree", "p0", "p1", "id", "side", *[F.lag(c).over(Window.orderBy("part", "side")).alias(f"b_{c}") for c in ("tree", "p0", "p1", "id", *heads)])
    lane = lambda k: (F.shiftrightunsigned(F.col(f"p{k // 4}").bitwiseXOR(F.col(f"b_p{k // 4}")), 48 - 16 * (k % 4)) == 0)
    shared = F.lit(0)
    for k in reversed(range(DEEPEST)):
        shared = F.when(lane(k), 1 + shared).otherwise(0)
    border = ends.where("side = 1 and tree = b_tree").select("id", F.col("b_id").alias("prev"), shared.alias("lcp"), *[F.col(f"b_{h}").alias(h) for h in heads])
    asked = met.where("side = 0").select("id", "prev", "lcp", *heads).unionByName(border.where(F.col("lcp") >= DEPTH))
    others = F.array("prev", *[F.when(F.col("lcp") >= d, F.col(f"head{d}")) for d in DEPTHS])
    pairs = scratch.table(asked.select("id", F.explode(F.array_compact(others)).alias("other")).where("id != other").distinct(), "pairs")
    sigs = scratch.table(pairs.join(nodes, "id"), "sigs").join(nodes.select(F.col("id").alias("other"), F.col("sig").alias("other_sig")), "other")
    alike = sigs.select("id", "other", "sig", "other_sig").mapInPandas(_alike(percent / 100 - SLACK), "id long, other long")
    return alike.toDF("a", "b").union(asked.where(F.col("lcp") == DEEPEST).select("id", "prev"))


def _confirmed(docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(id, label) of every document in a class. docs: id, text; classes: id, n, component."""
    # Tables on both sides of the joins on components, so that Spark can split a large class's rows.
    sizes = scratch.table(classes.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")), "sizes")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    dealt = classes.join(sizes.select("component", blocks.alias("blocks")), "component").select("id", "component", "blocks", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    schema = "id long, component long, blocks long, cluster long, leader boolean, items binary"
    dealt = scratch.table(dealt, "dealt")
    tasks = max(1, dealt.count() // BLOCK_DOCS)  # few bytes but much work: as many tasks as blocks, however little they read
    local = docs.join(dealt, "id").repartition(tasks, "component", "block").groupBy("component", "block").applyInPandas(_block(percent), schema)
    local = scratch.table(local, "local")
    label = local.select("id", F.col("cluster").alias("label"))
    many = local.where("blocks > 1")
    if many.isEmpty():
        return label
    # Leaders meet leaders, in groups of bounded size, while that lowers their number.
    merges, leaders, before = None, scratch.table(many.where("leader").select("component", "cluster", "items"), "leaders"), None
    while True:
        count = leaders.count()
        if before is not None and count > 0.7 * before:
            break
        groups = leaders.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("groups"))
        last = groups.agg(F.max("groups")).first()[0] == 1
        met = leaders.join(groups, "component").withColumn("group", F.pmod(F.xxhash64("cluster"), "groups"))
        met = scratch.table(met.groupBy("component", "group").applyInPandas(_leaders(percent), "a long, b long"), "met")
        merges = met if merges is None else merges.union(met)
        if last:
            break
        leaders, before = scratch.table(leaders.join(met.where("a = b").select(F.col("a").alias("cluster")), "cluster", "left_semi"), "leaders"), count
    joined = components(merges, scratch).toDF("cluster", "merged")
    many = scratch.table(many.join(joined, "cluster", "left").select("id", "component", "blocks", F.coalesce("merged", "cluster").alias("cluster"), "items"), "many")
    # Every document outside its class's largest cluster is asked against the whole class, in blocks.
    of = many.groupBy("component", "cluster").agg(F.count("*").alias("n"))
    largest = of.groupBy("component").agg(F.max(F.struct("n", "cluster")).alias("x")).select("component", F.col("x.cluster").alias("largest"))
    rest = many.join(largest, "component").where("cluster != largest").drop("largest")
    asking = rest.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("askers"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = rest.join(asking, "component").withColumn("asker", F.pmod(F.xxhash64("id"), "askers")).withColumn("block", span("blocks")).withColumn("asks", F.lit(True))
    every = many.join(asking, "component").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("asker", span("askers")).withColumn("asks", F.lit(False))
    columns = ["component", "asker", "block", "asks", "id", "cluster", "items"]
    links = rest.select(columns).union(every.select(columns)).repartition(tasks, "component", "asker", "block")
    links = links.groupBy("component", "asker", "block").applyInPandas(_across(percent), "a long, b long")
    links = scratch.table(links.where("a != b").distinct(), "links")
    joined = components(links, scratch).toDF("cluster", "merged")
    final = many.join(joined, "cluster", "left").select("id", F.coalesce("merged", "cluster").alias("label"))
    return label.join(many.select("id"), "id", "left_anti").union(final)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    named = texts.withColumn("id", F.col("id").cast("string"))  # pandas would turn integers with nulls into floats
    seen = named.mapInPandas(_features, "id string, n long, key binary, sig binary").withColumn("id", F.col("id").cast("long"))
    seen = scratch.table(seen, "features")
    full = seen.where("n > 0 and id is not null")
    heads = scratch.table(full.groupBy("key").agg(F.min("id").alias("id")), "heads")
    nodes = scratch.table(full.join(heads, ["key", "id"], "left_semi").dropDuplicates(["id", "key"]).select("id", "n", "sig"), "nodes")
    edges = _candidates(nodes.select("id", "sig"), scratch, percent)
    classes = scratch.table(components(edges, scratch).join(nodes.select("id", "n"), "id"), "classes")
    label = _confirmed(texts, classes, scratch, percent)
    label = scratch.table(label.groupBy("id").agg(F.min("label").alias("label")), "label")
    lowest = scratch.table(label.groupBy("label").agg(F.min("id").alias("lowest")), "lowest")
    label = scratch.table(label.join(lowest, "label").select("id", F.col("lowest").alias("component_id")), "labels")
    of_key = scratch.table(heads.join(label, "id", "left").select("key", F.coalesce("component_id", "id").alias("component_id")), "of_key")
    out = seen.join(of_key, "key", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """The rows of docs that stay, one document of each group."""
    told = near_duplicates(docs, id_column, text_column, percent)
    gone = free_name(docs, "gone")
    return docs.join(told.where("not kept").select(F.col("doc_id").alias(gone)), docs[id_column] == F.col(gone), "left_anti")
