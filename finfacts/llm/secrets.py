"""Secret scans: base patterns and high-entropy tokens, told apart by corpus-wide ownership frequency.

Every candidate value is hashed (SHA-256); the hashes are counted by distinct repositories and distinct owners over the whole
corpus. A value that several owners hold is a copied example; one that a single owner holds in few repositories looks
live. Live-looking tokens outside the base spans are added as kind `key`. Built-in functions only.

Defined results: a null text counts as empty; a null repository or owner counts as one of its own (the empty name);
an empty table gives no rows; rows that repeat a doc_id each get a row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, text_of
from ._spans import apart, spans

KINDS = ("assign", "access", "hex")
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Words of 20 or more token characters that hold an upper-case letter, a lower-case letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*?[0-9])(?=[A-Za-z0-9+/_=-]*?[A-Z])(?=[A-Za-z0-9+/_=-]*?[a-z])[A-Za-z0-9+/_=-]{20,}+"


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(spans(text, ASSIGN, text.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 6),
        "access": F.filter(spans(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["v"]) >= 20),
        "hex": spans(text, HEX, text.rlike("[0-9a-f]{24}")),
    }


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repo: Column | None = None, owner: Column | None = None, live_owners: int = 1, live_repos: int = 2, copied_owners: int = 3
) -> DataFrame:
    """One row per document: id, found: array of (s, k, e, base, owners, repos, verdict) by place.

    repo, owner: who holds a document (by default its source and language, and its source, each empty where docs hasn't the column).
    verdict: live (at most live_owners owners and live_repos repositories), example (copied_owners owners or more), else unsure.
    """
    scratch = Scratch(docs.sparkSession)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    repo = F.concat(named("source"), F.lit("\0"), named("lang")) if repo is None else repo
    owner = named("source") if owner is None else owner
    text = F.col("__t")
    value = lambda k, v: F.regexp_extract(v, ASSIGN, 1) if k == "assign" else v
    tagged = lambda k, rank: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.sha2(value(k, x["v"]), 256).alias("h")))
    found = (
        docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("__t"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"))
        .select("id", "repo", "owner", "__t", *[v.alias(k) for k, v in base_spans(text).items()])
        .withColumn("key", apart(spans(text, TOKEN, text.rlike("[A-Za-z0-9+/_=-]{20}")), *[F.col(k) for k in KINDS]))
        .select("id", "repo", "owner", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), F.sha2("__t", 256).alias("row"), F.array_sort(F.concat(*[tagged(k, i) for i, k in enumerate((*KINDS, "key"))])).alias("found"))
    )
    found = scratch.table(found, "found")
    # One row for each value and holder; copies within a holder are merged map-side, so a hot value stays spread.
    holders = found.select("repo", "owner", F.explode("found.h").alias("h")).groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    owned = holders.groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    owned = scratch.table(owned, "owned")
    verdict = F.when(F.col("owners") >= copied_owners, "example").when((F.col("owners") <= live_owners) & (F.col("repos") <= live_repos), "live").otherwise("unsure")
    told = (
        found.where(F.size("found") > 0)
        .select("key", "row", F.inline("found"))
        .join(owned, "h")
        .groupBy("key", "row")
        .agg(F.array_sort(F.collect_set(F.struct("s", "rank", "e", (F.col("rank") < len(KINDS)).alias("base"), "owners", "repos", verdict.alias("verdict")))).alias("found"))
    )
    none = F.array().cast("array<struct<s:int,rank:int,e:int,base:boolean,owners:bigint,repos:bigint,verdict:string>>")
    return scratch.finish(found.select("id", "key", "row").join(told, ["key", "row"], "left").select("id", F.coalesce("found", none).alias("found")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from scan()'s; a key counts if it looks live."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "key")])
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", names[x["rank"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
    of = lambda i: F.filter("found", lambda x: x["rank"] == i)
    kept = F.filter("found", lambda x: x["base"] | (x["verdict"] == "live"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(listed(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
        listed(kept).alias("spans"),
        F.size(F.filter("found", lambda x: x["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: x["verdict"] == "example")).cast("long").alias("n_example"),
    )
