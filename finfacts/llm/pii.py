"""Personal data: base patterns, and unseen identifiers by bootstrapped contextual extraction.

The base spans of a text are the seed entities. The whole word to the left of a seed is its lexical pattern, whatever it is. Candidates are
words with a digit or an @ that no base span covers; a candidate belongs to a kind if its shape fits it. Patterns and
instances (seeds and candidates by their surface) form a bipartite graph per kind. Spark scores it in rounds: a
pattern by the mean score of its instances, shrunk towards 0, an instance by the mean score of its patterns; seeds stay at 1.
Patterns that end with a high score and enough distinct seeds mark further spans. Built-in functions only.

Defined results: a null text counts as empty; an empty table gives no rows; rows that repeat a doc_id each get a row
of their own; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, text_of
from ._spans import apart, listed, spans

KINDS = ("email", "ip", "card", "phone")

# The look-behinds start a match where a run starts; the contract's leftmost matches are the same, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]{5,}+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reversed_digits = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_digits, lambda c, i: F.try_to_number(F.concat(F.lit("0"), c), F.lit("99")).cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)) - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    n = lambda x: F.length(digits(x["v"]))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["v"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda x: n(x).between(13, 19) & luhn(digits(x["v"]))),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n(x).between(9, 15)),
    }


def candidate_kind(v: Column) -> Column:
    """The kind that a candidate's shape fits, or null."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return (
        F.when(v.rlike(r"^[^@]+@[^@]+$"), "email")
        .when(v.rlike(r"^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$") | v.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "ip")
        .when(v.rlike(r"^[0-9][0-9-]+$") & digits.between(12, 19), "card")
        .when(v.rlike(r"^[(+]?[0-9][0-9().-]+$") & digits.between(7, 15), "phone")
    )


def detect(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = 3, min_score: float = 0.6, min_seeds: int = 3, shrink: float = 1.0
) -> DataFrame:
    """One row per document: id, base spans by kind, discovered spans (kind, s, e, score).

    rounds, min_score, min_seeds, shrink: the scoring rounds; what a pattern needs; what its mean is shrunk by.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.col("__t")
    base = base_spans(text)
    trimmed = lambda x: F.regexp_replace(x["v"], r"[.,;:!?'\")\]}>*#$%&|]+$", "")
    found = (
        docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("__t"))
        .select("id", "__t", *[v.alias(k) for k, v in base.items()])
        .withColumn("c", apart(spans(text, CANDIDATE, text.rlike("[0-9@]")), *[F.col(k) for k in KINDS]))
        .withColumn("c", F.transform("c", lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(trimmed(x))).alias("e"), trimmed(x).alias("v"), F.lower(x["left"]).alias("p"))))
        .withColumn("c", F.filter(F.transform("c", lambda x: F.struct(candidate_kind(x["v"]).alias("k"), x["s"], x["e"], x["v"], x["p"])), lambda x: x["k"].isNotNull() & (x["p"] != "")))
        .select(
            "id",
            F.col("id").cast("string").alias("key"),
            F.sha2("__t", 256).alias("row"),
            *[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("i"), F.lower(x["left"]).alias("p"))).alias(k) for k in KINDS],
            "c",
        )
    )
    found = scratch.table(found, "found")

    # The graph's edges: distinct (kind, pattern, instance), summed map-side before they are dealt out.
    node = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("k"), x["p"].alias("p"), x["i"].alias("i"), F.lit(1.0).alias("seed")))
    seeds = F.flatten(F.array(*[node(k) for k in KINDS]))
    others = F.transform("c", lambda x: F.struct(x["k"].alias("k"), x["p"].alias("p"), F.sha2(x["v"], 256).alias("i"), F.lit(0.0).alias("seed")))
    edges = found.select(F.inline(F.concat(seeds, others))).where("p != ''").groupBy("k", "p", "i").agg(F.max("seed").alias("seed"))
    edges = scratch.table(edges, "edges")
    scored = edges.withColumn("score", F.col("seed"))
    for r in range(rounds):
        patterns = scored.groupBy("k", "p").agg((F.sum("score") / (F.count("*") + F.lit(shrink))).alias("ps"), F.sum("seed").alias("seeds"))
        patterns = scratch.table(patterns, f"patterns{r}")
        instances = scratch.table(edges.where("seed = 0").join(patterns, ["k", "p"]).groupBy("k", "i").agg(F.avg("ps").alias("is")), f"instances{r}")
        scored = edges.join(instances, ["k", "i"], "left").select("k", "p", "i", "seed", F.when(F.col("seed") > 0, 1.0).otherwise(F.coalesce("is", F.lit(0.0))).alias("score"))
        if r < rounds - 1:
            scored = scratch.table(scored, f"scored{r}")
    good = patterns.where((F.col("ps") >= min_score) & (F.col("seeds") >= min_seeds)).select("k", "p", "ps")
    new = (
        found.select(F.coalesce("key", F.lit("")).alias("key"), "row", F.inline("c"))
        .join(good, ["k", "p"])
        .groupBy("key", "row")
        .agg(F.array_sort(F.collect_set(F.struct("s", "e", "k", F.col("ps").alias("score")))).alias("found"))
    )
    told = found.drop("c").withColumn("key", F.coalesce("key", F.lit(""))).join(new, ["key", "row"], "left").drop("key", "row")
    return scratch.finish(told.withColumn("found", F.coalesce("found", F.array().cast("array<struct<s:int,e:int,k:string,score:double>>"))))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from detect()'s."""
    texts = {k: listed(k, F.col(k)) for k in KINDS}
    place = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    both = lambda k: listed(k, F.array_sort(F.concat(F.transform(k, place), F.transform(F.filter("found", lambda x: x["k"] == k), place))))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*texts.values()), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[both(k) for k in KINDS]), ",").alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
