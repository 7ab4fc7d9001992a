"""URL filters: lists of host and path rules first, an empirical-Bayes reputation of the host for all other urls.

Labelled pages are outcomes, bad or not. A host's rate of bad pages is shrunk through beta-binomial priors: all hosts give the prior of a
suffix, a suffix that of its registered domains, a domain that of its hosts. Each prior's weight comes from the data: the spread of the
children's rates around their parent's beyond what chance gives (method of moments), and how little the parent itself is known. A child's own
outcomes are taken out of its parent's before they make its prior, so that none counts twice. A host is blocked if the bound below its
posterior rate lies over the limit; by Cantelli's inequality the rate is over it with a probability of `level` or more, whatever
the posterior's form. Hosts without outcomes have their domain's prior.

Built-in functions only. Pages are counted by host map-side first; only sums come to the driver. A page meets its host's row in a join: hosts
(domains) that hold over 1/4096 of the pages (hosts), fewer than 4096 by definition, are broadcast, the others shuffled.

Defined results: a null url, and one without ://, has an empty host and path; a null id stays; rows that repeat an id each get a row;
outcomes that are null don't count, those that repeat an id each count; rules with a null host, path or verdict don't count; rules of equal
length go by their text; empty pages give no rows; without outcomes the rate is one half with weight one and nothing is blocked; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, let

#: Keys that hold more than this part of the rows are hot.
HOT = 4096
#: Rules up to this count are broadcast.
FEW_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; every other last label is a suffix. A parameter of the operator.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.za", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "com.tw")
#: Least and largest share of a child's variance that lies between children: weights of a prior from 1 to 999.
SPREAD = (0.001, 0.5)
#: The largest share once the parent's own uncertainty is added: a prior weighs a ninth of an outcome at least.
MOST_SPREAD = 0.9


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*+)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*+([^?#]*+)", 1)


def suffix_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1)) if suffixes else F.substring_index(name, ".", -1)


def domain_of(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix with one label before it; the name itself if it has none, or is an address of numbers."""
    deep = F.when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3)) if suffixes else F.when(F.lit(False), name)
    return F.when(name.rlike(r"^[0-9.]+$|[\[\]]"), name).otherwise(F.coalesce(deep, F.substring_index(name, ".", -2)))


def bare(host: Column) -> Column:
    """A host without user, port and last dots."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*$", ""), r"\.++$", "")


def meet(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left with its row of right, which has one row for each key and, in `rows`, how many rows of left have it."""
    many = F.col(rows) > F.lit(total / HOT)
    hot = F.broadcast(right.where(many))
    few = left.join(hot.select(key), key, "left_anti").join(right.where(~many), key)
    return left.join(hot, key).unionByName(few)


def spread(children: DataFrame) -> float:
    """The share of variance between children, from one row per parent: n, k (all outcomes, bad ones), q, x (sums of n^2, k^2/n), g children."""
    r = F.col("k") / F.col("n")
    v = r * (1 - r)
    over = F.sum(F.col("x") - F.col("k") * F.col("k") / F.col("n") - v * (F.col("g") - 1))
    room = F.sum(v * (F.col("n") - F.col("q") / F.col("n") - (F.col("g") - 1)))
    a, b = children.where("n > 0").agg(over, room).first()
    return min(max(a / b, SPREAD[0]), SPREAD[1]) if a is not None and b and b > 0 else SPREAD[0]


def _sums(n: str, k: str) -> list[Column]:
    some = F.col(n) > 0
    square = lambda c: F.col(c).cast("double") * F.col(c)
    return [F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(square(n)).alias("q"), F.sum(F.when(some, square(k) / F.col(n)).otherwise(0.0)).alias("x"), F.sum(some.cast("long")).alias("g"), F.count("*").alias("rows")]


def reputation(hosts: DataFrame, scratch: Scratch, suffixes: tuple[str, ...] = SUFFIXES, level: float = 0.8) -> DataFrame:
    """hosts (host, pages, n, k: outcomes and bad ones) with mean and bound of the posterior rate."""
    name = bare(F.col("host"))
    named = hosts.select("host", "pages", F.col("n").alias("hn"), F.col("k").alias("hk"), domain_of(name, suffixes).alias("domain"), suffix_of(name, suffixes).alias("suffix"))
    named = scratch.table(named, "hosts")
    domains = scratch.table(named.groupBy("domain", "suffix").agg(*_sums("hn", "hk")), "domains")
    upper = scratch.table(domains.select("suffix", F.col("n").alias("dn"), F.col("k").alias("dk")).groupBy("suffix").agg(*_sums("dn", "dk")), "suffixes")
    top = upper.select(F.col("n").alias("sn"), F.col("k").alias("sk"), "rows").agg(*_sums("sn", "sk")[:-1], F.sum("rows").alias("rows"))
    n, k, domain_rows, host_rows = (x or 0 for x in (*top.select("n", "k", "rows").first(), named.count()))
    rho = [spread(t) for t in (domains, upper, top)]  # of hosts, domains, suffixes

    def prior(upper_n, upper_k, upper_mean, upper_weight, n: str, k: str, spread_: float) -> tuple[Column, Column]:
        """Mean and weight of a child's prior: its parent's posterior without the child's own outcomes; what the parent's rate may be off by adds to the spread."""
        weight = upper_n - F.col(n) + upper_weight
        return (upper_k - F.col(k) + upper_mean * upper_weight) / weight, 1 / F.least(spread_ + 1 / (weight + 1), F.lit(MOST_SPREAD)) - 1

    level_of = lambda up, n, k, s: prior(F.col("pn"), F.col("pk"), F.col("pm"), F.col("pw"), n, k, s) if up is None else prior(*up, n, k, s)
    carried = lambda pair: [F.col("n").alias("pn"), F.col("k").alias("pk"), pair[0].alias("pm"), pair[1].alias("pw"), F.col("rows").alias("of")]
    of_suffix = upper.select("suffix", *carried(level_of((F.lit(n), F.lit(k), F.lit(0.5), F.lit(1.0)), "n", "k", rho[2])))
    of_domain = meet(domains, of_suffix, "suffix", "of", domain_rows).select("domain", *carried(level_of(None, "n", "k", rho[1])))
    m, w = level_of(None, "hn", "hk", rho[0])
    mean = (F.col("hk") + m * w) / (F.col("hn") + w)
    far = (level / (1 - level)) ** 0.5  # Cantelli: less than 1 - level lies further than so many deviations below the mean
    bound = mean - far * F.sqrt(mean * (1 - mean) / (F.col("hn") + w + 1))
    known = meet(named, of_domain, "domain", "of", host_rows)
    return scratch.table(known.select("host", "pages", F.col("hn").alias("n"), F.col("hk").alias("k"), mean.alias("mean"), bound.alias("bound")), "reputation")


def _fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules of its name and of all domains above it, longest first."""
    lower = F.translate("host", UPPER, LOWER)
    known = rules.where("host is not null and path is not null and verdict is not null").select(lower.alias("above"), "path", "verdict", F.concat(lower, "path").alias("rule")).distinct()
    lists = known.groupBy("above").agg(F.collect_list(F.struct((-F.length("rule")).alias("order"), "rule", "path", "verdict")).alias("r"))
    deepest = known.agg(F.max(F.size(F.split("above", r"\.")))).first()[0] or 0
    lists = F.broadcast(lists) if known.count() <= FEW_RULES else lists
    above = F.array_distinct(F.array(*[F.substring_index("host", ".", -i) for i in range(1, deepest + 1)])) if deepest else F.array().cast("array<string>")
    return hosts.select("host", F.explode(above).alias("above")).join(lists, "above").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("rules"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: DataFrame, subject: Column, id_column: str = "page_id", url_column: str = "url", limit: float = 0.5, level: float = 0.8, suffixes: tuple[str, ...] = SUFFIXES
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, host_outcomes, host_bad, bound.

    outcomes: (id, bad boolean); subject: the id of a page's outcome, an expression over host and path; rules: (host, path, verdict).
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col(url_column).cast("string")
    parsed = pages.select(F.col(id_column).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    told = outcomes.where("bad is not null").groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k")).withColumnRenamed("id", "subject")
    asked = scratch.table(parsed.select("host", subject.alias("subject")).groupBy("host", "subject").agg(F.count("*").alias("pages")), "asked")
    counted = asked.where("subject is not null").join(told, "subject").groupBy("host").agg(F.sum(F.col("pages") * F.col("n")).alias("n"), F.sum(F.col("pages") * F.col("k")).alias("k"))
    hosts = asked.groupBy("host").agg(F.sum("pages").alias("pages")).join(counted, "host", "left").na.fill(0, ["n", "k"])
    known = reputation(hosts, scratch, suffixes, level)
    known = scratch.table(known.join(_fitting(known, rules), "host", "left"), "known")
    total = known.agg(F.sum("pages")).first()[0] or 0
    judged = meet(parsed, known, "host", "pages", total)
    rule = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.withColumn("fit", let(rule, lambda r: r)).select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.col("n").alias("host_outcomes"), F.col("k").alias("host_bad"), F.round("bound", 6).alias("bound")
    )
