"""Mixing sources to target weights by soft membership.

A classifier, trained on a labelled table, gives every document posteriors over the domains. Telling words, those that are far more
frequent in documents of one domain than in the others, add up to a score by domain; binned measures of the text give log-likelihoods
by domain; a softmax regression, fitted to its optimum on the labelled sample, turns both into posteriors. The document rates are the least-squares solution that brings the expected domain totals, sum of rate *
tokens * posterior, to the targets, with rates bounded below; of rates that do so equally well, those nearest to 1. At the solution a rate
is 1 plus a weighted sum of the posteriors, projected on the bound, so the unknowns are one weight per domain. They are found by
active-set Newton steps on the domain totals and second moments of the documents above the bound, until the projected gradient is zero but for
rounding; a fit that doesn't get there raises an error. Targets out of reach of the bound leave a residual, which is returned
and logged. The only things gathered are sums over documents: class counts by word and bin, and totals for each step. Built-in functions only.

Defined results: a null or empty text has no tokens, it gets a rate but adds to no total; labels with a null id or domain are left out, a
document labelled twice counts twice; without labelled rows there is one domain "all"; a domain without expected tokens can't be raised,
the rest of the fit is unaffected; an empty table gives no rows; no column but the id and the text is read.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, free_name, let, text_of

BINS = 16
SLOTS = 1 << 12  #: places of the table that telling words are looked up in
WORD_ENDS = r"[\x20\x09-\x0D.,;:!?\"'()\[\]]++"
TIGHT = 1e-8  #: the gradient, in shares of all tokens, that counts as zero


def _read(text: Column) -> Column:
    """What the features of a text are taken from, in one pass each: its length, words, lines and marks."""
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[^\p{L}\s]++", ""))
    return F.struct(F.length(text).cast("double").alias("n"), words_of(text).alias("words"), F.split(text, "\n").alias("lines"), marks.cast("double").alias("marks"))


def _binned(t: Column) -> dict[str, Column]:
    """Binned measures of what _read gives, each 0 .. BINS - 1."""
    binned = lambda x, scale: F.least(F.floor(x * scale), F.lit(BINS - 1)).cast("int")
    return {
        "length": binned(F.log2(t["n"] + 1), 1.0),
        "word": binned(t["n"] / F.size(t["words"]), 1.0),
        "marks": binned(t["marks"] / F.greatest(t["n"], F.lit(1.0)), 64.0),
        "repeats": binned(1.0 - F.size(F.array_distinct(t["lines"])) / F.size(t["lines"]), BINS),
    }


def measures(text: Column) -> Column:
    """The binned measures of a text, a struct."""
    return let(_read(text), lambda t: F.struct(*[c.alias(k) for k, c in _binned(t).items()]))


def words_of(text: Column) -> Column:
    """The words of a text, lower-case and without marks."""
    return F.split(F.lower(text), WORD_ENDS)


def _literal(x: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(x)), kind)


def slot_of(word: str) -> int:
    """Where a word stands in the table: Spark's xxhash64 mod SLOTS."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) % SLOTS


@dataclass
class Model:
    domains: list[str]
    tables: dict[str, list[list[float]]] = field(default_factory=dict)  # measure -> bin -> log-likelihood by domain
    words: dict[str, list[float]] = field(default_factory=dict)  # telling word -> log-odds by domain, 0 where it doesn't tell
    logits: list[list[float]] = field(default_factory=list)  # by domain: factors of the features, then the constant
    weights: list[float] = field(default_factory=list)  # what a rate gains, by posterior
    lower: float = 0.0
    residuals: list[float] = field(default_factory=list)  # expected less wanted tokens by domain, as shares of all tokens

    def features(self, text: Column) -> Column:
        """By domain the log-likelihood of the measures, then by domain the score of the telling words."""

        def likelihoods(bins: Column) -> Column:
            logs = _literal([0.0] * len(self.domains), "array<double>")
            for name, table in self.tables.items():
                logs = F.zip_with(logs, F.get(_literal(table, "array<array<double>>"), bins[name]), lambda a, b: a + b)
            return logs

        values = [[0.0] * SLOTS for _ in self.domains]
        for word, by_domain in self.words.items():
            for d, x in enumerate(by_domain):
                values[d][slot_of(word)] = x

        def score(v: list[float], h: Column) -> Column:
            return F.log1p(F.aggregate(h, F.lit(0.0), lambda a, i: a + F.get(_literal(v, "array<double>"), i)))

        def scores(words: Column) -> Column:
            if not self.words:
                return _literal([0.0] * len(self.domains), "array<double>")
            told = F.array_intersect(words, _literal(list(self.words), "array<string>"))
            return let(F.transform(told, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")), lambda h: F.array(*[score(v, h) for v in values]))

        both = lambda t: F.concat(let(F.struct(*[c.alias(k) for k, c in _binned(t).items()]), likelihoods), scores(t["words"]))
        return let(_read(text), both)

    def posteriors(self, text: Column) -> Column:
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))

        def dot(x: Column, row: list[float]) -> Column:
            return F.aggregate(F.zip_with(x, _literal(row[:-1], "array<double>"), lambda a, b: a * b), F.lit(row[-1]), lambda a, b: a + b)

        logs = let(self.features(text), lambda x: F.array(*[dot(x, row) for row in self.logits]))
        powers = let(logs, lambda a: let(F.array_max(a), lambda most: F.transform(a, lambda x: F.exp(x - most))))
        return let(powers, lambda a: let(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), lambda total: F.transform(a, lambda x: x / total)))

    def linear(self, p: Column, weights: list[float]) -> Column:
        """The rate before it is projected on the bound."""
        w = F.from_json(F.lit(str(weights)), "array<double>")
        return F.lit(1.0) + sum((w[d] * p[d] for d in range(1, len(self.domains))), w[0] * p[0])

    def rate(self, p: Column) -> Column:
        if not self.weights:
            return F.lit(max(1.0, self.lower))
        return F.greatest(F.lit(self.lower), self.linear(p, self.weights))


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 1.0) -> np.ndarray:
    """Factors by class (the constant last) at the optimum of the penalised likelihood, by damped Newton steps."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    m, hit = z.shape[1], np.eye(classes)[y]
    w, price = np.zeros((classes, m)), np.full(m, penalty)
    price[-1] = 1e-2

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        logits = z @ w.T
        logits -= logits.max(axis=1, keepdims=True)
        sums = np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return float(((logits - sums) * hit).sum() - (price * w * w).sum() / 2), np.exp(logits - sums)

    value, p = at(w)
    for _ in range(200):
        gradient = (hit - p).T @ z - price * w
        if np.abs(gradient).max() < 1e-6 * len(x):
            break
        hessian = np.zeros((classes * m, classes * m))
        for i in range(classes):
            for j in range(i, classes):
                hessian[i * m : (i + 1) * m, j * m : (j + 1) * m] = (z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
        hessian = np.triu(hessian) + np.triu(hessian, 1).T + np.diag(np.tile(price, classes))
        step, t = np.linalg.solve(hessian, gradient.ravel()).reshape(w.shape), 1.0
        while t > 1e-6 and at(w + t * step)[0] < value:
            t /= 2
        w = w + t * step
        value, p = at(w)
    w[:, -1] -= (w[:, :-1] * mean / spread).sum(axis=1)
    w[:, :-1] /= spread
    return w


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], scratch: Scratch, most_labelled: int = 20_000, most_words: int = 200, least_gain: float = 30.0, least_odds: float = 0.7) -> Model:
    """The classifier. docs: id, text; labels: doc_id, domain; domains: those to know beside the labelled ones.

    most_labelled: labelled rows learnt from, those with the smallest hash of their id. most_words: telling words, the best by
    gain (the likelihood-ratio statistic of a word's presence and a domain); least_gain, least_odds: what a word needs to tell.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).select(F.col("doc_id").alias("known"), F.col("domain").cast("string").alias("domain"))
    known = known.orderBy(F.xxhash64("known"), "known", "domain").limit(most_labelled)
    text = text_of("text")
    sample = docs.join(F.broadcast(known), docs["id"] == known["known"]).limit(most_labelled)  # most_labelled rows bound the broadcast side
    sample = scratch.table(sample.repartition(32).select("domain", "text", measures(text).alias("m")).select("domain", "text", "m.*"), "sample")
    names = [c for c in sample.columns if c not in ("domain", "text")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.col(n).alias("bin")) for n in names])).alias("x")
    counts = sample.select("domain", pairs).groupBy("domain", "x.m", "x.bin").agg(F.count("*").alias("n")).collect()  # domains * measures * BINS rows at most
    domains = sorted({r["domain"] for r in counts} | {d for d in domains if counts}) or ["all"]
    model, of, d = Model(domains), np.zeros((len(names), BINS, len(domains))), len(domains)
    for r in counts:
        of[names.index(r["m"]), r["bin"], domains.index(r["domain"])] += r["n"]
    if d == 1:
        return model
    sizes = of[0].sum(axis=0)
    total = float(sizes.sum())
    model.tables = {n: np.log((of[i] + 0.5) / (sizes + 0.5 * BINS)).tolist() for i, n in enumerate(names)}
    seen = sample.select("domain", F.explode(F.array_distinct(words_of(text))).alias("word")).where("word != ''")
    seen = seen.groupBy("word").agg(*[F.sum((F.col("domain") == x).cast("long")).alias(f"n{i}") for i, x in enumerate(domains)])
    n = sum(F.col(f"n{i}") for i in range(d))
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    odds, gains = [], []
    for i, z in enumerate(map(float, sizes)):
        a, rest = F.col(f"n{i}"), n - F.col(f"n{i}")
        gain = 2 * (term(a, n * z / total) + term(rest, n * (total - z) / total) + term(z - a, (total - n) * z / total) + term(total - z - rest, (total - n) * (total - z) / total))
        by = F.log((a + 0.5) / (z + 1)) - F.log((rest + 0.5) / (total - z + 1))
        tells = (gain >= least_gain) & (by >= least_odds)
        odds.append(F.when(tells, by).otherwise(0.0).alias(f"w{i}"))
        gains.append(F.when(tells, gain).otherwise(0.0))
    best = seen.select("word", F.greatest(*gains).alias("gain"), *odds).where("gain > 0").orderBy(F.desc("gain"), "word").limit(most_words).collect()
    taken: set[int] = set()
    for r in best:
        if slot_of(r["word"]) not in taken:  # of words with one place in the table the more telling one
            taken.add(slot_of(r["word"]))
            model.words[r["word"]] = [r[f"w{i}"] for i in range(d)]
    rows = sample.select("domain", model.features(text).alias("x")).collect()  # most_labelled rows at most
    model.logits = softmax_regression(np.array([r["x"] for r in rows]), np.array([domains.index(r["domain"]) for r in rows]), d).tolist()
    return model


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", budget: float = 1.0, lower: float = 0.0, rounds: int = 100, close: float = 1e-4, ridge: float = 1e-6, **learn_args) -> tuple[Model, DataFrame]:
    """The model, and the table of (id, tokens, posteriors) it was fitted to.

    labels: doc_id, domain. targets: the wanted share of tokens by domain (others: 0). budget: expected tokens as a multiple of all tokens.
    ridge: the price of a rate's squared distance from 1 against that of a squared residual; it makes the solution the only one.
    lower: least rate. rounds: steps after which a fit that hasn't converged is an error. close: the residual, as a share of all tokens,
    above which it is logged.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    model = learn(texts, labels, list(targets), scratch, **learn_args)
    model.lower, domains = lower, model.domains
    pieces = F.split(text_of("text"), r"[\x20\x09-\x0D]++")
    tokens = (F.size(pieces) - (F.get(pieces, F.lit(0)) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")
    table = scratch.table(texts.select("id", tokens.alias("tokens"), model.posteriors(text_of("text")).alias("p")), "posteriors")
    d = len(domains)
    p, w = [F.col("p")[i] for i in range(d)], F.col("tokens").cast("double")
    total = table.agg(F.sum(w).alias("s")).first()["s"]
    if not total:
        return model, table
    wanted = np.array([targets.get(x, 0.0) for x in domains]) * budget
    slim = table.select(w.alias("w"), *[p[i].alias(f"p{i}") for i in range(d)])
    cols = [F.col(f"p{i}") for i in range(d)]
    u = lambda x: model.linear(cols, x.tolist())
    # the dual: its gradient by a domain's weight is ridge * weight + expected - wanted
    energy = lambda u: F.sum(F.col("w") * F.when(u > lower, u * u / 2).otherwise(u * lower - lower * lower / 2))
    dual = lambda x, e: ridge / 2 * x @ x - wanted @ x + e / total

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value, the expected shares and the second moments of the documents above the bound."""
        live = F.when(F.col("u") > lower, F.col("w")).otherwise(0.0)
        sums = slim.withColumn("u", u(x)).withColumn("r", F.greatest(F.lit(lower), "u") * F.col("w")).withColumn("live", live)
        row = sums.agg(energy(F.col("u")), *[F.sum(F.col("r") * c) for c in cols], *[F.sum(F.col("live") * cols[i] * cols[j]) for i in range(d) for j in range(i, d)]).first()
        moments = np.zeros((d, d))
        moments[np.triu_indices(d)] = row[1 + d :]
        moments = (moments + np.triu(moments, 1).T) / total
        return dual(x, row[0]), np.array(row[1 : 1 + d], float) / total, moments

    x = np.zeros(d)
    value, share, moments = at(x)
    for _ in range(rounds):
        gradient = ridge * x + share - wanted
        size = np.abs(gradient).max()
        if size < TIGHT:
            break
        step = -np.linalg.solve(moments + ridge * np.eye(d), gradient)
        new = at(x + step)
        if new[0] > value + 1e-4 * (gradient @ step) and np.abs(ridge * (x + step) + new[1] - wanted).max() > size / 2:
            shorter = 0.5 ** np.arange(1, 25)  # too long: the best of its fractions, all in one pass
            energies = slim.agg(*[energy(u(x + t * step)) for t in shorter]).first()
            step = shorter[int(np.argmin([dual(x + t * step, e) for t, e in zip(shorter, energies)]))] * step
            new = at(x + step)
        x, (value, share, moments) = x + step, new
    else:
        raise RuntimeError(f"the rates have not converged in {rounds} steps: gradient {size}, residual {(share - wanted).tolist()}")
    model.weights, model.residuals = x.tolist(), (share - wanted).tolist()
    if np.abs(share - wanted).max() > close:
        logging.getLogger(__name__).warning("targets out of reach: residuals %s", dict(zip(domains, model.residuals)))
    return model, table


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **fit_args) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>, rate."""
    scratch = Scratch(docs.sparkSession)
    model, table = fit(docs, labels, targets, scratch, **fit_args)
    p = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(model.domains)]
    return scratch.finish(table.select(F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *p, model.rate(F.col("p")).alias("rate")))


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_column: str = "doc_id", text_column: str = "text", **fit_args) -> DataFrame:
    """The rows of docs, each as many times as its rate says; the rate's fraction is decided by a hash of the id."""
    scratch = Scratch(docs.sparkSession)
    model, _ = fit(docs, labels, targets, scratch, id_column, text_column, **fit_args)
    scratch.drop()
    times = free_name(docs, "times")
    rate = let(model.posteriors(text_of(text_column)), model.rate)
    lot = F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = let(rate, lambda r: (F.floor(r) + (lot < r - F.floor(r)).cast("long")).cast("int"))
    return docs.withColumn(times, F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
