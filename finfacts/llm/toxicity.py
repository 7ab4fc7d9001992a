"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they find.

Learning (from the training fold of the labels only; at most `most_labelled` labelled rows, those with the smallest hash
of their id): words and word beginnings that are far more frequent in toxic documents make the lexicon. A term's support is the number
of different words it follows, so copies of one document count once. The trie of the lexicon is run together with the
Levenshtein automata of its words (one edit for words of five letters or more); the product is determinised as far as texts ask for it.
Words that the automata only take with an edit and that clean documents use are no misspellings.

Scoring: a hit's weight is its term's log-odds, less in a window that quotes or reports, more in one that addresses
somebody. A logistic function of the summed and the largest weight, fitted on the same sample, is the score.

Defined results: null and empty texts get the score of a text without hits; without labels of both kinds the lexicon is empty and
the score is the share of toxic labels (0 without any); a null id is in no held-out fold; labels that repeat an id count each;
an empty table gives no rows; lang, source, labels and ids are not read by a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, fold

EDGE = ".,;:!?\"'()[]{}<>*#$%&|«»“”„‘’…-_=+~^`/\\"
QUOTES = re.compile("[\"«»“”„]")
REPORTING = frozenset("said says wrote quoted called quote reported dit écrit cité sagte schrieb zitat dijo escribió cita".split())
ADDRESS = frozenset("you your you're u tu te toi vous votre du dich dir ihr sie tú usted ustedes vosotros".split())
WINDOW, QUOTED, ADDRESSED = 8, 0.4, 1.2
STEMS = (4, 5, 6, 7)


class Lexicon:
    """The product of a lexicon's trie and the Levenshtein automata of its words, determinised lazily."""

    MOST_STATES = 50_000

    def __init__(self, words: dict[str, float], stems: dict[str, float], rigid: frozenset[str] = frozenset(), unless: frozenset[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[float, float, str]] = [(0.0, 0.0, "")]  # weight as a word, as a stem; the word if it takes an edit
        for terms, is_stem in ((words, False), (stems, True)):
            for term, weight in terms.items():
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.ends.append((0.0, 0.0, ""))
                    node = self.children[node][c]
                word, stem, edit = self.ends[node]
                self.ends[node] = (word, weight, edit) if is_stem else (weight, stem, term if len(term) >= 5 and term not in rigid else "")
        self.unless = unless
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.values: list[tuple[float, tuple[float, str], float]] = []  # exact word; word with an edit; stem reached
        self.start = self.state({(0, 0)})

    def state(self, items: set[tuple[int, int]]) -> int:
        for node, edits in list(items):  # a letter of the term left out
            if edits == 0:
                items |= {(child, 1) for child in self.children[node].values()}
        least: dict[int, int] = {}
        for node, edits in items:
            least[node] = min(edits, least.get(node, 9))
        key = frozenset(least.items())
        if key not in self.numbers:
            ends = [(self.ends[n], e) for n, e in key]
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.values.append((max([0.0, *(x[0] for x, e in ends if e == 0)]), max([(0.0, ""), *((x[0], x[2]) for x, e in ends if x[2])]), max([0.0, *(x[1] for x, e in ends if e == 0)])))
        return self.numbers[key]

    def step(self, at: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, edits in self.sets[at]:
            if c in self.children[node]:
                items.add((self.children[node][c], edits))
            if edits == 0:  # another letter in its place, or one too many
                items |= {(child, 1) for child in self.children[node].values()} | {(node, 1)}
        to = self.steps[at][c] = self.state(items) if items else -1
        return to

    def __call__(self, word: str) -> tuple[float, str]:
        """The best weight of a word; the lexicon's word if it takes an edit."""
        if len(self.sets) > self.MOST_STATES:
            self.reset()
        at, stem = self.start, 0.0
        for c in word:
            to = self.steps[at].get(c, -2)
            at = self.step(at, c) if to == -2 else to
            if at < 0:
                return stem, ""
            stem = max(stem, self.values[at][2])
        exact, near, _ = self.values[at]
        if max(exact, stem) > 0:
            return max(exact, stem), ""
        return near if near[0] > 0 and word not in self.unless else (0.0, "")


class _Weights(dict):
    """Weights of raw tokens; emptied when grown."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        if len(self) > 300_000:
            self.clear()
        word = token.strip(EDGE)
        w = self[token] = self.lexicon(word)[0] if word else 0.0
        return w


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rigid: frozenset[str] = frozenset()
    unless: frozenset[str] = frozenset()
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    prior: float = 0.0

    def weights(self) -> _Weights:
        return _Weights(Lexicon(self.words, self.stems, self.rigid, self.unless))

    def probability(self, total: float, largest: float) -> float:
        if not self.words and not self.stems:
            return self.prior
        z = self.bias + self.slopes[0] * math.log1p(total) + self.slopes[1] * largest
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def features(text: str | None, weights: _Weights) -> tuple[float, float, int, int]:
    """Summed and largest weight of the hits in their contexts, hits, quoted hits."""
    tokens = (text or "").lower().split()
    found = {t for t in set(tokens) if weights[t]}
    if not found:
        return 0.0, 0.0, 0, 0
    total = largest = 0.0
    hits = quoted = 0
    for i, t in enumerate(tokens):
        if t in found:
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            around = {w.strip(EDGE) for w in before} | {w.strip(EDGE) for w in after}
            opened = sum(len(QUOTES.findall(w)) for w in before) + (t[0] in "\"«“„")
            closed = any(QUOTES.search(w) for w in after) or QUOTES.search(t[1:]) is not None
            reports = (opened % 2 == 1 and closed) or bool(around & REPORTING)
            w = weights[t] * (QUOTED if reports else 1.0) * (ADDRESSED if around & ADDRESS and not reports else 1.0)
            total, largest, hits, quoted = total + w, max(largest, w), hits + 1, quoted + reports
    return total, largest, hits, quoted


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms with their numbers of clean and toxic documents; of toxic documents also with each word they follow."""
    counts: Counter = Counter()
    for pdf in batches:
        rows: set[tuple[str, bool, int]] = set()
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = [w.strip(EDGE) for w in (text or "").lower().split()]
            own: set[tuple[str, bool, bool]] = set()
            for last, w in zip(["", *words], words):
                if w:
                    terms = [(w, False), *((w[:n], True) for n in STEMS if len(w) > n)]
                    own |= {(*t, bool(toxic)) for t in terms}
                    if toxic:
                        rows |= {(*t, zlib.crc32(last.encode("utf-8", "surrogatepass"))) for t in terms}
            counts.update(own)
        if len(counts) > 200_000:
            yield _rows(counts)
            counts = Counter()
        yield pd.DataFrame([(t, s, h, 0, 0) for t, s, h in rows], columns=["term", "stem", "context", "toxic", "clean"]).astype({"context": "Int64"})
    yield _rows(counts)


def _rows(counts: Counter) -> pd.DataFrame:
    rows = [(t, s, None, n * y, n * (not y)) for (t, s, y), n in counts.items()]
    return pd.DataFrame(rows, columns=["term", "stem", "context", "toxic", "clean"]).astype({"context": "Int64"})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x1 = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x1.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_labelled: int = 20_000, most_terms: int = 2_000, least_gain: float = 30.0, least_weight: float = 2.5) -> Model:
    """Fit the model. docs, labels are joined by id; the labels' column is toxic.

    most_labelled: labelled rows learnt from, where ids repeat too. most_terms: the lexicon's size. least_gain, least_weight: what a term needs.
    """
    scratch = Scratch(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(most_labelled)
    texts = docs.select(F.col(id_column).alias("__doc"), F.col(text_column).cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).select("text", "toxic").limit(most_labelled)  # most_labelled rows bound the broadcast side
    sample = scratch.table(sample.repartition(32), "sample")  # the texts are read once
    counts = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        return Model(prior=toxic / max(1, toxic + clean))
    seen = sample.mapInPandas(_terms, "term string, stem boolean, context long, toxic long, clean long")
    seen = seen.groupBy("term", "stem").agg(F.least(F.countDistinct("context"), F.sum("toxic")).alias("hits"), F.sum("clean").alias("clean"))
    h, c = F.col("hits").cast("double"), F.col("clean").cast("double")
    share = toxic / (toxic + clean)
    gain = 2 * (h * F.log(h / (h + c) / share) + c * F.log(F.greatest(c / (h + c), F.lit(1e-9)) / (1 - share)))
    weight = F.log((h + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    terms = seen.where("hits > 0").select("term", "stem", "hits", gain.alias("gain"), weight.alias("weight")).where((F.col("gain") >= least_gain) & (F.col("weight") >= least_weight))
    found = terms.orderBy(F.desc("gain"), "term", "stem").limit(most_terms).collect()
    model = Model(prior=share)
    model.words = {r["term"]: r["weight"] for r in found if not r["stem"]}
    model.stems = {r["term"]: r["weight"] for r in found if r["stem"]}
    if not found:
        return model

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = model.weights().lexicon
        for pdf in batches:
            rows = [(w, lexicon(w)[1]) for t in pdf.loc[pdf["toxic"] == 0, "text"] for w in {w.strip(EDGE) for w in set((t or "").lower().split())}]
            yield pd.DataFrame([x for x in rows if x[1]], columns=["word", "term"], dtype="object")

    # What clean documents have near a word tells whether it takes an edit at all, or which words are none of its misspellings.
    close = sample.mapInPandas(near, "word string, term string").groupBy("term", "word").agg(F.count("*").alias("n"))
    often = close.groupBy("term").agg(F.sum("n").alias("n")).collect()  # most_terms rows at most
    support = {r["term"]: r["hits"] for r in found if not r["stem"]}
    model.rigid = frozenset(r["term"] for r in often if r["n"] > 1 + 0.05 * support[r["term"]])
    model.unless = frozenset(r["word"] for r in close.where(~F.col("term").isin(list(model.rigid))).select("word").distinct().collect())  # bounded by the sample: 1 + 5 % of each term's hits

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.weights()
        for pdf in batches:
            rows = [features(t, weights)[:2] for t in pdf["text"]]
            yield pd.DataFrame(rows, columns=["total", "largest"]).assign(toxic=pdf["toxic"].to_numpy() != 0)

    rows = sample.mapInPandas(measured, "total double, largest double, toxic boolean").collect()  # most_labelled rows at most
    b = _logistic(np.array([(math.log1p(r["total"]), r["largest"]) for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    model.bias, model.slopes = float(b[0]), (float(b[1]), float(b[2]))
    return model


def scorer(model: Model) -> Callable:
    """A function of the text column: struct of score, hits, quoted."""

    @F.pandas_udf("score double, n_hits int, n_quoted int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = model.weights()
        for texts in batches:
            rows = []
            for text in texts:
                total, largest, hits, quoted = features(text, weights)
                rows.append((model.probability(total, largest), hits, quoted))
            yield pd.DataFrame(rows, columns=["score", "n_hits", "n_quoted"]).astype({"n_hits": "int32", "n_quoted": "int32"})

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_hits, n_quoted."""
    told = docs.select(F.col(id_column).alias("doc_id"), scorer(learn(docs, labels, id_column, text_column))(F.col(text_column).cast("string")).alias("x"))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "x.score", (F.col("x.score") >= 0.5).cast("int").alias("predicted"), "x.n_hits", "x.n_quoted")


def keep_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with all columns of docs. With an empty lexicon nothing is told apart, and all rows stay."""
    model = learn(docs, labels, id_column, text_column)
    if not model.words and not model.stems:
        return docs
    return docs.where(scorer(model)(F.col(text_column).cast("string"))["score"] < 0.5)
