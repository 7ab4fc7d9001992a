"""Voices: nearest enrolled vector, and the speaker that covers most of a segment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(vectors: list) -> np.ndarray:
    m = np.array(vectors, np.float64).reshape(len(vectors), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def _nearest(pdf: pd.DataFrame, known: np.ndarray, ids: list, labels: list, least: float) -> pd.DataFrame:
    """Of known vectors in the order of their ids, the first of the largest cosine; products of equal vectors differ in the last bits only."""
    cosine = _unit(pdf["v"].tolist()) @ known.T
    best = cosine.round(12).argmax(axis=1)
    out = pd.DataFrame({"id": pdf["id"], "match": [ids[i] for i in best], "label": [labels[i] for i in best], "cosine": cosine[np.arange(len(best)), best]}, index=pdf.index)
    if "row" in pdf:
        out.insert(0, "row", pdf["row"])
    return out[out["cosine"] >= least]


def best_match(queries: DataFrame, enrolled: DataFrame, id_: str, vector: str, label: str, least: float = 0.55, most_enrolled: int | None = None, block: int = 10_000) -> DataFrame:
    """Each query with the enrolled vector of the largest cosine, if that is `least` or more; of several the smallest id.

    The enrolled set is counted. At most `block` vectors are gathered once, and a batch of queries is one matrix product.
    Larger sets, and then the queries, are dealt into blocks of about that size; every pair of blocks is one product, of which
    each query's best goes on, and the best of those is the match. A caller who gives most_enrolled wants larger sets refused.
    """
    n = enrolled.count()
    if most_enrolled is not None and n > most_enrolled:
        raise ValueError(f"{n} enrolled vectors; the caller's limit is {most_enrolled}")
    kinds = dict(enrolled.select(F.col(id_).alias("id"), F.col(label).alias("label")).dtypes)
    schema = f"id {kinds['id']}, match {kinds['id']}, label {kinds['label']}, cosine double"
    asked = queries.select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    if n > block:
        return _by_blocks(asked, enrolled.select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")), schema, least, -(-n // block), -(-asked.count() // block))
    rows = enrolled.select(id_, label, vector).orderBy(id_).collect()
    ids, labels, known = [r[0] for r in rows], [r[1] for r in rows], _unit([r[2] for r in rows]) if n else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if n and len(pdf):
                yield _nearest(pdf, known, ids, labels, least)

    return asked.mapInPandas(run, schema)


def _by_blocks(asked: DataFrame, enrolled: DataFrame, schema: str, least: float, known_blocks: int, asked_blocks: int) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(max(n, 1))).cast("int")
    numbered = lambda df: df.withColumn("row", F.monotonically_increasing_id())
    a = numbered(asked).withColumn("x", dealt(asked_blocks)).withColumn("y", every(known_blocks))
    b = numbered(enrolled).withColumn("y", dealt(known_blocks)).drop("row").withColumn("x", every(asked_blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        parts = [_nearest(left[i : i + 1000], known, right["id"].tolist(), right["label"].tolist(), least) for known in [_unit(right["v"].tolist())] for i in range(0, len(left), 1000)] if len(left) and len(right) else []
        return pd.concat(parts) if parts else pd.DataFrame(columns=["row", "id", "match", "label", "cosine"])

    found = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(run, f"row long, {schema}")
    first = F.min_by(F.struct("id", "match", "label", "cosine"), F.struct(-F.round("cosine", 12), "match")).alias("best")
    return found.groupBy("row").agg(first).select("best.*")


def dominant_overlap(segments: DataFrame, speakers: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """Each segment (key, seg_id, start, end) with the speaker (key, label, start, end) who covers most of it.

    Intervals meet in buckets of `width` seconds that they touch, so only intervals that are near are compared.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    touched = lambda df: df.withColumn("b", F.explode(F.sequence(bucket("start"), bucket("end"))))
    a = touched(segments.select(key, "seg_id", "start", "end"))
    b = touched(speakers.select(key, "label", "start", "end")).withColumnsRenamed({"start": "s2", "end": "e2"})
    low, high = F.greatest("start", "s2", F.col("b") * F.lit(width)), F.least("end", "e2", (F.col("b") + 1) * F.lit(width))
    met = a.join(b, [key, "b"]).withColumn("seconds", high - low).where("seconds > 0")
    sums = met.groupBy(key, "seg_id", "start", "end", "label").agg(F.sum("seconds").alias("seconds"))
    best = sums.groupBy(key, "seg_id", "start", "end").agg(F.max_by(F.struct("label", "seconds"), F.struct("seconds", "label")).alias("x"))
    length = F.col("end") - F.col("start")
    told = best.select(key, "seg_id", "x.label", "x.seconds", F.when(length > 0, F.col("x.seconds") / length).alias("confidence"))
    return segments.select(key, "seg_id").join(told, [key, "seg_id"], "left")
