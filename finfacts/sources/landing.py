"""Sinks for what vendors answer, for artifacts and for results; and the trace of what was read."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _plain(x: object) -> object:
    if isinstance(x, date):  # datetimes too
        return x.isoformat()
    if isinstance(x, Decimal):
        return format(x, "f")
    if isinstance(x, (set, frozenset)):
        return sorted(x, key=repr)
    raise TypeError(f"{type(x).__name__} has no JSON form")


def canonical_json(value: object) -> str:
    """One text for equal values: keys in order, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=_plain)


def fingerprint_of(params: object) -> str:
    return hashlib.sha256(canonical_json(params).encode()).hexdigest()


def with_hashes(responses: DataFrame, body: str = "body", params: str = "params", data: str | None = None) -> DataFrame:
    """Adds raw_hash, canonical_hash (white space and line ends don't count) and params_hash.

    With data, a column of bytes, a row has either a body or bytes; one with both or neither fails when it is read.
    """
    raw = F.col(body).cast("binary")
    squeezed = F.trim(F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"[ \t]+\n", "\n"))
    canonical = F.sha2(squeezed, 256)
    if data is not None:
        one = F.col(body).isNull() != F.col(data).isNull()
        raw = F.when(one, F.coalesce(raw, F.col(data))).otherwise(F.raise_error(F.lit("a response has a body or bytes, not both")).cast("binary"))
        canonical = F.coalesce(canonical, F.sha2(F.col(data), 256))
    return responses.withColumns({"raw_hash": F.sha2(raw, 256), "canonical_hash": canonical, "params_hash": F.sha2(params, 256)})


def cache_path(root: str, vendor: str, endpoint: str, *segments: str) -> str:
    """Where a vendor's answers are kept: folders that partition discovery reads back as columns."""
    parts = [f"vendor={vendor}", f"endpoint={endpoint.strip('/').replace('/', '-')}", *segments]
    if any(not s or s in (".", "..") or "/" in s for s in parts):
        raise ValueError(f"no path of {segments}")
    return "/".join([root.rstrip("/"), *parts])


def land(responses: DataFrame, existing: DataFrame | None, path: str, keys: Sequence[str] = ("vendor", "endpoint", "params_hash", "canonical_hash")) -> None:
    """Append the responses that aren't there yet, by vendor and endpoint."""
    rows = responses.dropDuplicates(list(keys))
    if existing is not None:
        rows = rows.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    rows.write.mode("append").partitionBy("vendor", "endpoint").parquet(path)


def new_artifacts(incoming: DataFrame, existing: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """The artifacts to append, and the existing ones with those superseded that have a new version.

    An artifact is known by its type and document; one with the same canonical hash is there already. Line ends and white space at
    their ends don't count.
    """
    keys = ["artifact_type", "source_document_id"]
    hashed = with_hashes(incoming, "body", "source_document_id").drop("params_hash").dropDuplicates([*keys, "canonical_hash"])
    fresh = hashed.join(existing.select(*keys, "canonical_hash"), [*keys, "canonical_hash"], "left_anti")
    hit = fresh.select(*keys).distinct().withColumn("__new", F.lit(True))
    old = existing.join(hit, keys, "left").withColumn("superseded_at", F.when(F.col("__new") & F.col("superseded_at").isNull(), now).otherwise(F.col("superseded_at"))).drop("__new")
    return fresh, old


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Delete and replace: the partitions that df has rows of, and no others. Tasks gather a partition's rows, so it gets few files."""
    df.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def export_csv(df: DataFrame, path: str, checks: dict[str, tuple[str, dict[str, int]]] | None = None) -> None:
    """CSV files with a header. checks: name -> (total, signed parts); each adds `check_<name>`, what the total misses of its parts, missing parts as 0."""
    for name, (total, parts) in (checks or {}).items():
        told = F.lit(0).cast("decimal(38,4)")
        for part, sign in parts.items():
            told = told + F.coalesce(F.col(part).cast("decimal(28,4)"), F.lit(0)) * sign
        df = df.withColumn(f"check_{name}", (F.col(total).cast("decimal(28,4)") - told).cast("decimal(38,4)"))
    df.write.mode("overwrite").option("header", True).csv(path)


def as_lines(df: DataFrame) -> DataFrame:
    """A screen's rows as JSON lines, in their order."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


@dataclass
class Trace:
    """What queries and actions ran: label, fingerprint of their parameters, rows, milliseconds, ids."""

    entries: list[dict] = field(default_factory=list)

    def run(self, df: DataFrame, label: str, params: object = None, ids: str | None = None, most: int = 1_000) -> list[dict]:
        """The first `most` rows as dicts, for reads of a screen's size. The entry has the number of all rows."""
        began = time.perf_counter()
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        total = df.count() if len(rows) > most else len(rows)
        self.record(label, params, began, total, [r[ids] for r in rows[:most]] if ids else [])
        return rows[:most]

    def record(self, label: str, params: object, began: float, rows: int, ids: Sequence = ()) -> None:
        """An action that ran elsewhere. began: time.perf_counter() at its start."""
        self.entries.append({"label": label, "params": fingerprint_of(params), "rows": rows, "ms": round(1000 * (time.perf_counter() - began), 1), "ids": list(ids)})
