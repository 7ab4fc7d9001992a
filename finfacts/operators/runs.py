"""Incremental runs of checks over a store of facts that grows by batches.

A store is a folder of facts by batch and a log of landed batches. A runner keeps beside it, all append-only: findings and covered units by run and
check, and a log of commits. A unit is what a check must see whole (an entity's period, its year): the check's `unit` columns. A run of a check
reads the keys of batches that are new to it, then the facts of the units they touch, and no others; where no batch is new it reads nothing. A
check's commit is written last: a run that dies before it left nothing that counts, and the next run does the same units again. Checks
fail apart from each other; one that failed has no commit, so its units stay due. What a check says now is, for each unit, what the last
committed run that covered it found.

Scopes name entities, verticals or checks; an entity's watermark is the last batch committed for it, alone or with all.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many changed entities the filter names them, so that the scan skips row groups; beyond, the units are joined.
FEW_ENTITIES = 1000
COMMIT = "run long, check string, entities array<string>, high long, status string, units long, new long, unchanged long, resolved long, error string, seconds double"
FINDING = ("fingerprint", "severity", "entity_id", "summary")


@dataclass(frozen=True)
class Check:
    """find: from the facts of whole units to fingerprint, severity, entity_id, summary and the unit's columns."""

    name: str
    find: Callable[[DataFrame], DataFrame]
    unit: tuple[str, ...] = ("entity_id", "period_end")
    vertical: str = "facts"


@dataclass(frozen=True)
class Scope:
    """Nothing named: all."""

    entities: frozenset | None = None
    verticals: frozenset | None = None
    checks: frozenset | None = None

    def takes(self, check: Check) -> bool:
        return (self.verticals is None or check.vertical in self.verticals) and (self.checks is None or check.name in self.checks)


class Store:
    """Facts by batch. A batch is landed once; landing it again replaces it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[dict]:
        return read_log(self.spark, f"{self.path}/batches", "batch long, schema string")

    @property
    def batches(self) -> list[int]:
        return sorted({r["batch"] for r in self._log()})

    def land(self, facts: DataFrame, batch: int, key: str = "entity_id") -> None:
        facts.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.path}/facts/batch={batch}")
        append_log(self.spark, f"{self.path}/batches", {"batch": batch, "schema": facts.schema.json()}, "batch long, schema string")

    def read(self, after: int = -1) -> DataFrame | None:
        """Facts of the batches after one; None where there are none."""
        from pyspark.sql.types import StructType

        log = {r["batch"]: r["schema"] for r in self._log()}
        paths = [f"{self.path}/facts/batch={b}" for b in sorted(log) if b > after]
        if not paths:
            return None
        return self.spark.read.schema(StructType.fromJson(json.loads(log[max(log)])).add("batch", "long")).option("basePath", f"{self.path}/facts").parquet(*paths)


def read_log(spark: SparkSession, path: str, schema: str) -> list[dict]:
    """Rows of a small log of the driver's own; none before the first is written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return []
    return [r.asDict() for r in spark.read.schema(schema).json(path).collect()]


def append_log(spark: SparkSession, path: str, row: dict, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(path)


@dataclass
class Summary:
    run: int
    checks: list[dict] = field(default_factory=list)

    @property
    def failed(self) -> dict[str, str]:
        return {c["check"]: c["error"] for c in self.checks if c["status"] == "failed"}

    def total(self, name: str) -> int:
        return sum(c[name] or 0 for c in self.checks)


class Runner:
    def __init__(self, store: Store, path: str, checks: Iterable[Check], entity: str = "entity_id") -> None:
        self.store, self.spark, self.path, self.checks, self.entity = store, store.spark, path.rstrip("/"), list(checks), entity

    # What has been done

    def commits(self) -> list[dict]:
        return read_log(self.spark, f"{self.path}/commits", COMMIT)

    def _done(self, check: Check) -> list[dict]:
        return [c for c in self.commits() if c["check"] == check.name and c["status"] == "succeeded"]

    def _marks(self, check: Check) -> tuple[int, dict[str, int]]:
        """The last batch done for all entities, and those of entities that are further."""
        done = self._done(check)
        whole = max((c["high"] for c in done if c["entities"] is None), default=-1)
        alone: dict[str, int] = {}
        for c in done:
            for e in c["entities"] or []:
                if c["high"] > whole:
                    alone[e] = max(alone.get(e, -1), c["high"])
        return whole, alone

    def _unit(self, check: Check) -> Column:
        return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in check.unit]), {"ignoreNullFields": "false"})

    # A run

    def due(self, check: Check, scope: Scope, high: int) -> DataFrame | None:
        """The units that batches new to the check touch, as columns of its unit and the unit's name; None, without reading, where none is new."""
        whole, alone = self._marks(check)
        wanted = None if scope.entities is None else {str(e) for e in scope.entities}
        low = whole if wanted is None else min((max(whole, alone.get(e, -1)) for e in wanted), default=high)
        if low >= high:
            return None
        rows = self.store.read(low)
        name = F.col(self.entity).cast("string")
        rows = rows.where(F.col("batch") <= high)
        rows = rows if wanted is None else rows.where(name.isin(sorted(wanted)))
        ahead = {e: b for e, b in alone.items() if wanted is None or e in wanted}
        if ahead:
            marks = self.spark.createDataFrame(sorted(ahead.items()), "__e string, __mark long")
            rows = rows.join(F.broadcast(marks), name == F.col("__e"), "left").where(F.col("batch") > F.coalesce("__mark", F.lit(whole)))  # as many rows as scopes named
        return rows.select(*check.unit, self.entity).distinct() if self.entity not in check.unit else rows.select(*check.unit).distinct()

    def facts_of(self, check: Check, units: DataFrame) -> DataFrame:
        """All facts of whole units. Nulls in a unit's columns are equal."""
        facts = self.store.read()
        few = [r[0] for r in units.select(self.entity).distinct().limit(FEW_ENTITIES + 1).collect()]
        if len(few) <= FEW_ENTITIES and None not in few:
            facts = facts.where(F.col(self.entity).isin(few))
        a, b = facts.alias("a"), units.select(*check.unit).distinct().alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in check.unit])
        return a.join(b, same, "left_semi")

    def run(self, scope: Scope = Scope()) -> Summary:
        """Runs the scope's checks over what is due. A check without anything due has no line in the summary."""
        high = max(self.store.batches, default=-1)
        number = max((c["run"] for c in self.commits()), default=-1) + 1
        out = Summary(number)
        for check in self.checks:
            if scope.takes(check):
                line = self._run_one(check, scope, number, high)
                out.checks += [line] if line else []
        return out

    def _run_one(self, check: Check, scope: Scope, number: int, high: int) -> dict | None:
        began = time.monotonic()
        entities = None if scope.entities is None else sorted(str(e) for e in scope.entities)
        line = {"run": number, "check": check.name, "entities": entities, "high": high, "status": "succeeded", "units": 0, "new": 0, "unchanged": 0, "resolved": 0, "error": None}
        try:
            units = self.due(check, scope, high)
            if units is None:
                return None
            at = f"run={number}/check={check.name}"
            units.withColumn("unit", self._unit(check)).write.mode("overwrite").parquet(f"{self.path}/units/{at}")
            units = self.spark.read.parquet(f"{self.path}/units/{at}")
            before = self.current(check)
            found = check.find(self.facts_of(check, units)).withColumn("unit", self._unit(check)).select("unit", *[F.col(c).cast("string").alias(c) for c in FINDING]).dropDuplicates(["fingerprint"])
            found.write.mode("overwrite").parquet(f"{self.path}/findings/{at}")
            now = self.spark.read.parquet(f"{self.path}/findings/{at}").select("fingerprint", F.lit(1).alias("now"))
            old = before.join(units.select("unit").distinct(), "unit", "left_semi").select("fingerprint", F.lit(1).alias("old"))
            count = now.join(old, "fingerprint", "full").agg(F.count_if(F.col("old").isNull()).alias("new"), F.count_if(F.col("now").isNotNull() & F.col("old").isNotNull()).alias("unchanged"), F.count_if(F.col("now").isNull()).alias("resolved")).first()
            line |= count.asDict() | {"units": units.count()}
        except Exception as e:  # noqa: BLE001  any failure is the check's own; its class stays with its text
            line |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        line["seconds"] = round(time.monotonic() - began, 3)
        append_log(self.spark, f"{self.path}/commits", line, COMMIT)
        return line

    # What checks say now

    def current(self, check: Check) -> DataFrame:
        """unit, run and the findings' columns: for each unit what the last committed run that covered it found."""
        runs = sorted({c["run"] for c in self._done(check)})
        if not runs:
            return self.spark.createDataFrame([], "unit string, run long, " + ", ".join(f"{c} string" for c in FINDING))
        read = lambda kind: reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{kind}/run={n}/check={check.name}").withColumn("run", F.lit(n).cast("long")) for n in runs])
        last = read("units").groupBy("unit").agg(F.max("run").alias("run"))
        return read("findings").join(last, ["unit", "run"], "left_semi").select("unit", "run", *FINDING)

    def findings(self) -> DataFrame:
        """All checks' current findings with their check."""
        return reduce(DataFrame.unionByName, [self.current(c).withColumn("check", F.lit(c.name)).withColumn("vertical", F.lit(c.vertical)) for c in self.checks])


def anchor_counts(ours: DataFrame, filed: DataFrame, absolute: float = 1e6, relative: float = 0.001) -> DataFrame:
    """A reconciliation's counts: entity_id, statement, stored (values with an anchor's concept), checked (with a filed value), matched, diverging.

    ours: entity_id, statement, concept, period_end, value; filed: entity_id, concept, end, val.
    """
    from .verify import tolerance

    theirs = filed.select("entity_id", "concept", F.col("end").alias("period_end"), F.col("val").cast("double").alias("other"))
    mine = F.col("value").cast("double")
    rows = ours.join(theirs, ["entity_id", "concept", "period_end"], "left")
    off = F.abs(mine - F.col("other")) > tolerance(F.col("other"), absolute, relative)
    return rows.groupBy("entity_id", "statement").agg(F.count("*").alias("stored"), F.count("other").alias("checked"), F.count_if(~off).alias("matched"), F.count_if(off).alias("diverging"))
