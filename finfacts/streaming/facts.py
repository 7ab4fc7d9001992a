"""Facts as a stream: files that arrive are checked, de-duplicated within a watermark and appended; late restatements are versions, not updates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schemas import FACTS, fact_expectations

IDENTITY = ["entity_id", "concept", "period_end", "period_type", "extraction_version", "published_at"]


def read_facts(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def accepted(facts: DataFrame, delay: str = "7 days") -> DataFrame:
    """Facts that keep their contracts, each identity once; one seen again within the delay is dropped without keeping all keys for ever."""
    keeps = F.lit(True)
    for e in fact_expectations().values():
        keeps = keeps & F.coalesce(e, F.lit(False))
    return facts.where(keeps).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(IDENTITY)


def rejected(facts: DataFrame) -> DataFrame:
    """Facts that break a contract, with the names of those they break."""
    names = F.filter(F.array(*[F.when(~F.coalesce(e, F.lit(False)), F.lit(k)) for k, e in fact_expectations().items()]), lambda x: x.isNotNull())
    return facts.withColumn("broken", names).where(F.size("broken") > 0)


def publication_counts(facts: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Facts by day of publication and statement, final once the watermark has passed."""
    return facts.withWatermark("published_at", delay).groupBy(F.window("published_at", window), "statement").agg(F.count("*").alias("n"))


def append(facts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write to Parquet, exactly once by the checkpoint; once: all that is there now, else for ever."""
    writer = facts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("statement")
    return (writer.trigger(availableNow=True) if once else writer).start()


VERSION_KEY = ("entity_id", "concept", "period_end", "period_type")
LINKS = "id long, published_at long, superseded_at long, supersedes_fact_id long, seq long"  #: times in microseconds


class Chain(StatefulProcessor):
    """Keeps the versions of one value in the order of publication and emits each whose place in the chain changes.

    State: the versions that may still get a neighbour, and how many links were emitted. What was published before the watermark can't get
    a version in front of it any more, so of those only the newest is kept; a value without news for `forget_ms` behind the watermark is forgotten.
    """

    def __init__(self, key: Sequence[str], forget_ms: int) -> None:
        self.row, self.forget_ms = Row(*key, *[c.split()[0] for c in LINKS.split(", ")]), forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "seq long, times array<long>, ids array<long>, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seq, times, ids, timer = self.state.get() or (0, [], [], 0)
        chain = sorted(zip(times, ids))
        known = sorted({*chain, *((r["__at"], r["id"]) for r in rows)})
        if known == chain:
            after = self._open(chain, timerValues.getCurrentWatermarkInMs() * 1000)
            if len(after) < len(chain):
                self._keep(seq, after, timer)
            return
        before = {i: self._link(chain, n) for n, (_, i) in enumerate(chain)}
        for n, (_, i) in enumerate(known):
            link = self._link(known, n)
            if before.get(i) != link:
                seq += 1
                yield self.row(*key, *link, seq)
        self._keep(seq, self._open(known, timerValues.getCurrentWatermarkInMs() * 1000), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        if held:
            seq, times, ids, _ = held
            chain = self._open(sorted(zip(times, ids)), timerValues.getCurrentWatermarkInMs() * 1000)
            if chain[-1][0] // 1000 + self.forget_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
            else:
                self._keep(seq, chain, 0)
        yield from ()

    def _keep(self, seq: int, chain: list[tuple[int, int]], timer: int) -> None:
        due = chain[-1][0] // 1000 + self.forget_ms
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((seq, [t for t, _ in chain], [i for _, i in chain], due))

    @staticmethod
    def _open(chain: list[tuple[int, int]], watermark: int) -> list[tuple[int, int]]:
        settled = sum(t < watermark for t, _ in chain)
        return chain[max(0, settled - 1) :]

    @staticmethod
    def _link(chain: list[tuple[int, int]], n: int) -> tuple:
        """id, published_at, superseded_at, supersedes_fact_id."""
        return chain[n][1], chain[n][0], chain[n + 1][0] if n + 1 < len(chain) else None, chain[n - 1][1] if n else None


def superseding(facts: DataFrame, key: Sequence[str] = VERSION_KEY, delay: str = "7 days", forget: timedelta = timedelta(days=3650)) -> DataFrame:
    """A stream of versions as a stream of links: key, id, published_at, superseded_at, supersedes_fact_id, seq.

    A version that comes late, within the delay, takes its place: it, the one before it and the one after it are emitted again. A version's last
    row (the largest seq) is what facts.supersede gives over all versions, whatever their order of arrival. Needs the RocksDB state store.
    """
    kinds = dict(facts.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], LINKS])
    cells = facts.select(*key, "id", "published_at", F.unix_micros("published_at").alias("__at")).withWatermark("published_at", delay)
    links = cells.groupBy(*key).transformWithState(statefulProcessor=Chain(key, int(forget.total_seconds() * 1000)), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return links.withColumns({c: F.timestamp_micros(c) for c in ("published_at", "superseded_at")})


def latest_links(links: DataFrame) -> DataFrame:
    """The last word on each version, from all links ever emitted."""
    last = F.max_by(F.struct("published_at", "superseded_at", "supersedes_fact_id"), "seq")
    return links.groupBy(*[c for c in links.columns if c not in ("published_at", "superseded_at", "supersedes_fact_id", "seq")]).agg(last.alias("x")).select("*", "x.*").drop("x")


def append_links(links: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append links to Parquet, a batch's rows under its number: a batch that is done again after a failure replaces its own."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = links.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_versions(facts: DataFrame, path: str, checkpoint: str, key: Sequence[str] = VERSION_KEY, once: bool = True) -> StreamingQuery:
    """Append the links that each batch of a stream of versions changes, by one window over all links told before and the batch.

    For volumes: superseding() answers key by key in Python from a state that the watermark bounds; here the links are the state, a batch costs a
    pass over them, and no version is too late. seq is the batch's number. A batch that is done again after a failure replaces its own.
    """
    fields = [*key, "id", "published_at", "superseded_at", "supersedes_fact_id"]
    w = Window.partitionBy(*key).orderBy("published_at", "id")

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select(*key, "id", "published_at", F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("long").alias("supersedes_fact_id"), F.lit(False).alias("__told"))
        if number > 0:
            told = latest_links(batch.sparkSession.read.parquet(*[f"{path}/batch={n}" for n in range(number)]))
            rows = rows.unionByName(told.select(*fields, F.lit(True).alias("__told")))
        once_each = rows.groupBy(*key, "id", "published_at").agg(*[F.max(c).alias(c) for c in ("superseded_at", "supersedes_fact_id", "__told")])
        now = once_each.select("*", F.lead("published_at").over(w).alias("__next"), F.lag("id").over(w).alias("__before"))
        same = F.col("__told") & F.col("superseded_at").eqNullSafe(F.col("__next")) & F.col("supersedes_fact_id").eqNullSafe(F.col("__before"))
        links = now.where(~same).select(*key, "id", "published_at", F.col("__next").alias("superseded_at"), F.col("__before").alias("supersedes_fact_id"), F.lit(number).cast("long").alias("seq"))
        links.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = facts.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
