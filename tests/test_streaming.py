"""Versions as a stream: any order of arrival ends in the batch result; state expires; a restart goes on where it stopped."""

import random
from datetime import datetime, timedelta

import pytest

from finfacts.operators import facts as ops
from finfacts.streaming import facts as stream

SCHEMA = "id long, entity_id long, concept string, period_end date, period_type string, published_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def version(i, entity, day, concept="revenue"):
    return (i, entity, concept, datetime(2024, 3, 31).date(), "quarter", datetime(2024, 5, 1) + timedelta(days=day))


def run(spark, tmp_path, batches, first=0, **how):
    """Each batch is a file, and a micro-batch of its own."""
    for n, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        stream.append_links(stream.superseding(source, **how), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("batch")


def as_rows(df):
    return sorted((r.id, r.published_at, r.superseded_at, r.supersedes_fact_id) for r in df.select("id", "published_at", "superseded_at", "supersedes_fact_id").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_ends_in_the_batch_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    versions = [version(i, i % 3, rng.choice([0, 1, 2, 3, 5, 8]), rng.choice(["revenue", "tax"])) for i in range(24)]
    rng.shuffle(versions)
    links = run(spark, tmp_path, [versions[:9], versions[9:10] + versions[:2], versions[10:]], delay="400 days")
    want = ops.supersede(spark.createDataFrame(versions, SCHEMA), list(stream.VERSION_KEY))
    assert as_rows(stream.latest_links(links)) == as_rows(want)
    assert links.count() > len(versions)  # neighbours of late versions were told again


def test_a_late_version_takes_its_place_and_a_repeat_says_nothing(spark, tmp_path):
    links = run(spark, tmp_path, [[version(1, 1, 0), version(3, 1, 10)], [version(2, 1, 5)], [version(2, 1, 5)]], delay="30 days")
    told = sorted((r.seq, r.id, r.supersedes_fact_id, None if r.superseded_at is None else r.superseded_at.day) for r in links.collect())
    assert told == [(1, 1, None, 11), (2, 3, 1, None), (3, 1, None, 6), (4, 2, 1, 11), (5, 3, 2, None)]


def test_state_shrinks_with_the_watermark(spark, tmp_path):
    """Behind the watermark only the newest version is kept, and a restatement still finds it; what is too late is dropped."""
    links = run(spark, tmp_path, [[version(i, 1, i) for i in range(5)], [version(50, 2, 100)], [version(51, 2, 101), version(9, 1, 102), version(8, 1, 2)]], delay="1 day")
    last = {r.id: r for r in stream.latest_links(links).collect()}
    assert last[9].supersedes_fact_id == 4 and last[4].superseded_at == last[9].published_at and 8 not in last
    state = spark.read.format("statestore").option("stateVarName", "chain").load(str(tmp_path / "ck")).collect()
    kept = {r.key.entity_id: sorted(r.value["ids"]) for r in state}
    assert kept == {1: [4, 9], 2: [50, 51]}


def test_state_is_forgotten(spark, tmp_path):
    run(spark, tmp_path, [[version(1, 1, 0)], [version(2, 2, 60)], [version(3, 2, 61)], [version(4, 2, 62)]], delay="1 day", forget=timedelta(days=30))
    state = spark.read.format("statestore").option("stateVarName", "chain").load(str(tmp_path / "ck")).collect()
    assert {r.key.entity_id for r in state} == {2}


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_by_whole_batches_end_in_the_batch_result(spark, tmp_path, seed):
    """Null keys, repeats, ties and versions as late as can be; an untouched value says nothing again; a batch done again replaces its own."""
    rng = random.Random(seed)
    versions = [version(i, rng.choice([None, 1, 2]), rng.choice([0, 1, 2, 3000]), rng.choice(["revenue", "tax"])) for i in range(24)]
    rng.shuffle(versions)
    for n, rows in enumerate([versions[:9], versions[9:10] + versions[:2], versions[10:] + [version(99, 7, 0)], [version(99, 7, 0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        stream.append_versions(source, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    links = spark.read.parquet(str(tmp_path / "out"))
    want = ops.supersede(spark.createDataFrame([*versions, version(99, 7, 0)], SCHEMA), list(stream.VERSION_KEY))
    assert as_rows(stream.latest_links(links.drop("batch"))) == as_rows(want)
    assert links.where("batch = 3").count() == 0 and links.where("id = 99").count() == 1


def test_the_query_calls_no_worker_per_key(spark, sf, monkeypatch):
    """A call per key and batch took 165 s at sf0.1 where the windows over whole batches take 39."""
    from finfacts.plans import catalog

    monkeypatch.setattr(stream, "superseding", None)
    monkeypatch.setattr(stream, "Chain", None)
    assert catalog.QUERIES["stream_versions"](spark, sf).count() > 0
