"""Incremental runs: what is read, what is found, failures and scopes."""

import os

from pyspark.sql import functions as F

from finfacts.operators import runs

SCHEMA = "entity_id long, period_end string, fiscal_year int, value long"


def negative(df):
    latest = df.groupBy("entity_id", "period_end").agg(F.max_by("value", "batch").alias("value"))
    return latest.where("value < 0").select("entity_id", "period_end", F.concat_ws(":", F.lit("neg"), "entity_id", F.coalesce("period_end", F.lit("-"))).alias("fingerprint"), F.lit("warning").alias("severity"), F.lit("x").alias("summary"))


def yearly(df):
    years = df.groupBy("entity_id", "fiscal_year").agg(F.count("*").alias("n"))
    return years.where("n > 2").select("entity_id", "fiscal_year", F.concat_ws(":", F.lit("many"), "entity_id", "fiscal_year").alias("fingerprint"), F.lit("info").alias("severity"), F.lit("x").alias("summary"))


def made(spark, tmp_path, checks=None):
    store = runs.Store(spark, str(tmp_path / "store"))
    return store, runs.Runner(store, str(tmp_path / "runs"), checks or [runs.Check("negative", negative), runs.Check("yearly", yearly, ("entity_id", "fiscal_year"), "periods")])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def found(runner):
    return sorted(r.fingerprint for r in runner.findings().collect())


def test_a_run_without_changes_reads_no_facts(spark, tmp_path):
    store, runner = made(spark, tmp_path)
    assert runner.run().checks == [] and found(runner) == []
    store.land(rows(spark, (1, "q1", 2024, -5), (1, "q2", 2024, 5), (2, "q1", 2024, 1), (3, None, None, -1)), 0)
    first = runner.run()
    assert found(runner) == ["neg:1:q1", "neg:3:-"] and (first.total("new"), first.total("units")) == (2, 4 + 3)
    os.rename(tmp_path / "store" / "facts", tmp_path / "store" / "away")  # a read of any fact would fail now
    assert runner.run().checks == [] and found(runner) == ["neg:1:q1", "neg:3:-"]
    os.rename(tmp_path / "store" / "away", tmp_path / "store" / "facts")


def test_only_changed_units_are_looked_at_again(spark, tmp_path):
    store, runner = made(spark, tmp_path)
    store.land(rows(spark, (1, "q1", 2024, -5), (1, "q2", 2024, -5), (2, "q1", 2024, -1), (2, "q2", 2024, 1)), 0)
    runner.run()
    store.land(rows(spark, (1, "q1", 2024, 7), (2, "q3", 2024, 1)), 1)
    second = {c["check"]: c for c in runner.run().checks}
    assert (second["negative"]["units"], second["negative"]["resolved"], second["negative"]["new"], second["negative"]["unchanged"]) == (2, 1, 0, 0)
    assert (second["yearly"]["units"], second["yearly"]["new"]) == (2, 2)  # the year's earlier rows are read with the new ones
    assert found(runner) == ["many:1:2024", "many:2:2024", "neg:1:q2", "neg:2:q1"]
    store.land(rows(spark, (1, "q1", 2024, 7)), 1)  # landed again: nothing is new
    assert runner.run().checks == []


def test_scopes_have_their_own_watermarks(spark, tmp_path):
    store, runner = made(spark, tmp_path)
    store.land(rows(spark, (1, "q1", 2024, -1), (2, "q1", 2024, -1), (3, "q1", 2024, -1)), 0)
    only = runner.run(runs.Scope(entities=frozenset([1]), checks=frozenset(["negative"])))
    assert [c["check"] for c in only.checks] == ["negative"] and found(runner) == ["neg:1:q1"]
    assert runner.run(runs.Scope(entities=frozenset([1]), verticals=frozenset(["facts"]))).checks == []
    rest = {c["check"]: c for c in runner.run().checks}
    assert rest["negative"]["units"] == 2 and rest["yearly"]["units"] == 3 and found(runner) == ["neg:1:q1", "neg:2:q1", "neg:3:q1"]
    assert runner.run().checks == []
    store.land(rows(spark, (1, "q1", 2024, 4), (2, "q1", 2024, 4)), 1)
    assert runner.run(runs.Scope(entities=frozenset([2]))).total("resolved") == 1 and found(runner) == ["neg:1:q1", "neg:3:q1"]
    assert runner.run(runs.Scope(entities=frozenset([1, 2]))).total("resolved") == 1 and found(runner) == ["neg:3:q1"]


def test_a_failed_check_stays_due_and_the_others_count(spark, tmp_path):
    broken = {"on": True}

    def fragile(df):
        if broken["on"]:
            return df.select(F.raise_error(F.lit("no luck")).alias("fingerprint"), "entity_id", "period_end", F.lit("x").alias("severity"), F.lit("x").alias("summary"))
        return negative(df)

    store, runner = made(spark, tmp_path, [runs.Check("fragile", fragile), runs.Check("negative", negative)])
    store.land(rows(spark, (1, "q1", 2024, -1)), 0)
    first = runner.run()
    assert set(first.failed) == {"fragile"} and "no luck" in first.failed["fragile"] and found(runner) == ["neg:1:q1"]
    broken["on"] = False
    again = runner.run()
    assert [(c["check"], c["units"], c["new"]) for c in again.checks] == [("fragile", 1, 1)] and again.failed == {}
    assert found(runner) == ["neg:1:q1", "neg:1:q1"]
    assert [(c["run"], c["check"], c["status"]) for c in sorted(runner.commits(), key=lambda c: (c["run"], c["check"]))] == [(0, "fragile", "failed"), (0, "negative", "succeeded"), (1, "fragile", "succeeded")]


def test_a_run_that_died_leaves_nothing_that_counts(spark, tmp_path, monkeypatch):
    store, runner = made(spark, tmp_path, [runs.Check("negative", negative)])
    store.land(rows(spark, (1, "q1", 2024, -1)), 0)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(runs, "append_log", dies)
        try:
            runner.run()
        except KeyboardInterrupt:
            pass
    assert (tmp_path / "runs" / "findings" / "run=0").exists() and found(runner) == []
    assert runner.run().total("new") == 1 and found(runner) == ["neg:1:q1"]
