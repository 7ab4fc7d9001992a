"""Vendor payloads, landing, streaming."""

import datetime
import decimal
import json

import pytest
from pyspark.sql import functions as F

from finfacts import schemas, testkit
from finfacts.operators import facts, verify
from finfacts.sources import landing, vendor
from finfacts.streaming import facts as stream


def load(spark, path, rows, statement="income_statement"):
    (path / "x.json").write_text(json.dumps(rows))
    entities = spark.createDataFrame([(7, "ACME", "12-31")], "entity_id long, ticker string, fiscal_year_end_md string")
    return vendor.statement_facts(vendor.read_statement(spark, str(path), statement), entities, statement, "fmp-1")


def row(**over):
    return {"symbol": "ACME", "date": "2024-03-31", "period": "Q1", "fiscalYear": "2024", "acceptedDate": "2024-05-01 12:00:00", "revenue": 100, "costOfRevenue": 40, "grossProfit": 60, "netIncome": 9, "netIncomeFromContinuingOperations": 10, "netIncomeFromDiscontinuedOperations": 0, "eps": 1.5} | over


def test_income_statement(spark, tmp_path):
    out = {r["concept"]: r for r in load(spark, tmp_path, [row()]).collect()}
    assert float(out["net_income"]["value"]) == 10 and float(out["minority_interest"]["value"]) == 1 and "tax" not in out
    assert out["revenue"]["fiscal_period_label"] == "FY2024 Q1" and out["eps_basic"]["unit"] == "USD/share" and not out["revenue"]["fiscal_year_mismatch"]
    assert str(out["revenue"]["published_at"]) == "2024-05-01 12:00:00"


def test_missing_split_uses_the_parents_income(spark, tmp_path):
    out = {r["concept"]: float(r["value"]) for r in load(spark, tmp_path, [row(netIncomeFromContinuingOperations=0, fiscalYear="2023")]).collect()}
    assert out["net_income"] == 9 and "minority_interest" not in out


def test_sums_keep_zero_and_skip_all_null(spark, tmp_path):
    rows = [{"symbol": "ACME", "date": "2024-03-31", "period": "Q1", "fiscalYear": "2024", "accountPayables": 5, "otherPayables": None, "inventory": 0}]
    out = {r["concept"]: float(r["value"]) for r in load(spark, tmp_path, rows, "balance_sheet").collect()}
    assert out == {"accounts_payable": 5, "inventory": 0}


def test_ties(spark):
    wide = spark.createDataFrame([(1, 100.0, 40.0, 60.0, None), (2, 100.0, 40.0, 75.0, None)], "entity_id int, revenue double, cogs double, gross_profit double, total_opex double")
    wide = wide.select("entity_id", *[(F.col(c) * 1_000_000).cast("decimal(28,4)").alias(c) for c in ("revenue", "cogs", "gross_profit")])
    out = verify.broken_ties(wide, verify.IS_TIES[:1], ["entity_id"]).collect()
    assert [(r["entity_id"], r["severity"]) for r in out] == [(2, "investigate")]
    assert len(verify.IS_TIES) == 5 and len(verify.CF_TIES) == 5


def test_segments(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"symbol": "ACME", "date": "2024-12-31", "period": "FY", "fiscalYear": "2024", "data": {"Data Center": 5, "U.S. & Canada": 7}}]))
    out = facts.explode_segments(vendor.read_segments(spark, str(tmp_path)), "data", ["symbol"])
    assert {(r["dimension_key"], float(r["value"])) for r in out.collect()} == {("data_center", 5), ("u_s_canada", 7)}


def test_landing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = landing.with_hashes(spark.createDataFrame([("v", "e", "{}", "a\r\nb  \n"), ("v", "e", "{}", "a\nb\n")], "vendor string, endpoint string, params string, body string"))
    assert rows.select("canonical_hash").distinct().count() == 1 and rows.select("raw_hash").distinct().count() == 2
    landing.land(rows, None, path)
    landing.land(rows, spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 1


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "est")
    landing.replace_partitions(spark.createDataFrame([(1, "q", 1), (2, "q", 2)], "s int, k string, v int"), path, ["s", "k"])
    landing.replace_partitions(spark.createDataFrame([(2, "q", 9)], "s int, k string, v int"), path, ["s", "k"])
    assert sorted((r["s"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9)]


def test_trace_and_hash(spark):
    trace = landing.Trace()
    assert len(trace.run(spark.range(5), "five", {"b": 1, "a": 2}, ids="id")) == 5 and trace.entries[0]["ids"] == [0, 1, 2, 3, 4]
    assert landing.fingerprint_of({"a": 2, "b": 1}) == trace.entries[0]["params"]


def test_trace_counts_all_rows(spark):
    trace = landing.Trace()
    assert len(trace.run(spark.range(1_001), "many", most=1_000)) == 1_000 and trace.entries[0]["rows"] == 1_001
    trace.record("answer", {"q": 1}, 0.0, 3, [1, 2])
    assert trace.entries[1]["rows"] == 3 and trace.entries[1]["ids"] == [1, 2]


def test_canonical_json():
    a = {"b": decimal.Decimal("1.50"), "a": datetime.date(2024, 1, 2), "c": {3, 1, 2}}
    assert landing.canonical_json(a) == '{"a":"2024-01-02","b":"1.50","c":[1,2,3]}'
    assert landing.cache_path("/x/", "v", "a/b", "T.json") == "/x/vendor=v/endpoint=a-b/T.json"
    with pytest.raises(ValueError):
        landing.cache_path("/x", "v", "e", "..")


def test_body_or_bytes(spark):
    rows = spark.createDataFrame([("{}", "a", None), ("{}", None, bytearray(b"a"))], "params string, body string, data binary")
    assert landing.with_hashes(rows, data="data").select("raw_hash").distinct().count() == 1
    with pytest.raises(Exception, match="not both"):
        landing.with_hashes(rows.withColumn("data", F.lit("x").cast("binary")), data="data").collect()


def test_artifacts_are_superseded_by_new_versions(spark):
    none = F.lit(None).cast("timestamp")
    first = spark.createDataFrame([("10-K", "d1", "text\r\n"), ("10-K", "d2", "other")], "artifact_type string, source_document_id string, body string")
    stored = landing.with_hashes(first, "body", "source_document_id").drop("params_hash").withColumn("superseded_at", none)
    again = spark.createDataFrame([("10-K", "d1", "text\n"), ("10-K", "d2", "changed")], first.schema)
    fresh, old = landing.new_artifacts(again, stored, F.lit("2024-01-01").cast("timestamp"))
    assert [r["source_document_id"] for r in fresh.collect()] == ["d2"]
    assert {r["source_document_id"]: r["superseded_at"] is None for r in old.collect()} == {"d1": True, "d2": False}


def test_csv_has_check_columns(spark, tmp_path):
    landing.export_csv(spark.createDataFrame([(100.0, 40.0, 61.0)], "revenue double, cogs double, gross_profit double"), str(tmp_path / "c"), {"gp": ("gross_profit", {"revenue": 1, "cogs": -1})})
    assert float(spark.read.option("header", True).csv(str(tmp_path / "c")).first()["check_gp"]) == 1


def test_feeds(spark, tmp_path):
    def read(feed, *rows):
        (tmp_path / feed).mkdir()
        (tmp_path / feed / "x.json").write_text(json.dumps(rows))
        return [r.asDict() for r in vendor.read_feed(spark, str(tmp_path / feed), feed).collect()]

    (e,) = read("estimates", {"symbol": "acme", "date": "2025-03-31", "revenueLow": 1, "revenueAvg": 2, "revenueHigh": 3, "epsAvg": 0.5, "numAnalystsEps": 4}, {"date": "2025-03-31"})
    assert (e["ticker"], float(e["revenue_avg"]), float(e["eps_avg"]), e["analysts_eps"], e["ebit_avg"]) == ("ACME", 2, 0.5, 4, None)
    (t,) = read("transcripts", {"symbol": "ACME", "year": 2024, "period": "Q3", "date": "2024-11-01", "content": "A: b"}, {"symbol": "ACME", "year": 2024, "period": "Q2", "content": " "})
    assert (t["fiscal_year"], t["fiscal_quarter"], t["content"]) == (2024, 3, "A: b")
    (n,) = read("employees", {"symbol": "ACME", "formType": "10-K", "periodOfReport": "2024-12-31", "employeeCount": 12, "filingDate": "2025-02-01"})
    assert n["employee_count"] == 12 and str(n["published_at"]) == "2025-02-01 00:00:00"
    raw, adjusted = read("prices", {"symbol": "A", "date": "2024-01-02", "close": 10.5, "volume": 7}), read("adjusted_prices", {"symbol": "A", "date": "2024-01-02", "adjClose": 9})
    assert float(raw[0]["close"]) == 10.5 and float(adjusted[0]["adj_close"]) == 9
    assert len(read("grades", {"symbol": "A", "date": "2024-01-02", "newGrade": "Buy"})) == len(read("price_targets", {"symbol": "A", "targetHigh": 3})) == len(read("earnings", {"symbol": "A", "epsActual": 3})) == len(read("target_news", {"symbol": "A", "priceTarget": 3})) == len(read("market_caps", {"symbol": "A", "marketCap": 3})) == 1


def test_statements_are_loaded_once_and_superseded(spark, tmp_path):
    now, entities = F.lit("2024-06-01").cast("timestamp"), spark.createDataFrame([(7, "ACME", "12-31")], "entity_id long, ticker string, fiscal_year_end_md string")
    facts_of = lambda rows: vendor.statement_facts(rows, entities, "income_statement", "fmp-1").drop("fiscal_year_mismatch")
    read = lambda name, *rows: ((tmp_path / name).mkdir(), (tmp_path / name / "x.json").write_text(json.dumps(rows)), vendor.read_statement(spark, str(tmp_path / name), "income_statement"))[2]
    empty = facts_of(read("a", row())).limit(0).select("*", F.lit(0).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(0).cast("long").alias("supersedes_fact_id"))
    load_ = lambda rows, existing: vendor.load_statement(rows, entities, "income_statement", "fmp-1", verify.IS_TIES[:1], existing, now, absolute=0.5)
    one, flags = load_(read("b", row()), empty)
    assert flags.count() == 0 and one.count() == facts_of(read("c", row())).count()
    two, flags = load_(read("d", row(grossProfit=70)), one)
    assert [(r["flag_type"], r["detail"]) for r in flags.collect()] == [("tie", "gross_profit")]
    changed = two.where("concept = 'gross_profit'").orderBy("superseded_at").collect()
    assert two.count() == one.count() + 1 and {r["superseded_at"] is None for r in changed} == {True, False}
    assert next(r for r in changed if r["superseded_at"] is None)["supersedes_fact_id"] == next(r for r in changed if r["superseded_at"] is not None)["id"]
    three, flags = load_(read("e", row(fiscalYear="2023", revenue=1)), one)
    assert three.count() == one.count() and [r["flag_type"] for r in flags.collect()] == ["fiscal_year_mismatch"]


def test_streamed_facts(spark, sf, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = testkit.facts(spark, sf).where("concept = 'revenue'").limit(40).withColumns({"supersedes_fact_id": F.lit(None).cast("long"), "supersession_reason": F.lit(None).cast("string")})
    bad = rows.limit(1).withColumn("fiscal_period_label", F.lit("nonsense"))
    rows.unionByName(rows.limit(10)).unionByName(bad).select(*schemas.FACTS.fieldNames()).coalesce(1).write.json(source)
    stream.append(stream.accepted(stream.read_facts(spark, source)), sink, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(sink).count() == rows.select(*stream.IDENTITY).distinct().count()
    told = stream.rejected(spark.read.schema(schemas.FACTS).json(source)).collect()
    assert [r["broken"] for r in told] == [["fiscal_label"]]
