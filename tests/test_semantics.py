"""Formulas, guards, periods, findings, documents: by hand-computed numbers."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from finfacts import schemas
from finfacts.functions import columns as fn
from finfacts.operators import asof, facts, metrics, quality, text, vectors, verify, windows
from finfacts.plans import grammar, screener
from finfacts.sources import vendor

M = 1_000_000
ENDS = [dt.date(y, m, d) for y in (2021, 2022) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]


def company(spark, **over):
    """Eight quarters of the formula company."""
    rows = []
    for i, end in enumerate(ENDS):
        v = {c: None for c in schemas.CONCEPTS}
        oi, interest = 20 + 2 * i, 2
        v |= {"revenue": 100 + 10 * i, "cogs": 40 + 4 * i, "gross_profit": 60 + 6 * i, "rd": 8 + i, "operating_income": oi, "interest_expense": interest, "ebt_incl_unusual": oi - 2, "tax": 0.25 * (oi - 2), "net_income": 0.75 * (oi - 2), "cfo": 15 + i, "capital_expenditures": -[3, 3, 4, 4, 5, 5, 6, 6][i], "dna_cf": 3, "sbc": 2, "cash_paid_for_interest": 2, "acquisitions": -1, "total_assets": 200 + 10 * i, "total_equity": 100 + 5 * i, "current_portion_lt_debt": 5, "long_term_debt": 30, "current_portion_leases_operating": 2, "long_term_leases_operating": 8, "cash_and_equivalents": 20, "short_term_investments": 10, "accounts_receivable": 10 + i, "inventory": 20 + i, "accounts_payable": 15 + i}
        v = {k: None if x is None else x * M for k, x in v.items()} | {"shares_diluted_weighted_avg": 50 + i}
        v |= {k: (f(i) if callable(f) else f) for k, f in over.items()}
        rows.append((1, end, end.year, *[None if v[c] is None else f"{v[c]:.4f}" for c in schemas.CONCEPTS], None if v["rd"] is None else f"{v['rd']:.4f}"))
    df = spark.createDataFrame(rows, "entity_id long, period_end date, calendar_year int, " + ", ".join(f"{c} string" for c in schemas.CONCEPTS) + ", rd_any_version string")
    return df.select("entity_id", "period_end", "calendar_year", *[F.col(c).cast("decimal(28,4)").alias(c) for c in (*schemas.CONCEPTS, "rd_any_version")])


def last(df, **exprs):
    return df.orderBy(F.desc("period_end")).select(*[e.alias(k) for k, e in exprs.items()]).first().asDict()


def test_formula_company(spark):
    frame = metrics.metric_frame(company(spark))
    q = last(frame, **metrics.quarter_metrics())
    assert q["gross_margin"] == pytest.approx(102 / 170)
    assert q["revenue_qoq_annualized"] == pytest.approx((170 / 160) ** 4 - 1)
    assert (q["dso"], q["dio"], q["dpo"]) == pytest.approx((17 / 620 * 365, 27 / 248 * 365, 22 / 248 * 365))
    assert q["net_debt"] == 15 * M and q["net_debt_to_ebitda"] == pytest.approx(15 / 136)
    assert last(frame, x=F.col("revenue_ttm"))["x"] == 620 * M
    y = last(frame, **metrics.yoy_metrics())
    assert y["revenue_yoy_ttm"] == pytest.approx((620 - 460) / 460) and y["diluted_share_count_growth"] == pytest.approx((57 - 53) / 53)
    cy = metrics.calendar_year(company(spark)).orderBy(F.desc("calendar_year")).first()
    assert cy["quarters_in_year"] == 4 and cy["revenue_cy"] == 620 * M


def test_rd_schedule(spark):
    row = last(metrics.metric_frame(company(spark)), a=F.col("rd_asset_q"), n=F.col("rd_coverage"), m=F.col("rd_amortization_q"))
    assert row["a"] == pytest.approx(sum((15 - j) * M * (20 - j) / 20 for j in range(8))) and row["n"] == 8 and row["m"] == pytest.approx(sum(range(8, 16)) * M / 20)


@pytest.mark.parametrize(("over", "column", "want"), [({"ebt_incl_unusual": -2 * M}, "tax_rate_ttm", 0.15), ({"ebt_incl_unusual": None}, "tax_rate_ttm", None), ({"total_equity": -900 * M}, "roic", None), ({"tax": None}, "adjusted_nopat_ttm", None)])
def test_guards(spark, over, column, want):
    assert last(metrics.metric_frame(company(spark, **over)), x=F.col(column))["x"] == want


def test_zero_revenue_has_no_margin(spark):
    assert last(metrics.metric_frame(company(spark, revenue=0)), **metrics.quarter_metrics())["gross_margin"] is None


def test_roiic_needs_a_change_of_capital(spark):
    frame = metrics.metric_frame(company(spark), least_roiic_change=1e15)
    assert frame.where("roiic IS NOT NULL").count() == 0


def test_one_shuffle_for_all_windows(spark):
    plan = metrics.metric_frame(company(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_source_priority_and_dimensions(spark):
    rows = [(1, "revenue", "100", "xbrl-amendment-1", None), (2, "revenue", "999", "fmp-9", None), (3, "revenue", "5", "human-verified-1", "product")]
    df = spark.createDataFrame(rows, "id long, concept string, value string, extraction_version string, dimension_type string").withColumn("value", F.col("value").cast("decimal(28,4)")).withColumn("published_at", F.current_timestamp()).withColumn("entity_id", F.lit(1))
    assert facts.pivot_wide(df, ["revenue"], ["entity_id"]).first()["revenue"] == 100
    assert facts.pick_source(df.where("dimension_type IS NULL"), ["entity_id", "concept"]).first()["id"] == 1


@pytest.mark.parametrize(("end", "md", "kind", "want"), [("2024-12-31", "12-31", "quarter", "FY2024 Q4"), ("2024-08-01", "07-31", "annual", "FY2024"), ("2024-06-30", "06-30", "quarter", "FY2024 Q4"), ("2024-09-30", "06-30", "quarter", "FY2025 Q1"), ("2024-05-01", "01-31", "quarter", "FY2025 Q1")])
def test_fiscal_period(spark, end, md, kind, want):
    _, _, label = fn.fiscal_period(F.lit(end).cast("date"), F.lit(md), F.lit(kind))
    assert spark.range(1).select(label).first()[0] == want


def test_asof_is_brute_force(spark):
    import random

    rng = random.Random(3)
    left = [(rng.randrange(4), rng.randrange(100), i) for i in range(200)]
    right = [(rng.randrange(4), rng.randrange(100), j) for j in range(60)]
    a, b = spark.createDataFrame(left, "e int, d int, i int"), spark.createDataFrame(right, "e int, k int, tie int")
    got = {r["i"]: r["tie"] for r in asof.asof_join(a, b, "e", "d", "k", "tie").collect()}
    for e, d, i in left:
        best = max(((k, t) for e2, k, t in right if e2 == e and k <= d), default=(None, None))
        assert got[i] == best[1]
    held = {(r["e"], r["k"]): r["tie"] for r in asof.validity(b, "e", "k", "tie").collect()}
    assert held == {(e, k): max(t for e2, k2, t in right if (e2, k2) == (e, k)) for e, k, _ in right}


@pytest.mark.parametrize("bad", ["", "FY24", "2024-Q5", "last_0q", "last_99q", "forward_4x", "asof:2024-13-01", "latest "[:-1] + "!"])
def test_bad_periods(bad):
    with pytest.raises(grammar.PeriodError):
        grammar.parse_period(bad)


def test_periods():
    assert grammar.parse_period("last_8q_sum") == grammar.Period("window", n=8, unit="q", how="sum")
    assert grammar.parse_period("asof:2024-02-29").day == dt.date(2024, 2, 29)
    assert grammar.supports(grammar.parse_period("last_3q"), "delta") and not grammar.supports(grammar.parse_period("last_2q"), "delta")
    for name, period in (("gross_margin", "next_q"), ("pe_ttm", "FY2024"), ("revenue_avg", "latest"), ("gross_margin_q", "last_3y"), ("revenue", "2024-Q1")):
        with pytest.raises(grammar.PeriodError):
            grammar.check(grammar.find_metric(name), grammar.parse_period(period), "level")


@given(st.integers(1, 40), st.sampled_from("qy"), st.sampled_from(["", "_avg", "_sum"]))
def test_window_grammar(n, unit, how):
    p = grammar.parse_period(f"last_{n}{unit}{how}")
    assert (p.n, p.unit, p.how) == (n, unit, how[1:] or "avg")


def test_screen_limits_and_errors(spark):
    frame = metrics.metric_frame(company(spark)).withColumn("fiscal_year", F.year("period_end"))
    out = screener.screen({"financials": frame}, "gross_margin_q", "latest", limit=10_000).collect()
    assert [(r["rank"], r["entity_id"]) for r in out] == [(1, 1)] and out[0]["citation"] == "M:financials:1:2022-12-31"
    with pytest.raises(grammar.PeriodError):
        screener.screen({"financials": frame}, "gross_margin_q", sort="up")


def test_fingerprint_ignores_order_and_nulls(spark):
    a = fn.fingerprint("c", {"x": F.lit(1), "y": F.lit("é")}, {"n": F.lit(None)})
    b = fn.fingerprint("c", {"y": F.lit("é"), "x": F.lit(1)}, {})
    row = spark.range(1).select(a.alias("a"), b.alias("b"), fn.fingerprint("d", {"x": F.lit(1)}).alias("c")).first()
    assert row["a"] == row["b"] != row["c"]


def test_finding_life(spark):
    now, later = F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")
    none = spark.createDataFrame([], schemas.FINDINGS)
    found = spark.createDataFrame([("f1", "c", "warning", 1, "s"), ("f1", "c", "warning", 1, "s"), ("f2", "c", "warning", 2, "s")], "fingerprint string, source_check string, severity string, entity_id long, summary string")
    first = quality.merge_findings(none, found, now).drop("event")
    assert {(r["fingerprint"], r["status"]) for r in first.collect()} == {("f1", "open"), ("f2", "open")}
    second = quality.merge_findings(first, found.where("fingerprint = 'f1'"), later)
    assert {(r["fingerprint"], r["event"]) for r in second.collect()} == {("f1", "re_observed"), ("f2", "auto_resolved")}
    other = quality.merge_findings(first, found.limit(0), later, checks_run=["another"])
    assert {r["event"] for r in other.collect()} == {"kept"}
    closed = quality.transition(first, ["f1"], "suppress", now, F.lit("2030-01-01").cast("timestamp"))
    again = quality.merge_findings(closed, found, later)
    assert {r["fingerprint"]: r["event"] for r in again.collect()} == {"f1": "suppressed", "f2": "re_observed"}
    with pytest.raises(ValueError):
        quality.transition(first, ["f1"], "suppress", now)


def test_sweep_isolates_failures(spark):
    sweep = quality.Sweep()
    good = spark.createDataFrame([("f", "c", "warning", 1, "s")], "fingerprint string, source_check string, severity string, entity_id long, summary string")
    out = sweep.run({"bad": lambda: spark.table("no_such_table"), "good": lambda: good})
    assert out.count() == 1 and list(sweep.failed) == ["bad"] and sweep.ran == ["good"]
    assert set(quality.CHECKS) >= {"zero_row_runs", "prices_gap_detection", "xbrl_audit_unresolved"} and len(quality.CHECKS) >= 19


def test_companyfacts(spark):
    import json

    unit = [{"start": "2023-01-01", "end": "2023-12-31", "val": 100, "filed": "2024-02-01", "accn": "a", "form": "10-K"}, {"start": "2023-01-01", "end": "2023-12-31", "val": 110, "filed": "2024-05-01", "accn": "b", "form": "10-K/A"}, {"start": "2023-01-01", "end": "2023-09-30", "val": 70, "filed": "2023-11-01", "accn": "c", "form": "10-Q"}, {"start": "2023-07-01", "end": "2023-09-30", "val": 25, "filed": "2023-11-01", "accn": "c", "form": "10-Q"}, {"start": "2023-07-01", "end": "2023-08-15", "val": 9, "filed": "2023-11-01", "accn": "c", "form": "10-Q"}]
    raw = spark.createDataFrame([(1, json.dumps({"facts": {"us-gaap": {"Revenues": {"units": {"USD": unit}}}}}))], "entity_id long, body string")
    entries = verify.explode_companyfacts(raw, "body", ["Revenues", "Missing"]).withColumn("concept", F.lit("revenue"))
    out = {(r["kind"], str(r["end"])): (float(r["val"]), r["derived"]) for r in verify.with_fourth_quarters(verify.latest_filed(entries)).collect()}
    assert out == {("annual", "2023-12-31"): (110, False), ("nine_months", "2023-09-30"): (70, False), ("quarter", "2023-09-30"): (25, False), ("quarter", "2023-12-31"): (40, True)}


def test_triage_by_hand(spark):
    rows = [
        ("total_equity", "StockholdersEquity", False, 9e9, 1e9), ("total_equity", "Other", False, 4e6, 1e9), ("total_equity", "Other", False, 6e6, 1e9), ("total_liabilities", "Liabilities", True, 4e7, 1e9), ("ebt_incl_unusual", "x", False, 2.4e8, 1e9),
        ("cash_and_equivalents", "x", False, 6e7, 1e9), ("total_assets", "x", False, 4e6, 1e9), ("revenue", "x", True, 9e8, 1e9), ("revenue", "x", False, 1e7, 1e9), ("revenue", "x", False, 9e6, 1e9), ("cfo", "x", False, 2e7, 1e10), ("net_income", "x", False, 2e7, 0.0), ("rd", "x", False, 9e8, 1e9),
    ]
    want = ["DEFINITIONAL", "DEFINITIONAL", "AMBIGUOUS", "DEFINITIONAL", "DEFINITIONAL", "AMBIGUOUS", "DEFINITIONAL", "AMBIGUOUS", "CORRUPTION", "AMBIGUOUS", "AMBIGUOUS", "CORRUPTION", "AMBIGUOUS"]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, concept string, tag string, derived boolean, delta double, other double")
    assert [r["v"] for r in df.select("i", verify.triage().alias("v")).orderBy("i").collect()] == want
    told = [r["c"] for r in df.select("i", verify.bulk_category().alias("c")).orderBy("i").collect()]
    assert told[3] == told[7] == "audit_derivation_artifact" and told[0] == "definitional_difference" and told[8] == told[12] == "keep_open"


def test_cross_statement_by_hand(spark):
    m = 1_000_000
    rows = [(1, 1, 10, 10, 100, None, 100, None, None), (1, 2, 12, 10, 130, 5, 135, 100, 35), (1, 3, 10, 10, 130, None, 120, 135, -5), (1, 4, None, 10, None, None, 7, 130, 1)]
    df = spark.createDataFrame([(e, p, *[None if x is None else float(x * m) for x in v]) for e, p, *v in rows], "entity_id int, period_end int, net_income_start double, net_income double, cash_and_equivalents double, restricted_cash double, cash_end_of_period double, cash_begin_of_period double, net_change_in_cash double")
    out = {(r["period_end"], r["tie"]) for r in verify.cross_statement(df, ["entity_id", "period_end"], windows.ordered()).collect()}
    assert out == {(2, "net_income"), (3, "cash_end")}


def test_amendment_steps(spark):
    ours = spark.createDataFrame([(1, "revenue", 2024, "2024-03-31", 100.0), (1, "revenue", 2024, "2024-06-30", 100.0), (2, "revenue", 2024, "2024-03-31", 9.0)], "entity_id int, concept string, fiscal_year int, period_end string, value double")
    filed = spark.createDataFrame([(1, "revenue", "2024-03-31", 102.0), (1, "revenue", "2024-06-30", 100.5), (2, "revenue", "2024-03-31", 50.0)], "entity_id int, concept string, end string, val double")
    failing = spark.createDataFrame([(1, 2024)], "entity_id int, fiscal_year int")
    assert [(r["period_end"], r["concepts"]) for r in verify.affected_periods(failing, ours, filed).collect()] == [("2024-03-31", ["revenue"])]
    given = spark.createDataFrame([(1, "revenue", 100.0), (1, "gross_profit", 60.0), (2, "revenue", 5.0), (3, "revenue", 9.0), (3, "gross_profit", 4.0), (3, "cogs", 1.0)], "k int, concept string, new double")
    assert {(r["k"], r["concept"], float(r["new"])) for r in verify.derived_candidates(given, ["k"]).where("derived").collect()} == {(1, "cogs", 40)}


def test_preferred_tags_and_quarters_of_filings(spark):
    import json

    def unit(val, start, end, filed="2024-02-01"):
        return {"start": start, "end": end, "val": val, "filed": filed, "accn": "a", "form": "10-Q"} if start else {"end": end, "val": val, "filed": filed, "accn": "a", "form": "10-Q"}

    tags = {"ProfitLoss": [unit(5, "2024-01-01", "2024-03-31")], "NetIncomeLoss": [unit(4, "2024-01-01", "2024-03-31", "2025-01-01"), unit(6, "2024-04-01", "2024-06-30")], "Assets": [unit(9, None, "2024-03-31")]}
    raw = spark.createDataFrame([(1, json.dumps({"facts": {"us-gaap": {k: {"units": {"USD": v}} for k, v in tags.items()}}}))], "entity_id int, body string")
    filed = verify.filed_values(raw, "body", {c: vendor.XBRL_TAGS[c] for c in ("net_income", "net_income_attributable_to_parent", "total_assets")})
    assert {(r["concept"], str(r["end"]), float(r["val"]), r["tag"]) for r in filed.collect()} == {("net_income", "2024-03-31", 5, "ProfitLoss"), ("net_income", "2024-06-30", 6, "NetIncomeLoss"), ("net_income_attributable_to_parent", "2024-03-31", 4, "NetIncomeLoss"), ("net_income_attributable_to_parent", "2024-06-30", 6, "NetIncomeLoss"), ("total_assets", "2024-03-31", 9, "Assets")}
    ours = spark.createDataFrame([(1, "2024-03-31", 2024, "net_income", 5.0), (1, "2024-06-30", 2024, "net_income", 9e6)], "entity_id int, period_end string, fiscal_year int, concept string, value double").withColumn("period_end", F.to_date("period_end"))
    assert [(str(r["period_end"]), r["derived"]) for r in verify.anchored(ours, filed).collect()] == [("2024-06-30", False)]


def test_promotions_are_verified_and_flagged_once(spark):
    null, now = F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame([(1, 7, "p", "revenue", 100.0), (2, 7, "p", "cogs", 40.0), (3, 7, "p", "gross_profit", 60.0)], "id long, entity_id int, period_end string, concept string, v double")
    df = df.select("id", "entity_id", "period_end", "concept", F.col("v").cast("decimal(28,4)").alias("value"), F.lit("fmp-1").alias("extraction_version"), now.alias("published_at"), null.alias("superseded_at"), F.lit(None).cast("long").alias("supersedes_fact_id"), F.lit(None).cast("string").alias("supersession_reason"))
    accepted = spark.createDataFrame([(7, "p", "revenue", 120.0)], "entity_id int, period_end string, concept string, other double")
    none = spark.createDataFrame([], "entity_id int, period_end string, flag_type string, detail string, resolved_at timestamp")
    run = lambda flags: verify.promote_verified(df, accepted, ["entity_id", "period_end", "concept"], ["entity_id", "period_end"], verify.IS_TIES[:1], flags, now, absolute=0.5)[1]
    once = run(none)
    assert [(r["flag_type"], r["detail"]) for r in once.collect()] == [("tie_after_promotion", "gross_profit")] and run(once).count() == 1


def test_standard_coverage(spark):
    assert len(quality.STANDARD) == 11
    coverage = spark.createDataFrame([(1, "prices", 30, dt.date(2024, 1, 1)), (1, "transcript", 19, dt.date(2024, 1, 1))], "entity_id int, vertical string, periods int, latest date")
    out = {(r["vertical"], r["rule"]): r["actual"] for r in quality.expected_coverage(coverage, spark.createDataFrame([(1,)], "entity_id int"), F.lit("2024-01-07").cast("date")).collect()}
    assert out[("prices", "recency")] == 6 and ("prices", "present") not in out and out[("transcript", "min_periods")] == 19 and ("transcript", "recency") not in out and out[("employees", "recency")] is None and len(out) == 8  # eleven less the three that are met


def test_slugs_lose_marks(spark):
    row = spark.createDataFrame([("Île-de-France & Öst",)], "label string").select(facts.slug_of(F.col("label")).alias("s")).first()
    assert row["s"] == "ile_de_france_ost" and len(facts.MARKED) == len(facts.PLAIN)


def test_resolving_runs_agree_on_periods(spark):
    at = dt.datetime(2024, 1, 1, 12)
    found = spark.createDataFrame([(1, at, "T", "FY2024-Q2"), (2, at, "T", None)], "finding int, resolved_at timestamp, ticker string, fiscal_period_key string")
    run = lambda i, minutes, counts, scope=None, kind="ingest": (i, at - dt.timedelta(minutes=minutes), "succeeded", kind, "v", scope, counts)
    runs = spark.createDataFrame([run(1, 5, '{"fiscal_year": 2024, "fiscal_quarter": 2}'), run(2, 5, '{"fiscal_year": 2023}'), run(3, 61, "{}"), run(4, 60, "{}", ["T"]), run(5, 1, "{}", ["U"]), run(6, 1, "{}", None, "reconciliation")], "run int, ended_at timestamp, status string, kind string, vendor string, ticker_scope array<string>, counts string")
    out = {(r["finding"], r["run"], r["action_label"]) for r in quality.resolving_runs(found, runs).collect()}
    assert out == {(1, 1, "ingest v FY2024-Q2"), (1, 4, "ingest v"), (2, 1, "ingest v FY2024-Q2"), (2, 2, "ingest v FY2023"), (2, 4, "ingest v")}


def test_a_check_that_fails_when_it_runs_is_reported(spark, tmp_path):
    def keep(name, df):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = spark.createDataFrame([("f", "c", "warning", 1, "s")], "fingerprint string, source_check string, severity string, entity_id long, summary string")
    sweep = quality.Sweep(keep)
    out = sweep.run({"bad": lambda: good.withColumn("summary", F.raise_error(F.lit("late"))), "good": lambda: good})
    assert out.count() == 1 and list(sweep.failed) == ["bad"]


def test_registry_has_every_name():
    names = {"revenue", "gross_margin", "operating_margin", "net_margin", "fcf", "cfo", "net_income", "operating_income", "rd", "sbc_pct_revenue", "roic", "roiic", "revenue_growth_yoy", "gross_profit_growth_yoy", "incremental_gross_margin", "incremental_operating_margin", "accruals_ratio", "net_debt_to_ebitda", "interest_coverage_ttm", "reinvestment_rate"}
    names |= {f"{x}_{k}" for x in ("revenue", "eps", "ebitda", "ebit", "net_income") for k in ("avg", "growth")} | {"pe_ttm", "ps_ttm", "ev_ebitda_ttm", "fcf_yield_ttm", "market_cap", "ev"}
    assert names <= set(grammar.METRICS) and len(names) == 36


def test_every_metric_can_be_read(spark):
    wide = company(spark)
    frame = metrics.metric_frame(wide).withColumns({"fiscal_year": F.year("period_end"), "fiscal_quarter": F.quarter("period_end")})
    names = [m.name for m in grammar.METRICS.values() if m.vertical == "financials" and m.grain == "q"]
    out = {r["metric"]: r["value"] for r in screener.read_metrics({"financials": frame, "annual": frame}, 1, names, "latest").collect()}
    assert set(out) == set(names) and out["revenue_growth_yoy"] == pytest.approx((620 - 460) / 460) and out["gross_margin_q"] == pytest.approx(102 / 170)
    assert grammar.quarter_concepts(grammar.find_metric("gross_margin_q"), schemas.CONCEPTS) == ["gross_profit", "revenue"] and grammar.quarter_concepts(grammar.find_metric("roic"), schemas.CONCEPTS) is None


def test_valuation_screen_falls_back_to_days_with_a_value(spark):
    days = spark.createDataFrame([(1, "2024-01-01", 5.0), (1, "2024-01-02", None), (2, "2024-01-02", 3.0), (3, "2024-01-02", None)], "entity_id int, date string, market_cap double").withColumn("date", F.to_date("date"))
    out = screener.valuation_screen(days, days.limit(0), lambda d, known: d, "market_cap").collect()
    assert [(r["entity_id"], r["value"], str(r["date"]), r["citation"]) for r in out] == [(1, 5.0, "2024-01-01", "M:valuation:1:2024-01-01"), (2, 3.0, "2024-01-02", "M:valuation:2:2024-01-02")]


def test_priorities_are_ordered(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    rows = [("odd", t(2024), 9), ("fmp-1", None, 1), ("fmp-1", t(1969), 1), ("fmp-1", t(2023), -5), ("fmp-1", t(2023), 7), ("xbrl-amendment-1", t(2000), 3), ("human-verified-1", None, 4)]
    df = spark.createDataFrame(rows, "extraction_version string, published_at timestamp, id long").withColumn("n", F.monotonically_increasing_id())
    assert [r["id"] for r in df.orderBy(facts.priority()).collect()] == [x[2] for x in rows]


def test_promotion_keeps_lineage(spark):
    df = spark.createDataFrame([(1, 7, "revenue", "10", None)], "id long, entity_id long, concept string, value string, superseded_at timestamp").withColumns({"value": F.col("value").cast("decimal(28,4)"), "extraction_version": F.lit("fmp-1"), "published_at": F.lit("2020-01-01").cast("timestamp"), "supersedes_fact_id": F.lit(None).cast("long"), "supersession_reason": F.lit(None).cast("string")})
    out = verify.promote(df, spark.createDataFrame([(7, "revenue", 12.0)], "entity_id long, concept string, other double"), ["entity_id", "concept"], F.lit("2024-01-01").cast("timestamp")).collect()
    live = [r for r in out if r["superseded_at"] is None]
    assert len(out) == 2 and len(live) == 1 and live[0]["supersedes_fact_id"] == 1 and float(live[0]["value"]) == 12


def test_expectations(spark, sf):
    from finfacts import testkit

    told = schemas.violations(testkit.facts(spark, sf), schemas.fact_expectations()).collect()
    assert {r["violations"] for r in told} == {0} and len(told) == 6


# Documents


def test_normalize_html():
    page = "<html><head><title>x</title></head><body><script>var a='<p>';</script><p>Fees &amp; ﬁnes</p><div>12</div><!-- no --><p>Second  line</p></body></html>"
    assert text.normalize_html(page) == "Fees & fines\n\nSecond line"
    assert text.normalize_html(None) == "" and text.search_text("  A\n B ") == "a b"


def test_sections_skip_the_contents():
    body = "Item 1. Business ........ 3\nItem 7. MD&A ....... 20\n" + "Item 1. Business\n" + "We make things. " * 60 + "\nItem 1A. Risk Factors\n" + "It may fail. " * 60 + "\nItem 7. Management's Discussion\n" + "It grew. " * 80
    got = text.sections(body, "10-K")
    assert [s["key"] for s in got] == ["business", "risk_factors", "mdna"] and all(s["method"] == "deterministic" for s in got)
    assert body[got[0]["start"] : got[0]["end"]].count("We make things") == 60
    assert text.sections("nothing", "10-K")[0]["method"] == "unparsed_fallback" and text.sections(None, None)[0]["end"] == 0


@given(st.text(alphabet="ab .!?\nA", max_size=400), st.integers(1, 30))
def test_chunks_cover_and_end(body, target):
    got = text.chunks(body, target=target, most=target + 10)
    assert all(a["start"] < b["start"] for a, b in zip(got, got[1:]))
    covered = {i for c in got for i in range(c["start"], c["end"])}
    assert all(i in covered for i, ch in enumerate(body) if ch in "abA")


def test_parts_indexes_and_tails():
    long = "We sell and we count what we sold. " * 20
    body = "Part I\nItem 1. Financial Statements\n" + long + "\n12\nPart II\nItem 1. Legal Proceedings\n" + long + "\nItem 1A. Risk Factors\n" + long + "\nItem 2. Sales of Equity\n" + long
    got = text.sections(body, "10-Q")
    assert [s["key"] for s in got] == ["financial_statements", "risk_factors"] and body[got[0]["start"] : got[0]["end"]].endswith("sold. ".strip())
    index = "".join(f"Item {i} See page of the report\n" for i in ("1", "1A", "3", "5", "7", "8"))
    body = "Item 1. Business\n" + long + "\nItem 1A. Risk Factors\n" + long + "\n" + index
    assert [(s["key"], s["method"]) for s in text.sections(body, "10-K")][:2] == [("business", "deterministic"), ("risk_factors", "deterministic")]


def test_questions_quotes_and_units(spark):
    assert text.driver_intent("What drove PLTR revenue growth in FY2024 Q3?") == {"tickers": ["PLTR"], "fiscal_year": 2024, "fiscal_quarter": 3, "period_type": "quarter"}
    for bad in ("What drove PLTR revenue?", "PLTR margins in FY2024", "what drove revenue in fiscal 2024"):
        with pytest.raises(text.IntentError):
            text.driver_intent(bad)
    assert text.quoted_in('It said "Sales  rose" twice', "… sales rose …") and not text.quoted_in('It said "sales fell"', "sales rose")
    df = spark.createDataFrame([(1, "Operator: Good day to all.\nJane Doe: Thanks."), (2, "no speakers here at all"), (3, None)], "k int, t string")
    assert {(r["k"], r["ordinal"], r["speaker"]) for r in text.transcript_units(df, "k", "t").collect()} == {(1, 0, "Operator"), (1, 1, "Jane Doe"), (2, 0, None), (3, 0, None)}


def test_headlines(spark):
    from finfacts.operators import reads

    df = spark.createDataFrame([("The Apache license is here",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(reads.highlighted(F.col("t"), ["license", "apache"])).collect()] == ["The <b>Apache</b> <b>license</b> is here", None, None]


def test_speaker_turns():
    body = "Operator: Good day to all.\nJane Doe: Thanks. It went well.\n"
    assert [(t["speaker"], body[t["start"] : t["end"]].strip()) for t in text.speaker_turns(body)] == [("Operator", "Good day to all."), ("Jane Doe", "Thanks. It went well.")]
    assert text.speaker_turns("long preamble " * 50 + "\nA Man: hi") == [] and text.speaker_turns(None) == []


def test_search(spark):
    df = spark.createDataFrame([(1, "Margins rising, margins up"), (2, "margin fell"), (3, "rising costs of margin")], "k int, t string")
    index = text.token_index(df, "k", "t")
    assert [r["k"] for r in text.search(index, "k", "rising margins").collect()] == [1, 3]
    assert [r["k"] for r in text.search(index, "k", "margins -rising").collect()] == [2] and text.search(index, "k", "nothing").count() == 0


def test_numbers_supported():
    assert text.supported_numbers("grew to 1,020", "was 1000") and not text.supported_numbers("grew to 1,200", "was 1000")


def test_islands_and_ytd(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 9), (1, 3, "b", 20)], "e int, q int, s string, v int")
    assert [r["island"] for r in windows.islands(df, ["e"], "q", "s").orderBy("q").collect()] == [1, 1, 2]
    assert [r[0] for r in df.orderBy("q").select(windows.discrete_from_ytd("v", "e", "e", "q")).collect()] == [5, 4, 11]


def test_best_match_refuses_large_sets(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y")], "i int, v array<double>, l string")
    assert {(r["id"], r["match"]) for r in vectors.best_match(df, df, "i", "v", "l").collect()} == {(1, 1), (2, 2)}
    with pytest.raises(ValueError):
        vectors.best_match(df, df, "i", "v", "l", most_enrolled=1)
    assert vectors.best_match(df, df.limit(0), "i", "v", "l").count() == 0


def test_keyed_merges(spark):
    old, new = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    assert {tuple(r) for r in facts.insert_ignore(old, new, ["k"]).collect()} == {(1, "a"), (None, "b"), (2, "y")}
    assert facts.upsert_counts(old.where("k = 1"), new.where("k IS NOT NULL"), ["k"]).first().asDict() == {"inserted": 1, "updated": 1}


def test_best_match_of_any_size_is_brute_force(spark):
    rng = np.random.default_rng(5)
    known = rng.integers(-3, 4, (70, 4)).astype(float)
    known[40:] = known[:30]  # equal vectors: the smallest id
    asked = np.vstack([rng.integers(-3, 4, (60, 4)), np.zeros((1, 4))]).astype(float)
    table = lambda m, ids: spark.createDataFrame([(i, f"l{i}", v.tolist()) for i, v in zip(ids, m)], "i long, l string, v array<double>")
    numbers = [*range(60), 7]  # an id that occurs twice is asked twice
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    cosine = (unit(asked) @ unit(known).T).round(12)
    want = sorted((i, int(c.argmax()), f"l{c.argmax()}", round(float(c.max()), 6)) for i, c in zip(numbers, cosine) if c.max() >= 0.6)
    for block in (10_000, 70, 69, 9):  # the last two by blocks
        out = vectors.best_match(table(asked, numbers), table(known, range(70)), "i", "v", "l", 0.6, block=block).collect()
        assert sorted((r["id"], r["match"], r["label"], round(r["cosine"], 6)) for r in out) == want


def test_exploded_texts_leave_in_pieces():
    """A batch of texts that give many rows is never held as one frame; all rows come, in their order."""
    import pandas as pd

    from finfacts.operators import text

    batch = pd.DataFrame({"k": [1, 2, 3], "t": ["25000", "0", "7"]})
    frames = list(text.in_pieces(iter([batch, batch]), ["k"], ["t"], lambda t: [{"n": i} for i in range(int(t))], ["k", "n"]))
    assert max(map(len, frames)) <= text.PIECE
    assert [tuple(r) for f in frames for r in f.to_numpy()] == 2 * ([(1, i) for i in range(25000)] + [(3, i) for i in range(7)])


def test_companyfacts_are_parsed_once_for_all_tags(spark):
    """Unknown tags and units, missing and broken parts give nothing and cost the other tags nothing."""
    import json

    from finfacts.operators import verify

    one = lambda v, unit="USD": {"units": {unit: [{"end": "2024-03-31", "val": v, "accn": "a", "filed": "2024-05-01", "form": "10-Q"}]}}
    bodies = [(1, json.dumps({"facts": {"us-gaap": {"A": one(5), "B": one(7), "Other": one(1)}}})), (2, json.dumps({"facts": {"us-gaap": {"A": one(2, "EUR"), "B": {"units": 3}, "C": one(9)}}})), (3, None), (4, "{}"), (5, "no json")]
    out = verify.explode_companyfacts(spark.createDataFrame(bodies, "entity_id long, body string"), "body", ["A", "B", "C"])
    assert sorted((r.entity_id, r.tag, int(r.val)) for r in out.collect()) == [(1, "A", 5), (1, "B", 7), (2, "C", 9)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1 and "get_json_object" not in text
