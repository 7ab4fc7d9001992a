"""Claims of answers against brute force, and turns and roles of calls, by hand."""

import random

import pytest

from finfacts.operators import calls, grounding


def claims(text):
    return [(c["kind"], c["cite"], c["said"], c["value"]) for c in grounding.claims_of(text)]


def test_claims_of_one_answer():
    said = 'Revenue was $1,234.5 million [F:1, M:2], up 13.5% [M:3]. "We  grew fast" said the chief [T:a,S:b]. "Too"  and "never cited"'
    assert claims(said) == [
        ("citation", "F:1", "[F:1]", None), ("citation", "M:2", "[M:2]", None), ("money", "F:1", "$1,234.5 million", 1.2345e9), ("money", "M:2", "$1,234.5 million", 1.2345e9),
        ("citation", "M:3", "[M:3]", None), ("money", "M:3", "$1,234.5 million", 1.2345e9), ("percent", "M:3", "13.5%", 0.135),
        ("quote", "T:a", "We  grew fast", None), ("quote", "S:b", "We  grew fast", None), ("citation", "T:a", "[T:a]", None), ("citation", "S:b", "[S:b]", None),
    ]
    assert claims("$5 Beta, $2B [F:1]")[1:] == [("money", "F:1", "$2B", 2e9)] and claims("$5 Beta [F:1]")[1:] == [("money", "F:1", "$5", 5.0)]
    assert claims("$7 [F:1] and again $7 [F:1]") == [("citation", "F:1", "[F:1]", None), ("money", "F:1", "$7", 7.0), ("citation", "F:1", "[F:1]", None)]
    assert claims("$7" + " " * 159 + "[F:1]") == [("citation", "F:1", "[F:1]", None)]
    assert claims(None) == claims("") == claims('"a quotation" $5 [x] [F:] [F:open') == []


def test_a_long_answer_takes_one_pass():
    assert claims("[F:" * 300_000) == [] and len(claims('"long enough" ' * 50_000 + "[T:x]")) == 50_001


def near(value, numbers, kind):
    absolute = 0.005 if kind == "percent" else 0.5
    met = [(abs(value - n), n) for n in numbers if abs(value - n) <= absolute or abs(value - n) <= 0.05 * max(abs(value), abs(n))]
    return min(met)[1] if met else None


@pytest.mark.parametrize("seed", range(3))
def test_numbers_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    size = lambda: rng.choice([rng.uniform(-1.2, 1.2), rng.uniform(8, 12) * rng.choice([-1, 1]), rng.uniform(90, 110), 10 ** rng.uniform(1, 9), 0.0, 10.0, 9.5, 10.5])
    numbers = [(f"F:{rng.randrange(4)}", size()) for _ in range(60)]
    asked = [(f"F:{rng.randrange(5)}", rng.choice(["money", "percent"]), size()) for _ in range(300)]
    asked += [(c, "money", n * f) for c, n in numbers[:30] for f in (1.0, 1.05, 0.95, 1 / 0.95, 1.0527)]
    known = spark.createDataFrame([*numbers, *numbers[:5], ("F:0", float("nan")), ("F:1", float("inf")), (None, 1.0), ("F:2", None)], "cite string, number double")
    got = {tuple(r) for r in grounding.check_numbers(spark.createDataFrame(asked, "cite string, kind string, value double"), known, ["cite"]).collect()}
    want = {(c, k, v, n) for c, k, v in asked for n in [near(v, [x for d, x in numbers if d == c], k)] if n is not None}
    assert got == want and len(got) > 50


def test_verdicts_and_grades(spark):
    answers = spark.createDataFrame([(1, '"Grew FAST again" [T:a] "never said so" [T:a] "no text here" [T:b] $10 million [F:f] $99 [F:f] 5% [M:none]'), (2, "nothing cited"), (3, None), (4, '"grew fast" [T:a]')], "id long, answer string")
    passages = spark.createDataFrame([(1, "T:a", "We grew\n fast again."), (1, "T:a", "We grew\n fast again."), (1, "T:b", None), (4, "T:a", None), (4, "T:a", "slow")], "id long, cite string, text string")
    numbers = spark.createDataFrame([(1, "F:f", 10_200_000.0), (1, "F:f", None), (4, "F:f", 1.0)], "id long, cite string, number double")
    checked = grounding.grounded(grounding.claims(answers, "id", "answer"), passages, numbers, key="id")
    got = sorted((r.id, r.claim, r.kind, r.cite, r.nearest, r.verdict) for r in checked.collect())
    assert [g[2:] for g in got if g[0] == 1 and g[2] != "citation"] == [("quote", "T:a", None, "found"), ("quote", "T:a", None, "missing"), ("quote", "T:b", None, "unchecked"), ("money", "F:f", 1.02e7, "near"), ("money", "F:f", None, "far"), ("money", "M:none", None, "unchecked"), ("percent", "M:none", None, "unchecked")]
    assert [g[5] for g in got if g[0] == 1 and g[2] == "citation"] == ["known"] * 5 + ["unknown"] and [g[5] for g in got if g[0] == 4] == ["missing", "known"]
    grades = sorted(tuple(r) for r in grounding.graded(answers, checked, "id").collect())
    assert grades == [(1, 6, 1, 1, 1, "unverified"), (2, 0, 0, 0, 0, "verified"), (3, 0, 0, 0, 0, "verified"), (4, 1, 0, 1, 0, "verified")]
    nothing = grounding.grounded(grounding.claims(answers.limit(0), "id", "answer"), passages.limit(0), numbers.limit(0), key="id")
    assert nothing.count() == 0 and grounding.graded(answers.limit(0), nothing, "id").count() == 0


def test_turns_with_times():
    script = "Preface\n[00:00-00:12] Operator\nGood day.\n\n  Welcome. \n[00:12–101:05]  Ann Berg \n[1:2-3:4] not a header\n[101:05-101:06] Bo"
    assert [tuple(t.values()) for t in calls.timed_turns(script)] == [(0, "Operator", 0, 12, "Good day. Welcome."), (1, "Ann Berg", 12, 6065, "[1:2-3:4] not a header"), (2, "Bo", 6065, 6066, "")]
    assert calls.timed_turns(None) == calls.timed_turns("no header") == []


CALL = [
    ("A", "Good day, everyone."), ("B", "With us are Dr. Lisa Su, our Chair and CEO, and Jean Hu, Executive Vice President, CFO, and Treasurer."), ("C", "Thanks."), ("C", "A fine year. Now I will turn the call over to Jean."),
    ("D", "Numbers."), ("A", "Our first question comes from the line of Bo Lund from Acme Bank. Go on."), ("E", "Two questions."), ("C", "Yes."), ("A", "The next question comes from Cy Dahl."), ("E", "Oops."), ("F", "Hello."), ("G", "Bye."),
]


def test_roles(spark):
    rows = [(1, i, s, t) for i, (s, t) in enumerate(CALL)] + [(2, 0, "X", None), (3, 0, "P", "a"), (3, 1, "Q", "b"), (3, 2, "R", "c"), (4, 0, None, "a")]
    segments = spark.createDataFrame(rows, "call long, i int, who string, said string")
    got = sorted((r.call, r.label, r.role, r.name, r.source) for r in calls.speaker_roles(segments, "call", "i", "who", "said").collect())
    s = "structural"
    assert got == [
        (1, "A", "operator", "Operator", s), (1, "B", "ir", "Investor Relations", s), (1, "C", "ceo", "Lisa Su", s), (1, "D", "cfo", "Jean Hu", s), (1, "E", "analyst", "Bo Lund from Acme Bank", s), (1, "F", "other", "F", "unknown"), (1, "G", "other", "G", "unknown"),
        (2, "X", "operator", "Operator", s), (3, "P", "operator", "Operator", s), (3, "Q", "ir", "Investor Relations", s), (3, "R", "ceo", None, s), (4, "", "operator", "Operator", s),
    ]
    voices = spark.createDataFrame([(1, "F", "analyst", "Cy Dahl", 0.9), (1, "F", "cto", "Di", 0.6), (1, "G", "cto", "Di", 0.54), (1, "D", "cfo", "Jean X. Hu", 0.55)], "call long, label string, role string, name string, cosine double")
    heard = {r.label: (r.role, r.name, r.source) for r in calls.speaker_roles(segments, "call", "i", "who", "said", voices).where("call = 1").collect()}
    assert heard["F"] == ("analyst", "Cy Dahl", "voiceprint") and heard["G"] == ("other", "G", "unknown") and heard["D"] == ("cfo", "Jean X. Hu", "voiceprint") and heard["C"] == ("ceo", "Lisa Su", s)
    assert calls.speaker_roles(segments.limit(0), "call", "i", "who", "said").count() == 0


def test_restated_periods_mark_others(spark):
    from finfacts.operators import verify

    rows = [(1, 2024, 2, "2024-06-30", "income_statement"), (1, 2024, 2, "2024-06-30", "income_statement"), (1, 2024, 4, "2024-12-31", "cash_flow"), (2, 2023, 4, "2023-12-31", "balance_sheet"), (3, 2023, 1, "2023-03-31", "segment"), (4, 2023, None, "2023-03-31", "balance_sheet")]
    found = verify.co_marked(spark.createDataFrame(rows, "entity_id long, fiscal_year int, fiscal_quarter int, period_end string, statement string"))
    got = sorted((r.entity_id, r.period_end[5:7], r.statement, r.period_type, r.direct) for r in found.collect())
    assert got == [
        (1, "06", "balance_sheet", "quarter", False), (1, "06", "cash_flow", "quarter", False), (1, "06", "income_statement", "quarter", True), (1, "12", "balance_sheet", "annual", False), (1, "12", "balance_sheet", "quarter", False), (1, "12", "cash_flow", "quarter", True),
        (2, "12", "balance_sheet", "annual", True), (2, "12", "balance_sheet", "quarter", True), (3, "03", "segment", "quarter", True), (4, "03", "balance_sheet", "quarter", True),
    ]
    stored = [(1, "balance_sheet", "2024-12-31", "annual", "inventory"), (1, "balance_sheet", "2024-12-31", "annual", "inventory"), (1, "cash_flow", "2024-12-31", "annual", "cfo"), (1, "cash_flow", "2024-06-30", "quarter", "cfo"), (5, "cash_flow", "2024-06-30", "quarter", "cfo")]
    kept = verify.rows_to_refresh(found, spark.createDataFrame(stored, "entity_id long, statement string, period_end string, period_type string, concept string"))
    assert sorted((r.entity_id, r.statement, r.period_type) for r in kept.collect()) == [(1, "balance_sheet", "annual")] * 2 + [(1, "cash_flow", "quarter")]


def test_coverage_has_both_levels(spark):
    from finfacts.operators import quality

    prices = spark.createDataFrame([(1, "2024-01-02", "2024-01-02", "2024-01"), (1, "2024-01-03", "2024-01-03", "2024-01"), (1, "2024-01-03", "2024-01-03", "2024-01"), (1, "2024-02-01", "2024-02-01", "2024-02"), (9, "2024-02-01", "2024-02-01", "2024-02")], "entity_id long, period string, at string, bucket string")
    papers = spark.createDataFrame([(1, "FY2024 Q1", "2024-05-01", "10q a"), (1, "FY2024 Q1", "2024-06-01", "10q b"), (1, None, None, None)], "entity_id long, period string, at string, bucket string")
    companies = spark.createDataFrame([(1, "A"), (2, "B"), (2, "B")], "entity_id long, ticker string")
    day = lambda d: d and d.isoformat()[5:]
    got = sorted((r.entity_id, r.vertical, r.level, r.bucket or "", r.n_rows, r.periods, day(r.earliest) or "", day(r.latest) or "") for r in quality.coverage_levels({"prices": prices, "papers": papers}, companies).collect())
    assert got == [
        (1, "papers", "bucket", "", 1, 0, "", ""), (1, "papers", "bucket", "10q a", 1, 1, "05-01", "05-01"), (1, "papers", "bucket", "10q b", 1, 1, "06-01", "06-01"), (1, "papers", "vertical", "", 3, 1, "05-01", "06-01"),
        (1, "prices", "bucket", "2024-01", 3, 2, "01-02", "01-03"), (1, "prices", "bucket", "2024-02", 1, 1, "02-01", "02-01"), (1, "prices", "vertical", "", 4, 3, "01-02", "02-01"), (2, "papers", "vertical", "", 0, 0, "", ""), (2, "prices", "vertical", "", 0, 0, "", ""),
    ]
    assert quality.coverage_levels({"prices": prices.limit(0)}, companies.limit(0)).count() == 0


def test_coverage_holds_dates_by_month_and_counts_told_once(spark):
    from finfacts.operators import quality

    days = ["2024-01-01", "2024-01-31", "2024-01-31", "2024-02-01", "2024-02-29", "0001-01-01", "-0001-01-01", None, None]
    prices = spark.createDataFrame([(1, d, b) for d in days for b in ("x", "y", None)], "entity_id long, day string, bucket string").selectExpr("entity_id", "CAST(day AS DATE) AS period", "CAST(day AS DATE) AS at", "bucket")
    companies = spark.createDataFrame([(1, "A")], "entity_id long, ticker string")
    named = prices.selectExpr("entity_id", "CAST(period AS STRING) AS period", "at", "bucket")
    rows = lambda df: sorted((r.vertical, r.level, r.bucket or "", r.n_rows, r.periods) for r in df.select("vertical", "level", "bucket", "n_rows", "periods").collect())
    got = rows(quality.coverage_levels({"all": prices, "once": prices, "named": named, "named once": named}, companies, once=["once", "named once"]))
    want = lambda v, n: [(v, "bucket", "", n, 6), (v, "bucket", "x", n, 6), (v, "bucket", "y", n, 6), (v, "vertical", "", 3 * n, 6)]
    assert got == want("all", 9) + want("named", 9) + want("named once", 7) + want("once", 7)
