"""Sections of filings: lists of contents, parts, standalone headings, indexes at the end, boundaries, confidence."""

from finfacts.operators import scan

SAY = "The quarter went well and customers bought more than a year ago, which we expect to go on for some time."
MORE = f"{SAY}\n{SAY}"


def found(spark, *filings):
    df = spark.createDataFrame([(i, form, body) for i, (form, body) in enumerate(filings)], "id long, form string, body string")
    out = {}
    for r in scan.filing_sections(df, "id", "body", "form").orderBy("id", "start").collect():
        out.setdefault(r.id, {})[r.section] = ((filings[r.id][1] or "")[r.start : r.end], r)
    return [out[i] for i in range(len(filings))]


Q = "\n".join(["TABLE OF CONTENTS", "Item 2. Management's Discussion and Analysis ........ 12", "Item 3. Quantitative and Qualitative Disclosures About Market Risk ........ 42", "Part I", "Item 2. Management's Discussion and Analysis of Financial Condition", MORE, "Item 3. Quantitative and Qualitative Disclosures About Market Risk", MORE, "41", "PART II. OTHER INFORMATION", "Item 1A. Risk Factors", MORE, "ITEM 6. EXHIBITS", "A list of exhibits that is no part of the risks above.", "SIGNATURES", "By hand."])


def test_quarterly_report_is_part_aware(spark):
    (got,) = found(spark, ("10-Q", Q))
    assert list(got) == ["mdna", "market_risk", "risk_factors"]
    assert [got[k][1].part for k in got] == ["i", "i", "ii"] and [got[k][1].item for k in got] == ["2", "3", "1a"]
    assert got["mdna"][0] == f"Item 2. Management's Discussion and Analysis of Financial Condition\n{MORE}"
    assert got["market_risk"][0].endswith(SAY)  # neither page number nor the next part
    assert got["risk_factors"][0] == f"Item 1A. Risk Factors\n{MORE}"
    assert {r.method for _, r in got.values()} == {"deterministic"} and {r.confidence for _, r in got.values()} == {1.0}


def test_an_item_of_another_part_is_another_item(spark):
    (got,) = found(spark, ("10-Q", "\n".join(["Part II", "Item 2. Unregistered Sales of Equity", MORE, "Item 5. Other Information", MORE, "Item 1. Legal Proceedings", MORE])))
    assert list(got) == ["other_information"] and got["other_information"][0] == f"Item 5. Other Information\n{MORE}"


def test_annual_report_with_dashes_stops_at_items_that_are_not_kept(spark):
    dashes = "\n".join(["Intro", MORE, "Item 1A — Risk Factors", MORE, "ITEM 1B. UNRESOLVED STAFF COMMENTS", "None.", "Item 3 – Legal Proceedings", MORE, "Item 7: Management’s Discussion", MORE, "Signature page follows", "x"])
    (got,) = found(spark, ("10-K/A", dashes))
    assert list(got) == ["risk_factors", "legal_proceedings", "mdna"]
    assert got["risk_factors"][0].endswith(SAY) and got["mdna"][0].endswith(SAY)


def test_contents_without_dots(spark):
    """Numbers alone, titles and pages on lines of their own, then the body."""
    contents = "\n".join(x for n, t in (("1.", "Business"), ("1A.", "Risk Factors"), ("3.", "Legal Proceedings"), ("7.", "Management's Discussion")) for x in (f"Item {n}", t, str(len(t))))
    body = "\n".join(["PART I", "Item 1. Business", MORE * 9, "Item 1A. Risk Factors", MORE * 9, "Item 3. Legal Proceedings", MORE, "PART II", "Item 7. Management's Discussion", MORE * 9])
    (got,) = found(spark, ("10-K", f"ANNUAL REPORT\n{contents}\n{body}"))
    assert list(got) == ["business", "risk_factors", "legal_proceedings", "mdna"]
    assert got["business"][0] == f"Item 1. Business\n{MORE * 9}" and got["legal_proceedings"][0].endswith(SAY)


def test_headings_of_their_own_beat_an_index_at_the_end(spark):
    text = "\n".join(
        ["Statements and Notes", "24", "Management's Discussion and Analysis", MORE, "MD&A", "25", "Quantitative and Qualitative Disclosures About Market Risk", SAY, "Controls and Procedures", SAY, "Risk Factors", MORE, "Part I - Financial Information", "Item 1. Financial Statements", "Pages 3 - 24", "Item 2.", "Management's Discussion and Analysis of Financial Condition", "Liquidity", "Pages 33 - 34"]
        + ["Item 3. Quantitative and Qualitative Disclosures About Market Risk", "Page 35", "Part II - Other Information", "Item 1A. Risk Factors", "Page 36"]
    )
    (got,) = found(spark, ("10-Q", text))
    assert list(got) == ["mdna", "market_risk", "controls", "risk_factors"]
    assert got["mdna"][0].startswith(f"Management's Discussion and Analysis\n{MORE}") and "Pages 33" not in got["mdna"][0] and got["risk_factors"][0].endswith(SAY)


def test_second_pass_takes_the_last_headings(spark):
    text = "\n".join(["Part I", "Item 2. Management's Discussion", "We say more of this below.", "Item 3. Quantitative Disclosures", MORE, "Item 2. Management's Discussion", MORE])
    (got,) = found(spark, ("10-Q", text))
    assert list(got) == ["market_risk", "mdna"] and got["mdna"][0] == f"Item 2. Management's Discussion\n{MORE}" and got["market_risk"][0].endswith(SAY)
    assert {r.method for _, r in got.values()} == {"repair"} and all(0.6 < r.confidence <= scan.UNSURE for _, r in got.values())


def test_a_single_or_short_section_loses_confidence(spark):
    one, short, both = found(spark, ("10-K", f"{MORE}\nItem 7. Management's Discussion\n{MORE}"), ("10-K", f"{MORE}\nItem 1A. Risk Factors\nFew words.\nItem 3. Legal Proceedings\n{MORE}"), ("10-K", f"{MORE}\nItem 7. Management's Discussion\nFew words."))
    assert one["mdna"][1].confidence == 0.85 and one["mdna"][1].method == "deterministic"
    assert {k: r.confidence for k, (_, r) in short.items()} == {"risk_factors": 0.95, "legal_proceedings": 1.0}
    assert (both["mdna"][1].confidence, both["mdna"][1].method) == (0.6, "repair")


def test_nothing_found_is_the_whole_body(spark):
    plain, null, empty, other, listed = found(spark, ("10-K", "Plain words without any heading."), ("10-Q", None), ("10-K", ""), ("8-K", Q), (None, "Item 7. Management's Discussion"))
    assert all(list(x) == ["full_body"] and x["full_body"][1].confidence == 0 and x["full_body"][1].method == "unparsed_fallback" for x in (plain, null, empty, other, listed))
    assert plain["full_body"][0] == "Plain words without any heading." and (null["full_body"][1].end, plain["full_body"][1].words) == (0, 5)


def test_one_shuffle_for_all_windows(spark):
    df = spark.createDataFrame([(1, "10-Q", Q)], "id long, form string, body string")
    plan = scan.filing_sections(df, "id", "body", "form")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") <= 3  # the windows' one; the two sides of the rest


def test_headings_of_releases(spark):
    from pyspark.sql import functions as F

    from finfacts.operators import text

    said = {
        "News Summary": "news_summary", "Second-Quarter 2025 Financial Results": "financial_results", "Q3 Financial Results": "financial_results", "Our Financial Results": None, "Business Outlook": "business_outlook", "Forward-Looking Statements": "forward_looking_statements", "About Acme, Inc.": "about_company", "About": None,
        "Explanation of Non-GAAP Measures": "non_gaap_measures", "Supplemental Reconciliations of GAAP Actuals": "non_gaap_reconciliations", "Consolidated Condensed Balance Sheets": "financial_tables", "Condensed Statement of Income": "financial_tables", "": None, "Outlook": None,
    }
    got = spark.createDataFrame([(x,) for x in said], "line string").select("line", text.release_unit(F.col("line")).alias("unit")).collect()
    assert {r.line: r.unit for r in got} == said
