"""Submission lists, file indexes and documents of filings, by hand."""

import datetime
import json

from pyspark.sql import functions as F

from finfacts.sources import submissions as sub

D = datetime.date


def lists(spark):
    recent = {
        "accessionNumber": ["a1", "a2", "a3", "a4", "a5", "a6", "a7"], "form": ["10-K", "10-Q", "8-K", "8-K", "10-K", "4", ""], "filingDate": ["2024-02-01", "2024-05-01", "2024-06-01", "2024-06-02", "2023-02-01", "2024-07-01", "2024-07-01"],
        "reportDate": ["2023-12-31", "", "2024-05-30", "2024-05-30", "2020-12-31", "", ""], "acceptanceDateTime": ["20240201163000", "2024-05-01T16:30:00.000Z", "", "nonsense"], "primaryDocument": ["k.htm", "q.htm", "e.htm", "f.htm", "old.htm", "g.htm", "h.htm"],
        "items": ["", "", "2.02,9.01", "5.02"], "isXBRL": [1, 0, 0, 0], "isInlineXBRL": [True],
    }
    older = {"accessionNumber": ["a1", "b1", "b2", None], "form": ["10-Q", "10-Q/A", "8-K/A", "10-K"], "filingDate": ["2020-01-01", "2023-11-01", "x", "2023-01-01"], "reportDate": ["2020-01-01", "2023-09-30"], "primaryDocument": ["z.htm", "b.htm", "c.htm", "d.htm"]}
    rows = [(1, 0, json.dumps({"filings": {"recent": recent}})), (1, 1, json.dumps(older)), (2, 0, "{broken"), (3, 0, None), (4, 0, "{}")]
    return spark.createDataFrame(rows, "entity_id long, shard int, body string")


def test_lists_of_submissions(spark):
    got = {r.accession_number: r for r in sub.submission_filings(lists(spark)).collect()}
    assert sorted(got) == ["a1", "a2", "a3", "a4", "a5", "a6", "b1"]
    assert (got["a1"].form_type, got["a1"].report_date, got["a1"].is_xbrl, got["a1"].is_inline_xbrl) == ("10-K", D(2023, 12, 31), True, True)  # the list itself before its older part
    assert got["a2"].report_date is None and got["a2"].accepted_at.hour == 16 and got["a4"].accepted_at is None and got["a3"].items == ["2.02", "9.01"] and got["a5"].items == []
    assert sub.submission_filings(lists(spark).limit(0)).collect() == []


def test_filings_wanted_and_their_documents(spark):
    entities = spark.createDataFrame([(1, "12-31"), (9, "06-30")], "entity_id long, fiscal_year_end_md string")
    filings = sub.submission_filings(lists(spark))
    day = lambda y, m, d: F.lit(f"{y}-{m:02}-{d:02}").cast("date")
    wanted = sub.wanted_filings(filings, entities, day(2022, 6, 1), day(2024, 12, 31))
    got = sorted((r.accession_number, r.period_type, r.fiscal_period_label) for r in wanted.collect())
    # a2 has no report date, a4 is not on results, a5 is of an early year, a6 of another form
    assert got == [("a1", "annual", "FY2023"), ("a3", None, None), ("b1", "quarter", "FY2023 Q3")]
    assert {r.accession_number for r in sub.wanted_filings(filings, entities, results_only=False).collect()} == {"a1", "a3", "a4", "a5", "b1"}
    assert [r.accession_number for r in sub.numbered(wanted, 1).collect()] == ["a3"]
    item = [{"name": "e.htm", "type": "EX-99"}, {"name": "ex991.htm", "description": "Our news"}, {"name": "ex991.htm"}, {"name": "x.pdf", "type": "EX-99.1"}, {"name": ""}, {"type": "EX-99.1"}, {"name": "note.txt", "description": "Earnings Release"}]
    index = spark.createDataFrame([(1, "a3", json.dumps({"directory": {"item": item}})), (1, "a1", json.dumps({"directory": {"item": item}})), (1, "b1", None), (1, "b1", "{}")], "entity_id long, accession_number string, body string")
    files = sub.index_files(index)
    assert files.where("accession_number = 'a3'").count() == 5
    docs = sorted((r.document_id, r.artifact_type, r.filename, r.title, r.amended, r.reason) for r in sub.filing_documents(wanted, files).collect())
    assert docs == [
        ("a1", "10k", "k.htm", None, False, None), ("a3", "8k", "e.htm", None, False, None), ("a3:ex991.htm", "press_release", "ex991.htm", "Our news", False, "filename_ex99_1"),
        ("a3:note.txt", "press_release", "note.txt", "Earnings Release", False, "description_earnings_release"), ("b1", "10q", "b.htm", None, True, None),
    ]
    assert sub.filing_documents(wanted, files.limit(0)).count() == 3


def test_why_a_file_is_a_release(spark):
    cases = [
        (("a.htm", "ex-99.1", None), "type_ex99"), (("a.htm", "EX-99.2", None), None), (("a.pdf", "EX-99.1", "press release"), None), (("A.HTML", None, "A Press Release"), "description_press_release"), (("q1earnings-release.htm", None, None), "filename_earnings_release"),
        (("earningspress.txt", "", ""), "filename_earnings_press"), (("my-pressrelease.htm", None, None), "filename_press_release"), (("d1dex99_1.htm", None, None), "filename_ex99_1"), (("ex992.htm", None, None), None), (("exhibit99.htm", None, None), "filename_ex99_1"), (("exhbit991.htm", None, None), "filename_ex99_1"),
        (("exhbit99.htm", None, None), None), (("ex9912.htm", None, None), None), (("amdq42023991.htm", None, None), "filename_quarter_991"), (("q3fy24pr.htm", None, None), "filename_quarterly_pr"), (("q324pr.htm", None, None), "filename_quarterly_pr"), ((None, "EX-99.1", None), None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, n string, t string, d string")
    got = [r.w for r in rows.select("i", sub.release_reason(F.col("n"), F.col("t"), F.col("d")).alias("w")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
