"""Every query of the library with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import hashlib
import math
import re

import duckdb
import pytest

from finfacts.operators import text
from finfacts.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(dict(zip(columns, row))[c]) for c in order) for row in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)
    assert got == want


def rows(spark, sf, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{table}.parquet").select(*columns).collect()]


def release(body):
    """Units of a release by a walk over its lines."""
    lines = [" ".join(x.split()) for x in (body or "").split("\n")]
    lines = [x for x in lines if x]
    head = next((i for i, x in enumerate(lines) if len(x.split()) >= 4), None)
    if head is None:
        return [("full_release_body", lines)] if lines else []
    out, key = [("headline", [lines[head]])], "release_body"
    for x in lines[head + 1 :]:
        if len(x) <= 140 and len(x.split()) <= 14 and x[-1] not in ".;,":
            key = {"Business Outlook": "business_outlook", "About Acme Corporation": "about_company"}.get(x, key)
        if out[-1][0] == key:
            out[-1][1].append(x)
        else:
            out.append((key, [x]))
    return out


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


#: What the queries without SQL should give, from the tables' rows by the functions on one text, which have their own tests.
BY_HAND = {
    "html_normalize": lambda s, sf: [(i, len(t), sha(t)) for i, h in rows(s, sf, "pages", "page_id", "html") for t in [text.normalize_html(h)]],
    "chunk_documents": lambda s, sf: [(i, *c.values()) for i, t in rows(s, sf, "documents", "doc_id", "text") for c in text.chunks(t, target=200, most=250)],
    "section_extract": lambda s, sf: [(i, *c.values()) for i, t in rows(s, sf, "documents", "doc_id", "text") for c in text.sections(t, "10-Q" if i % 2 else "10-K")],
    "chunk_warnings": lambda s, sf: [(i, c["ordinal"], warning((t or "")[c["start"] : c["end"]], c["heading"])) for i, t in rows(s, sf, "documents", "doc_id", "text") for c in text.chunks(t, target=200, most=250)],
    "release_units": lambda s, sf: [(i, n + 1, k, sha("\n".join(u))) for i, t in rows(s, sf, "documents", "doc_id", "text") for n, (k, u) in enumerate(release("\n".join("Business Outlook" if j % 7 == 3 else "About Acme Corporation" if j % 7 == 5 else x for j, x in enumerate((t or "").split("\n")))))],
}


def warning(body, heading):
    words = len(re.split(r"\s+", body.strip(" "), flags=re.ASCII))
    tests = [
        ("too_long", len(body) > 12_000), ("reference_only", re.search(r"(?i)market\s+risk.{0,40}incorporated\s+by\s+reference", body)), ("no_heading", not heading), ("page_tail", re.search(r"\n\s*\d{1,3}\s*$", body, re.ASCII)), ("boundary", re.search(r"(?i)^\s*(?:item\s+\d|part\s+i)", body)),
        ("short", words < 200), ("fragment", len(re.findall(r"[.!?](?:\s|$)", body, re.ASCII)) < 3), ("tiny", len(body) < 500),
    ]
    return next((k for k, hit in tests if hit), None)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_by_hand(spark, sf, name):
    want = sorted(map(repr, BY_HAND[name](spark, sf)))
    assert sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, sf).collect()) == want and want
