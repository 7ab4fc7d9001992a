"""Positional search against a brute-force cover search, and XBRL documents by hand."""

import itertools
import random
import re

import pytest

from finfacts.operators import search
from finfacts.operators.text import stemmed
from finfacts.sources import xbrl

WORDS = "margin margins operating demand grew fell the cost costs".split()


def covers_by_hand(text, query):
    """Smallest stretches of a text that satisfy a query, by trying all stretches."""
    words = [stemmed(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    named = {w for u in query.units for w in u}

    def holds(a, b, unit):
        return any(tuple(words[i : i + len(unit)]) == unit for i in range(a, b - len(unit) + 2))

    def good(a, b):
        return any(all(holds(a, b, u) for u in must) and not any(holds(0, len(words) - 1, u) for u in no) for must, no in query.alternatives)

    found = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(words)), 2) if good(a, b)]
    small = [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]
    return sorted((a, b, sum(w not in named for w in words[a : b + 1])) for a, b in small)


QUERIES = ["margin", "operating margin", '"operating margin"', '"operating margin" demand', "demand -cost", 'demand -"operating margin"', "grew or fell cost", '"cost grew" or "margins fell" or the', '"the the"', "margin margin demand", "nothing here", "-margin", "", '"operating margin" operating', 'demand or -cost']


@pytest.mark.parametrize("query", QUERIES)
def test_covers_are_those_of_brute_force(spark, query):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", ",", "-x"]) for _ in range(rng.randint(0, 22)))) for i in range(60)] + [(98, None), (99, "")]
    index = search.postings(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    asked = search.query_of(query)
    got = sorted((r.id, r.start, r.end, r.noise) for r in search.covers(index, "id", asked).collect())
    want = sorted((i, *c) for i, t in rows for c in covers_by_hand(t, asked))
    assert got == want
    ranks = {r.id: (r.covers, round(r.score, 9)) for r in search.ranked(index, "id", asked).collect()}
    assert ranks == {i: (len(cs), round(sum(0.1 / (1 + n) for _, _, n in cs), 9)) for i, t in rows if (cs := covers_by_hand(t, asked))}


def test_a_landed_index_is_read_by_its_terms(spark, tmp_path):
    rows = [(i, f"alpha {'beta' if i % 2 else 'gamma'} word{i}") for i in range(50)]
    index = search.postings(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    search.write_postings(index, "id", str(tmp_path / "index"))
    found = search.ranked(spark.read.parquet(str(tmp_path / "index")), "id", '"alpha beta"')
    assert sorted(r.id for r in found.collect()) == list(range(1, 50, 2))
    assert "PushedFilters: [In(term, [alpha,beta])" in found._jdf.queryExecution().executedPlan().toString()


def turns(spark):
    rows = [
        (1, "ARRW", "FY2025 Q1", "2025-03-31", "2025-05-01", None, 0, "CFO", "Gross margin expanded as data center demand improved."), (2, "ARRW", "FY2025 Q2", "2025-06-30", "2025-08-01", None, 0, "Operator", "Welcome to the call."), (3, "ARRW", "FY2025 Q2", "2025-06-30", "2025-08-01", None, 1, "CFO", "Operating margin expanded again; demand, AI demand."),
        (4, "ARRW", "FY2025 Q1", "2025-03-31", "2025-05-01", None, 1, "CEO", "Operating costs; margin of operating margins."), (5, "OTHR", "FY2025 Q2", "2025-06-30", "2025-08-01", None, 0, "CEO", "Operating margin."), (6, "ARRW", "FY2024 Q4", "2024-12-31", "2025-02-20", "2025-03-01", 0, "CEO", "Operating margin. Demand."),
    ]
    return spark.createDataFrame(rows, "turn_id long, entity string, period string, period_end string, published_at string, superseded_at string, ordinal int, speaker string, text string").selectExpr("turn_id", "entity", "period", "date(period_end) period_end", "timestamp(published_at) published_at", "timestamp(superseded_at) superseded_at", "ordinal", "speaker", "text")


def test_turn_search_filters_and_orders(spark):
    calls = turns(spark)
    index = search.postings(calls, "turn_id", "text")
    ids = lambda *a, **k: [r.turn_id for r in search.search_turns(calls, index, *a, **k).collect()]
    assert ids('"operating margin"') == [5, 3, 4]  # equal ranks go by period, then place
    assert ids('"operating margin"', entity="ARRW", period="FY2025 Q2") == [3]
    assert ids("operating margin", entity="ARRW") == [4, 3]  # three covers of the fourth turn
    assert ids('"operating margin"', asof="2025-06-01") == [4] and ids("margin", top=0) == []
    assert ids("margins", entity="ARRW") == [4]  # the word itself must be there, not its stem alone
    with pytest.raises(ValueError):
        ids("  ")


def test_mentions_of_the_latest_periods(spark):
    got = search.latest_mentions(turns(spark), ["demand", "AI"], 2).where("entity = 'ARRW'").orderBy("period_end").collect()
    assert [(r.period, r.turns, r.n_demand, r.n_ai) for r in got] == [("FY2025 Q1", 2, 1, 0), ("FY2025 Q2", 2, 2, 1)]


INSTANCE = """<?xml version="1.0"?><xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us="http://u" xmlns:d="http://xbrl.org/2006/xbrldi">
<xbrli:context id="y"><xbrli:entity><xbrli:identifier scheme="s">1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="i"><xbrli:entity><xbrli:identifier scheme="s">1</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="s"><xbrli:entity><xbrli:identifier scheme="s">1</xbrli:identifier><xbrli:segment><d:explicitMember dimension="us:Axis"> us:Cloud </d:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<us:Net contextRef="y" unitRef="usd" decimals="-3">100</us:Net><us:Eps contextRef="y" unitRef="eps">1.25</us:Eps><us:Assets contextRef="i" unitRef="usd">50</us:Assets><us:Assets contextRef="s" unitRef="usd">20</us:Assets><us:Note contextRef="y">text</us:Note><us:Lost contextRef="none" unitRef="no">7</us:Lost>
%s</xbrli:xbrl>"""


def linkbase(arcs):
    names = sorted({x for p, c, _ in arcs for x in (p, c)})
    locs = "".join(f'<l:loc x:href="a.xsd#us_{n}" x:label="at_{n}"/>' for n in names)
    return f'<l:linkbase xmlns:l="http://www.xbrl.org/2003/linkbase" xmlns:x="http://www.w3.org/1999/xlink"><l:calculationLink x:role="r">{locs}' + "".join(f'<l:calculationArc x:from="at_{p}" x:to="at_{c}" weight="{w}" order="2"/>' for p, c, w in arcs) + "</l:calculationLink></l:linkbase>"


def test_instance_facts(spark):
    df = spark.createDataFrame([(1, INSTANCE % ""), (2, None), (3, ""), (4, "<broken")], "filing long, body string")
    got = {(r.concept, r.dimensions): r for r in xbrl.facts(df, "filing", "body").collect()}
    assert len(got) == 6 and str(got["Net", None].start) == "2024-01-01" and str(got["Net", None].end) == "2024-12-31" and got["Net", None].decimals == "-3"
    assert (got["Eps", None].unit, float(got["Eps", None].number)) == ("USD/shares", 1.25)
    assert got["Assets", None].start is None and float(got["Assets", "us:Axis=us:Cloud"].number) == 20
    assert got["Note", None].number is None and got["Lost", None].end is None and got["Lost", None].unit is None
    assert sorted(r.filing for r in xbrl.broken(df, "filing", "body").collect()) == [2, 3, 4]


def test_network_of_three_levels_and_a_cycle(spark):
    arcs = [("Net", "Pre", 1), ("Net", "Tax", -1), ("Pre", "Gross", 1), ("Pre", "Cost", -1), ("Gross", "Sales", 1), ("Gross", "Goods", -1)]
    said = lambda **v: INSTANCE % "".join(f'<us:{k} contextRef="y" unitRef="usd">{n}</us:{k}>' for k, n in v.items())
    rows = [
        (1, said(Pre=120, Tax=20, Gross=150, Cost=30, Sales=400, Goods=250), linkbase(arcs)), (2, said(Pre=120, Tax=20, Gross=150, Cost=37, Sales=400, Goods=250), linkbase(arcs + arcs[:1])), (3, said(Pre=120, Tax=20, Gross=150, Sales=400, Goods=250), linkbase(arcs)),
        (4, said(Pre=120, Tax=20, Gross=150, Cost=30, Sales=400, Goods=250), linkbase([*arcs, ("Goods", "Pre", 1), ("Tax", "Tax", 1)])), (5, "<", linkbase(arcs)), (6, said(Pre=1), None),
    ]
    df = spark.createDataFrame(rows, "filing long, body string, links string")
    net = xbrl.network(xbrl.arcs(df, "filing", "links"), "filing")
    assert net.where("filing = 2").count() == 6
    ways = xbrl.walks(net, "filing")
    got = {(r.filing, r.parent): r for r in xbrl.check(xbrl.facts(df, "filing", "body"), net, "filing", ways).collect()}
    tie = lambda f, p: (got[f, p].ties, got[f, p].missing, got[f, p].leaves_tie, None if got[f, p].from_leaves is None else float(got[f, p].from_leaves))
    assert {p: tie(1, p) for p in ("Net", "Pre", "Gross")} == {"Net": (True, 0, True, 100.0), "Pre": (True, 0, True, 120.0), "Gross": (True, 0, True, 150.0)}
    assert tie(2, "Net") == (True, 0, False, 93.0) and tie(2, "Pre") == (False, 0, False, 113.0) and tie(2, "Gross") == (True, 0, True, 150.0)
    assert tie(3, "Pre") == (False, 1, None, None) and tie(3, "Gross")[0] is True
    assert tie(4, "Net") == (True, 0, None, None)  # its ways down run into cycles
    assert {(r.filing, tuple(r.members)) for r in xbrl.cycles(ways, "filing").collect()} == {(4, ("Goods", "Pre", "Gross")), (4, ("Tax",))}
    assert not {f for f, _ in got} & {5, 6}
    assert max(r.depth for r in ways.where("filing = 1").collect()) == 3
