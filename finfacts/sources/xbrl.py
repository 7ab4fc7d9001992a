"""XBRL filings: facts of instance documents, arcs of linkbases, and the calculation network as a weighted graph.

XML is read one document at a time by a small helper over batches; walking, rolling up and checking are joins over (filing, role, concept).

Defined results: a body that is null, empty or not well-formed gives no rows in facts and arcs, and one row in broken(); a fact whose context or unit
isn't there has nulls; the same arc twice in a role counts once; arcs without a weight have 1.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators.text import exploded

# Namespaces of the standard.
XBRLI, LINK, XLINK, XBRLDI = "{http://www.xbrl.org/2003/instance}", "{http://www.xbrl.org/2003/linkbase}", "{http://www.w3.org/1999/xlink}", "{http://xbrl.org/2006/xbrldi}"
FACT = "concept string, value string, unit string, decimals string, context string, start string, end string, dimensions string"
ARC = "kind string, role string, parent string, child string, weight double, place double, label string"


def _root(body: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(body) if body else None
    except ET.ParseError:
        return None


def _said(node: ET.Element | None, path: str) -> str | None:
    found = None if node is None else node.find(path)
    return None if found is None else (found.text or "").strip()


def facts_of(body: str | None) -> list[dict]:
    """Facts of an instance with what their contexts and units say; an instant has no start. dimensions: axis=member, in order."""
    root = _root(body)
    if root is None:
        return []
    contexts = {}
    for c in root.iter(f"{XBRLI}context"):
        end = _said(c, f"{XBRLI}period/{XBRLI}instant")
        axes = sorted(f"{m.get('dimension')}={''.join(m.itertext()).strip()}" for kind in ("explicitMember", "typedMember") for m in c.iter(f"{XBRLDI}{kind}"))
        contexts[c.get("id")] = {"start": None if end else _said(c, f"{XBRLI}period/{XBRLI}startDate"), "end": end or _said(c, f"{XBRLI}period/{XBRLI}endDate"), "dimensions": ",".join(axes) or None}
    units = {}
    for u in root.iter(f"{XBRLI}unit"):
        over = [_said(u, f"{XBRLI}divide/{XBRLI}{x}/{XBRLI}measure") for x in ("unitNumerator", "unitDenominator")]
        name = _said(u, f"{XBRLI}measure") or "/".join(x for x in over if x)
        units[u.get("id")] = "/".join(x.split(":")[-1] for x in name.split("/")) or u.get("id")
    none = {"start": None, "end": None, "dimensions": None}
    return [
        {"concept": f.tag.split("}")[-1], "value": (f.text or "").strip() or None, "unit": units.get(f.get("unitRef")), "decimals": f.get("decimals"), "context": f.get("contextRef"), **contexts.get(f.get("contextRef"), none)}
        for f in root
        if f.get("contextRef") is not None
    ]


def arcs_of(body: str | None) -> list[dict]:
    """Arcs of calculation, presentation and definition links; a locator stands for the concept that its href ends in."""
    root = _root(body)
    out = []
    for kind in ("calculation", "presentation", "definition"):
        for link in [] if root is None else root.iter(f"{LINK}{kind}Link"):
            named = {loc.get(f"{XLINK}label"): loc.get(f"{XLINK}href", "").split("#")[-1].split("_", 1)[-1] for loc in link.iter(f"{LINK}loc")}
            for a in link.iter(f"{LINK}{kind}Arc"):
                ends = [named.get(a.get(f"{XLINK}{x}")) for x in ("from", "to")]
                if all(ends):
                    out.append({"kind": kind, "role": link.get(f"{XLINK}role"), "parent": ends[0], "child": ends[1], "weight": float(a.get("weight", 1)), "place": float(a.get("order", 1)), "label": a.get("preferredLabel")})
    return out


def facts(df: DataFrame, filing: str, body: str) -> DataFrame:
    """filing and the columns of FACT, values as text; a fact's number is where value_number isn't null (it has a unit)."""
    rows = exploded(df, [filing], [body], facts_of, FACT)
    number = F.when(F.col("unit").isNotNull(), F.expr("try_cast(value AS decimal(28,4))"))
    return rows.withColumns({"start": F.expr("try_cast(`start` AS date)"), "end": F.expr("try_cast(`end` AS date)"), "number": number})


def arcs(df: DataFrame, filing: str, body: str) -> DataFrame:
    return exploded(df, [filing], [body], arcs_of, ARC)


def broken(df: DataFrame, filing: str, body: str) -> DataFrame:
    """Filings whose body can't be read."""
    return exploded(df, [filing], [body], lambda b: [] if _root(b) is not None else [{"size": len(b or "")}], "size int")


def network(arcs: DataFrame, filing: str) -> DataFrame:
    """Distinct calculation arcs: filing, role, parent, child, weight. Written once, as every round of a walk reads them."""
    return cut(arcs.where("kind = 'calculation'").groupBy(filing, "role", "parent", "child").agg(F.max("weight").cast("decimal(12,6)").alias("weight")))


def walks(net: DataFrame, filing: str) -> DataFrame:
    """All ways down from every concept: filing, role, top, node, weight (the product along the way), depth, path, closed.

    A way that comes back to a concept on it is closed there: a cycle. The loop ends when no way goes on, so it has as many rounds as the
    network has levels; each round's rows are cut off from those before.
    """
    on = [filing, "role"]
    step = net.select(*on, F.col("parent").alias("node"), F.col("child").alias("to"), F.col("weight").alias("by"))
    now = net.select(*on, F.col("parent").alias("top"), F.col("child").alias("node"), "weight", F.lit(1).alias("depth"), F.array("parent", "child").alias("path"), (F.col("parent") == F.col("child")).alias("closed"))
    out = now = cut(now)
    while True:
        now = cut(
            now.where(~F.col("closed")).join(step, [*on, "node"]).select(
                *on, "top", F.col("to").alias("node"), (F.col("weight") * F.col("by")).cast("decimal(12,6)").alias("weight"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("to")).alias("path"), F.array_contains("path", F.col("to")).alias("closed")
            )
        )
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def cycles(ways: DataFrame, filing: str) -> DataFrame:
    """Each cycle once: filing, role, members from the smallest name on."""
    ring = F.slice("path", 1, F.size("path") - 1)
    whole = ways.where(F.col("closed") & (F.col("top") == F.col("node")) & (F.col("top") == F.array_min(ring)))
    return whole.select(filing, "role", ring.alias("members")).distinct()


def check(facts: DataFrame, net: DataFrame, filing: str, ways: DataFrame | None = None, absolute: float = 1.0, relative: float = 1e-4) -> DataFrame:
    """Every reported parent against its children and against the leaves below it, by filing, role, parent, context and unit.

    from_children: sum of weight times value over the children that are reported in the same context and unit; missing: how many aren't.
    from_leaves: the same over the network's leaves below, along every way; null where one isn't reported or the way down is a cycle.
    ties, leaves_tie: within the larger of `absolute` and `relative` of the value; null where there is nothing to compare.
    """
    ways = walks(net, filing) if ways is None else ways
    on = [filing, "role"]
    values = facts.where("number IS NOT NULL AND dimensions IS NULL").groupBy(filing, "concept", "start", "end", "unit").agg(F.max("number").alias("value"))
    values = values.select(filing, "concept", F.struct("start", "end", "unit").alias("at"), "value")
    leaf = net.select(*on, F.col("parent").alias("node")).distinct()
    rings = ways.where("closed").select(*on, "top").distinct()
    down = ways.where("NOT closed").join(leaf, [*on, "node"], "left_anti").groupBy(*on, "top", "node").agg(F.sum("weight").cast("decimal(12,6)").alias("weight")).join(rings, [*on, "top"], "left_anti")
    named = net.select(*on, F.col("parent").alias("top"), F.col("child").alias("node"), "weight", F.lit(False).alias("deep")).unionByName(down.withColumn("deep", F.lit(True)))
    wanted = named.groupBy(*on, "top").agg(F.count_if(~F.col("deep")).alias("children"), F.count_if("deep").alias("leaves"))
    reached = named.join(values.withColumnRenamed("concept", "node"), [filing, "node"]).withColumn("part", F.col("weight") * F.col("value"))
    near = lambda c: F.when(~F.col("deep"), c)
    deep = lambda c: F.when(F.col("deep"), c)
    sums = reached.groupBy(*on, "top", "at").agg(F.sum(near(F.col("part"))).alias("from_children"), F.count(near(F.col("part"))).alias("seen"), F.sum(deep(F.col("part"))).alias("leaf_sum"), F.count(deep(F.col("part"))).alias("leaves_seen"))
    parents = wanted.join(values.withColumnRenamed("concept", "top"), [filing, "top"]).join(sums, [*on, "top", "at"], "left")
    from_leaves = F.when((F.col("leaves") > 0) & (F.col("leaves_seen") == F.col("leaves")), F.col("leaf_sum"))
    tie = lambda x: F.abs(F.col("value") - x) <= F.greatest(F.lit(absolute), F.abs("value").cast("double") * relative)
    out = parents.withColumns({"from_leaves": from_leaves, "missing": F.col("children") - F.coalesce("seen", F.lit(0))})
    return out.select(*on, F.col("top").alias("parent"), "at.start", "at.end", "at.unit", "value", "children", "missing", "from_children", tie(F.col("from_children")).alias("ties"), "from_leaves", tie(F.col("from_leaves")).alias("leaves_tie"))
