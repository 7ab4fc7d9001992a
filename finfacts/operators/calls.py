"""Transcripts of calls: turns with times, and who speaks in which role."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import exploded
from .windows import islands

# Words that hand a call over, how an operator announces a question, a chief's titles, turns within which an announced analyst speaks, least cosine of a voice.
HANDS_OVER = r"(?i)\b(?:turn|hand|give|pass) (?:it |the call |the conference |things )?(?:over )?to [a-z]"
ANNOUNCES = r"\b(?:[Ff]irst|[Nn]ext) question comes from (?:the line of )?(\p{Lu}\p{L}+ \p{Lu}\p{L}+(?: (?:from|of|with) \p{Lu}[\p{L}&]*(?: \p{Lu}[\p{L}&]*)*)?)"
TITLES = {"ceo": ("CEO", "Chief Executive Officer"), "cfo": ("CFO", "Chief Financial Officer")}
TITLE_WORDS = r"\b(?:Vice|President|Officer|Executive|Chief|Chair|Chairman|Treasurer|Senior|Corporate)\b"
WITHIN = 7
LEAST_COSINE = 0.55

_HEADER = re.compile(r"\[(\d{2,3}):(\d{2})[-–](\d{2,3}):(\d{2})\][ \t]+(\S.*)")


def timed_turns(text: str | None) -> list[dict]:
    """Turns under headers `[mm:ss-mm:ss] Name`: ordinal, speaker, start_sec, end_sec, text. What stands before the first header is in no turn; a turn may be empty."""
    out: list[dict] = []
    for line in (x.strip() for x in (text or "").split("\n")):
        if m := _HEADER.fullmatch(line):
            a, b, c, d = map(int, m.group(1, 2, 3, 4))
            out.append({"ordinal": len(out), "speaker": m[5], "start_sec": 60 * a + b, "end_sec": 60 * c + d, "text": []})
        elif out and line:
            out[-1]["text"].append(line)
    return [{**t, "text": " ".join(t["text"])} for t in out]


def timed_turn_documents(scripts: DataFrame, ids: list[str], text: str) -> DataFrame:
    """ids, ordinal, speaker, start_sec, end_sec, text of every turn. Each script stands alone, so rows that repeat give their turns again."""
    return exploded(scripts, ids, [text], timed_turns, "ordinal int, speaker string, start_sec int, end_sec int, text string")


def officer(text: Column, role: str) -> Column:
    """The name before an officer's title, titles and honorifics apart; null where there is none. A finance chief is looked for after the executive one."""
    title = "|".join(TITLES[role])
    head = F.regexp_extract(text, rf"(?s)^(.*?)\b(?:{title})\b", 1)
    if role == "cfo":
        head = F.regexp_replace(head, rf"(?s)^.*?\b(?:{'|'.join(TITLES['ceo'])})\b", "")
    named = F.filter(F.regexp_extract_all(head, F.lit(r"(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){1,3}),"), F.lit(1)), lambda n: ~n.rlike(TITLE_WORDS))
    return F.get(named, F.size(named) - 1)


def speaker_roles(segments: DataFrame, key: str, order: str, label: str, text: str, voices: DataFrame | None = None) -> DataFrame:
    """A row per call and speaker label: key, label, role, name, source.

    Whoever speaks first is the operator. Of the others' turns in order, neighbours of one label as one, the first is investor relations'; those
    after it up to the first that hands the call over belong to the chief executive, the next to the chief of finance; a label keeps its first role.
    Of the labels without a role the first to speak within seven segments of an announced question is an analyst, named by the earliest announcement.
    voices (key, label, role, name, cosine): the best match of 0.55 or more decides. All others are `other` and go by their label.
    Segments without a label count as one speaker's; a null text says nothing. Of equal places in a call the text decides.
    """
    call, placed = Window.partitionBy(key), ["__at"]
    said = F.coalesce(F.col(text), F.lit(""))
    rows = segments.select(key, F.coalesce(F.col(label), F.lit("")).alias("label"), said.alias("__said"), F.row_number().over(call.orderBy(order, said, label)).alias("__at"))
    rows = rows.withColumn("__first", F.first("label").over(call.orderBy(*placed)))
    blocks = islands(rows, [key], "__at", "label").where("label <> __first").groupBy(key, "label", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__said"))), lambda x: x["__said"]), " ").alias("__text"))
    blocks = blocks.withColumn("__n", F.row_number().over(call.orderBy("island")))
    blocks = blocks.withColumn("__handed", F.min(F.when((F.col("__n") > 1) & F.col("__text").rlike(HANDS_OVER), F.col("__n"))).over(call))
    intro = F.max(F.when(F.col("__n") == 1, F.col("__text"))).over(call)
    blocks = blocks.withColumns({"ceo": officer(intro, "ceo"), "cfo": officer(intro, "cfo")})
    n, handed = F.min("__n"), F.min("__handed")
    role = F.when(n == 1, "ir").when(handed.isNull() | (n <= handed), "ceo").when(n == handed + 1, "cfo")
    officers = blocks.groupBy(key, "label").agg(role.alias("role"), F.min("ceo").alias("ceo"), F.min("cfo").alias("cfo")).where("role IS NOT NULL")
    name = F.when(F.col("role") == "ir", "Investor Relations").when(F.col("role") == "ceo", F.col("ceo")).otherwise(F.col("cfo"))
    officers = officers.select(key, "label", "role", name.alias("name"))

    left = rows.join(officers.select(key, "label", "role"), [key, "label"], "left")
    free = F.when(F.col("role").isNull() & (F.col("label") != F.col("__first")), F.col("label"))
    asked = F.nullif(F.regexp_extract("__said", ANNOUNCES, 1), F.lit(""))
    picked = left.select(key, "__at", asked.alias("name"), F.first(free, ignorenulls=True).over(call.orderBy("__at").rowsBetween(1, WITHIN)).alias("label"))
    analysts = picked.where("name IS NOT NULL AND label IS NOT NULL").groupBy(key, "label").agg(F.min_by("name", "__at").alias("name")).select(key, "label", F.lit("analyst").alias("role"), "name")

    operators = rows.where("__at = 1").select(key, "label", F.lit("operator").alias("role"), F.lit("Operator").alias("name"))
    known = operators.unionByName(officers).unionByName(analysts).withColumn("source", F.lit("structural"))
    out = rows.select(key, "label").distinct().join(known, [key, "label"], "left")
    if voices is not None:
        best = voices.where(F.col("cosine") >= LEAST_COSINE).groupBy(key, "label").agg(F.max(F.struct("cosine", "name", "role")).alias("__voice"))
        out = out.join(best, [key, "label"], "left")
        heard = F.col("__voice").isNotNull()
        out = out.withColumns({c: F.when(heard, F.col(f"__voice.{c}")).otherwise(F.col(c)) for c in ("role", "name")} | {"source": F.when(heard, "voiceprint").otherwise(F.col("source"))})
    known = F.col("source").isNotNull()
    return out.select(key, "label", F.coalesce("role", F.lit("other")).alias("role"), F.when(known, F.col("name")).otherwise(F.col("label")).alias("name"), F.coalesce("source", F.lit("unknown")).alias("source"))
