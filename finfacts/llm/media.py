"""Media columns: interleaved sequences of text and media references, with payloads stored apart and joined by digest.

HTML is parsed into an ordered sequence of structs (position, kind, text, digest, caption): runs of text, and media
references whose `src` is `media:sha256:<digest>`; a reference's caption is its own figure's caption, before or after it, else its alt
text. Payloads are stored once per digest and task as 8-bit mono WAV files in a table; the digest join resolves references to what
is read back from there. interleave() does that for pages: one row per page, its items in their order with the payloads' features.

Defined results: a null text counts as empty and has a payload of 64 zero bytes; equal texts share one stored form; a reference
without a stored payload stays in its place with null values; a caption ends with its figure, at the latest at the next block; one
outside of figures is text; a figure in a figure has its own caption; a script or style that isn't closed hides the rest of its
page, as in HTML; media without a src are passed over; rows that repeat an id each get a row; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

SOURCE = "media:sha256:"
UNIT = 64
SLICE = 128  #: rows that a worker turns into files at a time


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, zeros appended up to a positive multiple of 64; the bytes before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(data: bytes) -> bytes:
    """The samples. Chunks other than fmt and data are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy in bits and shares of eight equal ranges of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    ranges = counts.reshape(8, 32).sum(axis=1) / n
    return f"mean={mean:.6f};dev={spread:.6f};entropy={max(0.0, -float((p * np.log2(p)).sum())):.6f};ranges={','.join(f'{x:.4f}' for x in ranges)}"


BLOCKS = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Sequence(HTMLParser):
    """Ordered items of a page."""

    SKIPPED = frozenset(("script", "style"))
    MEDIA = frozenset(("img", "audio", "video", "source"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.skip = 0
        self.figures: list[tuple[list[int], list[str]]] = []  # of each open figure its media and its caption's parts
        self.captioning = False

    def flush(self) -> None:
        run = "".join(self.text).strip()
        self.text = []
        if run:
            self.items.append(["text", run, None, None])

    def end_figure(self) -> None:
        media, parts = self.figures.pop()
        said = "".join(parts).strip()
        for i in media if said else ():
            self.items[i][3] = said
        self.captioning = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.captioning = False
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.figures.append(([], []))
        elif tag == "figcaption":
            self.captioning = bool(self.figures)
        elif tag in self.MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            if self.figures:
                self.figures[-1][0].append(len(self.items))
            self.items.append(["media", None, src.removeprefix(SOURCE), dict(attrs).get("alt")])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.captioning = False
        elif tag == "figure" and self.figures:
            self.flush()
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.figures[-1][1] if self.captioning else self.text).append(data)

    def done(self) -> list[list]:
        self.close()
        self.flush()
        while self.figures:
            self.end_figure()
        return self.items


def sequence(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) of a page's items in their order."""
    parser = _Sequence()
    parser.feed(page or "")
    return [(i, *item) for i, item in enumerate(parser.done())]


def page_of(text: str | None, digest: str, caption: str) -> str:
    """A page with the text and, after its first line, one figure."""
    head, _, rest = html.escape(text or "", quote=False).partition("\n")
    return f'<article><p>{head}</p><figure><img src="{SOURCE}{digest}" alt=""><figcaption>{html.escape(caption)}</figcaption></figure><p>{rest}</p></article>'


def sequences(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """id, items: array of structs."""
    kind = dict(pages.select(F.col(id_column).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [[dict(zip(("position", "kind", "text", "digest", "caption"), x)) for x in sequence(h)] for h in pdf["html"]]
            yield pd.DataFrame({"id": pdf["id"], "items": items})

    told = pages.select(F.col(id_column).cast("string").alias("id"), F.col(html_column).alias("html")).mapInPandas(run, "id string, items array<struct<position:int,kind:string,text:string,digest:string,caption:string>>")
    return told.withColumn("id", F.col("id").cast(kind))  # pandas would turn integers with nulls into floats


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for pdf in batches:
        for i in range(0, len(pdf), SLICE):
            rows = []
            for text in pdf["text"].iloc[i : i + SLICE]:
                payload, _ = payload_of(text)
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(digest.digest())
                    rows.append((digest.hexdigest(), to_wav(payload)))
            yield pd.DataFrame(rows, columns=["digest", "media"])


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for media in pdf["media"]:
            payload = from_wav(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        yield out.assign(digest=pdf["digest"].to_numpy())


def _references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each document its page's media reference, and the lengths of the runs beside it; the runs must come back as they went in."""
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["text"]):
            payload, n = payload_of(text)
            head, _, rest = (text or "").partition("\n")
            found = sequence(page_of(text, hashlib.sha256(payload).hexdigest(), f"{n} bytes"))
            aligned = [x[2] for x in found if x[1] == "text"] == [x for x in (head.strip(), rest.strip()) if x]
            items = [{"position": x[0], "kind": x[1], "chars": len(x[2] or ""), "digest": x[3], "caption": x[4]} for x in found]
            rows += [(i, n, x[0], x[3], x[4], aligned, items) for x in found if x[1] == "media"]
        yield pd.DataFrame(rows, columns=["id", "n_bytes", "position", "digest", "caption", "aligned", "items"])


def store(docs: DataFrame, scratch: Scratch, text_column: str = "text") -> DataFrame:
    """Write the payload table (digest, media) and return its reader."""
    return scratch.table(docs.select(F.col(text_column).cast("string").alias("text")).mapInPandas(_stored, "digest string, media binary"), "media", "zstd")


def measured(media: DataFrame) -> DataFrame:
    """By digest what is read back of the stored payloads; only payloads that still have their digest count."""
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, digest string"
    return media.mapInPandas(_measured, fields).where("payload_sha256 = digest").dropDuplicates(["digest"])


def resolve(references: DataFrame, read: DataFrame) -> DataFrame:
    """References joined by digest with measured()'s rows."""
    return references.join(read, "digest", "left")


def documents_as_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its page's media reference, resolved."""
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.select(F.col(id_column).alias("id")).dtypes)["id"]
    texts = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    references = texts.mapInPandas(_references, "id string, n_bytes long, position int, digest string, caption string, aligned boolean, items array<struct<position:int,kind:string,chars:int,digest:string,caption:string>>")
    told = resolve(references, scratch.table(measured(store(docs, scratch, text_column)), "measured"))  # a table: Spark can split a hot digest's references
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "aligned", "items"]
    return scratch.finish(told.select(F.col("id").cast(kind).alias("doc_id"), *columns))


def interleave(pages: DataFrame, read: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: id, items (position, kind, text, digest, caption, payload_bytes, feature) in their order. read: measured()'s rows.

    Only references meet the payloads; a page's items are put in order again by their positions.
    """
    row = F.monotonically_increasing_id()  # ids may repeat
    scratch = Scratch(pages.sparkSession)
    told = scratch.table(sequences(pages, id_column, html_column).withColumn("row", row), "sequences")
    asked = told.select("row", F.inline("items")).where("kind = 'media'").select("row", "position", "digest")
    found = resolve(asked, read.select("digest", "payload_bytes", "feature")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("payload_bytes", "feature")))).alias("found"))
    item = lambda x: F.struct(*[x[c].alias(c) for c in ("position", "kind", "text", "digest", "caption")], *[F.element_at("found", x["position"])[c].alias(c) for c in ("payload_bytes", "feature")])
    return scratch.finish(told.join(found, "row", "left").select("id", F.transform("items", item).alias("items")))
