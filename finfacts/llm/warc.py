"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: records with equal payloads are one group; the largest id writes the response, the others write
revisits that carry the HTTP headers without the payload, so only the response's row carries its html to the writer. Spark's text
writer ends each record with CR LF CR LF. Records are written by classes of size, so that the bytes of an archive are bounded.

Reading: a task looks at every place of an archive that has a WARC version line, in payloads too, and emits a candidate
with its offset and the offset of its successor. Pointer jumping from the file's start (the reached set is sent on along
jumps that double in length) keeps only reachable records: a version line within a payload starts no record, though it
may look like one. Payloads are read back and digested anew.

Defined results: a null html counts as empty; a null id is written as an empty id, read back as null, and becomes a revisit where its
group has an id; ids are whole numbers; rows that repeat the response's id are responses too; an empty table gives no records; a null url is an empty one;
a record cut off at a file's end is no record; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, text_of

END = "\r\n\r\n"
START = re.compile(rb"WARC/1\.[01]\r\n")
HEAD_END = re.compile(rb"\r\n\r\n")
#: Payloads up to so many bytes go in archives of so many records; longer ones are alone in theirs. Bounds what a task reads at a time.
CLASSES = ((1 << 16, 1_000), (1 << 20, 64))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, refers: str | None, payload: bytes | None, size: int | None = None, sha1: str | None = None) -> str:
    """A record without its end. A revisit has its payload's size and SHA-1 (hex) instead of the payload."""
    size, digest = (size, base64.b32encode(bytes.fromhex(sha1)).decode()) if payload is None else (len(payload), base32_sha1(payload))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}".encode()
    block = http + payload if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head) + END + block.decode("utf-8", "surrogatepass")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), 256):
            part = pdf.iloc[i : i + 256]
            told = zip(part["page"], part["url"], part["refers"], part["html"], part["n"], part["sha1"])
            yield pd.DataFrame({"value": [record(p or "", u, r, None if t is None else t.encode("utf-8", "surrogatepass"), n, h) for p, u, r, t, n, h in told]})


def write(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Write a record for each row, in gzipped archives in folders under path."""
    html = text_of(html_column)
    scratch = Scratch(pages.sparkSession)
    payloads = pages.select(F.col(id_column).cast("long").alias("id"), text_of(url_column).alias("url"), F.sha2(html, 256).alias("same"), F.octet_length(html).alias("n"), F.sha1(html).alias("sha1"), html.alias("html"))
    # Tables on both sides of the join on equal payloads, without their html: Spark can split a hot payload's rows.
    slim = scratch.table(payloads.drop("html"), "slim")
    heads = scratch.table(slim.groupBy("same").agg(F.max("id").alias("head")), "heads")
    tag = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("+"), F.coalesce(c.cast("string"), F.lit("")))
    first = heads.select("same", tag(F.col("head")).alias("tag"))
    responses = payloads.withColumn("tag", tag(F.col("id"))).join(first, ["same", "tag"], "left_semi").withColumn("refers", F.lit(None).cast("string"))
    revisits = slim.join(heads, "same").where(F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))).withColumn("html", F.lit(None).cast("string")).withColumn("refers", F.col("head").cast("string"))
    fields = [F.col("id").cast("string").alias("page"), "url", "refers", "html", "n", "sha1"]
    last = 0
    for k, (most, per_file) in enumerate((*CLASSES, (None, 1))):
        sized = F.col("n") >= last if most is None else F.col("n").between(last, most)
        rows = responses.where(sized).select(*fields)
        if not k:
            rows = rows.unionByName(revisits.select(*fields))
        rows.mapInPandas(_records, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/size{k}")
        last = (most or 0) + 1
    scratch.drop()


def _field(head: bytes, name: bytes) -> str:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else ""


def candidates(data: bytes) -> list[tuple]:
    """(offset, successor, page, kind, refers, payload bytes, digest) of each place that reads like a record.

    One walk over all version lines and all empty lines. A header with another version line in it is none, so headers don't overlap; a
    payload within the one of the last record that the file's own order reaches isn't digested. A response whose payload
    doesn't have its stated digest is no record.
    """
    starts, ends, out = [m.start() for m in START.finditer(data)], [m.start() for m in HEAD_END.finditer(data)], []
    k, walked = 0, 0
    number = lambda x: d[1] if (d := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    for start, following in zip(starts, [*starts[1:], len(data)]):
        while k < len(ends) and ends[k] < start:
            k += 1
        if k == len(ends) or ends[k] > following:
            continue
        head, body = data[start : ends[k] + 2], ends[k] + 4
        length = _field(head, b"Content-Length")
        if not length.isdigit() or body + int(length) + 4 > len(data):
            continue
        end = body + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            continue
        kind, page, digest = _field(head, b"WARC-Type"), _field(head, b"WARC-Record-ID"), _field(head, b"WARC-Payload-Digest").removeprefix("sha1:")
        split = k + 1
        split = ends[split] if split < len(ends) and ends[split] < end else -1  # the HTTP header's end
        if kind == "response":
            payload = data[split + 4 : end] if split >= 0 else data[body:end]
            size = len(payload)
            if start >= walked and digest != base32_sha1(payload):
                continue
        else:
            stated = _field(data[body : split + 2] if split >= 0 else data[body:end], b"Content-Length")
            size = int(stated) if stated.isdigit() else 0
        if start == walked:
            walked = end + 4
        out.append((start, end + 4, number(page), kind, number(_field(head, b"WARC-Refers-To")), size, digest))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            out = pd.DataFrame(candidates(data), columns=["at", "next", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])
            yield out.assign(file=path)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which offsets a chain of successors from 0 reaches, by pointer jumping."""
    order = np.argsort(at, kind="stable")
    place = np.searchsorted(at, after, sorter=order)
    n = len(at)
    found = np.where(place < n, order[np.minimum(place, n - 1)], n)
    jump = np.append(np.where((found < n) & (at[np.minimum(found, n - 1)] == after), found, n), n)  # n: nowhere
    reached = np.append(at == 0, False)
    for _ in range(max(1, n.bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[reachable(pdf["at"].to_numpy(), pdf["next"].to_numpy())].drop(columns=["file", "at", "next"])


def read(spark, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of every record under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    fields = "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"  # ids as strings: pandas would turn integers with nulls into floats
    told = files.mapInPandas(_scan, f"at long, next long, {fields}, file string")
    kept = told.groupBy("file").applyInPandas(_chain, fields)
    return kept.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back: one row per page."""
    scratch = Scratch(pages.sparkSession)
    path = scratch.path("archives")
    write(pages, path)
    return scratch.finish(read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
