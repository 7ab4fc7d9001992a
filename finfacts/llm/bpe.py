"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's pairs wait in buckets, one per merge rank; a bucket holds positions of a linked list, the leftmost first.
Three levels of 64-bit words mark the ranks whose buckets have entries; find-first-set on each level picks
the next rank. A merge relinks the list and files the two new pairs; entries that no longer name a live pair of that rank are stale
and skipped when they come up. A pre-token of n bytes takes O(n log n) steps, however long it is.

Defined results: a null text counts as empty (no ids); an empty table gives no rows; rows that repeat an id each get a row;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RankQueue:
    """Positions by rank; the lowest rank's leftmost position comes first. Empty again after each pre-token."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)  # words of 64 ranks
        self.mid = [0] * ((ranks >> 12) + 1)  # words of 64 low words; the third level is one number, a bit for each of these


class Encoder(dict):
    """Encodes by ranks (bytes -> rank). As a dict it keeps (number of ids, ids as text, bytes they are decoded to) by pre-token; emptied when grown."""

    MOST_KEPT, LONGEST_KEPT = 1_000_000, 40

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        # White space as in Unicode's property, which the four separators U+001C to U+001F haven't.
        self.ranks, self.split = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0))

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token. The queue's push and pop are written out here: calls would cost as much as the work."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        queue, rank_of = self.queue, ranks.get
        buckets, low, mid, top = queue.buckets, queue.low, queue.mid, 0
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # the next symbol's start, the one's before
        filed = [-1] * n  # the rank by which a symbol's pair with its successor waits
        new = [(i, rank_of(piece[i : i + 2], -1)) for i in range(n - 1)]
        while True:
            for i, rank in new:
                filed[i] = rank
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        a = rank >> 6
                        if not low[a]:
                            mid[a >> 6] |= 1 << (a & 63)
                            top |= 1 << (a >> 6)
                        low[a] |= 1 << (rank & 63)
            while top:
                b = (top & -top).bit_length() - 1
                word = mid[b]
                a = b << 6 | (word & -word).bit_length() - 1
                word = low[a]
                rank = a << 6 | (word & -word).bit_length() - 1
                bucket = buckets[rank]
                if len(bucket) > 1:
                    i = heappop(bucket)
                else:
                    i = bucket[0]
                    del buckets[rank]
                    low[a] = word = word & (word - 1)
                    if not word:
                        mid[b] = word = mid[b] & (mid[b] - 1)
                        if not word:
                            top &= top - 1
                if filed[i] == rank:
                    break
            else:
                break
            j = after[i]
            k = after[i] = after[j]
            filed[j] = filed[i] = -1
            h = before[i]
            new = []
            if k < n:
                before[k] = i
                new.append((i, rank_of(piece[i : after[k]], -1)))
            if h >= 0:
                new.append((h, rank_of(piece[h:k], -1)))
        ids, i = [], 0
        while i < n:
            k = after[i]
            ids.append(ranks[piece[i:k]])
            i = k
        return ids

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        out = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(piece) <= self.LONGEST_KEPT:
            if len(self) >= self.MOST_KEPT:
                self.clear()
            self[piece] = out
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.merge(piece.encode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes that the ids are decoded to."""
        sizes, ids, back = zip(*map(self.__getitem__, self.split(text))) if text else ((), (), ())
        return sum(sizes), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_ENCODERS: dict[str, Encoder] = {}


def digest_of(ranks: dict[bytes, int], pattern: str) -> str:
    """Names a vocabulary: SHA-256 of all its entries and the pattern."""
    told = hashlib.sha256(pattern.encode())
    for token, rank in sorted(ranks.items()):
        told.update(b"%d %d " % (len(token), rank) + token)
    return told.hexdigest()


def _encoder(ranks: dict[bytes, int], pattern: str, name: str) -> Encoder:
    """This worker's encoder. Python workers find this function by its module, so what it keeps serves all their tasks."""
    if name not in _ENCODERS:
        _ENCODERS.clear()  # one vocabulary at a time bounds a worker's memory
        _ENCODERS[name] = Encoder(ranks, pattern)
    return _ENCODERS[name]


def _with_encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str, of_text, schema: str, id_column: str, text_column: str) -> DataFrame:
    """Apply of_text(encoder, text) -> tuple to each text; a worker builds the encoder once."""
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern, digest_of(ranks, pattern)))  # bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*held.value)
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = [of_text(encoder, t or "") for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = docs.select(F.col(id_column)).dtypes[0][1]  # ids go as strings: pandas would turn integers with nulls into floats
    told = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInPandas(run, f"doc_id string, {schema}")
    return told.withColumn("doc_id", F.col("doc_id").cast(kind))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids."""
    return _with_encoder(docs, ranks, pattern, lambda e, t: (e.encode(t),), "ids array<int>", id_column, text_column)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, bytes of encoded rows (doc_id, ids)."""
    held = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bytes": [b"".join([held.value[i] for i in ids]) for ids in pdf["ids"]]})

    return encoded.mapInPandas(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again."""
    return _with_encoder(docs, ranks, pattern, lambda e, t: e.digest(t), "n_tokens long, ids_sha256 string, decoded_sha256 string", id_column, text_column)
