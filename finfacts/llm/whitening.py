"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, x = floor(scale * c). The distinct x vectors are the fit list: a table of packed blocks in the shared
folder. A step of the bidiagonalisation is one pass over it in which every task centres its rows, forms its part of u = Xv and then of
X'u; Spark sums the parts by dimension. u itself stays in the tasks: it is X times a vector w of one entry per dimension, so the
driver holds only w and X'u of each step, and both are orthogonalised in full against all steps before, as v is. The singular value
decomposition of the small bidiagonal matrix gives components and deviations. Where the space found is invariant, or could hide a repeated
value, the iteration starts again with a random direction orthogonal to it.

Nothing but sums by dimension comes to the driver. Numpy over Arrow batches in the tasks.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; entries that a vector lacks beside the
longest count as 0; rows that repeat an id each get rows; components whose variance is 0 (to rounding) don't exist, so a table of equal
vectors gives no rows, as an empty one does; equal deviations come in the order found; a deviation beyond a long is null; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import Scratch

BLOCK_MB = 4
#: Residuals of the wanted singular triplets, as a part of the largest value, at which the iteration may end.
TOLERANCE = 4e-15
LONG = 2**63


def whole_entries(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """Vectors as rows of whole numbers; absent entries are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(sizes), width), dtype=np.int64)
    x[np.arange(width) < sizes[:, None]] = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)), -(LONG - 1024), LONG - 1024).astype(np.int64)
    return x


def _keys(width: int, scale: float) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_entries(b.column("c"), width, scale)
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return keys


def _pack(width: int) -> Callable:
    most = max(1, (BLOCK_MB << 20) // (8 * width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            held += b.column("x").to_pylist()
            while len(held) >= most:
                yield pa.record_batch([pa.array([b"".join(held[:most])], pa.binary())], ["block"])
                held = held[most:]
        if held:
            yield pa.record_batch([pa.array([b"".join(held)], pa.binary())], ["block"])

    return pack


class Centre:
    """The exact mean S/n as a whole part and the rest over n; centred rows lose nothing to a large mean."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.rest = n, [s % n for s in sums]
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2 = (n*r - rest)^2, r = x - whole."""
        n, r = self.n, x - self.whole
        if max(abs(int(r.min(initial=0))), int(r.max(initial=0)), 1) * max(n, 1 << 20) * r.shape[1] >= 1 << 62:  # in Python's whole numbers
            r, rest = r.astype(object), np.array(self.rest, dtype=object)
        else:
            rest = np.array(self.rest, dtype=np.int64)
        fixed, pairs = sum(f * f for f in self.rest), zip((r * r).sum(axis=1).tolist(), (r * rest).sum(axis=1).tolist())
        all_ = [n * n * a - 2 * n * b + fixed for a, b in pairs]
        return [d if d < LONG else None for d in all_]


def _summed(blocks: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], long: bool = False) -> list:
    """Sums over all blocks of part(rows), an array; Spark adds the tasks' parts by place."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for block in b.column("block"):
                one = part(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, width))
                total = one if total is None else total + one
        if total is not None:
            flat = [str(x) for x in total.tolist()] if long else total
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(flat, pa.string() if long else pa.float64())], ["at", "value"])

    value = F.col("value").cast("decimal(38,0)") if long else F.col("value")
    got = blocks.mapInArrow(parts, f"at int, value {'string' if long else 'double'}").groupBy("at").agg(F.sum(value).alias("value")).collect()
    return [int(r["value"]) if long else r["value"] for r in sorted(got, key=lambda r: r["at"])]


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Number of rows, then sums by dimension, as Python's whole numbers."""
    safe = max(abs(int(x.min(initial=0))), int(x.max(initial=0))) < 1 << 40
    return np.array([len(x), *(x if safe else x.astype(object)).sum(axis=0).tolist()], dtype=object)


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, size: float, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling; product(w) is X'(Xw), size the Frobenius norm of X.

    u_j = X w_j; Z holds X'u_j, so that u_i'u = w_i'z needs no pass. A value below 1e-14 of size counts as 0.
    """
    rng, none = np.random.default_rng(seed), size * 1e-14
    v_all, w_all, z_all, alphas, betas, starts = [], [], [], [], [], [0]

    def fresh() -> np.ndarray:
        v = rng.standard_normal(width)
        for _ in range(2):
            for q in v_all:
                v -= q * (q @ v)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    while True:
        w = v - (beta * w_all[-1] if w_all else 0.0)
        z = product(w)
        if w_all:
            w_old, z_old = np.array(w_all), np.array(z_all)
            c = w_old @ z
            w, z = w - c @ w_old, z - c @ z_old
        alpha = float(np.sqrt(max(w @ z, 0.0)))
        dead = alpha <= none
        v_all.append(v)
        alphas.append(0.0 if dead else alpha)
        betas.append(beta)
        w_all.append(np.zeros(width) if dead else w / alpha)
        z_all.append(np.zeros(width) if dead else z / alpha)
        k = len(v_all)
        v = z_all[-1].copy()
        for _ in range(2):
            for q in v_all:
                v -= q * (q @ v)
        beta = float(np.linalg.norm(v))
        b = np.diag(alphas) + np.diag(betas[1:], 1)
        for start in starts[1:]:  # what the row before a new start still has in the directions after it
            b[start - 1, start:] = np.array(v_all[start:]) @ z_all[start - 1]
        left, s, right = np.linalg.svd(b)
        if k == width:
            break
        residuals, top = np.linalg.norm(np.array(z_all).T @ left - np.array(v_all).T @ right.T * s, axis=0), min(wanted, k)
        last = np.linalg.norm(right[:, starts[-1] :], axis=1) > 0.5
        settled = k >= wanted and bool((residuals[:top] <= tolerance * s[0]).all())
        gave = bool(last[:top].any())  # a stretch that gave a wanted value may have left another copy of it behind
        if settled and not gave and k - starts[-1] >= 8 and not (s + residuals)[last].max() >= s[top - 1]:
            break
        if beta <= none or (settled and gave):
            v, beta = fresh(), 0.0
            starts.append(k)
        else:
            v = v / beta
    return s, np.array(v_all).T @ right.T


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """A row per kept row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    c = F.col(vector_column).cast("array<double>")
    finite = F.forall(c, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    kept = vectors.where(F.col(vector_column).isNotNull() & finite).select(F.col(id_column).alias("id"), c.alias("c"))
    width = kept.agg(F.max(F.size("c"))).first()[0] or 0
    out = StructType([*kept.select("id").schema.fields, *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if not width:
        return spark.createDataFrame([], out)
    blocks = scratch.table(kept.select("c").mapInArrow(_keys(width, scale), "x binary").distinct().mapInArrow(_pack(width), "block binary"), "fit", "zstd")
    n, *sums = _summed(blocks, width, exact_sums, long=True)
    centre = Centre(n, sums)
    trace = _summed(blocks, width, lambda x: np.array([(centre.rows(x) ** 2).sum()]))[0]

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            return rows.T @ (rows @ w)

        return np.array(_summed(blocks, width, part))

    if trace <= 0:
        scratch.drop()
        return spark.createDataFrame([], out)
    values, vectors_ = bidiagonalise(product, width, components, float(np.sqrt(trace)))
    count = min(components, int((values > 1e-10 * values[0]).sum()))
    deviation = values[:count] / np.sqrt(n)
    turn = vectors_[:, :count] / deviation
    moments = lambda rows: np.concatenate([(rows @ turn).sum(axis=0), ((rows @ turn).T @ (rows @ turn)).ravel()])
    seen = np.array(_summed(blocks, width, lambda x: moments(centre.rows(x)))) / n
    mean, second = seen[:count], seen[count:].reshape(count, count)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())
    explained = values[:count] ** 2 / trace
    scratch.drop()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_entries(b.column("c"), width, scale)
            rows = np.repeat(np.arange(len(x)), count)
            one = lambda v, t: pa.array(v, t)
            yield pa.record_batch(
                [
                    b.column("id").take(pa.array(rows)), one(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), one(np.full(len(rows), n), pa.int64()), one(centre.deviations(x), pa.int64()).take(pa.array(rows)),
                    one((centre.rows(x) @ turn).ravel(), pa.float64()), one(np.tile(explained, len(x)), pa.float64()), one(np.full(len(rows), error), pa.float64()),
                ],
                out.names,
            )

    return kept.mapInArrow(project, out)
