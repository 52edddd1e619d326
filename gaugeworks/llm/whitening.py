"""Whitening of embeddings by a randomised range finder.

Entries become whole numbers, x = floor(scale * c) + shift, and each distinct vector of
them counts once. The covariance V of those rows is never built to begin with: a random
block Q of (components + oversampling) columns is multiplied by V in passes over all
centred rows (V Q = sum of a (a' Q) / n), made orthonormal after each, and the
eigenvectors of Q' V Q (Rayleigh-Ritz) give candidates. They are taken once every residual
|V u - e u| is below a fixed small share of its eigenvalue e; a spectrum without a
gap behind the last column is never resolved that way, so after a fixed number of passes
the block is expanded to the full dimension, for which one pass makes the result exact.

A pass is one job over the rows: a task adds up its own rows' product and gives one matrix
of dimension x columns; 64 tasks' matrices at a time are added in tasks, the sums of those
on the driver. What reaches the driver never holds a row.

Defined results: vectors that are null, empty, or hold a null, a non-finite entry or one
whose whole number has no 64 bits are dropped, and so are those of another length than
most (of equally many the longer). Components whose variance is at most 1e-12 of the
whole are no directions of the data and give no rows; so one distinct vector, or none,
gives no rows. Repeated rows and ids and null ids each keep their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import materialize

COMPONENTS, OVERSAMPLING, POWER_PASSES = 16, 10, 4
SCALE, SHIFT = 64, 1_000_000
#: Largest residual of an eigenvector, as a share of its eigenvalue.
TOLERANCE = 1e-13
#: Variance, as a share of the whole, up to which a component is none.
FLAT = 1e-12
#: Whole numbers stay within this distance of the shift.
LARGEST = 1 << 61
#: Tasks' matrices that are added in one task; rows that are centred at once.
FAN_IN, ROWS = 64, 8192


def whole(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(`keep` columns, x array<long>) of the vectors that count."""
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale) + shift)
    fits = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False)))
    return rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(fits).select(*keep, scaled.alias("x"))


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: columns of `axes` are components, `variances` their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0


def _matrix(batch: pa.Array, dim: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n, from the exact n x - S."""
    return (exact(x, n, sums) / n).astype(float)


def exact(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S; in Python's whole numbers where 64 bits are too few."""
    held = max(map(abs, sums), default=0) + n * int(np.abs(x).max(initial=0))
    kind = np.int64 if held < 1 << 63 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _added(rows: DataFrame, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """The sum of of(x) over blocks of all rows, in the order of the tasks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(shape), TaskContext.get().partitionId()
        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                total += of(_matrix(b.column(0).slice(first, ROWS), dim))
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "sums"])

    def some(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values("part")
        return pd.DataFrame({"part": [ordered["part"].iloc[0]], "sums": [reduce(np.add, ordered["sums"])]})

    made = rows.select("x").mapInArrow(own, "part long, sums array<double>")
    grouped = made.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(some, "part long, sums array<double>")
    found = sorted((r["part"], r["sums"]) for r in grouped.collect())
    return sum((np.array(s) for _, s in found), np.zeros(shape[0] * shape[1])).reshape(shape)


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, oversampling: int = OVERSAMPLING, power_passes: int = POWER_PASSES, tolerance: float = TOLERANCE, seed: int = 42, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None]:
    """The whole-number rows' dimension filter applied to `rows` (with all their columns and
    x), and the whitening; None where no vector counts."""
    other = [c for c in rows.columns if c.lower() != "x"]
    x = whole(rows, vector_col, scale, shift, tuple(other))
    lengths = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return x, None
    dim = int(lengths["dim"])
    x = x.where(F.size("x") == dim)
    once = materialize(x.select("x").distinct(), "whitening-rows")
    n = once.count()
    per = once.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    sums = tuple(int(r["s"]) for r in sorted(per, key=lambda r: r["at"]))

    def times(q: np.ndarray) -> np.ndarray:
        """V q, by a pass over all centred rows."""

        def block(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, sums)
            return a.T @ (a @ q)

        return _added(once, q.shape, block, dim) / n

    total = float(_added(once, (1, 1), lambda x: np.array([[np.square(centred(x, n, sums)).sum()]]), dim)[0, 0]) / n
    wanted, width = min(components, dim), min(components + oversampling, dim)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    for step in range(power_passes + 2):
        if step == power_passes + 1 and width < dim:  # the residuals failed: all directions
            q = np.linalg.qr(np.hstack([q, np.random.default_rng(seed + 1).standard_normal((dim, dim - width))]))[0]
        vq = times(q)
        values, turns = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        order = np.argsort(-values, kind="stable")[:wanted]
        axes, variances = q @ turns[:, order], values[order]
        residuals = np.linalg.norm(vq @ turns[:, order] - axes * variances, axis=0)
        if q.shape[1] == dim or (residuals <= tolerance * np.maximum(variances, 0)).all():
            break
        q = np.linalg.qr(vq)[0]
    real = variances > FLAT * total
    axes, variances = axes[:, real], variances[real]
    axes = axes / np.linalg.norm(axes, axis=0)
    found = Whitening(n, sums, axes, variances, total)
    return x, Whitening(n, sums, axes, variances, total, _identity_error(once, found, dim))


def _identity_error(once: DataFrame, w: Whitening, dim: int) -> float:
    """The largest entry of |covariance of the whitened rows - identity|, over all rows."""
    k = len(w.variances)
    if not k:
        return 0.0
    to = w.axes / np.sqrt(w.variances)

    def block(x: np.ndarray) -> np.ndarray:
        z = centred(x, w.n, w.sums) @ to
        return np.vstack([z.T @ z, z.sum(axis=0)])

    both = _added(once, (k + 1, k), block, dim) / w.n
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(`id_col`, component from 1, n, deviation: exact sum of (n x - S)^2, null beyond 64
    bits, whitened, explained, identity_error): a row for each vector that counts and each
    component. Scoring is one pass over `rows` in place."""
    known, w = fit(rows, vector_col, **settings)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.variances):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim, k, to = len(w.sums), len(w.variances), w.axes / np.sqrt(w.variances)
    explained = w.variances / w.total

    def deviation(d: np.ndarray) -> list[int | None]:
        if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * dim < 2**62:
            return np.square(d).sum(axis=1).tolist()
        exactly = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v < 1 << 63 else None for v in exactly]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, ROWS // k + 1):
                part = b.slice(first, ROWS // k + 1)
                d = exact(_matrix(part.column("x"), dim), w.n, w.sums)
                z, m = (d / w.n).astype(float) @ to, part.num_rows
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch([
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array(deviation(d), pa.int64()).take(at), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error)),
                ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return known.select(F.col(id_col).alias("id"), "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
