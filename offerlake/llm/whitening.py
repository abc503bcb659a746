"""Embedding whitening by cyclic Jacobi.

Each entry c of a vector becomes the whole number x = floor(1024 * c) + 100000. One pass sums the
x by dimension, exactly; a second sums the products of the centred vectors, a matrix for each
partition, whose rows are then added up by row number. The driver holds the d x d covariance only
and turns it by symmetric Jacobi rotations until every off-diagonal entry vanishes beside the
diagonal ones, which keeps small eigenvalues accurate. The sorted, scaled eigenvectors go to all
tasks and a third pass writes the whitened vectors.

Defined cases: vectors that are null or hold null, NaN or infinite entries are dropped, as are those
whose x does not fit in 52 bits. All others must have one length: the one that most have, the longer
of two that are as common; vectors of another length are dropped. Rows that repeat are rows of their own, with
their weight in the covariance, and null ids stay null. A component without variance (of a
dimension that never changes, or of a single row) cannot be scaled: its `whitened` is null, and it
is left out of identity_error. A deviation above the range of a long is null. An empty table gives
an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of one matrix product.
ROWS = 4096
#: x must stay below, so that sums and doubles are exact.
_LARGEST = float(1 << 52)
_TINY = float(np.finfo(np.float64).eps)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable rows in the batch, and their entries as doubles; the batch's vectors are of one length and without null entries."""
    values = batch.column("v")
    d = len(values[0]) if len(values) else 0
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), d)
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.flatnonzero((np.isfinite(flat) & (np.abs(flat) < _LARGEST / SCALE)).all(axis=1))
    return good, flat[good]


def _whole(c: np.ndarray) -> np.ndarray:
    return np.floor(c * SCALE).astype(np.int64) + SHIFT


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors without null entries, of the most common length."""
    v = F.col("embedding").cast("array<double>")
    some = vectors.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LARGEST / SCALE)))
    lengths = some.filter(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return some.filter(F.size("v") == (lengths["d"] if lengths else -1))


def sums(usable: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of x in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            good, c = _vectors(b)
            if len(good):
                n, total = n + len(good), _whole(c).sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.record_batch({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array(total, pa.int64())})

    rows = usable.select("v").mapInArrow(run, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"], [r["s"] for r in rows]) if rows else (0, [])


def covariance(usable: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of x with divisor n; vectors are centred before they are multiplied."""
    mean = np.array([s / n for s in total])  # whole numbers divide to the nearest double

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for b in batches:
            _, c = _vectors(b)
            for k in range(0, len(c), ROWS):
                y = _whole(c[k : k + ROWS]) - mean
                whole = y.T @ y + (0 if whole is None else whole)
        if whole is not None:
            yield pa.record_batch({"i": pa.array(range(len(whole)), pa.int32()), "row": pa.array(list(whole), pa.list_(pa.float64()))})

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.vstack(b.column("row").to_numpy(zero_copy_only=False)).sum(axis=0) for b in batches)
        yield pa.record_batch({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})

    parts = usable.select("v").mapInArrow(scatter, "i int, row array<double>")
    rows = sorted((r["i"], r["row"]) for r in parts.groupBy("i").applyInArrow(added, "i int, row array<double>").collect())
    v = np.array([r for _, r in rows]) / n
    return (v + v.T) / 2


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d dimensions in rounds of disjoint pairs, as a tournament deals them."""
    order, out = list(range(d + d % 2)), []
    for _ in range(len(order) - 1):
        half = len(order) // 2
        pairs = [(min(p, q), max(p, q)) for p, q in zip(order[:half], reversed(order[half:])) if max(p, q) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        order = [order[0], order[-1], *order[1:-1]]
    return out


def jacobi(v: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    One sweep takes every pair of dimensions once and turns their plane so that their common entry
    becomes zero. Pairs of one round are disjoint and turned together. It ends when each entry is
    below the rounding of the root of its two diagonal entries' product. Signs are set so that the
    largest entry of a vector is positive.
    """
    a, u = np.array(v, dtype=np.float64), np.eye(len(v))
    scale = np.abs(a).max(initial=0.0)
    for _ in range(most):
        turned = False
        for p, q in rounds(len(a)):
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            act = np.abs(apq) > np.maximum(_TINY * np.sqrt(np.abs(app * aqq)), _TINY * _TINY * scale)
            if not act.any():
                continue
            turned = True
            p, q, apq, app, aqq = p[act], q[act], apq[act], app[act], aqq[act]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            rp, rq = a[p], a[q]
            a[p], a[q] = c[:, None] * rp - s[:, None] * rq, s[:, None] * rp + c[:, None] * rq
            cp, cq = a[:, p], a[:, q]
            a[:, p], a[:, q] = cp * c - cq * s, cp * s + cq * c
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            up, uq = u[:, p], u[:, q]
            u[:, p], u[:, q] = up * c - uq * s, up * s + uq * c
        if not turned:
            break
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    u = u[:, order]
    if len(u):
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return e[order], u


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, in whole numbers of any size; null where it is no long."""
    biggest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, total), default=0)) * 2
    if biggest < 1 << 62:
        off = n * x - np.array(total, np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
        off = off.astype(object)
    else:
        off = n * x.astype(object) - np.array(total, object)
    return [s if s < 1 << 63 else None for s in ((off * off).sum(axis=1))]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, w, explained, identity_error): one row for each vector, with w the array of whitened components."""
    spark = vectors.sparkSession
    usable = _usable(vectors)
    n, total = sums(usable)
    v = covariance(usable, n, total) if n else np.zeros((0, 0))
    e, u = jacobi(v)
    trace, k = float(np.trace(v)), min(components, len(e))
    full = e[:k] > (len(e) * _TINY * e[0] if k else 0)
    mean = np.array([s / n for s in total])
    # A null place of w stands for a component without variance.
    sent = spark.sparkContext.broadcast((u[:, :k] / np.sqrt(np.where(full, e[:k], 1.0)), full, mean, n, total))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, full, mean, n, total = sent.value
        for b in batches:
            good, c = _vectors(b)
            if len(good):
                x = _whole(c)
                w = (x - mean) @ turn
                flat = pa.array(w.ravel(), mask=np.tile(~full, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), flat)
                yield pa.record_batch([b.column("vec_id").take(pa.array(good)), pa.array(_deviations(x, n, total), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    white = stored(usable.mapInArrow(project, f"vec_id {dict(vectors.dtypes)['vec_id']}, deviation long, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k) if full[i] and full[j]]
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first() if pairs else []
    error = max((abs(c - (i == j)) for (i, j), c in zip(pairs, found)), default=None)
    explained = [float(x) / trace if trace else None for x in e[:k]]
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "w", F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def components(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """whiten() with one row for each vector and component, numbered from 1."""
    each = whiten(vectors, most).select("*", F.posexplode("w").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error")
