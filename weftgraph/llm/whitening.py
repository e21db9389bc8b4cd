"""Whitening of embeddings: distributed centred scatter, cyclic Jacobi on the driver, a broadcast projection.

Entries become whole numbers, x = floor(scale * c). The fit list holds each distinct x vector once, so copies weigh nothing: their number n
and sums S per dimension are exact. In a second pass every task centres its vectors at S/n before it multiplies, and adds up one d x d
scatter; Spark adds those cell by cell. The driver diagonalises the covariance V by cyclic Jacobi rotations, disjoint pairs at
a time, until every off-diagonal entry is vanishingly small beside the geometric mean of its two diagonal ones; this bound, relative to
each pair, is what keeps small eigenvalues accurate. Components are sorted by falling eigenvalue, scaled by its root, and broadcast. A last pass
over the fit list measures how far the whitened covariance is from the identity.

What reaches the driver, or is broadcast, are d x d numbers; `MOST_DIMENSIONS` bounds d (128 MB), and longer vectors are an error.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are empty vectors and those of another length than most (ties:
the longer ones). Zero vectors stay. Null and repeated ids are rows like any other. A component whose eigenvalue is not above `LEAST` of the largest has no
direction to scale: its whitened values are null, and it is left out of the identity error (null if none is left). With fewer dimensions than components,
all dimensions are returned; no valid row gives no rows. A deviation that no 64-bit number holds is null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import written

SCALE, COMPONENTS = 256, 4
#: Longest vector; share of the largest eigenvalue under which there is nothing to scale; sweeps of rotations at most.
MOST_DIMENSIONS, LEAST, SWEEPS = 4096, 1e-13, 60
#: Vectors that a task multiplies at once.
BATCH = 4096


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix."""
    n, eps = len(a), np.finfo(np.float64).eps
    m = n + n % 2  # an idle partner for the last one
    a = np.pad((a + a.T) / 2, (0, m - n))
    v, ring = np.eye(m), np.arange(m)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(m - 1):  # a round of disjoint pairs; all pairs meet once in a sweep
            p, q = ring[: m // 2], ring[m // 2 :][::-1]
            off, d = a[p, q], np.abs(a[p, p] * a[q, q])
            rotate = np.abs(off) > eps * np.sqrt(d)
            rotate &= np.abs(off) > np.finfo(np.float64).tiny
            if rotate.any():
                turned = True
                p, q, off = p[rotate], q[rotate], off[rotate]
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for x in (a, v):
                    x[:, p], x[:, q] = c * x[:, p] - s * x[:, q], s * x[:, p] + c * x[:, q]
                a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
                a[p, q] = a[q, p] = 0
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    values = np.diag(a)[:n]
    order = np.argsort(-values, kind="stable")
    return values[order], v[:n, :n][:, order]


def whole_numbers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.when(good & (F.size(v) > 0), v.cast("array<double>")).alias("v")).where("v IS NOT NULL")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    d = size["n"] if size else 1
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries: {MOST_DIMENSIONS} at most")
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(F.lit(scale) * c)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(rows: DataFrame, d: int, project: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor: number of rows) of (x - centre) @ weights over `rows`, each task's products added up before they travel."""
    centre, weight = project
    k = weight.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(project)  # d x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                y = (_matrix(batch.column(0).slice(lo, BATCH), d) - shared.value[0]) @ shared.value[1]
                n, total, scatter = n + len(y), total + y.sum(0), scatter + y.T @ y
        if n:
            cells = np.concatenate([[n], total, scatter[np.triu_indices(k)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.zeros(1 + k + k * (k + 1) // 2)
    for row in cells.collect():  # k x k numbers
        found[row.cell] = row.value
    n, mean = found[0], found[1 : k + 1] / found[0]
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = found[k + 1 :] / n
    cov = cov + np.triu(cov, 1).T
    return mean, cov - np.outer(mean, mean)  # the centre is the mean but for rounding


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and whole-number sums per dimension, added up in each task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            safe = len(x) * (np.abs(x.astype(np.float64)).max(initial=0) + 1) < 2**62
            own = x.sum(0) if safe else x.astype(object).sum(0)
            n, total = n + len(x), [a + b for a, b in zip(total, own.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], names=["cell", "value"])

    cells = rows.select("x").mapInArrow(run, "cell int, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value"))
    found = {row.cell: int(row.value) for row in cells.collect()}  # d + 1 numbers
    return found[0], [found[j + 1] for j in range(d)]


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict | None:
    """n, sums S (whole numbers), eigenvalues, scaled components (d x k), explained shares and identity error; None without rows."""
    distinct = written(rows.select("x").distinct())
    d = distinct.select(F.size("x").alias("d")).first()
    if d is None:
        return None
    d = d["d"]
    n, sums = exact_sums(distinct, d)
    centre = np.array([s / n for s in sums])  # of whole numbers, rounded once
    _, cov = moments(distinct, d, (centre, np.eye(d)))
    values, vectors = jacobi(cov)
    k = min(components, d)
    useful = values[:k] > max(LEAST * values[0], 0)
    weight = vectors[:, :k] / np.sqrt(np.where(useful, values[:k], 1))
    _, white = moments(distinct, d, (centre, weight))
    gap = np.abs(white - np.eye(k))[np.ix_(useful, useful)]
    trace = np.trace(cov)
    share = values[:k] / trace if trace > 0 else np.zeros(k)
    return {"n": n, "sums": sums, "centre": centre, "values": values, "weight": weight, "useful": useful, "explained": share, "error": float(gap.max()) if gap.size else None}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S) squared of each row; None beyond 64 bits."""
    most = n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, sums))
    if x.shape[1] * most * most < 2**63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    out = (sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in out]


def whiten(rows: DataFrame, model: dict | None) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of each row."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # d x k numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, k = m["weight"].shape
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                x = _matrix(part.column(1), d)
                rows_, of = len(x), np.repeat(np.arange(len(x)), k)
                white = pa.array(((x - m["centre"]) @ m["weight"]).ravel(), mask=np.tile(~m["useful"], rows_))
                far = pa.array(deviations(x, m["n"], m["sums"]), pa.int64()).take(pa.array(of))
                each = lambda v, t: pa.array([v] * (rows_ * k), t)
                cols = [part.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)), each(m["n"], pa.int64()), far, white]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(m["explained"], rows_)), each(m["error"], pa.float64())], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "x").mapInArrow(run, schema)


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part."""
    rows = whole_numbers(embeddings)
    return whiten(rows, fit(rows)).withColumnRenamed("id", "vec_id")
