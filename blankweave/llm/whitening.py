"""Embedding whitening by spectral divide-and-conquer on the polar decomposition (QDWH).

1. *Fit list.* Every entry c becomes the whole number floor(256 c); each distinct vector
   counts once. Its sums are added as exact decimals, its covariance is centred before
   multiplying and added up over blocks of vectors. Only sums of dimensions by dimensions
   numbers reach the driver.
2. *Spectrum.* The covariance less a shift inside its spectrum has a polar factor U, found by
   the dynamically weighted Halley iteration with QR factors; (U + I) / 2 projects on the
   components above the shift. Its range and what is orthogonal to it are invariant, so the
   covariance splits in two, each part is treated alike, and what stays are eigenvectors.
3. *Whitening.* The mean and the first components, a table of dimensions by COMPONENTS
   numbers, go to all tasks, which project all rows.

Defined results: rows go whose vector is null or empty, holds a null or non-finite entry, has
another length than most vectors (the longer, if two lengths are as frequent) or an entry
whose 256-fold is no 64-bit number; repeated rows are each returned and count once in the
fit; a null vec_id is returned; there are as many components as dimensions at most, and a
component of eigenvalue zero (up to rounding) has null for whitened; explained is null if the trace is
zero; a deviation beyond 64 bits is null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SCALE, COMPONENTS = 256, 4
#: Eigenvalues below this share of the trace are rounding.
ZERO = 1e-13
ROUNDS = 12


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH with QR factors."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = 1e-16
    for _ in range(ROUNDS):
        low2 = min(low * low, 1.0)
        d = np.cbrt(4 * (1 - low2) / low2**2)
        wa = np.sqrt(1 + d) + np.sqrt(max(8 - 4 * d + 8 * (2 - low2) / (low2 * np.sqrt(1 + d)), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate((np.sqrt(wc) * x, np.eye(n))))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * low2) / (1 + wc * low2), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 1e-15 and moved < 1e-14 * n:
            break
    return x


def _halves(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces; None if no shift tells two groups of eigenvalues apart."""
    n, rng = len(a), np.random.default_rng(5)
    diagonal, best = np.sort(np.diag(a)), None
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 1e-15 * size:
        return None
    for shift in (np.median(diagonal), mean, mean + spread / 3, mean - spread / 3, mean + spread / 7, mean - spread / 7):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        basis = rng.standard_normal((n, k))
        for _ in range(2):
            basis, _ = np.linalg.qr(projector @ basis)
        whole, _ = np.linalg.qr(basis, mode="complete")
        upper, lower = whole[:, :k], whole[:, k:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = left, upper, lower
        if left <= 1e-14 * n * size:
            break
    return best and best[1:]


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, and unit eigenvectors as columns; each one's greatest entry is positive."""
    size = max(float(np.linalg.norm(covariance)), np.finfo(float).tiny)
    values, vectors = [], []
    todo = [np.eye(len(covariance))]
    while todo:
        basis = todo.pop()
        part = basis.T @ covariance @ basis
        halves = _halves((part + part.T) / 2, size) if basis.shape[1] > 1 else None
        if halves:
            todo += [basis @ half for half in halves]
            continue
        for i in range(basis.shape[1]):
            values.append(float(basis[:, i] @ covariance @ basis[:, i]))
            vectors.append(basis[:, i])
    order = np.argsort(-np.array(values), kind="stable")
    v = np.array(vectors).reshape(len(values), -1)[order].T
    v = v / np.linalg.norm(v, axis=0)
    return np.array(values)[order], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def whole_vectors(table: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows that take part, with whole numbers for entries."""
    entries = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**63 / SCALE))
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector)).where(F.coalesce((F.size(vector) > 0) & fits, F.lit(False)))
    usual = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(vector) == (usual["d"] if usual else 0)).select("vec_id", entries.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(parts: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of (i, j, value) over all tasks."""
    return {(r["i"], r["j"]): r["value"] for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toLocalIterator()}


_CELL = shared.fields(("i", T.IntegerType()), ("j", T.IntegerType()), ("value", T.DoubleType()))


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(sums.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.reshape(-1), pa.int32()), pa.array(j.reshape(-1), pa.int32()), pa.array(sums.reshape(-1))], names=_CELL.names)


class Whitening:
    """The mean (as whole part and rest), the first components and what they explain."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, count: int):
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s % n, n)) for s in sums])
        self.count = min(count, len(values))
        self.values, self.vectors, self.trace = values[: self.count], vectors[:, : self.count], trace
        self.usable = self.values > ZERO * max(trace, 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 in whole numbers."""
        far = max(float(np.abs(x.astype(np.float64)).max(initial=0)) * self.n, max(map(abs, map(float, self.sums)), default=0.0)) * 2
        if far * far * max(1, x.shape[1]) < 2.0**62:
            d = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, count: int = COMPONENTS) -> tuple[Whitening | None, float | None]:
    """The whitening of the distinct vectors ``x``, and the greatest entry of the whitened covariance less the identity."""
    listed = shared.cut(vectors.select("x").distinct(), "fit-list")
    sums = {r["i"]: (r["n"], int(r["s"])) for r in listed.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).toLocalIterator()}
    if not sums:
        shared.drop_cut(listed)
        return None, None
    d, n = len(sums), sums[0][0]
    sums = [sums[i][1] for i in range(d)]
    blank = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = blank.centred(_matrix(batch.column("x")))
            total += y.T @ y
        yield _cells(total)

    found = _summed(listed.mapInArrow(products, _CELL))
    covariance = np.array([[found[i, j] for j in range(d)] for i in range(d)]) / n
    covariance = (covariance + covariance.T) / 2
    values, components = components_of(covariance)
    model = Whitening(n, sums, values, components, float(np.trace(covariance)), count)

    def whitened_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((model.count, model.count)), np.zeros((1, model.count))
        for batch in batches:
            w = model.whitened(_matrix(batch.column("x")))
            total, mean = total + w.T @ w, mean + w.sum(axis=0)
        yield _cells(np.concatenate((total, mean)))

    found = _summed(listed.mapInArrow(whitened_products, _CELL))
    shared.drop_cut(listed)
    k = model.count
    mean = np.array([found[k, j] for j in range(k)]) / n
    seen = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)
    seen = seen[np.ix_(model.usable, model.usable)]
    return model, float(np.abs(seen).max()) if seen.size else None


def report(table: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component, as the query returns it."""
    vectors = whole_vectors(table)
    model, error = fit(vectors, count)
    schema = T.StructType([table.schema["vec_id"], *shared.fields(
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()),
    )])
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    sent = table.sparkSession.sparkContext.broadcast(model)  # dimensions times ``count`` numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = sent.value, _matrix(batch.column("x"))
            k, rows = own.count, len(x)
            each = np.repeat(np.arange(rows), k)
            share = own.values / own.trace if own.trace > 0 else np.full(k, np.nan)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, own.n), pa.int64()),
                pa.array(own.deviations(x), pa.int64()).take(pa.array(each)), pa.array(own.whitened(x).reshape(-1), from_pandas=True),
                pa.array(np.tile(share, rows), from_pandas=True), pa.array([error] * (rows * k), pa.float64()),
            ], names=schema.names)

    return vectors.mapInArrow(project, schema)
