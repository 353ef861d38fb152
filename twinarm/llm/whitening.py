"""Whitening of vectors: eigenvectors of their covariance from a triangular factor.

The covariance is exact: entries are whole numbers, their sums and the products of their
distances from the mean (moved to the nearest whole number below, the rest put right at
the end) are added up as whole numbers by tasks and by Spark. The scatter matrix, whose size is that of
a vector squared, gets a Cholesky factor with pivots; one-sided Jacobi rotations make the
columns of that factor orthogonal. Their squared norms are the eigenvalues and the
columns, divided by their norms, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinarm.llm.common import bound_batches, per_batch, small_batches, written
from twinarm.llm.vectors import exact_products, lengths, matrix

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Numbers from here on are taken for not finite, so that all sums fit in decimals of 38 digits.
REACH = 1 << 40
_BIG = pa.decimal128(38, 0)
_LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """Sums and components of ``n`` vectors of whole numbers; ``components`` has a column for each."""

    scale: int
    shift: int
    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    def distances(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose vectors count, and how far their numbers are from the mean's whole part."""
        rows, values = matrix(column, self.size)
        scaled = np.floor(values * self.scale)
        near = (np.abs(scaled) < REACH).all(1)
        below = np.array([s // self.n for s in self.sums], np.int64)
        return rows[near], scaled[near].astype(np.int64) + self.shift - below

    @property
    def rest(self) -> list[int]:
        """What the sums have beyond n times the mean's whole part."""
        return [s % self.n for s in self.sums]

    def whiten(self, distances: np.ndarray) -> np.ndarray:
        """Distances from the mean along each component, divided by the deviation there."""
        centred = distances - np.array([r / self.n for r in self.rest])
        return centred @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, distances: np.ndarray) -> list[int | None]:
        """Sum over entries of (n x - sum)**2, exact; None beyond 64 bits."""
        most = (int(np.abs(distances).max(initial=0)) + 1) * self.n
        if self.size * most * most <= _LONG_MAX:
            apart = distances * self.n - np.array(self.rest, np.int64)
            return (apart * apart).sum(1).tolist()
        apart = distances.astype(object) * self.n - np.array(self.rest, object)
        return [v if v <= _LONG_MAX else None for v in (apart * apart).sum(1).tolist()]


def _totals(df: DataFrame, make, target: str, kind: pa.DataType, vector: str) -> DataFrame:
    """Sums over all tasks of what each adds up: ``make`` returns a function that takes vectors and one that gives (group, n, list)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = make()
        for batch in small_batches(batches):
            take(batch.column(0))
        rows = list(give())
        if rows:
            groups, counts, lists = zip(*rows, strict=True)
            values = [[Decimal(v) for v in told] for told in lists] if kind == _BIG else lists
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.list_(kind))], names=["size", "n", "values"])

    bound_batches(df.sparkSession)
    found = df.select(F.col(f"`{vector}`").alias("v")).where("v is not null").mapInArrow(run, f"size bigint, n bigint, values array<{target}>")
    # Spark adds within a task first.
    return found.select("size", "n", F.posexplode("values").alias("at", "value")).groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def _first_sums(df: DataFrame, vector: str, scale: int, shift: int) -> tuple[int, tuple[int, ...]]:
    """Number and sums of the vectors of the commonest length, the longer one of ties."""
    def make():
        found: dict[int, list] = {}

        def take(column: pa.Array) -> None:
            for size in np.unique(lengths(column)).tolist():
                _, values = matrix(column, size) if size > 0 else (None, np.zeros((0, 0)))
                scaled = np.floor(values * scale)
                scaled = scaled[(np.abs(scaled) < REACH).all(1)].astype(np.int64) + shift
                if len(scaled):
                    mine = found.setdefault(size, [0, [0] * size])
                    mine[0] += len(scaled)
                    mine[1] = [a + b for a, b in zip(mine[1], scaled.sum(0).tolist(), strict=True)]

        return take, lambda: [(size, n, sums) for size, (n, sums) in found.items()]

    sums = written(_totals(df, make, "decimal(38,0)", _BIG, vector), "sums")
    best = sums.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    rows = sums.where(F.col("size") == best["size"]).orderBy("at").collect() if best else []
    return (rows[0]["n"], tuple(int(r["value"]) for r in rows)) if rows else (0, ())


def _scatter(df: DataFrame, model: Whitening, vector: str) -> np.ndarray:
    """The covariance, each entry the nearest double to the exact one."""
    upper = np.triu_indices(model.size)

    def make():
        total = [0, np.zeros(len(upper[0]), object)]

        def take(column: pa.Array) -> None:
            _, apart = model.distances(column)
            most = int(np.abs(apart).max(initial=0))
            if most * most * max(1, len(apart)) < 2**62:
                products = exact_products(apart.T, apart.T)
            else:
                products = apart.T.astype(object) @ apart.astype(object)
            total[0] += len(apart)
            total[1] = total[1] + products[upper].astype(object)

        return take, lambda: [(0, total[0], total[1].tolist())] if total[0] else []

    cells = {r["at"]: int(r["value"]) for r in _totals(df, make, "decimal(38,0)", _BIG, vector).collect()}
    out, rest, n = np.zeros((model.size, model.size)), model.rest, model.n
    for k, (i, j) in enumerate(zip(*(x.tolist() for x in upper), strict=True)):
        out[i, j] = out[j, i] = (n * cells[k] - rest[i] * rest[j]) / (n * n)
    return out


def pivoted_cholesky(matrix_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor and order of rows with ``matrix_[order][:, order] = factor @ factor.T``; a column for each pivot above rounding."""
    left, size = matrix_.astype(np.float64).copy(), len(matrix_)
    order, factor = np.arange(size), np.zeros((size, size))
    least = size * np.finfo(float).eps * max(0.0, left.diagonal().max(initial=0.0))
    for k in range(size):
        p = k + int(left.diagonal()[k:].argmax())
        if left[p, p] <= least:
            return factor[:, :k], order
        swap = [p, k]
        order[[k, p]], factor[[k, p]] = order[swap], factor[swap]
        left[[k, p]] = left[swap]
        left[:, [k, p]] = left[:, swap]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1:, k] = left[k + 1:, k] / factor[k, k]
        left[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until each pair is orthogonal; disjoint pairs are rotated together."""
    columns = factor.copy()
    n = columns.shape[1]
    ring = list(range(n + n % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if a < n and b < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = columns[:, p], columns[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.abs(c) > np.finfo(float).eps * size
            worst = max(worst, float(np.where(size > 0, np.abs(c) / np.where(size > 0, size, 1), 0).max()))
            half = np.where(off, (b - a) / (2 * np.where(off, c, 1)), 0)
            tangent = np.where(off, np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1, half)), 0)
            cosine = 1 / np.sqrt(1 + tangent * tangent)
            sine = cosine * tangent
            columns[:, p], columns[:, q] = cosine * x - sine * y, sine * x + cosine * y
        if worst <= 4 * np.finfo(float).eps * max(1, n) ** 0.5:
            break
    return columns


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit vectors as columns; the largest entry of each is positive."""
    factor, order = pivoted_cholesky(covariance)
    rotated = jacobi_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    falling = np.argsort(-norms, kind="stable")
    found = np.zeros_like(rotated)
    found[order] = (rotated / norms)[:, falling]
    sign = np.sign(np.take_along_axis(found, np.abs(found).argmax(0)[None, :], 0)) if found.size else 1.0
    return norms[falling] ** 2, found * sign


def _identity_error(df: DataFrame, model: Whitening, vector: str) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.eigenvalues)

    def make():
        total = [0, np.zeros(k), np.zeros((k, k))]

        def take(column: pa.Array) -> None:
            white = model.whiten(model.distances(column)[1])
            total[0] += len(white)
            total[1] += white.sum(0)
            total[2] += white.T @ white

        return take, lambda: [(0, total[0], [*total[1].tolist(), *total[2].ravel().tolist()])] if total[0] else []

    cells = np.array([r["value"] for r in _totals(df, make, "double", pa.float64(), vector).orderBy("at").collect()])
    mean, products = cells[:k] / model.n, cells[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all vectors of ``df``, which is read three times; None if there is none.

    Vectors that are null or hold null or a number that is not finite (or from 2**40 /
    ``scale`` on) are left out, and those of another length than most have. Components
    whose eigenvalue is zero but for rounding do not exist, so equal vectors have none.
    """
    n, sums = _first_sums(df, vector, scale, shift)
    if not n:
        return None
    model = Whitening(scale, shift, n, sums, 0.0, np.zeros(0), np.zeros((len(sums), 0)))
    covariance = _scatter(df, model, vector)
    values, components = eigen(covariance)
    model = Whitening(scale, shift, n, sums, float(np.trace(covariance)), values[:most], components[:, :most])
    if not len(model.eigenvalues):
        return model
    return Whitening(**model.__dict__ | {"identity_error": _identity_error(df, model, vector)})


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component, with the other columns of ``df``.

    Added: ``component`` from 1 on, ``n``, ``deviation`` (null beyond 64 bits), ``whitened``,
    ``explained`` and ``identity_error``; columns of these names are replaced. Without a
    model, or without components, there are no rows. Repeated rows and keys stay apart.
    """
    def make():
        k = 0 if model is None else len(model.eigenvalues)

        def compute(column: pa.Array):
            if not k:
                return {name: [] for name in ("component", "n", "deviation", "whitened", "explained", "identity_error")}, np.zeros(0, np.int64)
            rows, apart = model.distances(column)
            deviations = np.repeat(np.array(model.deviations(apart), object), k)
            return {
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)), "n": np.full(len(rows) * k, model.n), "deviation": deviations.tolist(),
                "whitened": model.whiten(apart).ravel(), "explained": np.tile(model.eigenvalues / model.trace, len(rows)),
                "identity_error": np.full(len(rows) * k, model.identity_error)}, np.repeat(rows, k)

        return compute

    return per_batch(df, vector, "component int,n long,deviation long,whitened double,explained double,identity_error double", make)
