"""Whitening of vectors on the leading components of their covariance, found by spectral divide and conquer."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestream.llm.common import written
from linestream.llm.vectors import binary_rows, from_binary, matrix

COMPONENTS = 4
SCALE = 256
#: Most components of a vector: the covariance (its square, as doubles) is held by the driver and by each task.
MOST_DIMS = 4096
_ROUNDS = 60


# Spectral divide and conquer of a symmetric matrix (dims x dims; the number of rows of the table does not matter here).


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of ``a`` by QR-based dynamically weighted Halley steps.

    For a symmetric matrix this is its matrix sign.  A lower bound of the singular values weighs each step, so
    that six or seven suffice even for a nearly singular matrix.
    """
    m = len(a)
    size = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    x, low = a / size, np.finfo(float).eps / m
    for _ in range(_ROUNDS):
        low = min(low, 1.0)
        d = np.cbrt(4 * (1 - low**2) / low**4)
        first = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * math.sqrt(1 + d)), 0.0))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(third) * x, np.eye(m)]))
        step = second / third * x + (first - second / third) / math.sqrt(third) * q[:m] @ q[m:].T
        step = (step + step.T) / 2
        change = np.abs(step - x).max()
        low, x = low * (first + second * low**2) / (1 + third * low**2), step
        if abs(1 - low) < 1e-15 and change < 1e-14 * m:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement.

    The columns of the projector are taken by falling length left, so the first ``rank`` span its range; one
    more pass through the projector takes out what rounding left in them.
    """
    m, left, picked = len(projector), projector.copy(), []
    for _ in range(rank):
        j = int(np.argmax((left * left).sum(axis=0)))
        q = left[:, j] / np.linalg.norm(left[:, j])
        left -= np.outer(q, q @ left)
        picked.append(j)
    rest = [j for j in range(m) if j not in set(picked)]
    inside, _ = np.linalg.qr(projector @ np.linalg.qr(projector[:, picked])[0])
    whole, _ = np.linalg.qr(np.hstack([inside, np.eye(m)[:, rest]]))
    return whole[:, :rank], whole[:, rank:]


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces of ``v``, larger eigenvalues first; None if ``v`` is a multiple of the identity.

    The shift is the median or the mean of the diagonal.  If it falls on an eigenvalue, its projector is no clean one and
    the halfway points to other quantiles of the diagonal are tried; of all the cleanest split counts.
    """
    m, diag = len(v), np.sort(np.diag(v))
    spread = np.abs(v - np.eye(m) * diag.mean()).max()
    if spread <= 4 * np.finfo(float).eps * max(np.abs(v).max(), 1e-300):
        return None
    mean, middle = diag.mean(), np.median(diag)
    tries = [middle, mean, (middle + mean) / 2, *((mean + np.quantile(diag, q)) / 2 for q in (0.75, 0.25, 0.9, 0.1, 1, 0))]
    best, found = np.inf, None
    for shift in tries:
        p = (np.eye(m) + polar_factor(v - shift * np.eye(m))) / 2
        rank = round(np.trace(p))
        if not 0 < rank < m:
            continue
        high, rest = _basis(p, rank)
        off = np.abs(high.T @ v @ rest).max()
        if off < best:
            best, found = off, (high, rest)
        if off <= 1e-14 * m * spread:
            break
    return found


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``v``, falling, and their unit eigenvectors as columns.

    Polar decompositions of the shifted matrix give spectral projectors; the subspaces are split until each has one
    dimension.  Subspaces below the first ``k`` are not followed.
    """

    def walk(part: np.ndarray, basis: np.ndarray, wanted: int) -> list[tuple[float, np.ndarray]]:
        if wanted <= 0:
            return []
        if len(part) == 1:
            return [(float(part[0, 0]), basis[:, 0])]
        halves = _split(part)
        if halves is None:  # every direction is an eigenvector
            return [(float(part[i, i]), basis[:, i]) for i in range(min(wanted, len(part)))]
        out = []
        for half in halves:
            own = half.T @ part @ half
            out += walk((own + own.T) / 2, basis @ half, wanted - len(out))
        return out

    # Smaller powers of two of it: no rounding, and no overflow in the norms.
    size = 2.0 ** math.frexp(np.abs(v).max() or 1.0)[1]
    found = walk((v + v.T) / 2 / size, np.eye(len(v)), min(k, len(v)))
    vectors = np.array([b for _, b in found]).T
    if found:
        vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, v @ vectors) if found else np.zeros(0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order] if found else np.zeros((len(v), 0))


# The table.


def whole_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x = floor(256 * component) of every row whose vector is there and holds only finite numbers."""
    c = F.col(column).cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(good)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))


def _ints(col: pa.Array, dims: int) -> np.ndarray:
    """Whole numbers of an array<long> column; those beyond 2^53 lie as far apart as doubles do."""
    return matrix(col, dims)


def _moments(fit: DataFrame, dims: int, inner) -> np.ndarray:
    """The sum over all tasks of a matrix of ``dims`` columns that ``inner(rows)`` gives for a batch.

    A task sends its rows of the matrix keyed by their number; those of one number meet in one task and are added
    in the order of the tasks, so that the driver gets one matrix, however many tasks there are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            part = inner(_ints(b.column("x"), dims))
            total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            cols = [pa.array(np.arange(len(total))), pa.array(np.full(len(total), task)), binary_rows(total)]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "task", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            parts = from_binary(b.column("part"), wide)
            for at, part in zip(b.column("at").to_pylist(), parts, strict=True):
                if at != now and now is not None:
                    yield _row(now, total)
                now, total = at, part.copy() if at != now else total + part
        if now is not None:
            yield _row(now, total)

    wide = inner(np.zeros((0, dims))).shape[1]
    sent = fit.select("x").mapInArrow(add, "at long, task long, part binary")
    sums = sent.repartition("at").sortWithinPartitions("at", "task").mapInArrow(merge, "at long, part binary")
    rows = sorted((r["at"], r["part"]) for r in sums.collect())  # as many rows as the matrix has
    return np.array([np.frombuffer(p) for _, p in rows])


def _row(at: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at]), binary_rows(total[None, :])], names=["at", "part"])


def _exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of each dimension, and the largest entry without its sign; whole numbers throughout."""
    each = fit.select(F.posexplode("x").alias("d", "v"))
    per = each.groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs(F.col("v").cast("decimal(38,0)"))).alias("m"))
    found = {r["d"]: (int(r["s"]), int(r["m"])) for r in per.collect()}  # one row per dimension
    return fit.count(), [found.get(d, (0, 0))[0] for d in range(dims)], max((m for _, m in found.values()), default=0)


def whiten(df: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """Each vector's coordinates on the leading components of the table, scaled to unit variance.

    vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row for every row of ``df`` and
    component.  Left out are rows whose vector is null or holds null or non-finite entries.  Vectors shorter than the
    longest count as padded with zeros.

    n, the sums and the covariance are over the distinct vectors of floor(256 * entry): copies are combined map-side, so
    a third of all rows with one vector is one row per task in that shuffle.  Sums are whole numbers; the covariance is a
    product of centred vectors per task, added by row of the matrix.  The driver gets matrices of dims x dims only, at
    most ``MOST_DIMS``.  ``identity_error`` is measured on the fitted vectors themselves.

    Repeated rows and null ids are rows of their own.  Without rows, or where all vectors are equal, there is no
    component and the result is empty; a direction without variance (below 1e-13 of the largest) is no component
    either.  A deviation that no long can hold is null.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, column)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMS}")
    if dims == 0:
        return spark.createDataFrame([], schema)
    # Padded ahead of the comparison, so that a vector and its padded form are one.
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    rows = rows.select("vec_id", padded.alias("x"))
    fit = written(rows.select("x").distinct(), "fit")
    n, sums, most = _exact_sums(fit, dims)
    mean = np.array([s / n for s in sums])
    cov = _moments(fit, dims, lambda x: (x - mean).T @ (x - mean)) / n
    values, vectors = leading_components(cov, components)
    keep = values > 1e-13 * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return spark.createDataFrame([], schema)
    k, turn, trace = len(values), vectors / np.sqrt(values), float(np.trace(cov))

    def seen(x: np.ndarray) -> np.ndarray:
        """First and second moments of the whitened rows, with their number."""
        w = np.hstack([(x - mean) @ turn, np.ones((len(x), 1))])
        return w.T @ w

    second = _moments(fit, dims, seen) / n
    error = float(np.abs(second[:k, :k] - np.outer(second[:k, k], second[k, :k]) - np.eye(k)).max())
    small = dims * (2 * n * most) ** 2 < 1 << 62
    whole = np.array(sums, np.int64 if small else object)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _ints(b.column("x"), dims)
            if small:
                off = n * x.astype(np.int64) - whole
                far = pa.array((off * off).sum(axis=1))
            else:
                exact = [sum((n * (v or 0) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in b.column("x").to_pylist()]
                far = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            w, each = (x - mean) @ turn, np.repeat(np.arange(len(b)), k)
            place = np.tile(np.arange(k), len(b))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(each)), pa.array((place + 1).astype(np.int32)), pa.array(np.full(len(each), n)),
                    far.take(pa.array(each)), pa.array(w.ravel()), pa.array((values / trace)[place]), pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(turned, schema)
