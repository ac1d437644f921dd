"""Whitening of integer vectors by a bidiagonal qd solver.

The covariance matrix is never formed. Tasks reduce blocks of centred rows to triangular factors by QR, factors are
stacked and reduced again in groups until one is left. Householder reflections make that factor bidiagonal, shifted
differential qd sweeps (dqds) find its singular values to high relative accuracy, and twisted factorisations recover the
directions. Only factors as wide as a vector (d x d numbers) travel; one of them reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.llm.common import named
from tableloom.session import materialise

EPS = 2.0**-53
#: An off-diagonal entry of the qd array this much smaller than its neighbour no longer matters (squared values).
NEGLIGIBLE = (10 * EPS) ** 2
#: Singular values closer than this, relatively, get directions that are made orthogonal to each other explicitly.
CLOSE = 1e-7
BLOCK_ROWS = 4096
FAN_IN = 32


# -- the small solver -----------------------------------------------------------


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor V of U^T A V = B, by Householder reflections from both sides."""
    a = np.array(matrix, dtype=float)
    d = a.shape[1]
    v = np.eye(d)
    for k in range(d):
        u = reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * u, u @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, 2 * w)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, 2 * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector whose reflection maps ``x`` onto the first axis; zero where nothing is to be done."""
    length = np.linalg.norm(x)
    if length == 0 or np.linalg.norm(x[1:]) == 0:
        return np.zeros_like(x)
    u = x / length
    u[0] += math.copysign(1.0, u[0])
    return u / np.linalg.norm(u)


def sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd sweep with shift; None if the shift was above the smallest eigenvalue."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        ds.append(d)
        total = d + e[k]
        if d < 0 or total <= 0:
            return None
        ratio = q[k + 1] / total
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, [*ds, d]


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling.

    A sweep's intermediate values give a lower bound of the smallest eigenvalue (they are the reciprocal diagonal of the
    inverse), which is the next shift; it becomes exact as the last value separates. A shift that proves too large is
    halved, at last to zero.
    """
    found: list[float] = []
    pending = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while pending:
        q, e, moved = pending.pop()
        shift, tries = 0.0, 0
        while True:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= NEGLIGIBLE * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                pending.append((q[: cut + 1], e[:cut], moved))
                q, e, shift = q[cut + 1 :], e[cut + 1 :], 0.0
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            if q[-1] == 0 or q[0] == 0:  # singular: a sweep without shift moves the zero to the end
                shift = 0.0
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            made = sweep(q, e, shift)
            while made is None and shift > 0:
                shift = shift / 2 if shift > NEGLIGIBLE * moved and tries % 4 < 3 else 0.0
                tries += 1
                made = sweep(q, e, shift)
            if made is None:  # both parts of a sum were zero
                q = [max(x, 1e-300) for x in q]
                continue
            q, e, ds = made
            moved += shift
            tries += 1
            if tries > 200 * (len(q) + 10):
                raise ArithmeticError("qd sweeps did not converge")
            shift = (1 - 1e-3) / sum(1 / x for x in ds) if min(ds) > 0 else 0.0
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B for an eigenvalue: factorised from the top and from the bottom, joined where the two
    meet with the smallest remainder."""
    n, top = len(diagonal), max(float(np.abs(diagonal).max()), float(np.abs(upper).max(initial=0.0)))
    tiny = EPS * EPS * top * top
    a = np.where(np.abs(diagonal) > EPS * top, diagonal, math.copysign(EPS * top, 1.0))
    d, low = a * a, upper / a[:-1]
    s, l_plus = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = d[i] + s[i] or tiny
        l_plus[i] = d[i] * low[i] / pivot
        s[i + 1] = l_plus[i] * low[i] * s[i] - value
    p, u_minus = np.empty(n), np.empty(n - 1)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1] or tiny
        u_minus[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * (d[i] / pivot) - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -l_plus[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -u_minus[i] * z[i]
    return z / np.linalg.norm(z)


def directions(factor: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of A^T A, falling, and unit eigenvectors (columns) of the first ``limit`` positive ones."""
    diagonal, upper, v = bidiagonal(factor)
    values = dqds(diagonal, upper)
    count = int((values[:limit] > (len(values) * EPS) ** 2 * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    b = np.diag(diagonal) + np.diag(upper, 1)
    made: list[np.ndarray] = []
    for k in range(count):
        z = twisted(diagonal, upper, values[k])
        close = [made[j] for j in range(k) if values[j] - values[k] <= CLOSE * values[k]]
        for attempt in range(6):
            left = z - sum(((c @ z) * c for c in close), np.zeros_like(z))
            left -= sum(((c @ left) * c for c in close), np.zeros_like(z))
            if not close or np.linalg.norm(left) > 0.5:
                break
            # the same direction again: inverse iteration from another start
            start = np.random.default_rng([k, attempt]).standard_normal(len(z))
            start -= sum(((c @ start) * c for c in close), np.zeros_like(z))
            shifted = b.T @ b - values[k] * (1 + 4 * EPS * (attempt + 1)) * np.eye(len(z))
            z = np.linalg.lstsq(shifted, start, rcond=EPS)[0] if attempt > 3 else np.linalg.solve(shifted, start)
            z /= np.linalg.norm(z)
        made.append(left / np.linalg.norm(left))
    vectors = v @ np.array(made).T if made else np.zeros((len(values), 0))
    largest = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])] if made else 1.0)


# -- over the rows ----------------------------------------------------------------


def matrix_of(batch: pa.RecordBatch, width: int, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they suffice, Python's otherwise."""
    bound = max((abs(int(x.min())), abs(int(x.max())))) if x.size else 0
    if n * bound < 2**62 and max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (spread(x, n, sums) / n).astype(float)


def squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of squares of n * x - S per row, exact; None beyond 64 bits."""
    gaps = spread(x, n, sums)
    if gaps.dtype != object and (gaps.size == 0 or x.shape[1] * int(np.abs(gaps).max()) ** 2 < 2**63):
        return (gaps * gaps).sum(axis=1).tolist()
    exact = (gaps.astype(object) ** 2).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in exact]


def gathered(df: DataFrame, start: Callable, join: Callable) -> np.ndarray:
    """One array of numbers out of a table: ``start`` turns a task's batches into one, ``join`` two into one.

    Arrays meet in groups of ``FAN_IN`` until one is left, which comes to the driver.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made.tolist()], pa.list_(pa.float64()))], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total = np.array(row) if total is None else join(total, np.array(row))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = materialise(df.mapInArrow(first, "v array<double>"))
    rows = parts.count()
    while rows > 1:
        rows = math.ceil(rows / FAN_IN)
        parts = materialise(parts.repartition(rows).mapInArrow(again, "v array<double>"))
        rows = parts.count() if rows > 1 else rows
    found = parts.first()
    return np.array(found["v"] if found else [])


@dataclass
class Whitening:
    """``n`` distinct vectors with ``sums``; ``vectors`` (columns) and their eigenvalues ``values``; the whole variance
    ``trace``; ``error``: largest entry of the whitened fit list's covariance minus the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def quantised(df: DataFrame, key: str, vector: str, levels: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """(key, x): every entry c becomes the long floor(levels * c) + offset.

    Rows whose vector is null, empty, holds a null or non-finite entry, or one whose x is no long, take no part; of
    vectors of different lengths those of the commonest length do (the longest of equally common ones).
    """
    entry = named(vector)
    fine = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * levels < F.lit(2.0**62)))
    x = F.transform(entry, lambda v: F.floor(v.cast("double") * levels).cast("bigint") + F.lit(offset).cast("bigint"))
    rows = materialise(df.filter(entry.isNotNull() & (F.size(entry) > 0) & fine).select(named(key).alias("key"), x.alias("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths["d"] if lengths else 0))


def fit(x: DataFrame, limit: int = 16) -> Whitening | None:
    """Learns from each distinct vector of column ``x`` (arrays of longs of one length) once; None without rows.

    Directions whose eigenvalue is zero to working precision are left out, so equal or dependent columns give fewer.
    """
    distinct = materialise(x.select("x").distinct())
    head = distinct.first()
    if head is None:
        return None
    d = len(head["x"])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            rows = matrix_of(batch, d)
            n += len(rows)
            small = len(rows) == 0 or len(rows) * max(abs(int(rows.min())), abs(int(rows.max()))) < 2**62
            total = total + (rows if small else rows.astype(object)).sum(axis=0).astype(object)
        kind = pa.decimal128(38, 0)
        values = pa.array([Decimal(int(v)) for v in [n, *total]], kind)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), values], names=["i", "v"])

    summed = distinct.mapInArrow(sums_of, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
    known = {r["i"]: int(r["v"]) for r in summed.collect()}  # one number per dimension
    n, sums = known[-1], [known[i] for i in range(d)]

    def triangle(rows: np.ndarray) -> np.ndarray:
        factor = np.linalg.qr(rows, mode="r")
        return np.vstack([factor, np.zeros((d - len(factor), d))]) if len(factor) < d else factor

    def reduced(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        factor = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = centred(matrix_of(batch.slice(at, BLOCK_ROWS), d), n, sums)
                factor = triangle(block if factor is None else np.vstack([factor, block]))
        return None if factor is None else factor.ravel()

    factor = gathered(distinct, reduced, lambda a, b: triangle(np.vstack([a.reshape(d, d), b.reshape(d, d)])).ravel())
    squared, vectors = directions(factor.reshape(d, d), limit)
    values = squared[: vectors.shape[1]] / n
    k = len(values)
    scaled = vectors / np.sqrt(values)

    def spread_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                w = centred(matrix_of(batch.slice(at, BLOCK_ROWS), d), n, sums) @ scaled
                mean = w.mean(axis=0)
                part = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                total = part if total is None else merged(total, part)
        return total

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts, means and centred second moments of two sets of rows together."""
        gap, both = b[1 : k + 1] - a[1 : k + 1], a[0] + b[0]
        second = a[k + 1 :] + b[k + 1 :] + (np.outer(gap, gap) * (a[0] * b[0] / both)).ravel()
        return np.concatenate([[both], a[1 : k + 1] + gap * (b[0] / both), second])

    error = 0.0
    if k:
        moments = gathered(distinct, spread_of, merged)
        error = float(np.abs(moments[k + 1 :].reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, float(squared.sum() / n), error)


def whiten(rows: DataFrame, model: Whitening | None, key: str = "key") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with column ``x`` and every
    component. Repeated rows and null keys are whitened like others; ``deviation`` is null beyond 64 bits. Without a
    model, or without components, no rows."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    chosen = rows.select(named(key).alias("k"), "x")
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema).toDF(*names)
    n, sums, error = model.n, model.sums, model.error
    scaled, explained, k, d = model.vectors / np.sqrt(model.values), model.values / model.trace, len(model.values), len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x, m = matrix_of(batch, d, 1), batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(squares(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((centred(x, n, sums) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ], names=["k", *names[1:]])

    return chosen.mapInArrow(run, schema).toDF(*names)
