"""Second-moment matrices of many columns.

Each Arrow batch contributes one NumPy product; a partition emits its partial
matrix, and Spark sums the partials. ``moments`` brings d x d numbers to the
driver; ``scatter`` keeps the matrix a table and ``krylov`` finds its leading
directions by products with a few columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import number, q
from tableloom.functions.stats import numeric_stats
from tableloom.session import materialise


class Moments:
    """Row count, mean vector and centred scatter matrix."""

    def __init__(self, n: int, mean: np.ndarray, scatter: np.ndarray):
        self.n, self.mean, self.scatter = n, mean, scatter

    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    def correlation(self) -> np.ndarray:
        deviation = np.sqrt(np.diag(self.scatter))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.scatter / np.outer(deviation, deviation)


def moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[str | None, Moments]:
    """Moments over complete rows (rows with any missing value are left out)."""
    width = len(columns)
    values = df.select(
        (q(by).cast("string") if by else F.lit(None).cast("string")).alias("class"),
        F.array(*[number(df, c) for c in columns]).alias("x"),
    ).filter(~F.exists("x", lambda v: v.isNull()) & (F.lit(by is None) | F.col("class").isNotNull()))
    stats = numeric_stats(df, columns, ["mean"])
    centre = np.array([stats[c]["mean"] or 0.0 for c in columns])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for label, rows in batch.groupby("class", dropna=False)["x"]:
                label = None if pd.isna(label) else label
                x = np.stack(rows.to_numpy()) - centre
                x = np.hstack([x, np.ones((len(x), 1))])
                sums[label] = sums.get(label, 0.0) + x.T @ x
        for label, total in sums.items():
            row, column = np.triu_indices(width + 1)
            yield pd.DataFrame({"class": label, "i": row, "j": column, "v": total[row, column]})

    summed = (
        values.mapInPandas(partial, "class string, i int, j int, v double")
        .groupBy("class", "i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    found: dict[str | None, Moments] = {}
    for label, part in summed.groupby("class", dropna=False):
        full = np.zeros((width + 1, width + 1))
        full[part["i"], part["j"]] = part["v"]
        full = full + np.triu(full, 1).T
        n = full[width, width]
        offset = full[:width, width] / n
        found[None if pd.isna(label) else label] = Moments(
            int(round(n)), centre + offset, full[:width, :width] - n * np.outer(offset, offset)
        )
    return found


@dataclass
class Scatter:
    """A centred scatter matrix that stays a table: ``rows(i, panel, v)`` holds row ``i``'s part in each panel of
    columns. ``counts`` and ``means`` per class (one class, ``None``, without classes) and the matrix's trace."""

    rows: DataFrame
    counts: dict[str | None, int]
    means: dict[str | None, np.ndarray]
    trace: float
    width: int
    panel: int

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    @property
    def mean(self) -> np.ndarray:
        return sum(self.counts[c] * m for c, m in self.means.items()) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The matrix times a few columns, which travel to its rows; as many numbers come back."""
        panel = self.panel

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch.column(1).to_numpy()
                made = [v.values.to_numpy() @ block[p * panel : (p + 1) * panel] for p, v in zip(parts.tolist(), batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["i", "v"])

        out = np.zeros((self.width, block.shape[1]))
        for r in self.rows.mapInArrow(product, "i int, v array<double>").collect():
            out[r["i"]] += r["v"]
        return out


def scatter(df: DataFrame, columns: Sequence[str], by: str | None = None, panel: int = 1024) -> Scatter:
    """Scatter of complete rows around their mean, or around their class's mean.

    Each task multiplies its rows by one panel of columns at a time and emits partial rows of the matrix; Spark adds
    them up by row. Counts and means of the classes come to the driver, matrices do not.
    """
    width = len(columns)
    values = df.select(
        (q(by).cast("string") if by else F.lit(None).cast("string")).alias("class"),
        F.array(*[number(df, c) for c in columns]).alias("x"),
    ).filter(~F.exists("x", lambda v: v.isNull()) & (F.lit(by is None) | F.col("class").isNotNull()))
    vector = array_to_vector("x")
    found = values.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(vector)).alias("mean")
    ).collect()
    counts = {r["class"]: r["n"] for r in found}
    means = {r["class"]: np.array(r["mean"]) for r in found}
    centres = values.sparkSession.sparkContext.broadcast(means)

    def partial(start: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                if by is None:
                    x = x - centres.value[None]
                else:
                    names = batch.column(0).dictionary_encode()
                    centre = np.array([centres.value[c] for c in names.dictionary.to_pylist()])
                    x = x - centre[names.indices.to_numpy()]
                part = x.T @ x[:, start : start + panel]
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64())),
                ], names=["i", "v"])

        return run

    panels = []
    for number_, start in enumerate(range(0, width, panel)):
        parts = values.mapInArrow(partial(start), "i int, v array<double>")
        added = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        panels.append(added.select("i", F.lit(number_).alias("panel"), "v"))
    rows = materialise(reduce(DataFrame.unionByName, panels))
    own = F.when(F.floor(F.col("i") / panel) == F.col("panel"), F.col("v")[F.col("i") % panel])
    trace = rows.agg(F.coalesce(F.sum(own), F.lit(0.0))).first()[0]
    return Scatter(rows, counts, means, float(trace), width, panel)


def orthonormal(block: np.ndarray, against: np.ndarray | None, size: float) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the columns of ``against``."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    new = u[:, s > 1e-11 * size]
    return new if against is None else np.linalg.qr(new - against @ (against.T @ new))[0]


def krylov(
    matrix: Scatter, start: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, np.ndarray], bool], fill: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis V of a block Krylov space and V^T A V.

    The space grows by one product with the matrix at a time until ``enough(values, vectors, residuals)`` holds for the
    eigenpairs in it, or it is closed; with ``fill``, a closed space goes on from another start.
    """
    d, rng = matrix.width, np.random.default_rng(1)
    basis = orthonormal(start, None, max(float(np.abs(start).max(initial=0.0)), 1e-300))
    image = matrix.times(basis) if basis.shape[1] else np.zeros((d, 0))
    last = basis.shape[1]
    while True:
        inner = basis.T @ image
        inner = (inner + inner.T) / 2
        values, turned = np.linalg.eigh(inner)
        residuals = np.linalg.norm(image @ turned - (basis @ turned) * values, axis=0)
        if basis.shape[1] >= d or enough(values[::-1], (basis @ turned)[:, ::-1], residuals[::-1]):
            return basis, inner
        size = max(float(np.abs(image).max(initial=0.0)), 1e-300)
        new = orthonormal(image[:, basis.shape[1] - last :], basis, size)[:, : d - basis.shape[1]]
        if not new.shape[1]:
            if not fill:
                return basis, inner
            new = orthonormal(rng.standard_normal((d, min(last or 1, d - basis.shape[1]))), basis, 1.0)
        basis, image, last = np.hstack([basis, new]), np.hstack([image, matrix.times(new)]), new.shape[1]


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest absolute entry made positive, so that signs are reproducible."""
    largest = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)
