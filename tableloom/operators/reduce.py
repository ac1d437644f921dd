"""Linear projections. The scatter matrix stays a table; directions are found by products with a few columns, and rows
are projected by one matrix product per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.columns import number, q
from tableloom.functions.moments import krylov, oriented, orthonormal, scatter
from tableloom.operators.base import FittedStep, Step

RIDGE = 1e-9
#: An eigenpair is found once its residual is this small against the largest eigenvalue.
RESIDUAL = 1e-13
#: Columns beyond those asked for in the first block.
SPARE = 8


class _Projection(FittedStep):
    PREFIX = ""

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows with a missing value have no coordinates."""
        names = self.state["columns"]
        mean, components = np.array(self.state["mean"]), np.array(self.state["components"]).T
        made = [f"{self.PREFIX}{j}" for j in range(1, components.shape[1] + 1)]
        others = [c for c in df.columns if c not in set(names) | set(made)]
        short = [f"c{i}" for i in range(len(others) + len(made))]
        chosen = df.select(*map(q, others), F.array(*[number(df, c) for c in names])).toDF(*short[: len(others)], "x")
        kept = len(others)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(kept).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean))
                scores = (x - mean) @ components  # missing values are NaN here
                columns = [pa.array(np.ascontiguousarray(c), from_pandas=True) for c in scores.T]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *columns], names=short)

        fields = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
        schema = ", ".join([*fields, *(f"{n} double" for n in short[kept:])])
        return chosen.mapInArrow(project, schema).toDF(*others, *made)

    def explained_variance(self, spark: SparkSession) -> DataFrame:
        """``(component, ratio, cumulative)``."""
        ratios = self.state["ratios"]
        rows = [
            (f"{self.PREFIX}{j}", float(r), float(sum(ratios[:j]))) for j, r in enumerate(ratios, 1)
        ]
        return spark.createDataFrame(rows, "component string, ratio double, cumulative double")


class PCAReducer(Step):
    """``n_components``, or as many as pass ``variance_ratio`` cumulatively."""

    OPTIONS: ClassVar = {
        "n_components": None, "variance_ratio": 0.95, "columns": None, "target": None, "keep": None,
    }

    def _fit(self, df: DataFrame) -> PCAReducerModel:
        names = self.pick(df, "numeric")
        if not names:
            raise ValueError("no numeric column to reduce")
        matrix = scatter(df, names)
        if not matrix.counts:
            raise ValueError("no complete row to learn from")
        d, k, wanted = len(names), self.opt("n_components"), self.opt("variance_ratio")
        if k is not None:
            k = max(1, min(k, d, max(matrix.n, 1)))

        def share(values: np.ndarray) -> np.ndarray:
            return values.clip(min=0.0) / matrix.trace if matrix.trace > 0 else np.zeros(len(values))

        def needed(values: np.ndarray) -> int:
            """Components until the wanted share is passed; more than there are values if they do not pass it."""
            return k if k is not None else int(np.searchsorted(np.cumsum(share(values)), wanted, side="right")) + 1

        def enough(values, vectors, residuals) -> bool:
            count = needed(values)
            small = RESIDUAL * max(float(values.max(initial=0.0)), 0.0)
            return count <= len(values) and bool((residuals[:count] <= small).all())

        start = np.random.default_rng(0).standard_normal((d, min(d, (k or 1) + SPARE)))
        basis, inner = krylov(matrix, start, enough, fill=True)
        values, turned = np.linalg.eigh(inner)
        values, vectors = values[::-1].clip(min=0.0), oriented((basis @ turned)[:, ::-1])
        k = max(1, min(needed(values), len(values), max(matrix.n, 1)))
        return PCAReducerModel(self.options(), {
            "columns": names, "mean": matrix.mean.tolist(),
            "components": vectors[:, :k].T.tolist(), "ratios": share(values)[:k].tolist(),
        })


class PCAReducerModel(_Projection):
    PREFIX = "PC"


class LDAReducer(Step):
    """Directions that separate the classes of the target."""

    OPTIONS: ClassVar = {"n_components": None, "columns": None, "target": None, "keep": None}

    def _fit(self, df: DataFrame) -> LDAReducerModel:
        target = self.target_of(df)
        if target is None:
            raise ValueError("discriminant projection needs a target column")
        names = self.pick(df, "numeric")
        within = scatter(df, names, by=target)
        classes, n = len(within.counts), within.n
        if classes < 2:
            raise ValueError("discriminant projection needs at least two classes")
        centre = within.mean
        # a column per class: their products are the scatter between classes
        between = np.array([np.sqrt(within.counts[c] / n) * (within.means[c] - centre) for c in sorted(within.counts)]).T
        best: list[np.ndarray] = []

        def solved(basis: np.ndarray, inner: np.ndarray):
            """Main axes of the class means after whitening by the spread within classes, inside a space."""
            spread, axes = np.linalg.eigh(inner / max(n - classes, 1))
            usable = spread > RIDGE * max(spread.max(initial=0.0), RIDGE)
            whiten = axes[:, usable] / np.sqrt(spread[usable])
            pulled = whiten.T @ (basis.T @ between)
            values, vectors = np.linalg.eigh(pulled @ pulled.T)
            return values[::-1].clip(min=0.0), (basis @ (whiten @ vectors))[:, ::-1], int(usable.sum())

        def enough(values, vectors, residuals) -> bool:
            """The separations no longer change."""
            found = solved(vectors, np.diag(values))[0][: classes - 1]
            same = bool(best) and len(best[-1]) == len(found) and np.allclose(best[-1], found, rtol=1e-13, atol=0)
            best.append(found)
            return same

        # the solution lies in the space that the class means span under repeated products with the matrix
        start = orthonormal(between, None, max(float(np.abs(between).max()), 1e-300))
        if not start.shape[1]:
            start = np.eye(len(names), 1)
        basis, inner = krylov(within, start, enough, fill=False)
        values, directions, rank = solved(basis, inner)
        limit = min(classes - 1, len(names), rank)
        k = min(self.opt("n_components") or limit, limit)
        directions = oriented(directions[:, :k])
        total = values[:limit].sum()
        return LDAReducerModel(self.options(), {
            "columns": names, "mean": centre.tolist(), "components": directions.T.tolist(),
            "ratios": (values[:k] / total if total > 0 else values[:k]).tolist(), "target": target,
        })


class LDAReducerModel(_Projection):
    PREFIX = "LD"
