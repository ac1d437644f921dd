"""Numeric transforms with parameters frozen at fit time."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import number
from tableloom.functions.expr import box_cox, quotient, yeo_johnson
from tableloom.functions.stats import numeric_stats, quantiles
from tableloom.operators.base import FittedStep, Step

GRID = [x / 2 for x in range(-10, 11)]
GRID_POINTS = 21
GRID_ROUNDS = 4
#: Lambdas are looked for this far from 0 when the best one lies at an end of the grid.
WIDEST = 1000.0


class _Shifted(Step):
    """Adds a shift that makes the training minimum positive (or non-negative)."""

    def _shift(self, low: float | None) -> float | None:
        raise NotImplementedError

    def _shifts(self, df: DataFrame) -> dict[str, float]:
        names = self.pick(df, "numeric")
        lows = {c: s["min"] for c, s in numeric_stats(df, names, ["min"]).items()}
        return {c: self._shift(low) for c, low in lows.items() if low is not None}


class LogTransformer(_Shifted):
    OPTIONS: ClassVar = {"columns": None, "base": math.e, "shift": 1e-6, "target": None, "keep": None}

    def _shift(self, low: float) -> float:
        return self.opt("shift") if low > 0 else abs(low) + self.opt("shift")

    def _fit(self, df: DataFrame) -> LogModel:
        return LogModel(self.options(), {"shifts": self._shifts(df)})


class LogModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        scale = math.log(self.opt("base"))
        return _replace(df, self.state["shifts"], lambda x, s: F.log(F.when(x + s > 0, x + s)) / scale)


class SqrtTransformer(_Shifted):
    OPTIONS: ClassVar = {"columns": None, "shift": 0.0, "target": None, "keep": None}

    def _shift(self, low: float) -> float:
        return self.opt("shift") if low >= 0 else abs(low) + self.opt("shift")

    def _fit(self, df: DataFrame) -> SqrtModel:
        return SqrtModel(self.options(), {"shifts": self._shifts(df)})


class SqrtModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, self.state["shifts"], lambda x, s: F.sqrt(F.when(x + s >= 0, x + s)))


class ReciprocalTransformer(Step):
    OPTIONS: ClassVar = {"columns": None, "shift": 1e-6, "target": None, "keep": None}

    def _fit(self, df: DataFrame) -> ReciprocalModel:
        return ReciprocalModel(self.options(), {"shifts": {c: self.opt("shift") for c in self.pick(df, "numeric")}})


class ReciprocalModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, self.state["shifts"], lambda x, s: quotient(F.lit(1.0), x + s))


class _Power(Step):
    OPTIONS: ClassVar = {"columns": None, "lambda_": None, "target": None, "keep": None}

    def _lambdas(self, df: DataFrame, names: Sequence[str], kind: str) -> dict[str, float]:
        fixed = self.opt("lambda_")
        return {c: float(fixed) for c in names} if fixed is not None else best_lambdas(df, names, kind)


class BoxCoxTransformer(_Power):
    def _fit(self, df: DataFrame) -> BoxCoxModel:
        names = self.pick(df, "numeric")
        lows = {c: s["min"] for c, s in numeric_stats(df, names, ["min"]).items()}
        names = [c for c in names if lows[c] is not None]
        shifts = {c: (abs(lows[c]) + 1 if lows[c] <= 0 else 0.0) for c in names}
        shifted = df.select(*[(number(df, c) + shifts[c]).alias(c) for c in names])
        lambdas = self._lambdas(shifted, names, "box-cox")
        return BoxCoxModel(self.options(), {"params": {c: [shifts[c], lambdas[c]] for c in names}})


class BoxCoxModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, self.state["params"], lambda x, p: box_cox(x + p[0], p[1]))


class YeoJohnsonTransformer(_Power):
    def _fit(self, df: DataFrame) -> YeoJohnsonModel:
        names = self.pick(df, "numeric")
        return YeoJohnsonModel(self.options(), {"params": self._lambdas(df, names, "yeo-johnson")})


class YeoJohnsonModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, self.state["params"], yeo_johnson)


class PercentileTransformer(Step):
    """Share of learned quantile points strictly below the value."""

    OPTIONS: ClassVar = {"columns": None, "n_quantiles": 1000, "target": None, "keep": None}

    def _fit(self, df: DataFrame) -> PercentileModel:
        names = self.pick(df, "numeric")
        points = np.linspace(0, 1, self.opt("n_quantiles")).tolist()
        learned = {c: v for c, v in quantiles(df, names, points).items() if v}
        return PercentileModel(self.options(), {"quantiles": learned})


class PercentileModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, self.state["quantiles"], lambda x, v: _share_below(v)(x))


def _share_below(points: list[float]):
    @F.pandas_udf("double")
    def share(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        found = np.searchsorted(np.asarray(points), v, side="left") / len(points)
        return pd.Series(found).where(~np.isnan(v), None)

    return share


def _replace(df: DataFrame, learned: Mapping, formula) -> DataFrame:
    changed = {c: formula(number(df, c), p) for c, p in learned.items() if c in df.columns}
    return df.withColumns(changed) if changed else df


# -- lambda by maximum likelihood ------------------------------------------------


def best_lambdas(df: DataFrame, names: Sequence[str], kind: str) -> dict[str, float]:
    """Maximum-likelihood lambda for all columns at once.

    Each round scores a grid of lambdas for every column in one aggregation, then
    the bracket around the best one is gridded again. A best point at an end of
    its grid moves the grid outwards instead.
    """
    if not names:
        return {}
    forward = box_cox if kind == "box-cox" else yeo_johnson
    grids = {c: list(GRID) for c in names}
    best = dict.fromkeys(names, 1.0)
    rounds = dict.fromkeys(names, GRID_ROUNDS)
    while open_ := [c for c in names if rounds[c] > 0]:
        aggregates: list[Column] = []
        for i, c in enumerate(open_):
            x = number(df, c)
            logs = F.log(F.when(x > 0, x)) if kind == "box-cox" else F.signum(x) * F.log1p(F.abs(x))
            aggregates += [F.count(x).alias(f"{i}:n"), F.sum(logs).alias(f"{i}:logs")]
            aggregates += [F.var_pop(forward(x, lam)).alias(f"{i}:{j}") for j, lam in enumerate(grids[c])]
        row = df.agg(*aggregates).first()
        for i, c in enumerate(open_):
            n, logs = row[f"{i}:n"], row[f"{i}:logs"]
            if not n:
                rounds[c] = 0
                continue

            def score(j: int, lam: float, n=n, logs=logs, i=i) -> float:
                variance = row[f"{i}:{j}"]
                if variance is None or variance <= 0 or not math.isfinite(variance):
                    return -math.inf
                return -n / 2 * math.log(variance) + (lam - 1) * logs

            scores = [score(j, lam) for j, lam in enumerate(grids[c])]
            top = int(np.argmax(scores))
            best[c] = grids[c][top]
            step = grids[c][1] - grids[c][0]
            if top in (0, len(grids[c]) - 1) and scores[top] > -math.inf and abs(best[c]) < WIDEST:  # an end point: look further out first
                grids[c] = [best[c] + (x - GRID_POINTS // 2) * 2 * step for x in range(GRID_POINTS)]
                continue
            rounds[c] -= 1
            grids[c] = np.linspace(best[c] - step, best[c] + step, GRID_POINTS).tolist()
    return {c: float(v) for c, v in best.items()}
