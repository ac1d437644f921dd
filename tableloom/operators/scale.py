"""Scaling. Learned parameters are a few numbers per column; applying them is a projection."""

from __future__ import annotations

import math
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.columns import number
from tableloom.functions.expr import box_cox, box_cox_inverse, yeo_johnson, yeo_johnson_inverse
from tableloom.functions.stats import numeric_stats, quantiles
from tableloom.operators.base import FittedStep, Step
from tableloom.operators.transform import best_lambdas

METHODS = ("standard", "minmax", "robust", "maxabs", "quantile", "power")
QUANTILES = 1000
TAIL = 1e-7


class FeatureScaler(Step):
    OPTIONS: ClassVar = {
        "method": "standard", "columns": None, "with_mean": True, "with_std": True,
        "power_method": "yeo-johnson", "lambda_": None, "n_quantiles": QUANTILES, "target": None, "keep": None,
    }

    def _check(self) -> None:
        if self.opt("method") not in METHODS:
            raise ValueError(f"unknown scaling method {self.opt('method')!r}, expected one of {', '.join(METHODS)}")
        if self.opt("power_method") not in ("yeo-johnson", "box-cox"):
            raise ValueError("power_method must be 'yeo-johnson' or 'box-cox'")

    def _fit(self, df: DataFrame) -> FeatureScalerModel:
        names = self.pick(df, "numeric")
        method = self.opt("method")
        learned: dict[str, dict] = {}
        if method == "standard":
            learned = _standard(df, names)
        elif method == "minmax":
            learned = numeric_stats(df, names, ["min", "max"])
        elif method == "maxabs":
            learned = {c: {"scale": s["max_abs"]} for c, s in numeric_stats(df, names, ["max_abs"]).items()}
        elif method == "robust":
            for c, v in quantiles(df, names, [0.25, 0.5, 0.75]).items():
                if v:
                    learned[c] = {"center": v[1], "scale": v[2] - v[0]}
        elif method == "quantile":
            counts = {c: s["count"] for c, s in numeric_stats(df, names, ["count"]).items()}
            for c in names:
                size = min(self.opt("n_quantiles"), counts[c])
                if size:
                    grid = np.linspace(0, 1, size).tolist()
                    learned[c] = {"grid": grid, "quantiles": quantiles(df, [c], grid, counts)[c]}
        else:
            learned = self._power(df, names)
        learned = {c: s for c, s in learned.items() if all(v is not None for v in s.values())}
        return FeatureScalerModel(self.options(), {"columns": learned})

    def _power(self, df: DataFrame, names: list[str]) -> dict[str, dict]:
        kind = self.opt("power_method")
        if kind == "box-cox" and any(
            s["min"] is not None and s["min"] <= 0 for s in numeric_stats(df, names, ["min"]).values()
        ):
            raise ValueError("box-cox scaling needs strictly positive data")
        fixed = self.opt("lambda_")
        lambdas = {c: fixed for c in names} if fixed is not None else best_lambdas(df, names, kind)
        forward = yeo_johnson if kind == "yeo-johnson" else box_cox
        powered = df.select(*[forward(number(df, c), lambdas[c]).alias(c) for c in names])
        after = _standard(powered, names)
        return {c: {"lambda": lambdas[c], **after[c]} for c in names}


def _standard(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Population deviation; a column without spread is divided by one."""
    return {
        c: {"mean": s["mean"], "scale": s["std_pop"] or (None if s["std_pop"] is None else 1.0)}
        for c, s in numeric_stats(df, names, ["mean", "std_pop"]).items()
    }


class FeatureScalerModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self._forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self._backward)

    def _apply(self, df: DataFrame, formula) -> DataFrame:
        scaled = {c: formula(number(df, c), s) for c, s in self.state["columns"].items() if c in df.columns}
        return df.withColumns(scaled) if scaled else df

    def _forward(self, x: Column, s: dict) -> Column:
        method = self.opt("method")
        if method == "standard":
            x = x - s["mean"] if self.opt("with_mean") else x
            return x / s["scale"] if self.opt("with_std") else x
        if method == "minmax":
            width = s["max"] - s["min"]
            return (x - s["min"]) / (width or 1.0)
        if method == "maxabs":
            return x / (s["scale"] or 1.0)
        if method == "robust":
            return (x - s["center"]) / (s["scale"] or 1.0)
        if method == "quantile":
            return _to_normal(s["quantiles"], s["grid"])(x)
        forward = yeo_johnson if self.opt("power_method") == "yeo-johnson" else box_cox
        return (forward(x, s["lambda"]) - s["mean"]) / s["scale"]

    def _backward(self, x: Column, s: dict) -> Column:
        method = self.opt("method")
        if method == "standard":
            x = x * s["scale"] if self.opt("with_std") else x
            return x + s["mean"] if self.opt("with_mean") else x
        if method == "minmax":
            return x * ((s["max"] - s["min"]) or 1.0) + s["min"]
        if method == "maxabs":
            return x * (s["scale"] or 1.0)
        if method == "robust":
            return x * (s["scale"] or 1.0) + s["center"]
        if method == "quantile":
            return _from_normal(s["quantiles"], s["grid"])(x)
        backward = yeo_johnson_inverse if self.opt("power_method") == "yeo-johnson" else box_cox_inverse
        return backward(x * s["scale"] + s["mean"], s["lambda"])

    def scale_params(self, spark: SparkSession) -> DataFrame:
        """Learned numbers as ``(column, parameter, value)``."""
        rows = [
            (c, name, float(v))
            for c, s in self.state["columns"].items()
            for name, v in s.items()
            if not isinstance(v, list)
        ]
        return spark.createDataFrame(rows, "column string, parameter string, value double")


#: Coefficients of algorithm AS 241 (Wichura, 1988), constant term first; its outermost range is not needed.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
OUTER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function for probabilities from 1e-10 to 1 - 1e-10."""
    centred = p - 0.5
    r = 0.180625 - centred * centred
    tail = np.sqrt(-np.log(np.minimum(p, 1 - p))) - 1.6
    value = [np.polynomial.polynomial.polyval(x, top) / np.polynomial.polynomial.polyval(x, bottom)
             for x, (top, bottom) in ((r, MIDDLE), (tail, OUTER))]
    return np.where(np.abs(centred) <= 0.425, centred * value[0], np.sign(centred) * value[1])


def _to_normal(values: list[float], grid: list[float]):
    """Rank by interpolation (from both sides, so ties map to their middle), then the normal inverse."""

    @F.pandas_udf("double")
    def normal(x: pd.Series) -> pd.Series:
        known, level = np.asarray(values), np.asarray(grid)
        v = x.to_numpy(dtype=float)
        ranks = 0.5 * (np.interp(v, known, level) - np.interp(-v, -known[::-1], -level[::-1]))
        ranks = np.where(v <= known[0], 0.0, np.where(v >= known[-1], 1.0, ranks))
        out = np.full(len(v), np.nan)
        ok = ~np.isnan(v)
        out[ok] = normal_quantile(ranks[ok].clip(TAIL, 1 - TAIL))
        return pd.Series(out).where(ok, None)

    return normal


def _from_normal(values: list[float], grid: list[float]):
    @F.pandas_udf("double")
    def original(z: pd.Series) -> pd.Series:
        v = z.to_numpy(dtype=float)
        ok = ~np.isnan(v)
        out = np.full(len(v), np.nan)
        erfc = np.frompyfunc(math.erfc, 1, 1)
        p = 0.5 * erfc(-v[ok] / math.sqrt(2)).astype(float)
        # clipped tails stand for the least and greatest value
        p = np.where(p < TAIL * 1.01, 0.0, np.where(p > 1 - TAIL * 1.01, 1.0, p))
        out[ok] = np.interp(p, grid, values)
        return pd.Series(out).where(ok, None)

    return original
