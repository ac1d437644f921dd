"""Training and scoring on ``pyspark.ml``, eleven model kinds behind one function."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any, ClassVar

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import NUMERIC, detect_target, number, q
from tableloom.functions.expr import unit_hash
from tableloom.functions.knn import knn_join
from tableloom.operators.base import FittedStep, Step
from tableloom.operators.boosting import HistogramBooster
from tableloom.operators.cells import cells_for
from tableloom.operators.scale import FeatureScaler
from tableloom.operators.select import class_labels
from tableloom.session import materialise

TREE_DEPTH_LIMIT = 30
FEATURES, LABEL, KEY = "__features", "__y", "__key"


# -- parameters (fixed values: names, types, defaults, ranges) --------------------


def _int(default, low=None, high=None, category=""):
    return {"type": "int", "default": default, "min": low, "max": high, "category": category}


def _float(default, low=None, high=None, category=""):
    return {"type": "float", "default": default, "min": low, "max": high, "category": category}


def _choice(default, *choices, kind="str", category=""):
    return {"type": kind, "default": default, "choices": list(choices), "category": category}


_INTERCEPT = {"fit_intercept": _choice(True, True, False, kind="bool", category="model")}
_ALPHA = {"alpha": _float(1.0, 0.001, 100.0, "regularization")}
_TREE = {
    "max_depth": _int(None, 1, TREE_DEPTH_LIMIT, "tree"), "min_samples_split": _int(2, 2, 100, "tree"),
    "min_samples_leaf": _int(1, 1, 100, "tree"), "max_features": _choice("sqrt", "auto", "sqrt", "log2", None),
    "random_state": _int(42, category="reproducibility"),
}
_BOOST = {
    "n_estimators": _int(100, 10, 1000, "boosting"), "learning_rate": _float(0.1, 0.001, 1.0, "boosting"),
    "random_state": _int(42, category="reproducibility"),
}
_SUBSAMPLE = {"subsample": _float(1.0, 0.1, 1.0, "sampling")}

SCHEMAS: dict[str, dict[str, dict]] = {
    "linear": {**_INTERCEPT, "C": _float(1.0, 0.001, 100.0, "regularization"),
               "max_iter": _int(1000, 100, 10000, "optimization")},
    "ridge": {**_INTERCEPT, **_ALPHA},
    "lasso": {**_INTERCEPT, **_ALPHA},
    "elasticnet": {**_INTERCEPT, **_ALPHA, "l1_ratio": _float(0.5, 0.0, 1.0, "regularization")},
    "decisiontree": _TREE,
    "randomforest": {**_TREE, "n_estimators": _int(100, 10, 1000, "ensemble"),
                     "bootstrap": _choice(True, True, False, kind="bool", category="ensemble")},
    "gradientboosting": {**_BOOST, **_SUBSAMPLE, "max_depth": _int(3, 1, 20, "tree"),
                         "min_samples_split": _int(2, 2, 100, "tree")},
    "xgboost": {**_BOOST, **_SUBSAMPLE, "max_depth": _int(6, 1, 20, "tree"),
                "colsample_bytree": _float(1.0, 0.1, 1.0, "sampling"),
                "reg_alpha": _float(0.0, 0.0, 10.0, "regularization"),
                "reg_lambda": _float(1.0, 0.0, 10.0, "regularization")},
    "lightgbm": {**_BOOST, **_SUBSAMPLE, "num_leaves": _int(31, 2, 255, "tree"),
                 "min_child_samples": _int(20, 5, 100, "tree")},
    "catboost": {**_BOOST, "depth": _int(6, 1, 16, "tree"), "l2_leaf_reg": _float(3.0, 0.0, 10.0, "regularization"),
                 "border_count": _int(254, 1, 255, "preprocessing")},
    "knn": {"n_neighbors": _int(5, 1, 100, "model"), "weights": _choice("uniform", "uniform", "distance"),
            "metric": _choice("minkowski", "euclidean", "manhattan", "chebyshev", "minkowski"),
            "p": _int(2, 1, 10, "distance"), "scaler_type": _choice("standard", "standard", "minmax", "robust", "none")},
}
KINDS = tuple(SCHEMAS)
REGRESSION_ONLY = ("ridge", "lasso", "elasticnet")


def schema_for(kind: str, task: str) -> dict[str, dict]:
    if kind not in SCHEMAS:
        raise ValueError(f"unknown model {kind!r}, expected one of {', '.join(KINDS)}")
    schema = dict(SCHEMAS[kind])
    if kind == "linear" and task == "regression":
        schema = dict(_INTERCEPT)
    return schema


def checked_params(kind: str, task: str, params: Mapping[str, Any] | None) -> dict[str, Any]:
    """Defaults filled in; unknown names and values out of range are errors."""
    schema = schema_for(kind, task)
    if task not in ("classification", "regression"):
        raise ValueError("task must be 'classification' or 'regression'")
    if kind in REGRESSION_ONLY and task != "regression":
        raise ValueError(f"{kind} is a regression model")
    given = dict(params or {})
    unknown = sorted(set(given) - set(schema))
    if unknown:
        raise ValueError(f"{kind} has no parameter {', '.join(unknown)}")
    for name, value in given.items():
        rule = schema[name]
        if "choices" in rule and value not in rule["choices"]:
            raise ValueError(f"{name}={value!r} is not one of {rule['choices']}")
        if value is not None and "choices" not in rule:
            if rule["min"] is not None and value < rule["min"] or rule["max"] is not None and value > rule["max"]:
                raise ValueError(f"{name}={value!r} is outside {rule['min']} … {rule['max']}")
    filled = {**{name: rule["default"] for name, rule in schema.items()}, **given}
    if "max_depth" in filled and filled["max_depth"] is None:
        filled["max_depth"] = TREE_DEPTH_LIMIT  # unlimited is as deep as Spark's trees go; that is what is logged
    return filled


# -- estimators ---------------------------------------------------------------------


def _columns() -> dict[str, str]:
    return {"featuresCol": FEATURES, "labelCol": LABEL}


def _linear(task, p, rows, spread, classes) -> Estimator:
    if task == "regression":
        return LinearRegression(**_columns(), regParam=0.0, fitIntercept=p["fit_intercept"])
    return LogisticRegression(
        **_columns(), regParam=1.0 / (p["C"] * rows), standardization=False, maxIter=p["max_iter"],
        fitIntercept=p["fit_intercept"], tol=1e-9,
    )


def _penalised(p, l1: float, l2: float) -> Estimator:
    """Spark's objective halves the squared loss per row and scales the L2 part by the label's deviation."""
    total = l1 + l2
    return LinearRegression(
        **_columns(), regParam=total, elasticNetParam=(l1 / total if total else 0.0), standardization=False,
        fitIntercept=p["fit_intercept"], maxIter=10000, tol=1e-9,
    )


def _ridge(task, p, rows, spread, classes):
    return _penalised(p, 0.0, p["alpha"] / rows * spread)


def _lasso(task, p, rows, spread, classes):
    return _penalised(p, p["alpha"], 0.0)


def _elasticnet(task, p, rows, spread, classes):
    return _penalised(p, p["alpha"] * p["l1_ratio"], p["alpha"] * (1 - p["l1_ratio"]) * spread)


def _tree_settings(p) -> dict[str, Any]:
    if p["min_samples_split"] != 2:
        raise ValueError("min_samples_split is not offered; use min_samples_leaf")
    return {
        **_columns(), "maxDepth": p["max_depth"],
        "minInstancesPerNode": p["min_samples_leaf"], "seed": p["random_state"],
    }


def _subset(p) -> str:
    return {None: "all", "auto": "sqrt", "sqrt": "sqrt", "log2": "log2"}[p["max_features"]]


def _decisiontree(task, p, rows, spread, classes):
    if p["max_features"] is None:
        return (DecisionTreeRegressor if task == "regression" else DecisionTreeClassifier)(**_tree_settings(p))
    return _forest(task, p, numTrees=1, bootstrap=False)


def _randomforest(task, p, rows, spread, classes):
    return _forest(task, p, numTrees=p["n_estimators"], bootstrap=p["bootstrap"])


def _forest(task, p, **more):
    kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
    return kind(**_tree_settings(p), featureSubsetStrategy=_subset(p), **more)


def _boosted(task, p, classes, **more) -> Estimator:
    settings = {
        **_columns(), "maxIter": p["n_estimators"], "stepSize": p["learning_rate"], "seed": p["random_state"],
        "subsamplingRate": p.get("subsample", 1.0), **more,
    }
    return (GBTRegressor if task == "regression" else GBTClassifier)(**settings)


def _second_order(task, p, classes, **more) -> Estimator:
    return HistogramBooster(
        task=task, classes=classes, features=FEATURES, label=LABEL, rounds=p["n_estimators"],
        learning_rate=p["learning_rate"], subsample=p.get("subsample", 1.0), seed=p["random_state"], **more,
    )


def _gradientboosting(task, p, rows, spread, classes):
    if p["min_samples_split"] != 2:
        raise ValueError("min_samples_split is not offered")
    if classes > 2:  # rounds under one softmax; Spark's own boosting is binary
        return _second_order(task, p, classes, max_depth=p["max_depth"])
    return _boosted(task, p, classes, maxDepth=p["max_depth"])


def _xgboost(task, p, rows, spread, classes):
    return _second_order(
        task, p, classes, max_depth=p["max_depth"], column_share=p["colsample_bytree"], l1=p["reg_alpha"],
        l2=p["reg_lambda"], min_hessian=1.0, max_bins=256,
    )


def _lightgbm(task, p, rows, spread, classes):
    return _second_order(
        task, p, classes, growth="leaf", max_leaves=p["num_leaves"], min_rows=p["min_child_samples"], min_hessian=1e-3,
    )


def _catboost(task, p, rows, spread, classes):
    return _second_order(
        task, p, classes, growth="oblivious", max_depth=p["depth"], l2=p["l2_leaf_reg"], max_bins=p["border_count"] + 1,
    )


_BUILDERS = {
    "linear": _linear, "ridge": _ridge, "lasso": _lasso, "elasticnet": _elasticnet, "decisiontree": _decisiontree,
    "randomforest": _randomforest, "gradientboosting": _gradientboosting, "xgboost": _xgboost,
    "lightgbm": _lightgbm, "catboost": _catboost,
}


# -- nearest neighbours ---------------------------------------------------------------


class NeighbourModel(Step):
    """Classifier or regressor by the k nearest training rows in scaled space.

    The training table stays a table. ``key`` identifies query rows.
    """

    OPTIONS: ClassVar = {
        "task": "classification", "features": None, "label": LABEL, "key": None, "n_neighbors": 5,
        "weights": "uniform", "metric": "minkowski", "p": 2, "scaler_type": "standard",
    }

    def _fit(self, df: DataFrame) -> NeighbourModelFitted:
        names = list(self.opt("features"))
        scaler = {}
        if self.opt("scaler_type") != "none":
            fitted = FeatureScaler(method=self.opt("scaler_type"), columns=names).fit(df)
            scaler = {"settings": fitted.settings, "columns": fitted.state["columns"]}
            df = fitted.transform(df)
        train = df.select(
            q(self.opt("key")).alias("row_id"), q(self.opt("label")).alias("label"),
            F.array(*[number(df, c) for c in names]).alias("vector"),
        )
        return NeighbourModelFitted(self.options(), {"scaler": scaler}, {"train": materialise(train)})


class NeighbourModelFitted(FittedStep):
    def _scaled(self, df: DataFrame) -> DataFrame:
        from tableloom.operators.scale import FeatureScalerModel

        names, scaler = self.opt("features"), self.state["scaler"]
        if scaler:
            df = FeatureScalerModel(scaler["settings"], {"columns": scaler["columns"]}).transform(df)
        return df.select(
            q(self.opt("key")).alias("query_id"), F.array(*[number(df, c) for c in names]).alias("vector")
        )

    def kneighbors(self, df: DataFrame, n_neighbors: int | None = None, exclude_same: bool = False) -> DataFrame:
        """``(query_id, candidate_id, distance, rank)`` among the training rows."""
        return knn_join(
            self._scaled(df), self.tables["train"], n_neighbors or self.opt("n_neighbors"), query_id="query_id",
            candidate_id="row_id", metric=self.opt("metric"), p=float(self.opt("p")), exclude_same=exclude_same,
        )

    def votes(self, df: DataFrame, exclude_same: bool = False) -> DataFrame:
        """``(query_id, label, weight)``; for a regression the label is the neighbour's value."""
        near = self.kneighbors(df, exclude_same=exclude_same)
        labels = self.tables["train"].select(F.col("row_id").alias("candidate_id"), "label")
        near = near.join(labels, "candidate_id")
        if self.opt("weights") == "uniform":
            return near.select("query_id", "label", F.lit(1.0).alias("weight"))
        # a neighbour at distance zero outweighs all others
        exact = near.groupBy("query_id").agg(F.min("distance").alias("closest"))
        weight = F.when(F.col("closest") == 0, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
        return near.join(exact, "query_id").select("query_id", "label", weight.alias("weight"))

    def predictions(self, df: DataFrame, exclude_same: bool = False) -> DataFrame:
        """``(query_id, prediction)``; the smallest label wins a tie."""
        votes = self.votes(df, exclude_same)
        if self.opt("task") == "regression":
            mean = F.sum(F.col("weight") * F.col("label")) / F.sum("weight")
            return votes.groupBy("query_id").agg(mean.alias("prediction"))
        tally = votes.groupBy("query_id", "label").agg(F.sum("weight").alias("weight"))
        return tally.groupBy("query_id").agg(
            F.min_by("label", F.struct(-F.col("weight"), F.col("label"))).alias("prediction")
        )

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``(query_id, label, probability)`` of the classes among the neighbours."""
        if self.opt("task") != "classification":
            raise ValueError("probabilities exist only for classification")
        votes = self.votes(df)
        total = votes.groupBy("query_id").agg(F.sum("weight").alias("total"))
        tally = votes.groupBy("query_id", "label").agg(F.sum("weight").alias("weight"))
        return tally.join(total, "query_id").select(
            "query_id", "label", (F.col("weight") / F.col("total")).alias("probability")
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        found = self.predictions(df).withColumnRenamed("query_id", "__found")
        return df.join(found, q(self.opt("key")) == F.col("__found"), "left").drop("__found")


# -- training workflow -------------------------------------------------------------------


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same rows under any partitioning."""
    u = unit_hash(q(key), seed=seed)
    return df.filter(u >= test_size), df.filter(u < test_size)


def fold_column(key: str, folds: int, seed: int = 42, label: Column | None = None) -> Column:
    """Fold number per row; with a label the folds are drawn within each class."""
    parts = [q(key)] + ([label] if label is not None else [])
    return F.floor(unit_hash(*parts, seed=seed) * folds).cast("int")


@dataclass
class Trained:
    kind: str
    task: str
    params: dict[str, Any]
    model: Model
    features: list[str]
    target: str
    key: str
    labels: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    train_rows: int = 0
    test_rows: int = 0

    def score(self, df: DataFrame) -> DataFrame:
        """The table with ``prediction`` (a class label or a number)."""
        scored = _score(self.model, _assembled(df, self.features, None, self.key), self.kind)
        scored = scored.drop(FEATURES, KEY, "rawPrediction", "probability")
        return scored.withColumn("prediction", self._label(F.col("prediction"))) if self.labels else scored

    def probabilities(self, df: DataFrame) -> DataFrame:
        """The table with ``probability``: one number per class, in the order of ``labels``."""
        if self.task != "classification":
            raise ValueError("probabilities exist only for classification")
        if self.kind == "knn":
            return self.model.probabilities(_assembled(df, self.features, None, self.key))
        assembled = _assembled(df, self.features, None, self.key)
        scored = _score(self.model, assembled, self.kind)
        return scored.withColumn("probability", vector_to_array("probability")).drop(FEATURES, KEY, "rawPrediction")

    def evaluate(self, df: DataFrame, metrics: Sequence[str] | None = None) -> dict[str, float]:
        labelled = _assembled(df, self.features, self._target_column(df), self.key)
        found = {r["metric"]: r["value"] for r in evaluation(_score(self.model, labelled, self.kind), LABEL, "prediction", self.task).collect()}
        return {k: v for k, v in found.items() if not metrics or k in metrics}

    def _label(self, code: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), code.cast("int") + 1)

    def _target_column(self, df: DataFrame) -> Column:
        return _target(df, self.target, self.task, self.labels)


def _target(df: DataFrame, target: str, task: str, labels: Sequence[str]) -> Column:
    if task == "regression":
        return number(df, target)
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), q(target).cast("string"))
    return F.when(position > 0, (position - 1).cast("double"))


def _assembled(df: DataFrame, features: Sequence[str], label: Column | None, key: str) -> DataFrame:
    df = df.withColumn(KEY, q(key))
    df = df.withColumn(LABEL, label) if label is not None else df
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def _score(model: Model, assembled: DataFrame, kind: str) -> DataFrame:
    return model.transform(assembled)


def _estimator(kind: str, task: str, params: dict, features, table: DataFrame, labels) -> Estimator:
    if kind == "knn":
        return NeighbourModel(task=task, features=list(features), key=KEY, label=LABEL, **params)
    if kind not in ("linear", *REGRESSION_ONLY):  # only penalties are scaled
        return _BUILDERS[kind](task, params, 1, 1.0, len(labels))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(LABEL).alias("s")).first()
    return _BUILDERS[kind](task, params, max(size["n"], 1), size["s"] or 1.0, len(labels))


@dataclass
class Learned:
    """A fitted model with its metrics on the rows it was taught or on the others, and numbers of both kinds of rows."""

    model: Model
    metrics: Callable[[bool], dict[str, float]]
    sizes: Callable[[], tuple[int, int]]


def _learned(estimator: Estimator, kind: str, task: str, table: DataFrame, taught: Column, features, labels) -> Learned:
    """Fits on the rows that are ``taught``; where sums over equal rows decide, on those."""
    cells = cells_for(table, taught, estimator, features, FEATURES, LABEL, task, len(labels))
    if cells is None:
        model = estimator.fit(table.filter(taught))
        return Learned(
            model, lambda part: _metrics(_score(model, table.filter(taught if part else ~taught), kind), task),
            lambda: tuple(table.agg(F.count_if(taught), F.count_if(~taught)).first()),
        )
    model = cells.fit(estimator)
    scored = cells.scored(model)
    counts = [F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).cast("long") for side in (F.col("taught"), ~F.col("taught"))]
    return Learned(
        model, lambda part: _metrics(scored.filter(F.col("taught") == part), task, "n", "spread"),
        lambda: tuple(scored.agg(*counts).first()),
    )


def _metrics(scored: DataFrame, task: str, *more: str) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in evaluation(scored, LABEL, "prediction", task, None, *more).collect()}


def _prepared(df: DataFrame, task: str, target: str | None, features, key: str):
    target = target or detect_target(df)
    if target is None:
        raise ValueError("training needs a target column")
    names = list(features) if features else [
        f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in (target, key)
    ]
    labels = class_labels(df, target) if task == "classification" else []
    if labels and isinstance(df.schema[target].dataType, NUMERIC):
        labels = sorted(labels, key=float)
    return target, names, labels


def train(
    df: DataFrame, kind: str, task: str, key: str, target: str | None = None,
    features: Sequence[str] | None = None, params: Mapping[str, Any] | None = None,
    test_size: float = 0.2, seed: int = 42, log=None,
) -> Trained:
    """Split, fit, evaluate on the held-out rows; optionally write the run to a ``RunLog``."""
    checked = checked_params(kind, task, params)
    target, names, labels = _prepared(df, task, target, features, key)
    label = _target(df, target, task, labels)
    table = materialise(_assembled(df, names, label, key).filter(F.col(LABEL).isNotNull()))
    run_id = log.start_run(kind, task, checked) if log else None
    taught = unit_hash(q(KEY), seed=seed) >= test_size
    estimator = _estimator(kind, task, checked, names, table.filter(taught), labels)
    found = _learned(estimator, kind, task, table, taught, names, labels)
    metrics, sizes = found.metrics(False), found.sizes()
    if log:
        log.log_metrics(run_id, {k: v for k, v in metrics.items() if v is not None})
        log.finish_run(run_id)
    return Trained(kind, task, checked, found.model, names, target, key, labels, metrics, sizes[0], sizes[1])


def cross_validate(
    df: DataFrame, kind: str, task: str, key: str, target: str | None = None,
    features: Sequence[str] | None = None, params: Mapping[str, Any] | None = None,
    folds: int = 5, scoring: str | None = None, seed: int = 42, parallelism: int = 2,
) -> dict[str, Any]:
    """Scores per fold, their mean and population deviation, and the mean training score."""
    checked = checked_params(kind, task, params)
    return cross_validated(folded(df, task, key, target, features, folds, seed), kind, task, checked, scoring, parallelism)


@dataclass
class Folded:
    """A table written with the fold of every row, to be learned from more than once."""

    table: DataFrame
    features: list[str]
    labels: list[str]
    folds: int


def folded(
    df: DataFrame, task: str, key: str, target: str | None = None, features: Sequence[str] | None = None, folds: int = 5,
    seed: int = 42,
) -> Folded:
    target, names, labels = _prepared(df, task, target, features, key)
    label = _target(df, target, task, labels)
    table = _assembled(df, names, label, key).filter(F.col(LABEL).isNotNull())
    stratum = F.col(LABEL) if task == "classification" else None
    table = materialise(table.withColumn("__fold", fold_column(KEY, folds, seed, stratum)))
    return Folded(table, names, labels, folds)


def cross_validated(
    rows: Folded, kind: str, task: str, checked: dict[str, Any], scoring: str | None = None, parallelism: int = 2
) -> dict[str, Any]:
    """``cross_validate`` with checked parameters on a table that has its folds."""
    scoring = scoring or ("accuracy" if task == "classification" else "r2")
    table, names, labels, folds = rows.table, rows.features, rows.labels, rows.folds

    def one(fold: int) -> tuple[float, float]:
        taught = F.col("__fold") != fold
        estimator = _estimator(kind, task, checked, names, table.filter(taught), labels)
        found = _learned(estimator, kind, task, table, taught, names, labels)
        return tuple(found.metrics(part)[scoring] for part in (False, True))

    with ThreadPool(min(parallelism, folds)) as pool:
        results = pool.map(inheritable_thread_target(table.sparkSession)(one), range(folds))
    scores = [r[0] for r in results]
    mean = sum(scores) / folds
    return {
        "cv_scores": scores, "mean_score": mean,
        "std_score": math.sqrt(sum((s - mean) ** 2 for s in scores) / folds),
        "train_scores": sum(r[1] for r in results) / folds,
    }


# -- metrics -----------------------------------------------------------------------------


def evaluation(
    df: DataFrame, label: str, prediction: str, task: str, metrics: Sequence[str] | None = None,
    weight: str | None = None, spread: str | None = None,
) -> DataFrame:
    """``(metric, value)``: accuracy and F1 from the confusion table, or squared errors and R².

    A row may stand for ``weight`` rows; for a regression ``label`` is then their mean and ``spread`` their squared
    distances from it.
    """
    if task == "classification":
        found = _classification(df, label, prediction, weight)
    else:
        y, p = q(label).cast("double"), q(prediction).cast("double")
        if weight is None:
            mse, variance = F.avg((y - p) * (y - p)), F.var_pop(y)
        else:
            w, within = q(weight), q(spread)
            middle = df.agg(F.sum(w * y) / F.sum(w)).first()[0]
            mse, variance = (F.sum(within + w * gap * gap) / F.sum(w) for gap in (y - p, y - F.lit(middle)))
        row = df.agg(mse.alias("mse"), variance.alias("variance"))
        found = row.select(F.inline(F.array(
            _metric("mse", F.col("mse")), _metric("rmse", F.sqrt("mse")),
            _metric("r2", 1 - F.try_divide(F.col("mse"), F.col("variance"))),
        )))
    return found.filter(F.col("metric").isin(list(metrics))) if metrics else found


def _metric(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))


def _classification(df: DataFrame, label: str, prediction: str, weight: str | None) -> DataFrame:
    rows = F.count(F.lit(1)) if weight is None else F.sum(q(weight)).cast("bigint")
    cells = df.groupBy(q(label).alias("a"), q(prediction).alias("p")).agg(rows.alias("n"))
    same = F.col("a") == F.col("p")
    none = F.lit(0).cast("bigint")

    def record(name: Column, actual: Column, predicted: Column, hit: Column) -> Column:
        return F.struct(
            name.cast("string").alias("class"), actual.alias("actual"), predicted.alias("predicted"), hit.alias("hit")
        )

    # one record for the true class and one for the predicted class of each cell
    n = F.col("n")
    sides = cells.select(F.inline(F.array(
        record(F.col("a"), n, none, F.when(same, n).otherwise(none)), record(F.col("p"), none, n, none)
    )))
    classes = sides.groupBy("class").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    f1 = 2.0 * F.col("hit") / (F.col("actual") + F.col("predicted"))
    return classes.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1_weighted"),
    ).select(F.inline(F.array(*[_metric(m, F.col(m)) for m in ("accuracy", "f1_macro", "f1_weighted")])))
