"""Feature selection: which columns to keep is learned, keeping them is a projection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import inf, isqrt, nextafter
from multiprocessing.pool import ThreadPool
from sys import float_info
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import CATEGORICAL, NUMERIC, number, present, q
from tableloom.functions.stats import numeric_stats
from tableloom.operators.base import FittedStep, Step
from tableloom.operators.encode import category_codes
from tableloom.session import materialise

METHODS = ("variance", "correlation", "importance", "rfe")
TREES = 100
SEED = 42
MAX_CLASSES = 1000
#: Values or ranges of a feature that a forest tells apart, as Spark's forests do by default.
BINS = 32
#: A table of more rows is merged for a forest if that leaves no more than this many, and one in so many; trees learned
#: at once, and rows per task of one.
LONG_ROWS, MOST_CELLS, LEAST_SHRINK, TREES_AT_ONCE, TASK_CELLS = 1 << 18, 1 << 20, 4, 8, 1 << 16


class FeatureSelector(Step):
    OPTIONS: ClassVar = {
        "method": "variance", "threshold": 0.01, "k": None, "columns": None, "task_type": "classification",
        "target": None, "keep": None, "elimination_step": 1, "trees": TREES, "max_classes": MAX_CLASSES,
    }

    def _check(self) -> None:
        if self.opt("method") not in METHODS:
            raise ValueError(f"unknown selection method {self.opt('method')!r}, expected one of {', '.join(METHODS)}")
        if self.opt("task_type") not in ("classification", "regression"):
            raise ValueError("task_type must be 'classification' or 'regression'")

    def _fit(self, df: DataFrame) -> FeatureSelectorModel:
        method, target = self.opt("method"), self.target_of(df)
        features = self.pick(df, None)
        if method == "variance":
            numeric = [c for c in features if isinstance(df.schema[c].dataType, NUMERIC)]
            stats = numeric_stats(df, numeric, ["var_pop"])
            scores = {c: stats[c]["var_pop"] for c in numeric}
            kept = [c for c in numeric if scores[c] is not None and scores[c] > self.opt("threshold")]
            kept += [c for c in features if c not in numeric]
        elif target is None:
            scores, kept = {}, features
        elif method == "correlation":
            numeric = [c for c in features if isinstance(df.schema[c].dataType, NUMERIC)]
            scores = {r["column"]: r["score"] for r in f_scores(df, numeric, target, self.opt("task_type")).collect()}
            kept = self._best(numeric, scores) + [c for c in features if c not in numeric]
        elif method == "importance":
            scores = self._importances(df, features, target)
            kept = self._best(features, scores)
        else:
            kept, scores = self._eliminate(df, features, target)
        return FeatureSelectorModel(
            self.options(), {"features": features, "kept": kept or features, "scores": scores, "target": target}
        )

    def _best(self, names: Sequence[str], scores: dict[str, float | None]) -> list[str]:
        known = {c: (scores.get(c) if scores.get(c) is not None else float("-inf")) for c in names}
        k = self.opt("k")
        if k is None:
            return [c for c in names if known[c] >= self.opt("threshold")]
        best = set(sorted(names, key=lambda c: -known[c])[:k])
        return [c for c in names if c in best]

    def _importances(self, df: DataFrame, features: list[str], target: str) -> dict[str, float]:
        return importances(df, features, target, self.opt("task_type"), self.opt("trees"))

    def _eliminate(self, df: DataFrame, features: list[str], target: str):
        wanted = self.opt("k") or max(1, len(features) // 2)
        table = materialise(coded_features(df, features, target, self.opt("task_type")))
        cells = merged(table, features, self.opt("trees"))
        left, scores = list(features), {}
        while True:
            found = _forest_scores(table, cells, left, self.opt("task_type"), self.opt("trees"))
            scores.update(found)
            if len(left) <= wanted:
                return left, scores
            drop = min(self.opt("elimination_step"), len(left) - wanted)
            weakest = set(sorted(left, key=lambda c: found[c])[:drop])
            left = [c for c in left if c not in weakest]
            cells = None if cells is None else narrowed(cells, left, self.opt("trees"))


class FeatureSelectorModel(FittedStep):
    def _transform(self, df: DataFrame) -> DataFrame:
        considered = set(self.state["features"])
        chosen = [c for c in self.state["kept"] if c in df.columns]
        others = [c for c in df.columns if c not in considered]
        return df.select(*[q(c) for c in [*chosen, *others]])

    def scores(self, spark) -> DataFrame:
        kept = set(self.state["kept"])
        rows = [
            (c, None if s is None else float(s), c in kept)
            for c, s in self.state["scores"].items()
        ]
        return spark.createDataFrame(rows, "column string, score double, kept boolean")


def f_scores(df: DataFrame, columns: Sequence[str], target: str, task_type: str) -> DataFrame:
    """``(column, score)``: ANOVA F of each column over the classes, or F of its Pearson r with a numeric target."""
    if task_type == "regression":
        y = number(df, target)
        row = df.agg(
            *[F.corr(number(df, c), y).alias(f"r{i}") for i, c in enumerate(columns)],
            *[F.count(F.when(number(df, c).isNotNull(), y)).alias(f"n{i}") for i, c in enumerate(columns)],
        )
        scores = [
            F.try_divide(F.col(f"r{i}") * F.col(f"r{i}") * (F.col(f"n{i}") - 2), 1 - F.col(f"r{i}") * F.col(f"r{i}"))
            for i in range(len(columns))
        ]
    else:
        named = df.filter(present(df, target).isNotNull())
        classes = named.groupBy(q(target).alias("class")).agg(
            *[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
            *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.var_pop(number(df, c)).alias(f"v{i}") for i, c in enumerate(columns)],
        )
        row = classes.agg(
            F.count(F.lit(1)).alias("k"),
            *[F.sum(f"n{i}").alias(f"N{i}") for i in range(len(columns))],
            *[F.sum(F.col(f"n{i}") * F.col(f"v{i}")).alias(f"w{i}") for i in range(len(columns))],
            *[F.sum(F.col(f"n{i}") * F.col(f"m{i}")).alias(f"s{i}") for i in range(len(columns))],
            *[F.sum(F.col(f"n{i}") * F.col(f"m{i}") * F.col(f"m{i}")).alias(f"q{i}") for i in range(len(columns))],
        )
        scores = [
            F.try_divide(
                (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"N{i}")) * (F.col(f"N{i}") - F.col("k")),
                F.col(f"w{i}") * (F.col("k") - 1),
            )
            for i in range(len(columns))
        ]
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), s.alias("score")) for c, s in zip(columns, scores)]))
    )


def coded_features(df: DataFrame, features: Sequence[str], target: str, task_type: str) -> DataFrame:
    """Numbers as doubles, categories as sorted codes, missing as -1; the target as ``__y``."""
    text = [c for c in features if isinstance(df.schema[c].dataType, CATEGORICAL)]
    named = df.filter(present(df, target).isNotNull())
    if task_type == "regression":
        named = named.withColumn("__y", number(df, target))
    else:
        codes = class_codes(named, target)
        named = named.withColumn("__y", codes)
    coded = category_codes(named, text, target) if text else named
    return coded.select(*[F.coalesce(number(coded, c), F.lit(-1.0)).alias(c) for c in features], "__y")


def class_codes(df: DataFrame, target: str, most: int = MAX_CLASSES):
    """Sorted class labels as 0, 1, …, as an expression; a target has few classes."""
    labels = class_labels(df, target, most)
    numeric = isinstance(df.schema[target].dataType, NUMERIC)
    labels = sorted(labels, key=float) if numeric else labels
    value = q(target).cast("string")
    return reduce(lambda e, p: e.when(value == p[1], float(p[0])), enumerate(labels[1:], 1), F.when(value == labels[0], 0.0))


def class_labels(df: DataFrame, target: str, most: int = MAX_CLASSES) -> list[str]:
    """The classes of a target; more than ``most`` means it is not a class column."""
    counts = df.filter(present(df, target).isNotNull()).groupBy(q(target).cast("string").alias("label")).count()
    labels = [r["label"] for r in counts.select("label").limit(most + 1).collect()]
    if len(labels) > most:
        raise ValueError(f"{target} has more than {most} classes (max_classes)")
    return sorted(labels)


def cut_points(table: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Where the bins of each feature begin: at each value if there are few, else at even ranks over all rows; a value
    that holds several ranks is a bin of its own."""
    counts = table.agg(*[F.approx_count_distinct(q(c), 0.02).alias(f"n{i}") for i, c in enumerate(features)]).first()
    few = [counts[f"n{i}"] <= 2 * BINS for i in range(len(features))]
    ranks = [i / BINS for i in range(1, BINS)]
    found = table.agg(
        *[F.percentile_approx(q(c), ranks, 100 * BINS).alias(f"r{i}") for i, c in enumerate(features)],
        *[F.collect_set(q(c)).alias(f"v{i}") for i, c in enumerate(features) if few[i]],
    ).first()
    cuts = []
    for i in range(len(features)):
        ranked = found[f"r{i}"]
        values = set(found[f"v{i}"]) if few[i] else set()
        if not few[i] or len(values) > BINS:
            values = set(ranked) | {nextafter(v, inf) for v in set(ranked) if ranked.count(v) > 1}
        finite = {min(v, float_info.max) for v in values if v > -inf}
        cuts.append(sorted(finite) or [0.0])
    return cuts


def merged(table: DataFrame, features: Sequence[str], trees: int) -> DataFrame | None:
    """The rows of a long table that no tree can tell apart as one: bins named like the features, ``__y`` and the weights
    ``__w0``, ``__w1``, … in every tree. None where that saves little.

    A forest draws each row a Poisson number of times per tree, with mean 1; what equal rows are drawn together is
    Poisson with their number as the mean, so every row still counts in every tree as it did.
    """
    if table.count() <= LONG_ROWS:
        return None
    cuts = cut_points(table, features)
    names = [f"__b{i}" for i in range(len(features))]
    bins = Bucketizer(
        splitsArray=[[-inf, *c, inf] for c in cuts], inputCols=list(features), outputCols=names
    ).transform(table).select(*names, "__y")
    found = bins.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.struct(*names, "__y"), 0.02).alias("cells")).first()
    if found["cells"] > min(MOST_CELLS, found["rows"] / LEAST_SHRINK):
        return None
    cells = bins.groupBy(*names, "__y").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("seed", F.xxhash64(*names, "__y"))
    kept = [*names, "__y"]
    schema = ", ".join([f"{c} double" for c in kept] + [f"__w{t} double" for t in range(trees)])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = np.array([
                np.random.default_rng((SEED, seed % (1 << 64))).poisson(n, trees)
                for seed, n in zip(batch["seed"].tolist(), batch["n"].tolist())
            ], dtype=np.float64).reshape(len(batch), trees)
            weights = pd.DataFrame(drawn, index=batch.index, columns=[f"__w{t}" for t in range(trees)])
            yield pd.concat([batch[kept], weights], axis=1)

    drawn = materialise(cells.mapInPandas(draw, schema))
    return drawn.select(*[F.col(b).alias(c) for b, c in zip(names, features)], *drawn.columns[len(names) :])


def narrowed(cells: DataFrame, features: Sequence[str], trees: int) -> DataFrame:
    """Merged rows that differ in none of these features as one, drawn as often as they were together."""
    drawn = [F.sum(f"__w{t}").alias(f"__w{t}") for t in range(trees)]
    return materialise(cells.groupBy(*[q(c) for c in features], "__y").agg(*drawn))


def _forest_scores(
    table: DataFrame, cells: DataFrame | None, features: Sequence[str], task_type: str, trees: int
) -> dict[str, float]:
    kind = RandomForestRegressor if task_type == "regression" else RandomForestClassifier
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x")
    if cells is None:
        vectors = assembler.transform(table).select("__x", "__y")
        forest = kind(featuresCol="__x", labelCol="__y", numTrees=trees, seed=SEED).fit(vectors)
        weights = forest.featureImportances.toArray()
    else:
        weights = _weighted_trees(assembler.transform(cells), kind, task_type, trees)
    return {c: float(w) for c, w in zip(features, weights)}


def _weighted_trees(vectors: DataFrame, kind, task_type: str, trees: int) -> np.ndarray:
    """Importances of a forest whose trees are learned one by one, each with its own weights of the rows."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("__y").alias("top")).first()
    label, share = F.col("__y"), "onethird"
    if task_type == "classification":
        # a tree may draw no row of a rare class
        classes = {"ml_attr": {"type": "nominal", "num_vals": int(size["top"]) + 1}}
        label, share = label.alias("__y", metadata=classes), "sqrt"
    # Spark looks for cuts in the square of maxBins rows: here in all
    options = {
        "featuresCol": "__x", "labelCol": "__y", "weightCol": "__w", "numTrees": 1, "bootstrap": False,
        "featureSubsetStrategy": share if trees > 1 else "all", "maxBins": max(BINS, isqrt(size["n"]) + 1),
    }

    tasks = -(-size["n"] // TASK_CELLS)

    def one(t: int) -> np.ndarray:
        rows = vectors.select("__x", label, F.col(f"__w{t}").alias("__w")).filter("__w > 0").coalesce(tasks)
        return kind(seed=SEED + t, **options).fit(rows).featureImportances.toArray()

    with ThreadPool(min(TREES_AT_ONCE, trees)) as pool:
        total = sum(pool.map(inheritable_thread_target(vectors.sparkSession)(one), range(trees)))
    return total / total.sum() if total.sum() > 0 else total


def importances(
    df: DataFrame, features: Sequence[str], target: str, task_type: str = "classification", trees: int = TREES
) -> dict[str, float]:
    """Random-forest importance of every feature."""
    table = materialise(coded_features(df, features, target, task_type))
    return _forest_scores(table, merged(table, features, trees), features, task_type, trees)
