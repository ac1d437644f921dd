"""Trees of Spark over rows that no tree can tell apart, as one weighted row each.

Spark's trees see a feature only through its bins, and their splits and leaves depend on sums alone: for a regression, also
under boosting, on the number and mean label of the rows with equal bins, for classes on their number per label. So a long
table is added up to its combinations of bins first. The cuts are those that Spark itself would take: from the sample of
rows that it would draw, by its own rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt, prod

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableloom.functions.columns import q
from tableloom.session import materialise

#: A table of more rows is added up, if there are at most so many combinations and one for so many rows; rows per task.
LONG_ROWS, MOST_CELLS, LEAST_SHRINK, TASK_CELLS = 1 << 18, 1 << 20, 4, 1 << 16
#: Rows that Spark looks for cuts in, unless the square of the number of bins is more.
SAMPLE_ROWS = 10_000


def sums_decide(estimator: Estimator) -> bool:
    """Whether a fit sees each row once, by its bins, and counts no rows in leaves."""
    if isinstance(estimator, (GBTRegressor, GBTClassifier)):
        if estimator.getSubsamplingRate() != 1.0:
            return False
    elif not isinstance(estimator, (DecisionTreeRegressor, DecisionTreeClassifier)):
        return False
    return estimator.getMinInstancesPerNode() == 1


def spark_cuts(rows: DataFrame, n: int, features: Sequence[str], estimator: Estimator) -> list[list[float]]:
    """The cuts that ``estimator`` would try on these ``n`` rows."""
    bins = min(estimator.getMaxBins(), n)
    share = min(1.0, max(bins * bins, SAMPLE_ROWS) / n)
    seen = rows.select(*[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    if share < 1:
        spark = rows.sparkSession
        seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(estimator.getSeed()).nextInt()
        drawn = seen._jdf.javaRDD().sample(False, share, seed)
        seen = DataFrame(spark._jsparkSession.createDataFrame(drawn, seen._jdf.schema()), spark)
    sample = np.array([tuple(r) for r in seen.collect()], dtype=float).reshape(-1, len(features))
    return [cuts_of(x, share * n, bins - 1) for x in sample.T]


def cuts_of(x: np.ndarray, expected: float, most: int) -> list[float]:
    """Spark's rule: zeros are as many as ``expected`` values leave; cuts at even strides of rows, midway between values."""
    values, counts = np.unique(x[x != 0.0], return_counts=True)
    weights = counts.astype(float)
    if not len(values):
        return []
    if expected - weights.sum() > np.finfo(float).eps * weights.sum() * 100:
        at = int(np.searchsorted(values, 0.0))
        weights = np.insert(weights, at, expected - weights.sum())
        values = np.insert(values, at, 0.0)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles.tolist()
    stride = expected / (most + 1)
    cuts, count, target = [], weights[0], stride
    for i in range(1, len(values)):
        before, count = count, count + weights[i]
        if abs(before - target) < abs(count - target):
            cuts.append(float(middles[i - 1]))
            target += stride
    return cuts


def bin_of(x: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """Number of cuts below a value, by halving."""
    if not cuts:
        return F.lit(float(first))
    half = len(cuts) // 2
    return F.when(x <= cuts[half], bin_of(x, cuts[:half], first)).otherwise(bin_of(x, cuts[half + 1 :], first + half + 1))


class CellModel(Model):
    """A model of bins, for feature vectors."""

    def __init__(self, model: Model, cuts: list[list[float]], column: str):
        super().__init__()
        self.model, self.cuts, self.column = model, cuts, column

    def _transform(self, df: DataFrame) -> DataFrame:
        kept, values, names = f"{self.column}_kept", f"{self.column}_values", [c for c in df.columns if c != self.column]
        # a step of its own, lest every comparison unpack the vector
        unpacked = df.withColumnRenamed(self.column, kept).withColumn(values, vector_to_array(q(kept)))
        bins = F.array(*[bin_of(q(values)[i], c) for i, c in enumerate(self.cuts)])
        scored = self.model.transform(unpacked.withColumn(self.column, array_to_vector(bins)))
        own = (*names, kept, values, self.column)
        added = [q(c) for c in scored.columns if c not in own]
        return scored.select(*[q(kept).alias(c) if c == self.column else q(c) for c in df.columns], *added)


class Cells:
    """A table added up by bins: (bins, label, part, n, spread). A regression's ``label`` is the mean of a cell's rows and
    ``spread`` their squared distances from it; classes are cells of their own."""

    def __init__(self, table: DataFrame, cuts: list[list[float]], features: Sequence[str], vector: str, label: str, task: str, taught: Column):
        bins = [bin_of(q(c).cast("double"), cut).alias(f"b{i}") for i, (c, cut) in enumerate(zip(features, cuts))]
        coded = table.select(*bins, q(label).alias("y"), taught.alias("taught"))
        keys, n = [*(f"b{i}" for i in range(len(cuts))), "taught"], F.count(F.lit(1)).alias("n")
        if task == "regression":
            # population variance keeps no sum of squares
            cells = coded.groupBy(*keys).agg(F.avg("y").alias("y"), n, (F.var_pop("y") * n).alias("spread"))
        else:
            cells = coded.groupBy(*keys, "y").agg(n, F.lit(0.0).alias("spread"))
        cells = materialise(cells)
        # a cut beside a bin without rows parts the same rows as the one below it, which Spark then takes
        found = cells.filter("taught").agg(*[F.sort_array(F.collect_set(f"b{i}")) for i in range(len(cuts))]).first()
        self.cuts = [[cut[int(b)] for b in seen[:-1]] for cut, seen in zip(cuts, found)]
        place = [
            sum([(F.col(f"b{i}") > b).cast("double") for b in seen[:-1]], F.lit(0.0)) for i, seen in enumerate(found)
        ]
        bound = array_to_vector(F.array(*place)).alias(vector)
        self.rows = cells.select(bound, F.col("y").alias(label), "taught", F.col("n").cast("double").alias("n"), "spread")
        self.vector = vector

    def fit(self, estimator: Estimator) -> CellModel:
        taught = self.rows.filter("taught").drop("taught", "spread")
        size = taught.count()
        taught = taught.coalesce(max(1, -(-size // TASK_CELLS)))
        # all bins are to be seen: Spark looks for them in the square of maxBins rows
        bins = max(estimator.getMaxBins(), isqrt(size) + 1)
        model = estimator.copy({estimator.weightCol: "n", estimator.maxBins: bins}).fit(taught)
        return CellModel(model, self.cuts, self.vector)

    def scored(self, model: CellModel) -> DataFrame:
        return model.model.transform(self.rows)


def cells_for(
    table: DataFrame, taught: Column, estimator: Estimator, features: Sequence[str], vector: str, label: str, task: str,
    classes: int,
) -> Cells | None:
    """The table added up for ``estimator``, which learns from the rows that are ``taught``; None where that is no help."""
    plain = (T.NumericType, T.BooleanType)
    if not sums_decide(estimator) or not all(isinstance(table.schema[c].dataType, plain) for c in features):
        return None
    rows = table.filter(taught)
    n = rows.count()
    if n <= LONG_ROWS:
        return None
    cuts = spark_cuts(rows, n, features, estimator)
    if prod(len(c) + 1 for c in cuts) * max(1, classes) > min(MOST_CELLS, n // LEAST_SHRINK):
        return None
    return Cells(table, cuts, features, vector, label, task, taught)
