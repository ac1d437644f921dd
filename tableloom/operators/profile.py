"""The numbers behind profiling charts, as small DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableloom.functions.columns import choose_columns, family_columns, number, present, q
from tableloom.functions.keyed import global_rank, rows_before
from tableloom.functions.stats import numeric_stats, quantiles
from tableloom.operators import detect
from tableloom.operators.reduce import PCAReducer
from tableloom.operators.select import importances
from tableloom.session import materialise

BINS = 30


def missing_ranking(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    report = detect.missing_values(df).filter(F.col("column").isNotNull() & (F.col("missing") > 0))
    return report.select("column", "percent").orderBy(F.desc("percent"), "column")


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, correlation)`` for every pair, each over the rows where both are present."""
    names = choose_columns(df, columns, "numeric")
    pairs = list(combinations(names, 2))
    if method == "pearson":
        row = df.agg(*[F.corr(*_both(df, a, b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        records = [_pair(a, b, F.col(f"`{i}`")) for i, (a, b) in enumerate(pairs)]
        return row.select(F.inline(F.array(*records)))
    if method == "spearman":
        return reduce(DataFrame.unionByName, [_spearman(df, a, b) for a, b in pairs])
    if method == "kendall":
        return reduce(DataFrame.unionByName, [_kendall(df, a, b) for a, b in pairs])
    raise ValueError(f"unknown correlation method {method!r}")


def _both(df: DataFrame, a: str, b: str) -> tuple[Column, Column]:
    x, y = number(df, a), number(df, b)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def _pair(a: str, b: str, value: Column) -> Column:
    return F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("correlation"))


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(number(df, a).alias("x"), number(df, b).alias("y")).na.drop()
        .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    )


def mid_ranks(counts: DataFrame, value: str, n: str, rank: str) -> DataFrame:
    """Average rank of every distinct value from its count."""
    placed = rows_before(counts, [q(value)], n, "__before")
    return placed.withColumn(rank, F.col("__before") + (q(n) + 1) / 2.0).drop("__before")


def _spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    counts = materialise(_pair_counts(df, a, b))
    ranks = []
    for value in ("x", "y"):
        own = counts.groupBy(value).agg(F.sum("n").alias("m"))
        ranks.append(mid_ranks(own, value, "m", f"r{value}").select(value, f"r{value}"))
    joined = counts.join(ranks[0], "x").join(ranks[1], "y")
    return joined.agg(_weighted_corr(F.col("rx"), F.col("ry"), F.col("n")).alias("correlation")).select(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), "correlation"
    )


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    w = w.cast("double")
    total = F.sum(w)
    mx, my = F.sum(w * x) / total, F.sum(w * y) / total
    cov = F.sum(w * x * y) / total - mx * my
    return F.try_divide(
        cov, F.sqrt((F.sum(w * x * x) / total - mx * mx) * (F.sum(w * y * y) / total - my * my))
    )


def _kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b from the table of distinct pairs.

    Concordant partners of a pair are those smaller in both values. They are
    counted with a two-level decomposition of the x order: per level, partners in
    the left half of the same node are counted by one running sum over y, so the
    work is (distinct pairs) x (levels) and no pairs of pairs are formed.
    """
    counts = materialise(_pair_counts(df, a, b))
    xs = global_rank(counts.select("x").distinct(), [F.col("x")], "ix")
    ys = global_rank(counts.select("y").distinct(), [F.col("y")], "iy")
    coded = materialise(
        counts.join(xs.select("x", "ix"), "x").join(ys.select("y", "iy"), "y").select("ix", "iy", "n")
    )
    top = coded.agg(F.max("ix")).first()[0] or 0
    levels = max(1, int(top).bit_length())
    nodes = coded.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select(
        "level", F.expr("shiftright(ix, level + 1)").alias("node"), "iy", "n",
        F.expr("shiftright(ix, level) & 1").alias("right"),
    )
    cells = nodes.groupBy("level", "node", "iy").agg(
        F.sum(F.when(F.col("right") == 0, F.col("n")).otherwise(0)).alias("left_n"),
        F.sum(F.when(F.col("right") == 1, F.col("n")).otherwise(0)).alias("right_n"),
    )
    # smaller y on the left of the same node: smaller in both
    below = _running(cells, "left_n")
    concordant = below.agg(F.sum(F.col("right_n").cast("double") * F.col("before"))).first()[0] or 0.0

    def tied(*keys: str) -> float:
        groups = coded.groupBy(*keys).agg(F.sum("n").alias("m"))
        return groups.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()[0] or 0.0

    rows = float(coded.agg(F.sum("n")).first()[0] or 0)
    pairs = rows * (rows - 1) / 2
    tx, ty, txy = tied("ix"), tied("iy"), tied("ix", "iy")
    discordant = pairs - tx - ty + txy - concordant
    scale = ((pairs - tx) * (pairs - ty)) ** 0.5
    tau = (concordant - discordant) / scale if scale else None
    return df.sparkSession.createDataFrame([(a, b, tau)], "column_a string, column_b string, correlation double")


def _running(cells: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over smaller ``iy`` in the same (level, node), in two steps so no node is one task."""
    block = F.floor(F.col("iy") / 4096)
    cells = cells.withColumn("block", block)
    blocks = cells.groupBy("level", "node", "block").agg(F.sum(value).alias("in_block"))
    earlier = F.coalesce(
        F.sum("in_block").over(
            Window.partitionBy("level", "node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    starts = blocks.select("level", "node", "block", earlier.alias("start"))
    inside = F.coalesce(
        F.sum(value).over(
            Window.partitionBy("level", "node", "block").orderBy("iy").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return cells.withColumn("inside", inside).join(starts, ["level", "node", "block"]).withColumn(
        "before", F.col("start") + F.col("inside")
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """``(column, bin, lower, upper, n, mean, std)``; equal-width bins, the last one closed."""
    names = choose_columns(df, columns, "numeric")
    stats = numeric_stats(df, names, ["count", "min", "max", "mean", "std"])
    names = [c for c in names if stats[c]["count"]]
    edges = {c: _edges(stats[c]["min"], stats[c]["max"]) for c in names}

    def bin_of(c: str) -> Column:
        low, high = edges[c]
        share = (number(df, c) - low) * bins / (high - low)
        return F.least(F.floor(share), F.lit(bins - 1)).cast("int")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin")) for c in names])
    counted = (
        df.select(F.inline(pairs)).filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.createDataFrame(
        [(c, b, lo + (hi - lo) * b / bins, lo + (hi - lo) * (b + 1) / bins, stats[c]["mean"], stats[c]["std"])
         for c, (lo, hi) in edges.items() for b in range(bins)],
        "column string, bin int, lower double, upper double, mean double, std double",
    )
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std"
    )


def _edges(low: float, high: float) -> tuple[float, float]:
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def box_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, q1, median, q3, whisker_low, whisker_high, n)``; whiskers end at values within 1.5 IQR."""
    names = choose_columns(df, columns, "numeric")
    quartiles = {c: v for c, v in quantiles(df, names, [0.25, 0.5, 0.75]).items() if v}
    aggregates, records = [], []
    for i, (c, (q1, median, q3)) in enumerate(quartiles.items()):
        x, reach = number(df, c), 1.5 * (q3 - q1)
        inside = F.when(x.between(q1 - reach, q3 + reach), x)
        aggregates += [F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}"), F.count(x).alias(f"n{i}")]
        records.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(median).alias("median"), F.lit(q3).alias("q3"),
            F.col(f"lo{i}").alias("whisker_low"), F.col(f"hi{i}").alias("whisker_high"), F.col(f"n{i}").alias("n"),
        ))
    return df.agg(*aggregates).select(F.inline(F.array(*records)))


def outlier_points(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``(key…, column, value, lower, upper)`` of values beyond 1.5 IQR."""
    names = choose_columns(df, columns, "numeric")
    bounds = detect.outlier_bounds(df, names)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), number(df, c).alias("value"),
                 F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"))
        for c, (lo, hi) in bounds.items()
    ])
    points = df.select(*[q(k) for k in key], F.inline(cells))
    return points.filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def pca_coordinates(
    df: DataFrame, components: int = 2, columns: Sequence[str] | None = None, label: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scores of complete rows on the first two or three components, and their variance shares."""
    names = choose_columns(df, columns, "numeric", exclude=[label])
    complete = df.select(*[number(df, c).alias(c) for c in names], *([q(label)] if label else [])).na.drop(subset=names)
    model = PCAReducer(n_components=components, columns=names, target=label).fit(complete)
    return model.transform(complete), model.explained_variance(df.sparkSession)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return detect.class_distribution(df, target).orderBy(F.desc("n"), "class")


def top_importances(
    df: DataFrame, features: Sequence[str], target: str, task_type: str = "classification", n: int = 20, trees: int = 100
) -> DataFrame:
    scores = importances(df, features, target, task_type, trees)
    rows = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:n]
    return df.sparkSession.createDataFrame(rows, "column string, importance double")


def data_summary(df: DataFrame, top_categories: int | None = None) -> DataFrame:
    """Types, missing counts, shape, numbers of numeric columns, cardinalities, duplicates: ``(section, item, value)``.

    ``top_categories`` asks for the columns with the most categories only.
    """
    spark = df.sparkSession
    kinds: dict[str, int] = {}
    for field in df.schema.fields:
        kinds[field.dataType.simpleString()] = kinds.get(field.dataType.simpleString(), 0) + 1
    fixed = [("dtype", k, float(v)) for k, v in kinds.items()] + [("shape", "columns", float(len(df.columns)))]
    numeric = family_columns(df, "numeric")
    parts = [spark.createDataFrame(fixed, "section string, item string, value double")]

    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.count_if(present(df, c).isNull()).cast("double").alias(f"m{i}") for i, c in enumerate(names)],
        *[f(number(df, c)).alias(f"{s}{i}") for i, c in enumerate(numeric)
          for s, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
    )
    records = [_entry("shape", "rows", F.col("rows"))]
    records += [_entry("missing", c, F.col(f"m{i}")) for i, c in enumerate(names)]
    records += [
        _entry("describe", f"{c}.{s}", F.col(f"{s}{i}"))
        for i, c in enumerate(numeric) for s in ("mean", "std", "min", "max")
    ]
    wide = row.select(F.inline(F.array(*records))).filter((F.col("section") != "missing") | (F.col("value") > 0))
    parts.append(wide)

    kinds_of = detect.cardinality(df)
    if top_categories is not None:
        kinds_of = kinds_of.orderBy(F.desc("categories"), "column").limit(top_categories)
    parts.append(
        kinds_of.select(
            F.lit("categories").alias("section"), F.col("column").alias("item"),
            F.col("categories").cast("double").alias("value"),
        )
    )
    copies = detect.duplicates(df).select(F.inline(F.array(
        _entry("duplicates", "count", F.col("duplicates").cast("double")),
        _entry("duplicates", "percent", F.coalesce(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), F.lit(0.0))),
    )))
    return reduce(DataFrame.unionByName, [*parts, copies])


def _entry(section: str, item: str, value: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"), value.alias("value"))


