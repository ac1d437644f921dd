"""Data-quality reports. Every report is a small DataFrame computed by aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import choose_columns, number, present, q
from tableloom.functions.moments import scatter
from tableloom.functions.stats import numeric_stats, quantiles, value_counts
from tableloom.session import materialise

# Settings of the standard report.
MISSING_THRESHOLD = 0.05
OUTLIER_THRESHOLD = 1.5
CORRELATION_THRESHOLD = 0.8
MAX_CATEGORIES = 50


# Rebalancing advice by class ratio (below, severity, methods by priority).
ADVICE = (
    (2.0, "low", ("none",)),
    (5.0, "medium", ("random_over", "smote")),
    (10.0, "high", ("smote", "adasyn")),
    (float("inf"), "high", ("adasyn", "smote")),
)


def _unpivot(row: DataFrame, records: Sequence[Column], schema: str) -> DataFrame:
    """One wide aggregate row turned into one row per record."""
    if not records:
        return row.sparkSession.createDataFrame([], schema)
    return row.select(F.inline(F.array(*records)))


def missing_values(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> DataFrame:
    """``(column, missing, rows, percent, problem)``; a null column name is the whole table."""
    names = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(names)],
    )

    def record(label: Column, missing: Column, cells: Column, flagged: bool) -> Column:
        percent = F.coalesce(F.try_divide(missing * 100.0, cells), F.lit(0.0))
        problem = (percent >= threshold * 100) if flagged else F.lit(False)
        return F.struct(
            label.alias("column"), missing.alias("missing"), cells.alias("rows"),
            percent.alias("percent"), problem.alias("problem"),
        )

    total = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(len(names))])
    records = [record(F.lit(None).cast("string"), total, F.col("rows") * len(names), False)]
    records += [record(F.lit(c), F.col(f"m{i}"), F.col("rows"), True) for i, c in enumerate(names)]
    return _unpivot(row, records, "")


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float = OUTLIER_THRESHOLD
) -> dict[str, tuple[float, float]]:
    """Inclusive bounds per column; columns without values (or without spread, for z-scores) are left out."""
    bounds: dict[str, tuple[float, float]] = {}
    if method == "iqr":
        for c, quartiles in quantiles(df, columns, [0.25, 0.75]).items():
            if quartiles:
                reach = threshold * (quartiles[1] - quartiles[0])
                bounds[c] = (quartiles[0] - reach, quartiles[1] + reach)
    elif method == "zscore":
        for c, s in numeric_stats(df, columns, ["count", "mean", "std"]).items():
            if s["count"] and s["std"] is not None:
                bounds[c] = (s["mean"] - threshold * s["std"], s["mean"] + threshold * s["std"])
    else:
        raise ValueError(f"unsupported outlier method {method!r}: use 'iqr' or 'zscore'")
    return bounds


def outliers(
    df: DataFrame,
    method: str = "iqr",
    threshold: float = OUTLIER_THRESHOLD,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``(column, n, outliers, percent, lower, upper, problem)`` over non-null values."""
    names = choose_columns(df, columns, "numeric")
    bounds = outlier_bounds(df, names, method, threshold)
    if method == "zscore":
        bounds = {c: b for c, b in bounds.items() if b[0] < b[1]}
    names = [c for c in names if c in bounds]
    row = df.agg(
        *[F.count(number(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
        *[
            F.count_if((number(df, c) < bounds[c][0]) | (number(df, c) > bounds[c][1])).alias(f"o{i}")
            for i, c in enumerate(names)
        ],
    ) if names else df.limit(0)
    records = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("outliers"),
            (F.col(f"o{i}") * 100.0 / F.col(f"n{i}")).alias("percent"),
            F.lit(float(bounds[c][0])).alias("lower"), F.lit(float(bounds[c][1])).alias("upper"),
            (F.col(f"o{i}") > 0).alias("problem"),
        )
        for i, c in enumerate(names)
    ]
    return _unpivot(
        row, records,
        "column string, n bigint, outliers bigint, percent double, lower double, upper double, problem boolean",
    )


def correlated_pairs(
    df: DataFrame, threshold: float = CORRELATION_THRESHOLD, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column_a, column_b, correlation)`` of absolute Pearson values above the threshold, complete rows only."""
    return correlations(df, columns).filter(F.col("correlation") > threshold)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Absolute Pearson value of every column pair, over complete rows."""
    names = choose_columns(df, columns, "numeric")
    schema = "column_a string, column_b string, correlation double"
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    matrix = scatter(df, names)
    if not matrix.counts:  # no complete row
        return df.sparkSession.createDataFrame([(names[i], names[j], None) for i, j in pairs], schema)
    listed = F.array(*[F.lit(n) for n in names])
    cells = matrix.rows.select("i", F.posexplode("v").alias("at", "v"), (F.col("panel") * matrix.panel).alias("from"))
    cells = cells.select("i", (F.col("at") + F.col("from")).alias("j"), "v").filter("j >= i")
    own = cells.filter("i = j").select(F.col("i").alias("k"), F.sqrt("v").alias("s"))  # one row per column
    rows, columns = own.toDF("i", "s_i"), own.toDF("j", "s_j")
    found = cells.filter("j > i").join(F.broadcast(rows), "i").join(F.broadcast(columns), "j")
    return found.select(
        listed[F.col("i")].alias("column_a"), listed[F.col("j")].alias("column_b"),
        F.abs(F.try_divide("v", F.col("s_i") * F.col("s_j"))).alias("correlation"),
    )


def cardinality(
    df: DataFrame, max_categories: int = MAX_CATEGORIES, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(column, categories, problem)``: distinct non-null values, from one shuffle of partial counts."""
    names = choose_columns(df, columns, "categorical")
    if not names:
        return df.sparkSession.createDataFrame([], "column string, categories bigint, problem boolean")
    counted = value_counts(df, names).groupBy("column").agg(F.count("value").alias("categories"))
    return counted.withColumn("problem", F.col("categories") > max_categories)


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, duplicates, problem)``: rows equal to another on all columns, beyond the first."""
    names = choose_columns(df, columns)
    groups = df.groupBy(*[q(c) for c in names]).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"),
    ).withColumn("problem", F.col("duplicates") > 0)


def detection_report(
    df: DataFrame,
    missing_threshold: float = MISSING_THRESHOLD,
    outlier_method: str = "iqr",
    outlier_threshold: float = OUTLIER_THRESHOLD,
    correlation_threshold: float = CORRELATION_THRESHOLD,
    max_categories: int = MAX_CATEGORIES,
    isolate: bool = False,
) -> DataFrame:
    """All detectors in long form: ``(detector, column, metric, value, problem)``.

    With ``isolate`` every detector runs at once and by itself; one that fails
    leaves one line, a problem whose metric names the error, and the others go on.
    """

    def line(detector: str, frame: DataFrame, column: Column, metrics: dict[str, str], flagged: str) -> DataFrame:
        records = F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"), F.col(source).cast("double").alias("value"),
                    (F.col("problem") if source == flagged else F.lit(False)).alias("problem"),
                )
                for metric, source in metrics.items()
            ]
        )
        return frame.select(F.lit(detector).alias("detector"), column.alias("column"), F.inline(records))

    pair = F.concat_ws(",", "column_a", "column_b")
    column, none = F.col("column"), F.lit(None).cast("string")
    detectors: dict[str, Callable[[], DataFrame]] = {
        "missing_values": lambda: line(
            "missing_values", missing_values(df, missing_threshold), column,
            {"missing": "missing", "percent": "percent"}, "percent",
        ),
        "outliers": lambda: line(
            "outliers", outliers(df, outlier_method, outlier_threshold), column,
            {"outliers": "outliers", "percent": "percent"}, "outliers",
        ),
        "correlation": lambda: line(
            "correlation", correlated_pairs(df, correlation_threshold).withColumn("problem", F.lit(True)), pair,
            {"correlation": "correlation"}, "correlation",
        ),
        "cardinality": lambda: line(
            "cardinality", cardinality(df, max_categories), column, {"categories": "categories"}, "categories"
        ),
        "duplicates": lambda: line("duplicates", duplicates(df), none, {"duplicates": "duplicates"}, "duplicates"),
    }
    if not isolate:
        return reduce(DataFrame.unionByName, [make() for make in detectors.values()])

    def alone(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        try:
            return materialise(make())
        except Exception as error:  # whatever a detector raises is its own result
            text = f"failed: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
            return df.sparkSession.createDataFrame(
                [(name, None, text, None, True)],
                "detector string, column string, metric string, value double, problem boolean",
            )

    return reduce(DataFrame.unionByName, [alone(name, make) for name, make in detectors.items()])


@dataclass(frozen=True)
class Detector:
    """A detector with its options, for use by name."""

    function: Callable[..., DataFrame]
    options: dict

    def detect(self, df: DataFrame) -> DataFrame:
        return self.function(df, **self.options)


def report_summary(report: DataFrame) -> DataFrame:
    """One line per detector: how many problems it found."""
    found = F.count_if(F.col("problem"))
    return report.groupBy("detector").agg(
        found.alias("problems"),
        F.when(found == 0, F.lit("no problem detected"))
        .otherwise(F.concat(found.cast("string"), F.lit(" problem(s)")))
        .alias("summary"),
    )


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems grouped by column, and the verdict ``(is_valid, total_problems, columns_with_issues)``.

    A failing detector counts as a problem without a column and does not stop the others.
    """
    problems = detection_report(df, isolate=True).filter("problem")
    named = problems.filter((F.col("detector") != "correlation") & F.col("column").isNotNull())
    by_column = named.groupBy("column").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("detector"))).alias("detectors"),
        F.count(F.lit(1)).alias("problems"),
    )
    verdict = problems.agg(
        F.count(F.lit(1)).alias("total_problems"),
        F.count_distinct(
            F.when(F.col("detector") != "correlation", F.col("column"))
        ).alias("columns_with_issues"),
    ).select((F.col("total_problems") == 0).alias("is_valid"), "total_problems", "columns_with_issues")
    return by_column, verdict


def quality_context(df: DataFrame, name: str = "unknown") -> DataFrame:
    """Shape, problems and rounded statistics of a named data set in long form."""
    width = len(df.columns)

    def record(metric: str, value: Column) -> Column:
        return F.struct(
            F.lit("shape").alias("detector"), F.lit(None).cast("string").alias("column"),
            F.lit(metric).alias("metric"), value.alias("value"), F.lit(False).alias("problem"),
        )

    filled = F.when(F.col("rows") > 0, F.lit(float(width))).otherwise(F.lit(0.0))
    shape = df.agg(F.count(F.lit(1)).cast("double").alias("rows")).select(
        F.inline(F.array(record("rows", F.col("rows")), record("columns", filled)))
    )
    report = shape.unionByName(detection_report(df))
    return report.select(
        F.lit(name).alias("dataset_name"), "detector", "column", "metric",
        F.round("value", 2).alias("value"), "problem",
    )


def quality_markdown(context: DataFrame, operations: Sequence[str] = ()) -> DataFrame:
    """The context as one Markdown text; a report has a bounded number of lines."""
    problem = F.concat(
        F.lit("- "), F.col("detector"), F.lit(" "), F.coalesce(F.col("column"), F.lit("table")),
        F.lit(": "), F.col("metric"), F.lit(" "), F.col("value").cast("string"),
    )
    lines = context.groupBy("dataset_name").agg(
        F.max(F.when(F.col("metric") == "rows", F.col("value"))).cast("bigint").alias("rows"),
        F.max(F.when(F.col("metric") == "columns", F.col("value"))).cast("bigint").alias("columns"),
        F.array_sort(F.collect_list(F.when(F.col("problem"), problem))).alias("problems"),
    )
    done = [f"- {name}" for name in operations] or ["- No preprocessing applied."]
    found = F.when(F.size("problems") == 0, F.array(F.lit("- No issues detected."))).otherwise(F.col("problems"))
    return lines.select(
        "dataset_name",
        F.concat_ws(
            "\n",
            F.array(
                F.concat(F.lit("## Dataset: "), F.col("dataset_name")), F.lit(""),
                F.concat(F.lit("- Rows: "), F.col("rows").cast("string")),
                F.concat(F.lit("- Columns: "), F.col("columns").cast("string")),
                F.lit(""), F.lit("## Detected issues"),
            ),
            found,
            F.array(F.lit(""), F.lit("## Preprocessing"), *[F.lit(x) for x in done]),
        ).alias("markdown"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, percent, ratio)``: percent of all rows including those without a class."""
    counts = df.groupBy(present(df, target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    named = F.col("class").isNotNull()
    totals = counts.agg(
        F.sum("n").alias("rows"),
        F.max(F.when(named, F.col("n"))).alias("most"),
        F.min(F.when(named, F.col("n"))).alias("least"),
    ).first()
    return counts.filter(named).select(
        "class", "n", (F.col("n") * 100.0 / F.lit(totals["rows"])).alias("percent"),
        (F.lit(totals["most"]) / F.lit(totals["least"])).cast("double").alias("ratio"),
    )


def rebalancing_advice(df: DataFrame, target: str) -> DataFrame:
    """``(ratio, severity, method, priority)`` for the class ratio of the target."""
    ratio = class_distribution(df, target).agg(F.max("ratio").alias("ratio"))
    advice = F.coalesce(
        *[
            F.when(
                F.col("ratio") < limit,
                F.array(
                    *[
                        F.struct(F.lit(severity).alias("severity"), F.lit(m).alias("method"),
                                 F.lit(i).alias("priority"))
                        for i, m in enumerate(methods, 1)
                    ]
                ),
            )
            for limit, severity, methods in ADVICE
        ]
    )
    return ratio.select("ratio", F.inline(advice))
