"""D1–D11 and S1–S8."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.data import COPIED, GAPS, RELATED, SEGMENTS, SPIKES, near, rounded, rounded_columns, table
from tableloom.functions.columns import detect_target, select_columns, split_target
from tableloom.operators import detect
from tableloom.session import scratch_path
from tableloom.sources import corpus, tables

GAP_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "sparse_price", "finished",
]


def missing_sql(src: str, columns: list[str], threshold: float = 0.05) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS rows FROM {src} t"
        for c in columns
    ]
    per_column = " UNION ALL ".join(parts)
    return f"""
    WITH c AS ({per_column})
    SELECT "column", missing, rows, {near('missing * 100.0 / rows')} AS percent,
           missing * 100.0 / rows >= {threshold * 100} AS problem FROM c
    UNION ALL
    SELECT NULL, CAST(sum(missing) AS BIGINT), CAST(sum(rows) AS BIGINT),
           {near('sum(missing) * 100.0 / sum(rows)')}, false FROM c"""


def iqr_sql(src: str, columns: list[str], t: float = 1.5) -> str:
    parts = []
    for c in columns:
        parts.append(f"""
        SELECT '{c}' AS "column", count(x) AS n,
               count(*) FILTER (x < lo OR x > hi) AS outliers, any_value(lo) AS lo, any_value(hi) AS hi
        FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} s),
             (SELECT q1 - {t} * (q3 - q1) AS lo, q3 + {t} * (q3 - q1) AS hi FROM (
                SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                       quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src} s))""")
    return " UNION ALL ".join(parts)


def outlier_frame_sql(bounds_sql: str) -> str:
    return f"""
    SELECT "column", n, outliers, {near('outliers * 100.0 / n')} AS percent,
           {near('lo', 4)} AS lower, {near('hi', 4)} AS upper, outliers > 0 AS problem
    FROM ({bounds_sql}) WHERE n > 0"""


def correlation_sql(src: str, columns: list[str]) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, abs(corr({a}, {b})) AS correlation "
        f"FROM {src} t WHERE {complete}"
        for a, b in combinations(columns, 2)
    )


def cardinality_sql(src: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS categories FROM {src} t" for c in columns
    )


def duplicate_sql(src: str, columns: list[str]) -> str:
    listed = ", ".join(columns)
    return f"SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT {listed}, count(*) AS n FROM {src} t GROUP BY ALL)"


def report_sql(src: str, columns: list[str], numeric: list[str], text: list[str]) -> str:
    """Long form of all five detectors."""
    missing = missing_sql(src, columns)
    return f"""
    WITH m AS ({missing}), o AS ({iqr_sql(src, numeric)}),
         r AS ({correlation_sql(src, numeric)}), k AS ({cardinality_sql(src, text)})
    SELECT 'missing_values' AS detector, "column", 'missing' AS metric, CAST(missing AS DOUBLE) AS value,
           false AS problem FROM m
    UNION ALL SELECT 'missing_values', "column", 'percent', percent, problem FROM m
    UNION ALL SELECT 'outliers', "column", 'outliers', outliers, outliers > 0 FROM o
    UNION ALL SELECT 'outliers', "column", 'percent', {near('outliers * 100.0 / n')}, false FROM o
    UNION ALL SELECT 'correlation', column_a || ',' || column_b, 'correlation', {near('correlation')}, true
              FROM r WHERE correlation > 0.8
    UNION ALL SELECT 'cardinality', "column", 'categories', categories, categories > 50 FROM k
    UNION ALL SELECT 'duplicates', NULL, 'duplicates', ({duplicate_sql(src, columns)}), ({duplicate_sql(src, columns)}) > 0"""


NUMBERS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "related"]
REPORT = [*NUMBERS, "l_returnflag", "l_linestatus"]
DISTRIBUTION = """
    WITH c AS (SELECT o_orderpriority AS class, count(*) AS n FROM {src} t GROUP BY 1)
    SELECT class, n, {percent} AS percent, {ratio} AS ratio FROM c WHERE class IS NOT NULL""".format(
    src=GAPS.sql,
    percent=near("n * 100.0 / (SELECT sum(n) FROM c)"),
    ratio=near(
        "CAST((SELECT max(n) FROM c WHERE class IS NOT NULL) AS DOUBLE) /"
        " (SELECT min(n) FROM c WHERE class IS NOT NULL)"
    ),
)


def d1(spark, sf):
    return rounded_columns(detect.missing_values(GAPS.df(spark, sf)), ["percent"])


def d2(spark, sf):
    found = detect.outliers(SPIKES.df(spark, sf), columns=["value", "flat"])
    return rounded_columns(rounded_columns(found, ["percent"]), ["lower", "upper"], 4)


def d3(spark, sf):
    found = detect.outliers(SPIKES.df(spark, sf), "zscore", 3.0, ["value", "flat"])
    return rounded_columns(rounded_columns(found, ["percent"]), ["lower", "upper"], 4)


D3_SQL = outlier_frame_sql(f"""
    SELECT 'value' AS "column", count(value) AS n,
           count(*) FILTER (abs((value - m) / s) > 3.0) AS outliers,
           any_value(m - 3.0 * s) AS lo, any_value(m + 3.0 * s) AS hi
    FROM {SPIKES.sql} t, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM {SPIKES.sql} u)""")


def d4(spark, sf):
    return rounded_columns(detect.correlated_pairs(RELATED.df(spark, sf)), ["correlation"])


def d5(spark, sf):
    return detect.cardinality(table(spark, sf, "part"))


def d6(spark, sf):
    return detect.duplicates(COPIED.df(spark, sf))


def d7(spark, sf):
    return rounded_columns(detect.detection_report(RELATED.df(spark, sf)), ["value"])


def d8_columns(spark, sf):
    return detect.validate(RELATED.df(spark, sf))[0]


def d8_verdict(spark, sf):
    return detect.validate(RELATED.df(spark, sf))[1]


REPORT_SQL = report_sql(RELATED.sql, REPORT, NUMBERS, ["l_returnflag", "l_linestatus"])
D8_COLUMNS_SQL = f"""
    SELECT "column", string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, count(*) AS problems
    FROM ({REPORT_SQL}) WHERE problem AND detector <> 'correlation' AND "column" IS NOT NULL GROUP BY 1"""
D8_VERDICT_SQL = f"""
    SELECT count(*) = 0 AS is_valid, count(*) AS total_problems,
           count(DISTINCT CASE WHEN detector <> 'correlation' THEN "column" END) AS columns_with_issues
    FROM ({REPORT_SQL}) WHERE problem"""


def d9(spark, sf):
    return detect.quality_context(RELATED.df(spark, sf), "lineitem").withColumn("value", rounded("value", 2))


D9_SQL = f"""
    SELECT 'lineitem' AS dataset_name, detector, "column", metric, {near('value', 2)} AS value, problem FROM (
      SELECT 'shape' AS detector, NULL AS "column", 'rows' AS metric, count(*) AS value, false AS problem
      FROM {RELATED.sql} t
      UNION ALL SELECT 'shape', NULL, 'columns', 8, false
      UNION ALL SELECT * FROM ({REPORT_SQL}))"""


def d9_markdown(spark, sf):
    return detect.quality_markdown(detect.quality_context(SEGMENTS.df(spark, sf), "customer"))


def d10(spark, sf):
    return rounded_columns(
        detect.class_distribution(GAPS.df(spark, sf), "o_orderpriority"), ["percent", "ratio"]
    )


def d11(spark, sf):
    advice = detect.rebalancing_advice(SEGMENTS.df(spark, sf), "segment")
    return rounded_columns(advice, ["ratio"]).withColumn("priority", F.col("priority").cast("bigint"))


D11_SQL = f"""
    WITH c AS (SELECT segment, count(*) AS n FROM {SEGMENTS.sql} t WHERE segment IS NOT NULL GROUP BY 1),
         r AS (SELECT max(n) * 1.0 / min(n) AS ratio FROM c),
         rules(lo, hi, severity, method, priority) AS (VALUES
           (0, 2, 'low', 'none', 1), (2, 5, 'medium', 'random_over', 1), (2, 5, 'medium', 'smote', 2),
           (5, 10, 'high', 'smote', 1), (5, 10, 'high', 'adasyn', 2),
           (10, 1e18, 'high', 'adasyn', 1), (10, 1e18, 'high', 'smote', 2))
    SELECT {near('ratio')} AS ratio, severity, method, CAST(priority AS BIGINT) AS priority
    FROM r, rules WHERE ratio >= lo AND ratio < hi"""


# -- sources -------------------------------------------------------------------


def s1(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    return tables.load(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


def s2(spark, sf):
    return tables.read_parquet(spark, f"{sf}/supplier.parquet")


def s3(spark, sf):
    path = scratch_path(spark, "parts") + ".csv"
    accented = table(spark, sf, "part").select(
        F.col("p_partkey"), F.concat(F.col("p_name"), F.lit(" déjà")).alias("title")
    )
    accented.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.load(spark, path).select(F.col("p_partkey").cast("bigint"), "title")


def s4(spark, sf):
    """Texts written as Markdown files of at most 50 documents; the writer's quote mark is taken out again."""
    root = scratch_path(spark, "corpus")
    (
        table(spark, sf, "documents").select("text").write
        .option("extension", "md").option("maxRecordsPerFile", 50)
        .option("quote", "\u0000").option("sep", "\u0001").option("emptyValue", "")
        .csv(root)
    )
    found = corpus.read_markdown(spark, root)
    letters = F.length(F.regexp_replace("content", r"[\s\x00]", ""))
    return found.agg(
        F.sum(letters).cast("bigint").alias("letters"),
        (F.count_distinct("document_id") == F.count(F.lit(1))).alias("ids_unique"),
    )


def s5(spark, sf):
    return tables.preview(table(spark, sf, "orders"), 100, ["o_totalprice", "o_orderkey"]).select(
        "o_orderkey", "o_totalprice"
    )


def s5_shape(spark, sf):
    return tables.shape(table(spark, sf, "orders")).select(
        "rows", "columns", F.concat_ws(",", "names").alias("names")
    )


def s6(spark, sf):
    chosen = select_columns(table(spark, sf, "customer"), ["c_custkey", "not_there", "c_name"])
    return chosen.select("c_custkey", "c_name")


def s6_family(spark, sf):
    return select_columns(table(spark, sf, "customer"), None, "numeric")


def s7(spark, sf):
    """Class sizes of whatever column is found to be the target."""
    df = table(spark, sf, "embeddings")
    target = detect_target(df)
    return df.groupBy(F.col(target).cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "target", F.lit(target)
    )


def s8(spark, sf):
    """Features and target of one frame, after a step that drops rows."""
    df = GAPS.df(spark, sf).withColumnRenamed("finished", "target")
    features, target = split_target(df)
    kept = df.na.drop(subset=["o_totalprice"])
    return kept.groupBy(F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 4).alias("mean_price"),
        F.lit(len(features)).cast("bigint").alias("features"),
    )


CHECKS = {
    "s1_csv_scan": (s1, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "s2_parquet_scan": (s2, "SELECT * FROM supplier"),
    "s3_encoding_fallback": (s3, "SELECT p_partkey, p_name || ' déjà' AS title FROM part"),
    "s4_markdown_corpus": (
        s4,
        "SELECT CAST(sum(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'))) AS BIGINT) AS letters, "
        "true AS ids_unique FROM documents",
    ),
    "s5_preview": (
        s5, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100",
    ),
    "s5_shape": (
        s5_shape,
        "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, "
        "'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS names FROM orders",
    ),
    "s6_column_selection": (s6, "SELECT c_custkey, c_name FROM customer"),
    "s6_numeric_family": (s6_family, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"),
    "s7_target_detection": (
        s7, "SELECT CAST(label AS BIGINT) AS class, count(*) AS n, 'label' AS target FROM embeddings GROUP BY 1",
    ),
    "s8_target_stays_with_rows": (
        s8,
        f"SELECT finished AS target, count(*) AS n, {near('avg(o_totalprice)', 4)} AS mean_price, "
        f"CAST(6 AS BIGINT) AS features FROM {GAPS.sql} t WHERE o_totalprice IS NOT NULL GROUP BY 1",
    ),
    "d1_missing_values": (d1, missing_sql(GAPS.sql, GAP_COLUMNS)),
    "d2_outliers_iqr": (d2, outlier_frame_sql(iqr_sql(SPIKES.sql, ["value", "flat"]))),
    "d3_outliers_zscore": (d3, D3_SQL),
    "d4_correlated_pairs": (
        d4,
        f"SELECT column_a, column_b, {near('correlation')} AS correlation "
        f"FROM ({correlation_sql(RELATED.sql, NUMBERS)}) WHERE correlation > 0.8",
    ),
    "d5_high_cardinality": (
        d5,
        'SELECT "column", categories, categories > 50 AS problem '
        f"FROM ({cardinality_sql('part', ['p_name', 'p_brand', 'p_type'])})",
    ),
    "d6_duplicate_rows": (
        d6,
        "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, sum(n - 1) > 0 AS problem "
        "FROM (SELECT cust_group, o_orderstatus, o_orderpriority, price_group, o_orderkey, count(*) AS n "
        f"FROM {COPIED.sql} t GROUP BY ALL)",
    ),
    "d7_detection_report": (d7, REPORT_SQL),
    "d8_problems_by_column": (d8_columns, D8_COLUMNS_SQL),
    "d8_validation_verdict": (d8_verdict, D8_VERDICT_SQL),
    "d9_quality_context": (d9, D9_SQL),
    "d9_quality_markdown": (d9_markdown, None),
    "d10_class_distribution": (d10, DISTRIBUTION),
    "d11_rebalancing_advice": (d11, D11_SQL),
}
