"""R1–R9 and V1–V9."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.data import GAPS, SPIKES, Source, near, rounded, rounded_columns, table
from checks.detection import GAP_COLUMNS
from tableloom.operators import profile
from tableloom.operators.encode import category_codes
from tableloom.operators.reduce import LDAReducer, PCAReducer
from tableloom.operators.select import FeatureSelector

LINES = Source(
    "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "CAST(1 AS DOUBLE) AS flat", "l_returnflag",
)
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]
DIMS = 64
VECTORS = Source("embeddings", "vec_id", "label", *[f"CAST(embedding[{i}] AS DOUBLE) AS v{i}" for i in range(DIMS)])
# list positions start at 0 in Spark and at 1 in DuckDB
VECTORS.sql = f"(SELECT vec_id, label, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}' for i in range(DIMS))} FROM embeddings)"
AXES = [f"v{i}" for i in range(DIMS)]
#: Both halves of each vector added up: two columns that read all entries and have a closed form.
HALVES = Source("embeddings", "vec_id", "label", *[
    f"{' + '.join(f'CAST(embedding[{i}] AS DOUBLE)' for i in part)} AS {name}"
    for name, part in (("low", range(32)), ("high", range(32, 64)))
])
HALVES.sql = "(SELECT vec_id, label, " + ", ".join(
    f"{' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE)' for i in part)} AS {name}"
    for name, part in (("low", range(32)), ("high", range(32, 64)))
) + " FROM embeddings)"
#: The squared covariance matrix added up: what the squares of all eigenvalues add up to.
SQUARES_SQL = f"""
    WITH t AS (SELECT * FROM {VECTORS.sql} x), m AS (SELECT {', '.join(f'avg(v{i}) AS m{i}' for i in range(DIMS))} FROM t),
         c AS (SELECT vec_id, [{', '.join(f'v{i} - m{i}' for i in range(DIMS))}] AS y FROM t, m),
         l AS (SELECT vec_id, unnest(y) AS y, generate_subscripts(y, 1) AS i FROM c),
         s AS (SELECT a.i, b.i AS j, sum(a.y * b.y) / ((SELECT count(*) FROM t) - 1) AS v
               FROM l a JOIN l b USING (vec_id) GROUP BY 1, 2)
    SELECT sum(v * v) AS squares, sum(v) FILTER (i = j) AS trace, max(v) FILTER (i = j) AS widest FROM s"""
ORDERS = ["o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate_year"]


def r1(spark, sf):
    df = LINES.df(spark, sf)
    model = FeatureSelector(method="variance", threshold=0.01, columns=[*NUMBERS, "l_returnflag"]).fit(df)
    return rounded_columns(model.scores(spark), ["score"], 3)


R1_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {near(f'var_pop({c})', 3)} AS score, var_pop({c}) > 0.01 AS kept FROM {LINES.sql} t"
    for c in NUMBERS
)


def r2(task, target):
    def run(spark, sf):
        df = LINES.df(spark, sf)
        names = [c for c in NUMBERS if c not in (target, "flat")]
        model = FeatureSelector(method="correlation", columns=names, target=target, task_type=task, k=2).fit(df)
        return rounded_columns(model.scores(spark), ["score"], 4)

    return run


def r2_sql(task, target):
    names = [c for c in NUMBERS if c not in (target, "flat")]
    parts = []
    for c in names:
        if task == "regression":
            score = f"SELECT pow(corr({c}, {target}), 2) * (count(*) - 2) / (1 - pow(corr({c}, {target}), 2)) FROM l"
        else:
            score = f"""SELECT (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) * (sum(n) - count(*))
                / (sum(n * v) * (count(*) - 1)) FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v
                FROM l GROUP BY {target})"""
        parts.append(f"SELECT '{c}' AS \"column\", ({score}) AS s")
    return f"""WITH l AS (SELECT * FROM {LINES.sql} t), f AS ({' UNION ALL '.join(parts)})
        SELECT "column", {near('s', 4)} AS score, row_number() OVER (ORDER BY s DESC) <= 2 AS kept FROM f"""


def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("o_orderdate_year", F.year("o_orderdate"))


def r3(spark, sf):
    model = FeatureSelector(
        method="importance", columns=ORDERS, target="o_orderstatus", k=2
    ).fit(orders(spark, sf))
    return model.scores(spark)


def r4(spark, sf):
    model = FeatureSelector(method="rfe", columns=ORDERS, target="o_orderstatus", k=2).fit(orders(spark, sf))
    return model.scores(spark)


def r5(spark, sf):
    df = LINES.df(spark, sf)
    model = FeatureSelector(method="variance", columns=NUMBERS).fit(df)
    return model.transform(df)


def r6(spark, sf):
    """All 64 components: uncorrelated, falling, with the trace and the squares of the covariance matrix, and each row
    as far from the centre as before."""
    df = VECTORS.df(spark, sf)
    out = PCAReducer(columns=AXES, n_components=DIMS, target="label").fit(df).transform(df)
    names = [f"PC{i}" for i in range(1, DIMS + 1)]
    row = out.agg(
        F.count(F.lit(1)).alias("n"), *[F.var_samp(c).alias(c) for c in names],
        *[F.avg(c).alias(f"mean{c}") for c in names], *[F.corr(a, b).alias(f"with{b}") for a, b in zip(names, names[1:])],
        F.corr(names[0], names[-1]).alias("ends"),
    )
    spread = [F.col(c) for c in names]
    return row.select(
        "n", rounded(sum(spread[1:], spread[0]), 9).alias("trace"),
        rounded(sum((c * c for c in spread[1:]), spread[0] * spread[0]), 9).alias("squares"),
        rounded(F.greatest(*[F.abs(f"mean{c}") for c in names]), 6).alias("off_centre"),
        rounded(F.greatest(*[F.abs(f"with{c}") for c in names[1:]], F.abs("ends")), 6).alias("correlated"),
        F.array_sort(F.array(*[-c for c in spread])).eqNullSafe(F.array(*[-c for c in spread])).alias("falling"),
    )


R6_SQL = f"""
    SELECT (SELECT count(*) FROM embeddings) AS n, {near('trace', 9)} AS trace, {near('squares', 9)} AS squares,
           CAST(0 AS DOUBLE) AS off_centre, CAST(0 AS DOUBLE) AS correlated, true AS falling FROM ({SQUARES_SQL})"""


def r6_rows(spark, sf):
    """Every row's squared distance from the centre over all components."""
    df = VECTORS.df(spark, sf)
    out = PCAReducer(columns=AXES, n_components=DIMS, target="label").fit(df).transform(df)
    terms = [F.col(f"PC{i}") * F.col(f"PC{i}") for i in range(1, DIMS + 1)]
    return out.select("vec_id", rounded(sum(terms[1:], terms[0]), 6).alias("distance"))


R6_ROWS_SQL = f"""
    WITH t AS (SELECT * FROM {VECTORS.sql} x), m AS (SELECT {', '.join(f'avg(v{i}) AS m{i}' for i in range(DIMS))} FROM t)
    SELECT vec_id, {near(' + '.join(f'(v{i} - m{i}) * (v{i} - m{i})' for i in range(DIMS)))} AS distance FROM t, m"""


def r6_plane(spark, sf):
    """Two columns have a closed form: the eigenvalues of a 2 x 2 covariance."""
    df = HALVES.df(spark, sf)
    out = PCAReducer(columns=["low", "high"], n_components=2, target="label").fit(df).transform(df)
    return out.agg(rounded(F.var_samp("PC1"), 9).alias("first"), rounded(F.var_samp("PC2"), 9).alias("second"))


PLANE = "WITH c AS (SELECT var_samp(low) AS a, var_samp(high) AS b, covar_samp(low, high) AS c FROM {0} t)"
FIRST, SECOND = (f"(a + b) / 2 {sign} sqrt(pow((a - b) / 2, 2) + c * c)" for sign in "+-")
R6_PLANE_SQL = f"{PLANE.format(HALVES.sql)} SELECT {near(FIRST, 9)} AS first, {near(SECOND, 9)} AS second FROM c"


def r7(spark, sf):
    """Shares of all 64 components: how many, their sum, the sum of their squares; and those of the two halves."""
    df, halves = VECTORS.df(spark, sf), HALVES.df(spark, sf)
    shares = PCAReducer(columns=AXES, n_components=DIMS, target="label").fit(df).explained_variance(spark)
    whole = shares.agg(
        F.lit("all").alias("component"), rounded(F.sum(F.col("ratio") * F.col("ratio")), 9).alias("ratio"),
        rounded(F.max("cumulative"), 9).alias("cumulative"), F.count(F.lit(1)).alias("n"),
    )
    two = PCAReducer(columns=["low", "high"], n_components=2, target="label").fit(halves).explained_variance(spark)
    return whole.unionByName(rounded_columns(two, ["ratio", "cumulative"], 9).withColumn("n", F.lit(1).cast("bigint")))


R7_SQL = f"""
    WITH h AS ({PLANE.format(HALVES.sql)} SELECT {FIRST} AS first, {SECOND} AS second FROM c)
    SELECT 'all' AS component, {near('squares / (trace * trace)', 9)} AS ratio, CAST(1 AS DOUBLE) AS cumulative, 64 AS n
    FROM ({SQUARES_SQL})
    UNION ALL SELECT 'PC1', {near('first / (first + second)', 9)}, {near('first / (first + second)', 9)}, 1 FROM h
    UNION ALL SELECT 'PC2', {near('second / (first + second)', 9)}, CAST(1 AS DOUBLE), 1 FROM h"""


def r8(spark, sf):
    """All directions over all 64 axes: within-class spread of each is one, they are uncorrelated within classes, and no
    single axis separates the classes better than the first (``best``: share of axes that do not)."""
    df = VECTORS.df(spark, sf)
    model = LDAReducer(columns=AXES, target="label").fit(df)
    out = model.transform(df)
    names = [c for c in out.columns if c.startswith("LD")]
    pairs = list(combinations(names, 2))

    def ratios(frame, columns):
        """Spread between classes against that within."""
        parts = frame.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns]
        )
        within = [F.sum(F.col("n") * F.col(f"v_{c}")) for c in columns]
        between = [F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) - F.pow(F.sum(F.col("n") * F.col(f"m_{c}")), 2) / F.sum("n") for c in columns]
        return parts.agg(*[(b / w).alias(c) for c, w, b in zip(columns, within, between)]).first()

    axes, first = ratios(df, AXES), ratios(out, ["LD1"])["LD1"]
    classes = out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(c) for c in names],
        *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs],
    )
    scale = F.sum("n") - F.count(F.lit(1))
    spread = [F.sum(F.col("n") * F.col(c)) / scale for c in names]
    crossed = [F.abs(F.sum(F.col("n") * F.col(f"{a}_{b}")) / scale) for a, b in pairs]
    return classes.agg(
        F.sum("n").alias("n"), F.lit(len(names)).cast("bigint").alias("directions"),
        rounded(F.least(*spread) if len(spread) > 1 else spread[0]).alias("least"),
        rounded(F.greatest(*spread) if len(spread) > 1 else spread[0]).alias("largest"),
        rounded(F.greatest(F.lit(0.0), *crossed) if crossed else F.lit(0.0)).alias("crossed"),
        F.lit(sum(r <= first * (1 + 1e-9) for r in axes) / DIMS).alias("best"),
    )


def r9(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_orderpriority")
    return category_codes(df, ["o_orderpriority"]).withColumn(
        "o_orderpriority", F.col("o_orderpriority").cast("bigint")
    )


def r9_large(spark, sf):
    return category_codes(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name"]).withColumn(
        "c_name", F.col("c_name").cast("bigint")
    )


def v1(spark, sf):
    return rounded_columns(profile.missing_ranking(GAPS.df(spark, sf)), ["percent"])


CUSTOMER = Source("customer", "c_custkey", "c_acctbal", "c_nationkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 12 END AS slot")
PLANE = ["c_acctbal", "c_nationkey", "slot"]


def v2(method):
    def run(spark, sf):
        return rounded_columns(
            profile.correlation_matrix(CUSTOMER.df(spark, sf), method, PLANE), ["correlation"]
        )

    return run


def v2_sql(method):
    parts = []
    for a, b in combinations(PLANE, 2):
        rows = f"(SELECT {a} AS x, {b} AS y FROM {CUSTOMER.sql} t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        if method == "pearson":
            value = f"SELECT corr(x, y) FROM {rows}"
        elif method == "spearman":
            value = f"""SELECT corr(rx, ry) FROM (SELECT
                rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM {rows})"""
        else:
            value = f"""SELECT sum(sign(p.x - r.x) * sign(p.y - r.y)) /
                sqrt(sum(CASE WHEN p.x <> r.x THEN 1.0 ELSE 0 END) * sum(CASE WHEN p.y <> r.y THEN 1.0 ELSE 0 END))
                FROM {rows} p, {rows} r"""
        parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {near(f'({value})')} AS correlation")
    return " UNION ALL ".join(parts)


def v3(spark, sf):
    df = table(spark, sf, "lineitem")
    out = profile.histogram(df, ["l_extendedprice", "l_tax"])
    out = rounded_columns(out, ["lower", "upper", "mean", "std"], 4)
    return out.withColumn("bin", F.col("bin").cast("bigint"))


def v3_sql():
    parts = []
    for c in ("l_extendedprice", "l_tax"):
        parts.append(f"""
        SELECT '{c}' AS "column", b.bin, {near('lo + (hi - lo) * b.bin / 30', 4)} AS lower,
               {near('lo + (hi - lo) * (b.bin + 1) / 30', 4)} AS upper, coalesce(n, 0) AS n,
               {near('m', 4)} AS mean, {near('sd', 4)} AS std
        FROM (SELECT unnest(range(0, 30)) AS bin) b
        CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi, avg({c}) AS m, stddev_samp({c}) AS sd FROM lineitem) s
        LEFT JOIN (SELECT least(CAST(floor(({c} - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin, count(*) AS n
                   FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1) h
          ON h.bin = b.bin""")
    return " UNION ALL ".join(parts)


def v4(spark, sf):
    out = profile.box_summary(SPIKES.df(spark, sf), ["value"])
    return rounded_columns(out, ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


V4_SQL = f"""
    WITH s AS (SELECT * FROM {SPIKES.sql} t),
         k AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM s)
    SELECT 'value' AS "column", {near('any_value(q1)', 4)} AS q1, {near('any_value(md)', 4)} AS median,
           {near('any_value(q3)', 4)} AS q3,
           {near('min(value) FILTER (value >= q1 - 1.5 * (q3 - q1))', 4)} AS whisker_low,
           {near('max(value) FILTER (value <= q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high, count(value) AS n FROM s, k"""


def v5(spark, sf):
    out = profile.outlier_points(SPIKES.df(spark, sf), ["event_id"], ["value"])
    return rounded_columns(out, ["value", "lower", "upper"], 4)


V5_SQL = f"""
    WITH s AS (SELECT * FROM {SPIKES.sql} t),
         k AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s)
    SELECT event_id, 'value' AS "column", {near('value', 4)} AS value, {near('q1 - 1.5 * (q3 - q1)', 4)} AS lower,
           {near('q3 + 1.5 * (q3 - q1)', 4)} AS upper
    FROM s, k WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""


def v6(spark, sf):
    """Coordinates on all 64 components lie as far from the centre as the rows did."""
    scores, _ = profile.pca_coordinates(VECTORS.df(spark, sf).drop("vec_id"), DIMS, AXES, "label")
    terms = [F.col(f"PC{i}") * F.col(f"PC{i}") for i in range(1, DIMS + 1)]
    return scores.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg(sum(terms[1:], terms[0])), 6).alias("spread"),
    )


V6_SQL = f"""
    WITH t AS (SELECT * FROM {VECTORS.sql} x), m AS (SELECT {', '.join(f'avg(v{i}) AS m{i}' for i in range(DIMS))} FROM t)
    SELECT CAST(label AS BIGINT) AS label, count(*) AS n,
           {near('avg(' + ' + '.join(f'(v{i} - m{i}) * (v{i} - m{i})' for i in range(DIMS)) + ')')} AS spread
    FROM t, m GROUP BY 1"""


def v7(spark, sf):
    return rounded_columns(profile.class_balance(table(spark, sf, "events"), "event_type"), ["percent", "ratio"])


V7_SQL = f"""
    WITH c AS (SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1)
    SELECT class, n, {near('n * 100.0 / (SELECT sum(n) FROM c)')} AS percent,
           {near('(SELECT max(n) FROM c) * 1.0 / (SELECT min(n) FROM c)')} AS ratio FROM c WHERE class IS NOT NULL"""


def v8(spark, sf):
    return profile.top_importances(orders(spark, sf), ORDERS, "o_orderstatus", n=3)


def v9(spark, sf):
    return profile.data_summary(GAPS.df(spark, sf)).withColumn("value", rounded("value", 2))


def v9_sql():
    src = GAPS.sql
    numeric = ["o_orderkey", "o_custkey", "o_totalprice", "sparse_price", "finished"]
    parts = [
        "SELECT 'dtype' AS section, 'bigint' AS item, 2.0 AS value UNION ALL SELECT 'dtype', 'string', 2.0 "
        "UNION ALL SELECT 'dtype', 'double', 3.0 UNION ALL SELECT 'shape', 'columns', 7.0",
        f"SELECT 'shape', 'rows', count(*) FROM {src} t",
    ]
    parts += [
        f"SELECT 'missing', '{c}', count(*) - count({c}) FROM {src} t HAVING count(*) > count({c})" for c in GAP_COLUMNS
    ]
    for c in numeric:
        for s, f in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}.items():
            parts.append(f"SELECT 'describe', '{c}.{s}', {f}({c}) FROM {src} t")
    parts += [f"SELECT 'categories', '{c}', count(DISTINCT {c}) FROM {src} t" for c in ("o_orderstatus", "o_orderpriority")]
    listed = ", ".join(GAP_COLUMNS)
    copies = f"(SELECT {listed}, count(*) AS n FROM {src} t GROUP BY ALL)"
    parts.append(f"SELECT 'duplicates', 'count', sum(n - 1) FROM {copies}")
    parts.append(f"SELECT 'duplicates', 'percent', sum(n - 1) * 100.0 / sum(n) FROM {copies}")
    return f"SELECT section, item, {near('value', 2)} AS value FROM ({' UNION ALL '.join(parts)})"


CHECKS = {
    "r1_variance_filter": (r1, R1_SQL),
    "r2_f_test_classes": (r2("classification", "l_returnflag"), r2_sql("classification", "l_returnflag")),
    "r2_f_test_regression": (r2("regression", "l_extendedprice"), r2_sql("regression", "l_extendedprice")),
    "r3_importance_filter": (r3, None),
    "r4_recursive_elimination": (r4, None),
    "r5_keep_subset": (
        r5,
        "SELECT l_quantity, l_extendedprice, l_orderkey, l_linenumber, l_returnflag "
        f"FROM {LINES.sql} t",
    ),
    "r6_pca": (r6, R6_SQL),
    "r6_pca_rows": (r6_rows, R6_ROWS_SQL),
    "r6_pca_two_columns": (r6_plane, R6_PLANE_SQL),
    "r7_explained_variance": (r7, R7_SQL),
    "r8_discriminant_projection": (
        r8,
        "SELECT count(*) AS n, count(DISTINCT label) - 1 AS directions, CAST(1 AS DOUBLE) AS least, "
        "CAST(1 AS DOUBLE) AS largest, CAST(0 AS DOUBLE) AS crossed, CAST(1 AS DOUBLE) AS best FROM embeddings",
    ),
    "r9_category_codes": (
        r9,
        f"WITH g AS (SELECT * FROM {GAPS.sql} t), m AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM "
        "(SELECT DISTINCT o_orderpriority AS k FROM g WHERE o_orderpriority IS NOT NULL)) "
        "SELECT o_orderkey, CAST(coalesce(code, -1) AS BIGINT) AS o_orderpriority FROM g LEFT JOIN m ON o_orderpriority = k",
    ),
    "r9_category_codes_many": (
        r9_large, "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name FROM customer",
    ),
    "v1_missing_ranking": (
        v1,
        "WITH m AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {near(f'(count(*) - count({c})) * 100.0 / count(*)')} AS percent FROM {GAPS.sql} t"
            for c in GAP_COLUMNS
        ) + ") SELECT * FROM m WHERE percent > 0",
    ),
    "v2_correlation_pearson": (v2("pearson"), v2_sql("pearson")),
    "v2_correlation_spearman": (v2("spearman"), v2_sql("spearman")),
    # every pair of rows is too slow in SQL at larger sizes; the test suite checks it by brute force as well
    "v2_correlation_kendall": (v2("kendall"), v2_sql("kendall")),
    "v3_histogram": (v3, v3_sql()),
    "v4_box_summary": (v4, V4_SQL),
    "v5_outlier_points": (v5, V5_SQL),
    "v6_pca_coordinates": (v6, V6_SQL),
    "v7_class_balance": (v7, V7_SQL),
    "v8_top_importances": (v8, None),
    "v9_data_summary": (v9, v9_sql()),
}
