"""C1–C10."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import COPIED, GAPS, SPIKES, Source, near, rounded_columns
from tableloom.operators import clean

NEIGHBOURS = Source(
    "customer", "c_custkey",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 1000 END AS balance",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS nation",
    "CAST(c_custkey % 30 AS DOUBLE) AS age",
)
KEYS = ["cust_group", "o_orderstatus", "price_group"]


def c1(keep):
    def run(spark, sf):
        return clean.drop_duplicates(COPIED.df(spark, sf).distinct(), KEYS, keep, ["o_orderkey"])

    return run


def c1_sql(keep):
    order = {"first": "o_orderkey", "last": "o_orderkey DESC"}
    listed = "cust_group, o_orderstatus, o_orderpriority, price_group, o_orderkey"
    part = ", ".join(KEYS)
    if keep is False:
        inner = f"SELECT DISTINCT {listed} FROM {COPIED.sql} t"
        return f"SELECT {listed} FROM (SELECT *, count(*) OVER (PARTITION BY {part}) AS n FROM ({inner})) WHERE n = 1"
    return (
        f"SELECT {listed} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order[keep]}) AS rn "
        f"FROM (SELECT DISTINCT {listed} FROM {COPIED.sql} t)) WHERE rn = 1"
    )


def c1_rows(spark, sf):
    """Whole rows, without an order."""
    return clean.DuplicateDropper().fit(COPIED.df(spark, sf)).transform(COPIED.df(spark, sf))


def c2(spark, sf):
    df = GAPS.df(spark, sf)
    return clean.SparseColumnDropper().fit(df).transform(df)


def c3(strategy, **more):
    def run(spark, sf):
        df = GAPS.df(spark, sf).drop("sparse_price", "finished")
        model = clean.Imputer(strategy=strategy, columns=["o_totalprice", "o_orderpriority"], **more).fit(df)
        return rounded_columns(model.transform(df), ["o_totalprice"], 4)

    return run


def c3_sql(fill: str) -> str:
    mode = "SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"
    return f"""
    WITH g AS (SELECT * FROM {GAPS.sql} t)
    SELECT o_orderkey, o_custkey, o_orderstatus, {near(f'coalesce(o_totalprice, ({fill}))', 4)} AS o_totalprice,
           coalesce(o_orderpriority, ({mode})) AS o_orderpriority FROM g"""


PRICE_MODE = "SELECT price_group FROM g WHERE price_group IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"


def c3_mode(spark, sf):
    df = COPIED.df(spark, sf)
    model = clean.Imputer(strategy="most_frequent", columns=["price_group"]).fit(df)
    return model.transform(df).withColumn("price_group", F.col("price_group").cast("bigint"))


def c4(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_orderpriority")
    return clean.Imputer(columns=["o_orderpriority"]).fit(df).transform(df)


def c5(spark, sf):
    df = NEIGHBOURS.df(spark, sf)
    names = ["balance", "nation", "age"]
    model = clean.Imputer(strategy="knn", knn_neighbors=5, columns=names, key="c_custkey").fit(df)
    return rounded_columns(model.transform(df), names, 7)


def c5_sql() -> str:
    """Mean of the five nearest donors by missing-tolerant distance; ties go to the smaller value."""
    names = ["balance", "nation", "age"]
    gaps = [f"(q.{c} - d.{c})" for c in names]
    used = " + ".join(f"(CASE WHEN {g} IS NULL THEN 0 ELSE 1 END)" for g in gaps)
    total = " + ".join(f"coalesce({g} * {g}, 0)" for g in gaps)

    def one(c):
        return f"""
        SELECT key, avg(v) AS v FROM (
          SELECT q.c_custkey AS key, d.{c} AS v,
                 row_number() OVER (PARTITION BY q.c_custkey ORDER BY ({total}) * 3.0 / nullif({used}, 0), d.{c}) AS rn
          FROM g q, g d WHERE q.{c} IS NULL AND d.{c} IS NOT NULL AND ({used}) > 0) WHERE rn <= 5 GROUP BY key"""

    return f"""
    WITH g AS (SELECT * FROM {NEIGHBOURS.sql} t), b AS ({one('balance')}), n AS ({one('nation')})
    SELECT g.c_custkey, {near('coalesce(g.balance, b.v)', 7)} AS balance,
           {near('coalesce(g.nation, n.v)', 7)} AS nation, {near('age', 7)} AS age
    FROM g LEFT JOIN b ON g.c_custkey = b.key LEFT JOIN n ON g.c_custkey = n.key"""


def c6(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_totalprice")
    return clean.Imputer(strategy="drop", columns=["o_totalprice"]).fit(df).transform(df)


def c7(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_totalprice", "sparse_price", "o_orderpriority")
    model = clean.Imputer(
        strategy="constant", fill_value=-1, column_strategies={"o_totalprice": "mean", "sparse_price": "median"},
        keep=["o_orderkey"],
    ).fit(df)
    return rounded_columns(model.transform(df), ["o_totalprice", "sparse_price"], 4)


C7_SQL = f"""
    WITH g AS (SELECT * FROM {GAPS.sql} t)
    SELECT o_orderkey, {near('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM g))', 4)} AS o_totalprice,
           {near('coalesce(sparse_price, (SELECT median(sparse_price) FROM g))', 4)} AS sparse_price,
           coalesce(o_orderpriority, (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL
             GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM g"""


def c8(method, threshold):
    def run(spark, sf):
        model = clean.OutlierTreatment(method=method, threshold=threshold, columns=["value", "flat"]).fit(
            SPIKES.df(spark, sf)
        )
        return rounded_columns(model.bounds(spark), ["lower", "upper"], 4)

    return run


def c8_sql(method, threshold):
    parts = []
    for c in ("value", "flat"):
        if method == "iqr":
            q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
            low, high = f"{q1} - {threshold} * ({q3} - {q1})", f"{q3} + {threshold} * ({q3} - {q1})"
        else:
            low, high = (f"avg({c}) {s} {threshold} * stddev_samp({c})" for s in "-+")
        parts.append(f"SELECT '{c}' AS \"column\", {near(low, 4)} AS lower, {near(high, 4)} AS upper FROM {SPIKES.sql} t")
    return " UNION ALL ".join(parts)


def c9(spark, sf):
    df = SPIKES.df(spark, sf)
    return rounded_columns(clean.OutlierTreatment(columns=["value"]).fit(df).transform(df), ["value"], 4)


BOUNDS = f"""(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {SPIKES.sql} u)"""
C9_SQL = f"""
    SELECT event_id, user_id, event_type, flat, {near('''CASE WHEN value IS NOT NULL THEN
      least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END''', 4)} AS value
    FROM {SPIKES.sql} t, {BOUNDS}"""


def c10(spark, sf):
    df = SPIKES.df(spark, sf)
    return clean.OutlierTreatment(columns=["value"], action="drop").fit(df).transform(df)


CHECKS = {
    "c1_drop_duplicates_first": (c1("first"), c1_sql("first")),
    "c1_drop_duplicates_last": (c1("last"), c1_sql("last")),
    "c1_drop_duplicates_all": (c1(False), c1_sql(False)),
    "c1_drop_duplicate_rows": (c1_rows, f"SELECT DISTINCT * FROM {COPIED.sql} t"),
    "c2_drop_sparse_columns": (
        c2,
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, finished "
        f"FROM {GAPS.sql} t",
    ),
    "c3_impute_mean": (c3("mean"), c3_sql("SELECT avg(o_totalprice) FROM g")),
    "c3_impute_median": (c3("median"), c3_sql("SELECT median(o_totalprice) FROM g")),
    "c3_impute_constant": (c3("constant", fill_value=7.5), c3_sql("SELECT 7.5")),
    "c3_impute_most_frequent": (
        c3_mode,
        f"WITH g AS (SELECT * FROM {COPIED.sql} t) SELECT cust_group, o_orderstatus, o_orderpriority, o_orderkey, "
        f"coalesce(price_group, ({PRICE_MODE})) AS price_group FROM g",
    ),
    "c4_impute_category": (
        c4,
        f"WITH g AS (SELECT * FROM {GAPS.sql} t) SELECT o_orderkey, coalesce(o_orderpriority, "
        "(SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM g",
    ),
    "c5_impute_neighbours": (c5, c5_sql()),
    "c6_drop_null_rows": (
        c6, f"SELECT o_orderkey, o_totalprice FROM {GAPS.sql} t WHERE o_totalprice IS NOT NULL",
    ),
    "c7_strategy_per_column": (c7, C7_SQL),
    "c8_outlier_bounds_iqr": (c8("iqr", 1.5), c8_sql("iqr", 1.5)),
    "c8_outlier_bounds_zscore": (c8("zscore", 3.0), c8_sql("zscore", 3.0)),
    "c9_winsorize": (c9, C9_SQL),
    "c10_drop_outlier_rows": (
        c10,
        f"SELECT t.* FROM {SPIKES.sql} t, {BOUNDS} "
        "WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)",
    ),
}
