"""F1–F8, T1–T6, G1–G5."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import DATED, GAPS, Source, near, rounded, rounded_columns, table
from tableloom.functions.keyed import rows_before
from tableloom.operators import features, transform
from tableloom.operators.scale import FeatureScaler

BALANCES = Source(
    "customer", "c_custkey",
    "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal END AS bal",
    "CAST(1 AS DOUBLE) AS flat",
)
B = BALANCES.sql


def scaled(method, digits=6, **more):
    def run(spark, sf):
        df = BALANCES.df(spark, sf)
        model = FeatureScaler(method=method, columns=["bal", "flat"], **more).fit(df)
        return rounded_columns(model.transform(df), ["bal", "flat"], digits)

    return run


def scaled_sql(formula: str, flat: str, digits: int = 6) -> str:
    return f"""
    WITH s AS (SELECT avg(bal) AS m, stddev_pop(bal) AS sd, min(bal) AS lo, max(bal) AS hi, max(abs(bal)) AS ma,
                      median(bal) AS med, quantile_cont(bal, 0.25) AS q1, quantile_cont(bal, 0.75) AS q3
               FROM {B} t)
    SELECT c_custkey, {near(formula, digits)} AS bal, {near(flat, digits)} AS flat FROM {B} t, s"""


def f5(spark, sf):
    """Place of every row by its normal score, and the score of the ends; exact scores are tested on their own."""
    df = BALANCES.df(spark, sf).select("c_custkey", "bal")
    out = FeatureScaler(method="quantile", columns=["bal"]).fit(df).transform(df).filter("bal IS NOT NULL")
    placed = rows_before(out.groupBy("bal").agg(F.count(F.lit(1)).alias("n")), [F.col("bal")], "n", "before")
    place = (F.col("before") + 1).cast("bigint")
    ends = F.when(F.abs("bal") > 5, rounded(F.col("bal"), 3))
    out = out.join(placed.select("bal", "before"), "bal")
    return out.select("c_custkey", place.alias("place"), ends.alias("end_score"))


F5_SQL = f"""SELECT c_custkey, rank() OVER (ORDER BY bal) AS place, CASE WHEN bal = (SELECT min(bal) FROM {B} t)
             THEN -5.199 WHEN bal = (SELECT max(bal) FROM {B} t) THEN 5.199 END AS end_score FROM {B} t WHERE bal IS NOT NULL"""

YJ = ("(CASE WHEN {x} >= 0 THEN (pow({x} + 1, {l}) - 1) / {l} ELSE -(pow(1 - {x}, 2 - {l}) - 1) / (2 - {l}) END)")


def f7(method, **more):
    def run(spark, sf):
        df = BALANCES.df(spark, sf).select("c_custkey", "bal")
        model = FeatureScaler(method=method, columns=["bal"], **more).fit(df)
        return rounded_columns(model.inverse_transform(model.transform(df)), ["bal"], 4)

    return run


ROUND_TRIP = f"SELECT c_custkey, {near('bal', 4)} AS bal FROM {B} t"


def f8(spark, sf):
    df = BALANCES.df(spark, sf)
    model = FeatureScaler(method="robust", columns=["bal"]).fit(df)
    return rounded_columns(model.scale_params(spark), ["value"], 4)


F8_SQL = f"""
    SELECT 'bal' AS "column", 'center' AS parameter, {near('median(bal)', 4)} AS value FROM {B} t UNION ALL
    SELECT 'bal', 'scale', {near('quantile_cont(bal, 0.75) - quantile_cont(bal, 0.25)', 4)} FROM {B} t"""


def transformed(step, digits=6, **more):
    def run(spark, sf):
        df = BALANCES.df(spark, sf).select("c_custkey", "bal")
        return rounded_columns(step(columns=["bal"], **more).fit(df).transform(df), ["bal"], digits)

    return run


def transformed_sql(formula: str, digits: int = 6) -> str:
    return f"""
    WITH s AS (SELECT min(bal) AS lo FROM {B} t)
    SELECT c_custkey, {near(formula, digits)} AS bal FROM {B} t, s"""


def likelihood(step, digits):
    """The learned lambda is at least as likely as a fine grid evaluated in SQL."""

    def run(spark, sf):
        df = table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("x"))
        model = step(columns=["x"]).fit(df)
        params = model.state["params"]["x"]
        lam = params[1] if isinstance(params, list) else params
        return df.agg(F.count(F.lit(1)).alias("n")).select("n", F.round(F.lit(lam), digits).alias("lam"))

    return run


def likelihood_sql(kind: str, digits: int) -> str:
    step = 10.0**-digits
    y = "(pow(x, l) - 1) / l" if kind == "box-cox" else "(pow(x + 1, l) - 1) / l"
    logs = "ln(x)" if kind == "box-cox" else "ln(x + 1)"
    return f"""
    WITH d AS (SELECT p_retailprice / 100 AS x FROM part),
         grid AS (SELECT i * {step} AS l FROM range(-300, 500) r(i) WHERE i <> 0),
         s AS (SELECT l, count(*) AS n, -count(*) / 2.0 * ln(var_pop({y})) + (l - 1) * sum({logs}) AS score
               FROM d, grid GROUP BY l)
    SELECT n, round(l, {digits}) AS lam FROM s ORDER BY score DESC LIMIT 1"""


def t6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    model = transform.PercentileTransformer(columns=["l_quantity"], n_quantiles=1000).fit(df)
    return rounded_columns(model.transform(df), ["l_quantity"])


T6_SQL = f"""
    WITH g AS (SELECT list(v ORDER BY i) AS grid FROM (
           SELECT i, quantile_cont(l_quantity, i / 999.0) AS v FROM
             (SELECT unnest(range(0, 1000)) AS i) p, lineitem GROUP BY i)),
         d AS (SELECT DISTINCT l_quantity AS v FROM lineitem),
         m AS (SELECT v, len(list_filter(grid, lambda x: x < v)) / 1000.0 AS share FROM d, g)
    SELECT l_orderkey, l_linenumber, {near('share')} AS l_quantity FROM lineitem JOIN m ON l_quantity = v"""
T6_SQL = T6_SQL.replace(
    "quantile_cont(l_quantity, i / 999.0) AS v FROM\n             (SELECT unnest(range(0, 1000)) AS i) p, lineitem GROUP BY i",
    "q AS v FROM (SELECT unnest(range(0, 1000)) AS i, unnest((SELECT quantile_cont(l_quantity, ["
    + ", ".join(repr(i / 999) for i in range(1000)) + "]) FROM lineitem)) AS q)",
)


def g1(**more):
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
        out = features.PolynomialFeatures(columns=["l_quantity", "l_tax"], **more).fit(df).transform(df)
        return rounded_columns(out, [c for c in out.columns if c not in ("l_orderkey", "l_linenumber")])

    return run


def g1_sql(terms: dict[str, str]) -> str:
    listed = ", ".join(f'{near(expr)} AS "{name}"' for name, expr in terms.items())
    return f"SELECT l_orderkey, l_linenumber, {listed} FROM lineitem"


def g2(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_totalprice", "o_custkey", "finished")
    out = features.InteractionFeatures(
        columns=["o_totalprice", "o_custkey", "finished"], max_interactions=3
    ).fit(df).transform(df)
    made = [c for c in out.columns if "*" in c]
    return rounded_columns(out, made, 2)


def g2_sql() -> str:
    one = {"o_totalprice": "coalesce(o_totalprice, 1)", "o_custkey": "o_custkey", "finished": "finished"}
    sets = [("o_totalprice", "o_custkey"), ("o_totalprice", "finished"), ("o_custkey", "finished"),
            ("o_totalprice", "o_custkey", "finished")]
    listed = ", ".join(f'{near(" * ".join(one[c] for c in s), 2)} AS "{"*".join(s)}"' for s in sets)
    return f"SELECT o_orderkey, o_totalprice, o_custkey, finished, {listed} FROM {GAPS.sql} t"


def g3(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    out = features.RatioFeatures(columns=["l_quantity", "l_extendedprice", "l_tax"]).fit(df).transform(df)
    return rounded_columns(out, [c for c in out.columns if "_over_" in c], 3)


def g3_sql() -> str:
    names = ["l_quantity", "l_extendedprice", "l_tax"]
    listed = ", ".join(
        f"{near(f'{a} / ({b} + 1e-6)', 3)} AS {a}_over_{b}" for a in names for b in names if a != b
    )
    return f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax, {listed} FROM lineitem"


def g4(spark, sf):
    df = GAPS.df(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = features.GroupAggregates(group_column="o_orderpriority", agg_columns=["o_totalprice"]).fit(df).transform(df)
    return rounded_columns(out, [c for c in out.columns if c.startswith("o_totalprice_")], 2)


def g4_sql() -> str:
    aggregates = {"mean": "avg(x)", "sum": "coalesce(sum(x), 0)", "std": "stddev_samp(x)", "min": "min(x)",
                  "max": "max(x)", "count": "count(x)"}
    made = ", ".join(f"{e.replace('x)', 'o_totalprice)', 1)} AS {n}" for n, e in aggregates.items())
    listed = ", ".join(f"{near(f'm.{n}', 2)} AS o_totalprice_{n}" for n in aggregates)
    return f"""
    WITH g AS (SELECT * FROM {GAPS.sql} t), m AS (SELECT o_orderpriority AS k, {made} FROM g
               WHERE o_orderpriority IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, o_orderpriority, o_totalprice, {listed} FROM g LEFT JOIN m ON o_orderpriority = m.k"""


def g5(spark, sf):
    df = DATED.df(spark, sf)
    out = features.DateParts(date_columns=["o_orderdate", "text_date"]).fit(df).transform(df)
    parts = [c for c in out.columns if c.startswith(("o_orderdate_", "text_date_"))]
    return out.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in parts])


def g5_sql() -> str:
    columns = []
    for name, d in (("o_orderdate", "o_orderdate"), ("text_date", "try_cast(text_date AS TIMESTAMP)")):
        for part, expr in {
            "year": "year({d})", "month": "month({d})", "day": "day({d})", "dayofweek": "isodow({d}) - 1",
            "quarter": "quarter({d})", "is_weekend": "coalesce(CAST(isodow({d}) >= 6 AS BIGINT), 0)",
        }.items():
            columns.append(f"CAST({expr.format(d=d)} AS BIGINT) AS {name}_{part}")
    return f"SELECT o_orderkey, {', '.join(columns)} FROM {DATED.sql} t"


YEO = YJ.format(x="bal", l="0.5")
CHECKS = {
    "f1_standard": (scaled("standard"), scaled_sql("(bal - m) / sd", "0")),
    "f1_standard_no_mean": (scaled("standard", with_mean=False), scaled_sql("bal / sd", "1")),
    "f2_minmax": (scaled("minmax"), scaled_sql("(bal - lo) / (hi - lo)", "0")),
    "f3_robust": (scaled("robust"), scaled_sql("(bal - med) / (q3 - q1)", "0")),
    "f4_maxabs": (scaled("maxabs"), scaled_sql("bal / ma", "1")),
    "f5_quantile_normal": (f5, F5_SQL),
    "f6_power_fixed_lambda": (
        scaled("power", lambda_=0.5),
        f"WITH s AS (SELECT avg({YEO}) AS m, stddev_pop({YEO}) AS sd FROM {B} t) "
        f"SELECT c_custkey, {near(f'({YEO} - m) / sd')} AS bal, CAST(0 AS DOUBLE) AS flat FROM {B} t, s",
    ),
    "f7_inverse_standard": (f7("standard"), ROUND_TRIP),
    "f7_inverse_robust": (f7("robust"), ROUND_TRIP),
    "f7_inverse_power": (f7("power"), ROUND_TRIP),
    "f8_scale_parameters": (f8, F8_SQL),
    "t1_log": (
        transformed(transform.LogTransformer),
        transformed_sql("ln(nullif(greatest(bal + CASE WHEN lo > 0 THEN 1e-6 ELSE abs(lo) + 1e-6 END, 0), 0))"),
    ),
    "t1_log_base_10": (
        transformed(transform.LogTransformer, base=10.0, shift=1.0),
        transformed_sql("ln(bal + CASE WHEN lo > 0 THEN 1.0 ELSE abs(lo) + 1.0 END) / ln(10)"),
    ),
    "t2_sqrt": (
        transformed(transform.SqrtTransformer), transformed_sql("sqrt(bal + CASE WHEN lo >= 0 THEN 0 ELSE abs(lo) END)"),
    ),
    "t3_reciprocal": (transformed(transform.ReciprocalTransformer), transformed_sql("1 / nullif(bal + 1e-6, 0)")),
    "t4_box_cox": (
        transformed(transform.BoxCoxTransformer, 4, lambda_=0.5),
        transformed_sql("(pow(bal + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END, 0.5) - 1) / 0.5", 4),
    ),
    "t4_box_cox_lambda": (likelihood(transform.BoxCoxTransformer, 2), likelihood_sql("box-cox", 2)),
    "t5_yeo_johnson": (
        transformed(transform.YeoJohnsonTransformer, 3, lambda_=0.5), transformed_sql(YEO, 3),
    ),
    "t5_yeo_johnson_lambda": (likelihood(transform.YeoJohnsonTransformer, 2), likelihood_sql("yeo-johnson", 2)),
    "t6_percentile_rank": (t6, T6_SQL),
    "g1_polynomial": (
        g1(),
        g1_sql({"l_quantity": "l_quantity", "l_tax": "l_tax", "l_quantity^2": "l_quantity * l_quantity",
                "l_quantity l_tax": "l_quantity * l_tax", "l_tax^2": "l_tax * l_tax"}),
    ),
    "g1_interaction_only": (
        g1(interaction_only=True, include_bias=True),
        g1_sql({"1": "1", "l_quantity": "l_quantity", "l_tax": "l_tax", "l_quantity l_tax": "l_quantity * l_tax"}),
    ),
    "g2_interactions": (g2, g2_sql()),
    "g3_ratios": (g3, g3_sql()),
    "g4_group_aggregates": (g4, g4_sql()),
    "g5_date_parts": (g5, g5_sql()),
}
