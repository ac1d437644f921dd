"""B1–B10, L1–L3 and M1–M18."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.data import UNEVEN, Source, near, rounded, rounded_columns, table
from tableloom.operators import models
from tableloom.operators.balance import ClassBalancer
from tableloom.operators.boosting import HistogramBooster
from tableloom.operators.select import FeatureSelector
from tableloom.plans import search
from tableloom.plans.config import PrepareConfig
from tableloom.plans.prepare import build, create, prepare, register_component
from tableloom.session import scratch_path
from tableloom.sources.runlog import RunLog

U = UNEVEN.sql
SIZES = f"(SELECT label, count(*) AS n FROM {U} t GROUP BY 1)"


def balanced(spark, sf, method, **more):
    return ClassBalancer(method=method, target="label", key="c_custkey", **more).resample(UNEVEN.df(spark, sf))


def b1(spark, sf):
    """Class sizes, and the fewest and most copies of any one row."""
    copies = balanced(spark, sf, "random_over").groupBy("label", "c_custkey").agg(F.count(F.lit(1)).alias("k"))
    return copies.groupBy("label").agg(
        F.sum("k").alias("n"), F.min("k").alias("fewest"), F.max("k").alias("most"), F.count(F.lit(1)).alias("rows"),
    )


B1_SQL = f"""
    WITH s AS {SIZES}, m AS (SELECT max(n) AS big FROM s)
    SELECT label, big AS n, big // n AS fewest, CAST(ceil(big * 1.0 / n) AS BIGINT) AS most, n AS rows FROM s, m"""


def b2(spark, sf):
    kept = balanced(spark, sf, "random_under")
    return kept.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("rows")
    )


B2_SQL = f"WITH s AS {SIZES} SELECT label, (SELECT min(n) FROM s) AS n, (SELECT min(n) FROM s) AS rows FROM s"


def grown(method):
    """Class sizes, and whether new points lie in the bounding box of their class."""

    def run(spark, sf):
        before = UNEVEN.df(spark, sf)
        after = balanced(spark, sf, method)
        box = before.groupBy(F.col("label").alias("l")).agg(
            *[f(c).alias(f"{s}_{c}") for c in ("c_acctbal", "nation") for s, f in (("lo", F.min), ("hi", F.max))]
        )
        inside = reduce(
            lambda a, b: a & b,
            [F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9) for c in ("c_acctbal", "nation")],
        )
        return after.join(box, F.col("label") == F.col("l")).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("originals"), F.bool_and(inside).alias("in_box"),
        )

    return run


B3_SQL = f"""
    WITH s AS {SIZES} SELECT label, (SELECT max(n) FROM s) AS n, n AS originals, true AS in_box FROM s"""


def b4(spark, sf):
    """The adaptive sizes are rounded per row: the result is near the majority size."""
    out = grown("adasyn")(spark, sf)
    most = out.agg(F.max("originals")).first()[0]
    return out.select(
        "label", "originals", "in_box", (F.abs(F.col("n") - most) < 0.1 * most).alias("near_majority")
    )


B4_SQL = f"WITH s AS {SIZES} SELECT label, n AS originals, true AS in_box, true AS near_majority FROM s"

DISTANCE = "sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.nation - b.nation, 2))"
NEAR_SQL = f"""
    SELECT a.c_custkey AS q, a.label AS ql, b.c_custkey AS c, b.label AS cl, row_number() OVER (
             PARTITION BY a.c_custkey ORDER BY {DISTANCE}, CAST(b.c_custkey AS VARCHAR)) AS rank
    FROM {U} a, {U} b WHERE a.c_custkey <> b.c_custkey"""


def cleaned(method):
    def run(spark, sf):
        return balanced(spark, sf, method)

    return run


B5_SQL = f"""
    WITH k AS (SELECT * FROM ({NEAR_SQL}) WHERE rank = 1)
    SELECT * FROM {U} t WHERE NOT EXISTS (SELECT 1 FROM k x JOIN k y ON x.q = y.c AND x.c = y.q
      WHERE x.q = t.c_custkey AND x.ql <> x.cl AND x.ql <> 'rare')"""
B6_SQL = f"""
    WITH k AS (SELECT * FROM ({NEAR_SQL}) WHERE rank <= 3)
    SELECT * FROM {U} t WHERE label = 'rare' OR NOT EXISTS (
      SELECT 1 FROM k WHERE k.q = t.c_custkey AND k.ql <> k.cl)"""


def combined(method):
    def run(spark, sf):
        return balanced(spark, sf, method).groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("originals")
        )

    return run


def b9(spark, sf):
    """A text feature cannot be interpolated, so rows are repeated instead."""
    df = UNEVEN.df(spark, sf).withColumn("name", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    out = ClassBalancer(method="smote", target="label", key="c_custkey").resample(df)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def b10(spark, sf):
    balancer = ClassBalancer(method="random_over", target="label", key="c_custkey")
    balancer.resample(UNEVEN.df(spark, sf))
    r = balancer.report()
    rows = [(r["method"], r["rows_before"], r["rows_after"], r["columns"], str(r["sampling_strategy"]), r["seed"])]
    return spark.createDataFrame(
        rows, "method string, rows_before bigint, rows_after bigint, columns bigint, strategy string, seed bigint"
    )


B10_SQL = f"""
    WITH s AS {SIZES} SELECT 'random_over' AS method, CAST(sum(n) AS BIGINT) AS rows_before,
    CAST(count(*) * max(n) AS BIGINT) AS rows_after, CAST(4 AS BIGINT) AS columns, 'auto' AS strategy,
    CAST(42 AS BIGINT) AS seed FROM s"""

# -- preparing by configuration -----------------------------------------------------

TABLE = Source(
    "orders", "o_orderkey",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 40 ELSE o_totalprice END AS price",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    "CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS sparse",
    "CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS target",
    copies_where="o_orderkey % 50 = 0",
)
PREPARED = f"""
    d AS (SELECT DISTINCT o_orderkey, price, priority, target FROM {TABLE.sql} t),
    md AS (SELECT median(price) AS md FROM d),
    i AS (SELECT o_orderkey, target, coalesce(price, md) AS price, coalesce(priority, (SELECT priority FROM d
            WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM d, md),
    k AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM i),
    w AS (SELECT o_orderkey, target, priority, least(greatest(price, q1 - {{t}} * (q3 - q1)), q3 + {{t}} * (q3 - q1)) AS price
          FROM i, k)"""


def l1(spark, sf):
    df = TABLE.df(spark, sf)
    config = PrepareConfig.preset("quick")
    out = build(config, target="target", keep=["o_orderkey"]).fit(df).transform(df)
    made = [c for c in out.columns if c.startswith("priority_")]
    return rounded_columns(out, ["price", *made], 5)


def l1_sql():
    values = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    hot = [f"(CASE WHEN priority = '{v}' THEN 1.0 ELSE 0.0 END)" for v in values]
    stats = ", ".join(f"avg({h}) AS a{i}, stddev_pop({h}) AS s{i}" for i, h in enumerate(hot))
    made = ", ".join(f'{near(f"({h} - a{i}) / s{i}", 5)} AS "priority_{v}"' for i, (h, v) in enumerate(zip(hot, values)))
    return f"""WITH {PREPARED.format(t=1.5)}, z AS (SELECT avg(price) AS m, stddev_pop(price) AS sd, {stats} FROM w)
        SELECT o_orderkey, target, {near('(price - m) / sd', 5)} AS price, {made} FROM w, z"""


def l2(spark, sf):
    done = prepare(TABLE.df(spark, sf), PrepareConfig.preset("robust"), keep=["o_orderkey"])
    return rounded_columns(done.table, ["price", "priority"], 5)


L2_SQL = f"""
    WITH {PREPARED.format(t=3.0)}, g AS (SELECT avg(target) AS prior FROM w),
    c AS (SELECT priority AS p, count(*) * 1.0 / (count(*) + 10) * avg(target)
            + (1 - count(*) * 1.0 / (count(*) + 10)) * any_value(prior) AS code FROM w, g GROUP BY 1),
    e AS (SELECT o_orderkey, target, price, code AS priority FROM w JOIN c ON priority = p),
    z AS (SELECT median(price) AS pm, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS ps,
                 median(priority) AS cm, quantile_cont(priority, 0.75) - quantile_cont(priority, 0.25) AS cs FROM e)
    SELECT o_orderkey, target, {near('(price - pm) / ps', 5)} AS price,
           {near('(priority - cm) / CASE WHEN cs = 0 THEN 1 ELSE cs END', 5)} AS priority FROM e, z"""


def l2_imbalanced(spark, sf):
    """Rebalance, then prepare: class sizes after the whole run."""
    done = prepare(
        UNEVEN.df(spark, sf), PrepareConfig.preset("imbalanced", encoding_method="none"), key="c_custkey"
    )
    return done.table.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def l3(spark, sf):
    """A stage of one's own, registered and used by name after the configured ones."""
    try:
        register_component("price_band", lambda **kw: SQLTransformer(
            statement="SELECT *, CAST(floor(price * 2) AS BIGINT) AS band FROM __THIS__"
        ))
    except ValueError:
        pass  # registered by an earlier call in this process
    df = TABLE.df(spark, sf)
    config = PrepareConfig.preset("minimal", encoding_method="none", drop_high_missing=True, drop_duplicates=True)
    out = build(config, "target", ["o_orderkey"], extra=[create("price_band")]).fit(df).transform(df)
    return out.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


L3_SQL = f"""
    WITH {PREPARED.format(t=1e9)}, z AS (SELECT avg(price) AS m, stddev_pop(price) AS sd FROM w)
    SELECT CAST(floor((price - m) / sd * 2) AS BIGINT) AS band, count(*) AS n FROM w, z GROUP BY 1"""

# -- models -----------------------------------------------------------------------------

LINES = Source(
    "lineitem", "l_orderkey * 10 + l_linenumber AS id", "l_quantity", "l_tax", "l_discount",
    "l_extendedprice / 1000 AS price",
)


def fitted(kind, params=None):
    """Prediction at fixed points from a fit on all rows with one feature."""

    def run(spark, sf):
        df = LINES.df(spark, sf)
        found = models.train(df, kind, "regression", "id", "price", ["l_quantity"], params, test_size=0.0)
        points = df.groupBy("l_quantity").agg(F.min("id").alias("id"))
        scored = found.score(points)
        return scored.select("l_quantity", rounded("prediction", 3).alias("prediction"))

    return run


def fitted_sql(slope: str) -> str:
    return f"""
    WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(price) AS my, var_pop(l_quantity) AS vx,
                      covar_pop(l_quantity, price) AS cxy, stddev_samp(price) AS sy FROM {LINES.sql} t),
         b AS (SELECT mx, my, {slope} AS slope FROM s)
    SELECT l_quantity, {near('my + slope * (l_quantity - mx)', 3)} AS prediction
    FROM (SELECT DISTINCT l_quantity FROM {LINES.sql} t), b"""


def classified(kind, params, target="o_orderstatus"):
    """Accuracy and sizes of a trained classifier."""

    def run(spark, sf):
        df = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).withColumn(
            "month", F.month("o_orderdate")
        )
        found = models.train(df, kind, "classification", "o_orderkey", target, ["o_totalprice", "year", "month"], params)
        return _outcome(spark, found)

    return run


def regressed(kind, params):
    def run(spark, sf):
        found = models.train(
            LINES.df(spark, sf), kind, "regression", "id", "price", ["l_quantity", "l_tax", "l_discount"], params
        )
        return _outcome(spark, found)

    return run


def _outcome(spark, found) -> DataFrame:
    rows = [(m, float(v)) for m, v in found.metrics.items()]
    rows += [("train_rows", float(found.train_rows)), ("test_rows", float(found.test_rows))]
    return spark.createDataFrame(rows, "metric string, value double")


def terms(spark, sf) -> DataFrame:
    """Orders with a class that year and month decide, and a feature that decides nothing."""
    df = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).withColumn("month", F.month("o_orderdate"))
    kind = F.when(F.col("year") < 1994, "early").when(F.col("month") <= 6, "first").otherwise("second")
    return df.withColumn("term", kind).withColumn("late", F.when(F.col("year") < 1995, "no").otherwise("yes"))


TERM_SQL = """SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1994 THEN 'early' WHEN month(o_orderdate) <= 6 THEN 'first'
    ELSE 'second' END AS prediction FROM orders"""
LATE_SQL = "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1995 THEN 'no' ELSE 'yes' END AS prediction FROM orders"


def predicted(kind, params, target="term"):
    """Every row's predicted class, learned from the training rows: where features decide the class, it is the class."""

    def run(spark, sf):
        df = terms(spark, sf)
        found = models.train(df, kind, "classification", "o_orderkey", target, ["o_totalprice", "year", "month"], params)
        return found.score(df).select("o_orderkey", "prediction")

    return run


def folds(spark, sf):
    """Accuracy in every fold of a tree that can tell the classes apart."""
    found = models.cross_validate(
        terms(spark, sf), "decisiontree", "classification", "o_orderkey", "term", ["year", "month"],
        params={"max_depth": 4, "max_features": None},
    )
    rows = [(i, float(s)) for i, s in enumerate(found["cv_scores"])]
    return spark.createDataFrame(rows, "fold bigint, accuracy double")


def kept_features(method):
    def run(spark, sf):
        model = FeatureSelector(method=method, columns=["o_totalprice", "year", "month"], target="term", k=2).fit(terms(spark, sf))
        return model.scores(spark).filter("kept").select("column")

    return run


SPLIT_FEATURES = ["l_quantity", "l_tax", "l_discount"]


def first_split(**options):
    """The first tree's only split, learned from all lines: feature, cut, gain as a share of the squared gradients, and
    the values of both leaves."""

    def run(spark, sf):
        df = table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in SPLIT_FEATURES], F.col("l_extendedprice").cast("double").alias("__y"))
        df = VectorAssembler(inputCols=SPLIT_FEATURES, outputCol="__features").transform(df)
        tree = HistogramBooster(rounds=1, learning_rate=0.1, **options).fit(df).splits(spark)
        squares = df.agg((F.var_pop("__y") * F.count(F.lit(1))).alias("s"))
        root, sides = tree.filter("node = 0"), tree.filter("node > 0").groupBy().agg(
            F.max_by("value", -F.col("node")).alias("low"), F.max_by("value", "node").alias("high")
        )
        names = F.array(*[F.lit(c) for c in SPLIT_FEATURES])
        return root.join(F.broadcast(sides)).join(F.broadcast(squares)).select(
            names[F.col("feature")].alias("feature"), rounded("cut", 6).alias("cut"),
            rounded(F.col("gain") / F.col("s"), 9).alias("gain"), rounded("low", 4).alias("low"), rounded("high", 4).alias("high"),
        )

    return run


def first_split_sql(l1=0.0, l2=0.0, least=1):
    def strength(g, h):
        return f"pow(greatest(abs({g}) - {l1}, 0), 2) / ({h} + {l2})"

    def value(g, h):
        return f"-0.1 * sign({g}) * greatest(abs({g}) - {l1}, 0) / ({h} + {l2})"

    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, g FROM r" for c in SPLIT_FEATURES)
    return f"""
        WITH m AS (SELECT avg(CAST(l_extendedprice AS DOUBLE)) AS mean FROM lineitem),
             r AS (SELECT *, mean - CAST(l_extendedprice AS DOUBLE) AS g FROM lineitem, m),
             c AS (SELECT feature, x, sum(g) AS g, count(*) AS h FROM ({parts}) GROUP BY 1, 2),
             b AS (SELECT feature, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt,
                     sum(h) OVER (PARTITION BY feature) AS ht FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
             s AS (SELECT *, 0.5 * ({strength('gl', 'hl')} + {strength('(gt - gl)', '(ht - hl)')} - {strength('gt', 'ht')}) AS gain
                   FROM b WHERE hl >= {least} AND ht - hl >= {least})
        SELECT feature, {near('x', 6)} AS cut, {near('gain / (SELECT sum(g * g) FROM r)', 9)} AS gain,
               {near(value('gl', 'hl'), 4)} AS low, {near(value('(gt - gl)', '(ht - hl)'), 4)} AS high
        FROM s ORDER BY gain DESC LIMIT 1"""


PEOPLE = Source(
    "customer", "c_custkey", "c_acctbal", "CAST(c_nationkey AS DOUBLE) AS nation",
    "CAST(c_custkey % 3 AS DOUBLE) AS kind",
)
PEOPLE_NEAR = f"""
    WITH s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(nation) AS mn, stddev_pop(nation) AS sn
               FROM {PEOPLE.sql} t),
         z AS (SELECT c_custkey, kind, (c_acctbal - ma) / sa AS a, (nation - mn) / sn AS b FROM {PEOPLE.sql} t, s),
         k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rank FROM (
           SELECT x.c_custkey AS q, y.c_custkey AS c, y.kind, {{d}} AS d FROM z x, z y WHERE x.c_custkey <> y.c_custkey))"""
EUCLID = "sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))"


def neighbours(spark, sf, task="classification", **more):
    df = PEOPLE.df(spark, sf)
    model = models.NeighbourModel(
        task=task, features=["c_acctbal", "nation"], label="kind", key="c_custkey", **more
    ).fit(df)
    return df, model


def m11(task, **more):
    def run(spark, sf):
        df, model = neighbours(spark, sf, task, **more)
        out = model.predictions(df, exclude_same=True)
        return out.select("query_id", rounded("prediction", 5).alias("prediction"))

    return run


M11_VOTE = PEOPLE_NEAR.format(d=EUCLID) + f"""
    SELECT query_id, {near('kind', 5)} AS prediction FROM (
      SELECT q AS query_id, kind, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, kind) AS r
      FROM k WHERE rank <= 5 GROUP BY q, kind) WHERE r = 1"""
M11_MEAN = PEOPLE_NEAR.format(d=EUCLID) + f"""
    SELECT q AS query_id, {near('''CASE WHEN min(d) = 0 THEN avg(kind) FILTER (d = 0)
      ELSE sum(kind / nullif(d, 0)) / sum(1 / nullif(d, 0)) END''', 5)} AS prediction FROM k WHERE rank <= 5 GROUP BY q"""


def m12(metric, **more):
    def run(spark, sf):
        df, model = neighbours(spark, sf, metric=metric, **more)
        out = model.kneighbors(df, 4, exclude_same=True)
        return out.select(
            "query_id", "candidate_id", rounded("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank")
        )

    return run


def m12_sql(distance):
    return PEOPLE_NEAR.format(d=distance) + f"""
        SELECT q AS query_id, c AS candidate_id, {near('d')} AS distance, rank FROM k WHERE rank <= 4"""


def m13(spark, sf):
    """Every row is in exactly one part; about a fifth is held out; the parts do not depend on partitioning."""
    df = table(spark, sf, "orders")
    train, test = models.split(df, "o_orderkey")
    _, again = models.split(df.repartition(13), "o_orderkey")
    keys = train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part"))
    ).unionByName(again.select("o_orderkey", F.lit("again").alias("part")))
    rows = keys.groupBy("o_orderkey").agg(
        F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("parts").isin("train", "again,test")).alias("misplaced"),
        (F.abs(F.count_if(F.col("parts") != "train") / F.count(F.lit(1)) - 0.2) < 0.05).alias("share_ok"),
    )


def m14(spark, sf):
    """Probabilities are between 0 and 1 and sum to 1 for every row."""
    df = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    found = models.train(
        df, "randomforest", "classification", "o_orderkey", "o_orderstatus", ["o_totalprice", "year"],
        {"max_depth": 4},
    )
    out = found.probabilities(df)
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("normalised"),
        F.max(F.size("probability")).cast("bigint").alias("classes"),
    )


def m15_classes(spark, sf):
    """A rule as the prediction: status by year of the order."""
    df = table(spark, sf, "orders").withColumn(
        "guess", F.expr("CASE WHEN year(o_orderdate) < 1995 THEN 'F' WHEN year(o_orderdate) < 1997 THEN 'P' ELSE 'O' END")
    )
    return rounded_columns(models.evaluation(df, "o_orderstatus", "guess", "classification"), ["value"])


M15_CLASSES = f"""
    WITH d AS (SELECT o_orderstatus AS a, CASE WHEN year(o_orderdate) < 1995 THEN 'F'
                 WHEN year(o_orderdate) < 1997 THEN 'P' ELSE 'O' END AS p FROM orders),
         c AS (SELECT x AS class, (SELECT count(*) FROM d WHERE a = x) AS actual, (SELECT count(*) FROM d WHERE p = x) AS pred,
                 (SELECT count(*) FROM d WHERE a = x AND p = x) AS hit
               FROM (SELECT DISTINCT a AS x FROM d UNION SELECT DISTINCT p FROM d)),
         f AS (SELECT *, 2.0 * hit / (actual + pred) AS f1 FROM c)
    SELECT 'accuracy' AS metric, {near('sum(hit) * 1.0 / sum(actual)')} AS value FROM f
    UNION ALL SELECT 'f1_macro', {near('avg(f1)')} FROM f
    UNION ALL SELECT 'f1_weighted', {near('sum(f1 * actual) / sum(actual)')} FROM f"""


def m15_numbers(spark, sf):
    df = LINES.df(spark, sf).withColumn("guess", F.col("l_quantity") * 2)
    return rounded_columns(models.evaluation(df, "price", "guess", "regression"), ["value"], 4)


M15_NUMBERS = f"""
    WITH d AS (SELECT avg(pow(price - 2 * l_quantity, 2)) AS mse, var_pop(price) AS v FROM {LINES.sql} t)
    SELECT 'mse' AS metric, {near('mse', 4)} AS value FROM d UNION ALL SELECT 'rmse', {near('sqrt(mse)', 4)} FROM d
    UNION ALL SELECT 'r2', {near('1 - mse / v', 4)} FROM d"""


def m16(spark, sf):
    """Training with a log: the logged metrics are the reported ones."""
    log = RunLog(spark, scratch_path(spark, "training"))
    found = models.train(
        LINES.df(spark, sf), "linear", "regression", "id", "price", ["l_quantity", "l_tax"], log=log
    )
    logged = log.table("metrics").select("metric_name", F.col("metric_value").alias("logged"))
    reported = spark.createDataFrame(list(found.metrics.items()), "metric_name string, reported double")
    return logged.join(reported, "metric_name").select(
        "metric_name", (F.col("logged") == F.col("reported")).alias("same"),
        F.lit(log.experiments().first()["status"]).alias("status"),
    )


def m17(spark, sf):
    found = models.cross_validate(LINES.df(spark, sf), "linear", "regression", "id", "price", ["l_quantity", "l_tax"])
    rows = [(f"fold{i}", float(s)) for i, s in enumerate(found["cv_scores"])]
    rows += [(k, float(found[k])) for k in ("mean_score", "std_score", "train_scores")]
    return spark.createDataFrame(rows, "score string, value double")


def m18(spark, sf):
    candidates = [{"max_depth": p["max_depth"], "max_features": None} for p in search.random_params(
        {"max_depth": models.SCHEMAS["decisiontree"]["max_depth"]}, 2, seed=7
    )]
    return search.random_search(
        LINES.df(spark, sf), "decisiontree", "regression", "id", candidates, target="price",
        features=["l_quantity", "l_tax"],
    )


def m18_suggest(spark, sf):
    df = table(spark, sf, "lineitem")
    found = search.suggest_for(df, "gradientboosting", "regression", ["l_quantity", "l_tax"])
    rows = [(k, float(v)) for k, v in found.items()]
    return spark.createDataFrame(rows, "parameter string, value double")


M18_SQL = """
    WITH n AS (SELECT count(*) AS n FROM lineitem)
    SELECT 'n_estimators' AS parameter, CAST(CASE WHEN n > 10000 THEN 500 WHEN n > 5000 THEN 200 ELSE 100 END AS DOUBLE) AS value
    FROM n UNION ALL SELECT 'learning_rate', CASE WHEN n > 10000 THEN 0.05 ELSE 0.1 END FROM n
    UNION ALL SELECT * FROM (VALUES ('random_state', 42.0), ('subsample', 1.0), ('max_depth', 3.0), ('min_samples_split', 2.0))"""

CHECKS = {
    "b1_random_over": (b1, B1_SQL),
    "b2_random_under": (b2, B2_SQL),
    "b3_smote": (grown("smote"), B3_SQL),
    "b4_adasyn": (b4, B4_SQL),
    "b5_tomek_links": (cleaned("tomek"), B5_SQL),
    "b6_edited_neighbours": (cleaned("enn"), B6_SQL),
    "b7_smote_tomek": (combined("smote_tomek"), None),
    "b8_smote_edited": (combined("smote_enn"), None),
    "b9_fallback": (b9, f"WITH s AS {SIZES} SELECT label, (SELECT max(n) FROM s) AS n FROM s"),
    "b10_balance_report": (b10, B10_SQL),
    "l1_prepare_quick": (l1, l1_sql()),
    "l2_prepare_robust": (l2, L2_SQL),
    "l2_prepare_imbalanced": (l2_imbalanced, f"WITH s AS {SIZES} SELECT label, (SELECT max(n) FROM s) AS n FROM s"),
    "l3_stage_of_ones_own": (l3, L3_SQL),
    "m1_linear_regression": (fitted("linear"), fitted_sql("cxy / vx")),
    "m1_logistic": (classified("linear", {"C": 1.0}), None),
    "m2_ridge": (fitted("ridge", {"alpha": 50.0}), fitted_sql("cxy / (vx + 50.0 / n)")),
    "m3_lasso": (fitted("lasso", {"alpha": 20.0}), fitted_sql("sign(cxy) * greatest(abs(cxy) - 20.0, 0) / vx")),
    "m4_elastic_net": (
        fitted("elasticnet", {"alpha": 10.0, "l1_ratio": 0.5}),
        fitted_sql("sign(cxy) * greatest(abs(cxy) - 5.0, 0) / (vx + 5.0)"),
    ),
    "m5_decision_tree": (classified("decisiontree", {"max_depth": 5, "max_features": None}), None),
    "m6_random_forest": (classified("randomforest", {"max_depth": 5}), None),
    "m7_gradient_boosting": (regressed("gradientboosting", {}), None),
    "m7_gradient_boosting_classes": (classified("gradientboosting", {"max_depth": 2}), None),
    "m1_logistic_rows": (predicted("linear", {"C": 10.0}, "late"), LATE_SQL),
    "m5_decision_tree_rows": (predicted("decisiontree", {"max_depth": 5, "max_features": None}), TERM_SQL),
    "m6_random_forest_rows": (predicted("randomforest", {"max_depth": 5, "max_features": None, "n_estimators": 20}), TERM_SQL),
    "m7_gradient_boosting_rows": (predicted("gradientboosting", {"max_depth": 3, "n_estimators": 10}, "late"), LATE_SQL),
    "m7_softmax_rows": (predicted("gradientboosting", {"max_depth": 3, "n_estimators": 10}), TERM_SQL),
    "m8_xgboost_rows": (predicted("xgboost", {"max_depth": 3, "n_estimators": 10, "reg_alpha": 0.5}), TERM_SQL),
    "m9_lightgbm_rows": (predicted("lightgbm", {"num_leaves": 7, "n_estimators": 10}), TERM_SQL),
    "m10_catboost_rows": (predicted("catboost", {"depth": 4, "n_estimators": 10}), TERM_SQL),
    "m17_fold_accuracy": (folds, "SELECT i AS fold, CAST(1 AS DOUBLE) AS accuracy FROM range(5) t(i)"),
    "r3_importance_kept": (kept_features("importance"), "SELECT unnest(['month', 'year']) AS \"column\""),
    "r4_elimination_kept": (kept_features("rfe"), "SELECT unnest(['month', 'year']) AS \"column\""),
    "m8_first_split": (first_split(max_depth=1, l1=100.0, l2=50.0), first_split_sql(100.0, 50.0)),
    "m9_first_split": (first_split(growth="leaf", max_leaves=2, min_rows=500), first_split_sql(least=500)),
    "m10_first_split": (first_split(growth="oblivious", max_depth=1, l2=3.0), first_split_sql(l2=3.0)),
    "m8_boosting_xgboost_profile": (regressed("xgboost", {"max_depth": 4, "colsample_bytree": 0.7, "n_estimators": 30}), None),
    "m9_boosting_lightgbm_profile": (regressed("lightgbm", {"num_leaves": 15, "n_estimators": 30}), None),
    "m10_boosting_catboost_profile": (regressed("catboost", {"depth": 4, "n_estimators": 30}), None),
    "m11_neighbour_vote": (m11("classification"), M11_VOTE),
    "m11_neighbour_mean_by_distance": (m11("regression", weights="distance"), M11_MEAN),
    "m12_k_neighbours": (m12("euclidean"), m12_sql(EUCLID)),
    "m12_k_neighbours_manhattan": (m12("manhattan"), m12_sql("abs(x.a - y.a) + abs(x.b - y.b)")),
    "m12_k_neighbours_chebyshev": (m12("chebyshev"), m12_sql("greatest(abs(x.a - y.a), abs(x.b - y.b))")),
    "m12_k_neighbours_minkowski": (
        m12("minkowski", p=3), m12_sql("pow(pow(abs(x.a - y.a), 3) + pow(abs(x.b - y.b), 3), 1.0 / 3)"),
    ),
    "m13_split": (m13, "SELECT count(*) AS n, CAST(0 AS BIGINT) AS misplaced, true AS share_ok FROM orders"),
    "m14_probabilities": (
        m14, "SELECT count(*) AS n, count(*) AS normalised, count(DISTINCT o_orderstatus) AS classes FROM orders",
    ),
    "m15_metrics_classes": (m15_classes, M15_CLASSES),
    "m15_metrics_numbers": (m15_numbers, M15_NUMBERS),
    "m16_train_workflow": (
        m16, "SELECT * FROM (VALUES ('mse', true, 'completed'), ('rmse', true, 'completed'), ('r2', true, 'completed')) "
        "v(metric_name, same, status)",
    ),
    "m17_cross_validation": (m17, None),
    "m18_random_search": (m18, None),
    "m18_suggested_parameters": (m18_suggest, M18_SQL),
}
