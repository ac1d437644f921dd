import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableloom.functions import stats
from tableloom.functions.columns import choose_columns, detect_target
from tableloom.functions.expr import md5_modulo, uuid5
from tableloom.functions.keyed import global_rank, lookup_join, rows_before
from tableloom.functions.knn import knn_join
from tableloom.functions.moments import moments


def uneven(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.full(n // 3, 7.0), rng.lognormal(0, 3, n // 3), rng.integers(0, 50, n - 2 * (n // 3))])
    return pd.DataFrame({"id": np.arange(n), "x": rng.permutation(x), "y": 10.0 ** rng.integers(-300, 300, n)})


@pytest.mark.parametrize("limit", [None, 25])
def test_quantiles_are_exact_on_uneven_data(spark, limit):
    frame = uneven()
    found = stats.quantiles(spark.createDataFrame(frame), ["x", "y"], [0.0, 0.01, 0.25, 0.5, 0.75, 1.0], limit=limit)
    for c in ("x", "y"):
        want = np.percentile(frame[c], [0, 1, 25, 50, 75, 100])
        assert np.allclose(found[c], want, rtol=1e-12)


def test_many_ranks_from_value_counts(spark):
    frame = uneven()
    probs = np.linspace(0, 1, 101)
    found = stats.quantiles(spark.createDataFrame(frame), ["x"], list(probs), limit=25)["x"]
    assert np.allclose(found, np.quantile(frame["x"], probs), rtol=1e-12)


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert stats.quantiles(df, ["x"], [0.5]) == {"x": None}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert stats.null_counts(df, ["x"]) == (3, {"x": 2})
    assert stats.numeric_stats(df, ["x"], ["mean"])["x"]["mean"] == 1.0


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("b", 9), ("a", 10), (None, None)], "t string, n int")
    assert stats.most_frequent(df, ["t", "n"]) == {"t": "a", "n": "9"}


def test_column_choice_and_target(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 0)], "k int, t string, v double, Label int")
    assert choose_columns(df, None, "numeric") == ["k", "v", "Label"]
    assert choose_columns(df, ["t", "nope", "v"], "numeric") == ["t", "v"]
    assert detect_target(df) == "Label"


def test_hash_and_uuid_match_their_definitions(spark):
    import hashlib
    import uuid

    values = ["", "a", "5-LOW", "é"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", md5_modulo(F.col("v")).alias("h"), uuid5(F.col("v")).alias("u")).collect():
        assert row["h"] == int(hashlib.md5(row["v"].encode()).hexdigest(), 16) % 1_000_000
        assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, row["v"]))


def test_lookup_with_hot_and_missing_keys(spark):
    rows = [("hot",)] * 50 + [("cold",)] * 3 + [(None,)] * 20 + [("new",)]
    df = spark.createDataFrame(rows, "k string")
    table = spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3)], "key string, code int")
    plain = lookup_join(df, table, "k", "key", None, {"hot": 7})
    assert dict(plain.groupBy("code").count().collect()) == {1: 50, 2: 3, None: 21}
    safe = lookup_join(df, table, "k", "key", None, {"hot": 7}, null_safe=True)
    assert dict(safe.groupBy("code").count().collect()) == {1: 50, 2: 3, 3: 20, None: 1}


def test_global_rank_and_rows_before(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), (F.col("id") % 5 + 1).alias("n"))
    assert global_rank(df, [F.col("v")], "r").filter("r <> v").count() == 0
    rows = rows_before(df, [F.col("v")], "n", "b").toPandas().sort_values("v")
    assert (rows["b"].to_numpy() == rows["n"].cumsum().shift(fill_value=0).to_numpy()).all()


def test_ranks_inside_groups_that_span_ranges(spark):
    from tableloom.functions.keyed import grouped_rank

    rows = [("hot", i) for i in range(400)] + [(f"g{i % 9}", i) for i in range(90)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = grouped_rank(df, "k", [F.col("v")], "r").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, v): sorted(w for j, w in rows if j == k).index(v) for k, v in rows}
    assert len(got) == len(rows) and all(r.r == want[r.k, r.v] for r in got)


def brute(x, y, qid, cid, k, dist, same):
    found = {}
    for i, q in enumerate(qid):
        order = sorted((dist(x[i], y[j]), c) for j, c in enumerate(cid) if not (same and c == q))
        found[q] = [c for _, c in order[:k]]
    return found


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski", "cosine"])
@pytest.mark.parametrize("block_rows", [4096, 12])
def test_neighbours_equal_brute_force(spark, metric, block_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3)).round(3)
    x[:30] = x[0]  # a third are copies of one row
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "manhattan": lambda a, b: np.abs(a - b).sum(),
        "chebyshev": lambda a, b: np.abs(a - b).max(),
        "minkowski": lambda a, b: (np.abs(a - b) ** 3).sum() ** (1 / 3),
        "cosine": lambda a, b: ((a - b) ** 2).sum() / 2,
    }[metric]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    near = knn_join(
        df, df, 4, query_id="id", candidate_id="id", metric=metric, p=3.0, exclude_same=True, block_rows=block_rows
    )
    got: dict = {}
    for r in near.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    data = unit if metric == "cosine" else x
    want = brute(data, data, range(90), range(90), 4, dist, True)
    rounded = {q: [round(float(dist(data[q], data[c])), 9) for c in cs] for q, cs in want.items()}
    assert {q: [round(float(dist(data[q], data[c])), 9) for c in cs] for q, cs in got.items()} == rounded
    if metric != "cosine":
        assert got == want


def test_neighbours_within_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big" if i < 60 else f"g{i % 7}", rng.normal(size=2).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g string, vector array<double>")
    near = knn_join(df, df, 2, query_id="id", candidate_id="id", exclude_same=True, within="g", block_rows=16)
    got = {(r["query_id"], r["rank"]): r["candidate_id"] for r in near.collect()}
    for i, g, v in rows:
        order = sorted((float(np.hypot(*(np.array(v) - np.array(w)))), j) for j, h, w in rows if h == g and j != i)
        for k, (_, j) in enumerate(order[:2], 1):
            assert got[i, k] == j


def clustered(n=3000, d=64, centres=30, seed=6):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] * 3 + rng.normal(size=(n, d)) * 0.3


def test_tree_prunes_in_many_dimensions_and_blocks_stay_in_place(spark):
    from tableloom.functions import knn

    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>")
    offered = df.select(F.lit("").alias("cell"), F.col("id").alias("candidate_id"), "vector")
    asked = df.select(F.lit("").alias("cell"), F.col("id").alias("query_id"), "vector")
    search = knn.Search(6, "euclidean", 2.0, 100)
    layout = knn.lay_out(offered, search, False)
    leaves = sum(len(b) for b in layout.boxes.values())
    assert leaves >= 30
    kind = knn._placed(offered, "candidate_id", True)
    blocks = offered.mapInArrow(knn._placing(layout, "candidate_id", True), kind)
    assert blocks.count() == len(x)  # every candidate is in one block
    assert blocks.groupBy("cell", "leaf", "part").count().agg(F.max("count")).first()[0] <= 2 * search.block_rows
    home = asked.mapInArrow(knn._placing(layout, "query_id", True), knn._placed(asked, "query_id", True))
    first = knn.stream(home.withColumn("bound", F.lit(float("inf"))), blocks, search)
    further = first.mapInArrow(knn._routing(layout, search), knn._routed_schema(asked)).count()
    assert further < 0.2 * len(x) * leaves
    near = knn_join(df, df, 5, query_id="id", candidate_id="id", exclude_same=True, block_rows=100)
    got = {(r["query_id"], r["rank"]): r["candidate_id"] for r in near.collect()}
    d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert all(got[i, k + 1] == want[i, k] for i in range(len(x)) for k in range(5))


def test_leaves_are_about_a_block_where_no_axis_leads(spark):
    from tableloom.functions import knn

    x = np.random.default_rng(4).normal(size=(2000, 40))
    offered = spark.createDataFrame([("", i, v.tolist()) for i, v in enumerate(x)], "cell string, candidate_id int, vector array<double>")
    search = knn.Search(6, "manhattan", 2.0, 100)
    leaves = sum(len(b) for b in knn.lay_out(offered, search, False).boxes.values())
    assert 16 <= leaves <= 24 and search.block_rows == 125


def test_large_groups_get_trees_of_their_own(spark):
    x = clustered(900, 16, 9)
    rows = [(i, "hot" if i < 700 else f"g{i % 20}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, g string, vector array<double>")
    near = knn_join(df, df, 3, query_id="id", candidate_id="id", exclude_same=True, within="g", block_rows=60)
    got = {(r["query_id"], r["rank"]): r["candidate_id"] for r in near.collect()}
    groups = np.array([r[1] for r in rows])
    for i in range(0, 900, 7):
        same = [j for j in np.flatnonzero(groups == groups[i]) if j != i]
        want = sorted(same, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:3]
        assert [got[i, k] for k in range(1, len(want) + 1)] == want


def test_busy_blocks_are_copied_for_long_streams_only(spark, monkeypatch):
    from tableloom.functions import knn

    monkeypatch.setattr(knn, "STREAM_ROWS", 50)
    df = spark.createDataFrame([(i, [float(i), float(i * i % 17)]) for i in range(120)], "id int, vector array<double>")
    near = knn_join(df, df, 1, query_id="id", candidate_id="id")
    assert near.filter("query_id = candidate_id AND distance = 0").count() == 120


@pytest.mark.parametrize("metric,width,share", [("manhattan", 64, 4), ("manhattan", 600, 1), ("euclidean", 64, 4)])
def test_few_pairs_are_measured_and_the_best_are_all_pairs_best(metric, width, share):
    from functools import wraps

    from tableloom.functions import knn

    rng = np.random.default_rng(5)
    y = rng.normal(size=(900, width))
    y[5], y[100:130], y[7], y[8] = y[3], y[99], 50 * y[7], 0.0
    x = np.vstack([y[:40] + 0.3 * rng.normal(size=(40, width)), y[90:110], 9 * rng.normal(size=(5, width))])
    plain = knn._distance(metric, 2)
    full, cells = plain(x, y), []

    @wraps(plain)
    def counting(*args, **more):
        found = plain(*args, **more)
        cells.append(found.size)
        return found

    for bound in (np.full(len(x), np.inf), np.sort(full, axis=1)[:, 3]):
        found = knn.Block(list(range(900)), y).best(x, bound, 6, metric == "euclidean", counting)
        for d, most, (ids, distances) in zip(full, bound, found):
            order = [c for c in np.lexsort((np.arange(900), d))[:6] if d[c] <= most * (1 + 1e-9)]
            if metric == "manhattan":
                assert ids == order and (distances == d[order]).all()
            else:
                assert np.allclose(distances, d[order], atol=1e-6)
    assert sum(cells) / 2 < x.shape[0] * 900 / share + 900


def test_city_block_codes_of_odd_numbers(spark):
    from tableloom.functions import knn

    rng, plain = np.random.default_rng(6), knn._distance("manhattan", 1)
    same = np.ones((60, 20))
    for y in (same, same * 1e200, same * 0.0, rng.normal(size=(60, 20)) * 1e-200, np.where(rng.random((60, 20)) < 0.01, np.inf, 1.0)):
        with np.errstate(invalid="ignore"):
            d = plain(same[:3], y)
        found = knn.Block(list(range(60)), y).best(same[:3], np.full(3, np.inf), 4, False, plain)
        for one, (ids, distances) in zip(d, found):
            order = [c for c in np.lexsort((np.arange(60), one))[:4]]
            assert ids == order and (distances == one[order]).all()


def test_moments_per_class(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.normal(5, 2, size=(200, 3)), columns=list("abc"))
    frame["y"] = np.where(np.arange(200) % 3 == 0, "p", "q")
    parts = moments(spark.createDataFrame(frame).repartition(5), ["a", "b", "c"], by="y")
    for label, m in parts.items():
        own = frame.loc[frame["y"] == label, ["a", "b", "c"]]
        assert m.n == len(own)
        assert np.allclose(m.covariance(), own.cov())


def test_normal_quantile():
    import numpy as np
    from statistics import NormalDist

    from tableloom.operators.scale import normal_quantile

    p = np.concatenate([np.linspace(1e-7, 1 - 1e-7, 2001), 10.0 ** -np.arange(2, 10), 1 - 10.0 ** -np.arange(2, 10)])
    want = [NormalDist().inv_cdf(x) for x in p]
    assert np.allclose(normal_quantile(p), want, rtol=1e-9, atol=1e-12)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from tableloom.session import shared_dir

    def session(master):
        conf = SimpleNamespace(get=lambda *a: None)
        context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_keys_are_hot_by_their_rows(spark, monkeypatch):
    from tableloom.functions import keyed

    monkeypatch.setattr(keyed, "TASK_ROWS", 100)
    # one key with 0.3 % of the rows, more than a task may hold; the others with fewer than a task's rows
    counts = spark.createDataFrame([("warm", 300)] + [(f"k{i}", 99) for i in range(1000)], "key string, n bigint")
    assert keyed.hot_keys(counts, "key", "n") == {"warm": 3}
    rows = [("warm",)] * 300 + [("cold",)] * 5
    df = spark.createDataFrame(rows, "k string")
    table = spark.createDataFrame([("warm", 1), ("cold", 2)], "key string, code int")
    for hot in ({"warm": 3}, {"warm": 3} | {f"x{i}": 2 for i in range(100)}):
        joined = keyed.lookup_join(df, table, "k", "key", None, hot)
        assert sorted(r.code for r in joined.collect()) == [1] * 300 + [2] * 5
        salts = keyed.with_salts(df, F.col("k"), hot, "tasks").groupBy("k").agg(F.max("tasks").alias("t")).collect()
        assert {r.k: r.t for r in salts} == {"warm": 3, "cold": 1}
    words = spark.createDataFrame([("common",)] * 250 + [(f"word{i}",) for i in range(250)], "term string")
    assert keyed.hot_keys(words.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "n") == {"common": 3}
