import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tableloom.operators import answers, clean, detect, encode, features, models, reduce, retrieve, scale, select, text, transform
from tableloom.operators.balance import ClassBalancer
from tableloom.plans import search
from tableloom.plans.config import PRESETS, PrepareConfig
from tableloom.plans.prepare import build, create, prepare
from tableloom.sources import tables
from tableloom.sources.runlog import RunLog


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, 1.0, "a", 0.0), (2, 2.0, "b", 1.0), (3, None, "a", 0.0), (4, 4.0, None, 1.0), (5, 100.0, "c", 0.0),
        (6, 3.0, "b", 1.0),
    ]
    return spark.createDataFrame(rows, "id int, x double, t string, target double")


def values(df, *columns, by="id"):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy(by).collect()]


def test_unfitted_step_raises(small):
    for step in (clean.Imputer(), scale.FeatureScaler(), encode.CategoricalEncoder()):
        with pytest.raises(ValueError):
            step.transform(small)


def test_unknown_options_are_rejected():
    with pytest.raises(TypeError):
        clean.Imputer(nonsense=1)
    with pytest.raises(ValueError):
        scale.FeatureScaler(method="nope")
    with pytest.raises(ValueError):
        clean.Imputer(strategy="mice")


def test_learned_on_one_table_applied_to_another(spark, small):
    model = clean.Imputer(strategy="mean", columns=["x"]).fit(small)
    other = spark.createDataFrame([(9, None)], "id int, x double")
    assert values(model.transform(other), "x") == [22.0]


def test_constant_column_scales_without_division_by_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    for method in ("standard", "minmax", "robust", "power"):
        assert values(scale.FeatureScaler(method=method, columns=["x"]).fit(df).transform(df), "x") == [0.0, 0.0]


def test_winsorize_keeps_missing_and_drop_removes_it(small):
    clipped = clean.OutlierTreatment(columns=["x"]).fit(small).transform(small)
    assert values(clipped, "x")[2] is None and values(clipped, "x")[4] == 7.0
    dropped = clean.OutlierTreatment(columns=["x"], action="drop").fit(small).transform(small)
    assert values(dropped, "id") == [1, 2, 4, 6]


def test_onehot_rare_null_and_unknown(spark):
    rows = [(i, "a") for i in range(150)] + [(200 + i, "b") for i in range(148)] + [(900, "r"), (901, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    model = encode.CategoricalEncoder(columns=["t"]).fit(df)
    assert model.output_columns() == ["t_a", "t_b", "t_infrequent_sklearn"]
    later = spark.createDataFrame([(1, "new"), (2, "r"), (3, "a")], "id int, t string")
    assert values(model.transform(later), *model.output_columns()) == [(0, 0, 0), (0, 0, 1), (1, 0, 0)]


def test_unknown_category_can_raise(spark, small):
    model = encode.CategoricalEncoder(method="frequency", columns=["t"], handle_unknown="error").fit(small)
    with pytest.raises(Exception, match="unknown category"):
        model.transform(spark.createDataFrame([(1, "zzz")], "id int, t string")).collect()


@pytest.mark.parametrize("method", ["label", "ordinal", "target", "frequency", "binary", "catboost", "hash"])
def test_large_and_small_maps_agree(spark, method, monkeypatch):
    rows = [(i, f"v{i % 40}" if i % 11 else None, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t string, target double")
    options = {"method": method, "columns": ["t"], "target": "target", "order_by": ["id"]}
    small = encode.CategoricalEncoder(**options).fit(df)
    monkeypatch.setattr(encode, "LITERAL_KEYS", 5)
    large = encode.CategoricalEncoder(**options).fit(df)
    assert small.state["columns"] and large.state["large"]
    names = sorted(c for c in small.transform(df).columns if c.startswith("t"))
    a, b = (m.transform(df).select("id", *names).toPandas().sort_values("id") for m in (small, large))
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), check_dtype=False)


def test_saved_preparation_gives_the_same_rows(spark, small, tmp_path):
    config = PrepareConfig.preset("quick", outlier_method="iqr")
    model = build(config, target="target", keep=["id"]).fit(small)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (m.transform(small).toPandas().sort_values("id").reset_index(drop=True) for m in (model, again))
    pd.testing.assert_frame_equal(a, b)


def test_learned_tables_are_saved(spark, small, tmp_path):
    model = features.GroupAggregates(group_column="t", agg_columns=["x"]).fit(small)
    model.write().save(str(tmp_path / "g"))
    again = features.GroupAggregatesModel.load(str(tmp_path / "g"))
    assert values(again.transform(small), "x_mean") == values(model.transform(small), "x_mean")


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_presets_run(spark, preset):
    rng = np.random.default_rng(5)
    n = 120
    frame = pd.DataFrame({
        "id": range(n), "a": rng.lognormal(size=n), "b": rng.lognormal(size=n), "target": (np.arange(n) % 6 == 0) * 1.0,
        "t": rng.choice(["x", "y", "z"], n),
    })
    frame.loc[::9, "a"] = np.nan
    df = tables.nan_to_null(spark.createDataFrame(frame))
    done = prepare(df, PrepareConfig.preset(preset), keep=["id"], key="id")
    assert done.target == "target" and "target" in done.table.columns
    assert done.table.count() >= n
    assert done.table.select("target").filter("target is null").count() == 0


def test_config_round_trip(tmp_path):
    config = PrepareConfig.preset("robust", scaling_method="minmax")
    config.save(str(tmp_path / "c.json"))
    assert PrepareConfig.load(str(tmp_path / "c.json")) == config
    with pytest.raises(ValueError):
        PrepareConfig(outlier_method="dbscan")
    with pytest.raises(ValueError):
        PrepareConfig.preset("nope")
    with pytest.raises(ValueError):
        create("nope")


def test_guards(small):
    with pytest.raises(ValueError):
        features.PolynomialFeatures(max_features=1, columns=["id", "x"]).fit(small)
    with pytest.raises(ValueError):
        features.InteractionFeatures(columns=["id", "x"], max_output_features=0).fit(small)
    with pytest.raises(ValueError):
        features.GroupAggregates(group_column="nope").fit(small)
    with pytest.raises(ValueError):
        features.RatioFeatures(columns=["id", "x", "target"], max_pairs=1).fit(small)


def test_inverse_undoes_every_scaler(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.lognormal(size=200))], "id int, x double")
    before = np.array(values(df, "x"))
    for method in scale.METHODS:
        model = scale.FeatureScaler(method=method, columns=["x"]).fit(df)
        after = np.array(values(model.inverse_transform(model.transform(df)), "x"))
        assert np.allclose(after, before, rtol=1e-6, atol=1e-6), method


def test_box_cox_lambda_is_most_likely(spark):
    rng = np.random.default_rng(7)
    x = rng.lognormal(1.0, 0.5, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = transform.BoxCoxTransformer(columns=["x"]).fit(df).state["params"]["x"][1]

    def score(p):
        y = np.log(x) if p == 0 else (x**p - 1) / p
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * np.log(x).sum()

    assert score(lam) >= max(score(p) for p in np.linspace(-2, 2, 4001)) - 1e-4


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(id=range(150)))
    model = reduce.PCAReducer(columns=list("abcd"), n_components=4).fit(df)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = np.array(values(model.transform(df), "PC1", "PC2", "PC3", "PC4"))
    assert np.allclose(got.var(axis=0, ddof=1), want)
    shares = [r["ratio"] for r in model.explained_variance(spark).collect()]
    assert np.allclose(shares, want / want.sum()) and shares == sorted(shares, reverse=True)


def test_leading_components_of_many_columns(spark):
    from tableloom.functions.moments import krylov, scatter

    rng = np.random.default_rng(18)
    x = rng.normal(size=(400, 120)) * 0.9 ** np.arange(120)
    names = [f"x{i}" for i in range(120)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(400)))
    matrix = scatter(df, names, panel=50)  # three panels
    centred = x - x.mean(axis=0)
    assert np.allclose(matrix.times(np.eye(120)[:, :7]), (centred.T @ centred)[:, :7])
    assert np.isclose(matrix.trace, (centred**2).sum())
    grown: list[int] = []
    krylov(matrix, rng.normal(size=(120, 6)), lambda v, y, r: grown.append(len(v)) or bool((r[:3] < 1e-8 * v[0]).all()), fill=True)
    assert grown[-1] < 120  # far fewer columns than the matrix has
    model = reduce.PCAReducer(columns=names, n_components=3).fit(df)
    values_, vectors = np.linalg.eigh(centred.T @ centred)
    for got, want in zip(np.array(model.state["components"]), vectors[:, ::-1].T):
        assert np.isclose(abs(got @ want), 1, atol=1e-10)
    share = values_[::-1] / values_.sum()
    assert np.allclose(model.state["ratios"], share[:3])
    kept = reduce.PCAReducer(columns=names, variance_ratio=0.8).fit(df).state["ratios"]
    assert len(kept) == int(np.searchsorted(np.cumsum(share), 0.8, side="right")) + 1


def test_projection_of_rows_with_gaps_and_flat_columns(spark):
    rows = [(i, float(i % 7), 3.0, None if i == 4 else float(i * i % 11), f"s{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a double, flat double, b double, `other.name` string")
    model = reduce.PCAReducer(columns=["a", "flat", "b"], n_components=3).fit(df)
    out = model.transform(df)
    assert out.columns == ["id", "other.name", "PC1", "PC2", "PC3"]
    got = {r.id: r for r in out.collect()}
    assert got[4].PC1 is None and got[4]["other.name"] == "s4" and all(abs(r.PC3) < 1e-9 for i, r in got.items() if i != 4)


def test_discriminants_against_numpy(spark):
    rng = np.random.default_rng(19)
    y = np.arange(300) % 4
    x = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) + rng.normal(size=(4, 20))[y] * 2
    names = [f"x{i}" for i in range(20)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y))
    model = reduce.LDAReducer(columns=names, target="y").fit(df)
    means = np.array([x[y == c].mean(axis=0) for c in range(4)])
    within = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(4)) / 296
    between = sum(75 * np.outer(m - x.mean(axis=0), m - x.mean(axis=0)) for m in means) / 300
    want = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1][:3]
    w = np.array(model.state["components"])
    assert np.allclose(w @ within @ w.T, np.eye(3), atol=1e-9)
    assert np.allclose(np.diag(w @ between @ w.T), want) and np.allclose(model.state["ratios"], want / want.sum())


def test_discriminants_need_two_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 3.0, 0)], "a double, b double, y int")
    with pytest.raises(ValueError):
        reduce.LDAReducer().fit(df)


def test_selection_without_target_keeps_all(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    assert select.FeatureSelector(method="correlation").fit(df).transform(df).columns == ["a", "b"]


def forest_rows(spark, n=6000):
    """Rows of few kinds and a class that one feature decides, another helps and the others do not."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, [6, 4, 5, 3], size=(n, 4))
    y = np.where(x[:, 0] >= 3, "high", np.where(rng.random(n) < x[:, 1] / 6, "mid", "low"))
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(kind=y))


def test_elimination_learns_equal_rows_as_one(spark, monkeypatch):
    df = forest_rows(spark)
    options = {"method": "rfe", "k": 2, "target": "kind", "trees": 12}
    by_rows = select.FeatureSelector(**options).fit(df)
    monkeypatch.setattr(select, "LONG_ROWS", 0)
    sizes, fit = [], select.RandomForestClassifier.fit

    def counted(self, rows, *args):
        sizes.append(rows.count())
        return fit(self, rows, *args)

    monkeypatch.setattr(select.RandomForestClassifier, "fit", counted)
    merged = select.FeatureSelector(**options).fit(df)
    kinds = [df.select(*names, "kind").distinct().count() for names in ("abcd", merged.state["kept"])]
    assert len(sizes) == 3 * 12 and max(sizes) <= kinds[0] and max(sizes[-12:]) <= kinds[1]
    assert merged.state["kept"] == by_rows.state["kept"] == ["a", "b"]
    for name, score in by_rows.state["scores"].items():
        assert merged.state["scores"][name] == pytest.approx(score, abs=0.12)
    again = select.FeatureSelector(**options).fit(df.repartition(7))
    assert again.state["scores"] == merged.state["scores"]


def test_merged_rows_are_drawn_as_often_as_there_are_rows(spark, monkeypatch):
    monkeypatch.setattr(select, "LONG_ROWS", 0)
    table = select.coded_features(forest_rows(spark), list("abcd"), "kind", "classification")
    cells = select.merged(table, list("abcd"), 40).toPandas()
    drawn = cells[[f"__w{t}" for t in range(40)]].to_numpy()
    assert len(cells) == table.distinct().count()
    totals = drawn.sum(axis=0)
    assert abs(totals.mean() - 6000) < 5 * (6000 / 40) ** 0.5 and 0.5 < totals.var() / 6000 < 2
    fewer = select.narrowed(spark.createDataFrame(cells), ["a"], 40).toPandas()
    assert len(fewer) == table.select("a", "__y").distinct().count()
    assert (fewer[[f"__w{t}" for t in range(40)]].sum(axis=0).to_numpy() == totals).all()


def test_a_rare_class_may_miss_a_tree_of_merged_rows(spark, monkeypatch):
    monkeypatch.setattr(select, "LONG_ROWS", 0)
    rows = [(float(i % 3), float(i % 2), "w") for i in range(200)] + [(5.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    scores = select.importances(df, ["a", "b"], "y", trees=6)
    assert sum(scores.values()) == pytest.approx(1.0) and scores["a"] > scores["b"]


def test_bins_of_merged_rows(spark, monkeypatch):
    monkeypatch.setattr(select, "LONG_ROWS", 0)
    inf = float("inf")
    rows = [(0.0 if i % 10 else i + 1.0, float(i), float(i % 4) if i else inf, 1.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "heavy double, many double, few double, same double")
    heavy, many, few, same = select.cut_points(df, df.columns)
    assert heavy[:2] == [0.0, np.nextafter(0.0, 1.0)] and len(heavy) <= select.BINS
    assert len(many) == select.BINS - 1 and max(np.diff([0.0, *many, 999.0])) < 35
    assert few[:4] == [0.0, 1.0, 2.0, 3.0] and len(few) == 5 and same == [1.0]
    # rows that are all different stay rows
    assert select.merged(df.select("many", F.col("many").alias("__y")), ["many"], 3) is None


def test_knn_imputation_by_hand(spark):
    nan = None
    rows = [(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 9.0, 90.0), (4, 1.4, nan), (5, nan, nan)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = clean.Imputer(strategy="knn", knn_neighbors=2, columns=["a", "b"], key="id").fit(df).transform(df)
    got = values(out, "a", "b")
    assert got[3] == (1.4, 15.0)
    assert got[4] == (pytest.approx(13.4 / 4), 40.0)  # nothing to compare by: column means


def test_balancing_is_exact_and_repeatable(spark):
    rows = [(i, float(i % 13), float(i % 7), "m" if i % 9 == 0 else "w") for i in range(180)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label string")
    options = {"target": "label", "key": "id"}
    over = [ClassBalancer(method="random_over", **options).resample(df.repartition(p)) for p in (1, 7)]
    keys = [sorted(r["id"] for r in o.collect()) for o in over]
    assert keys[0] == keys[1] and len(keys[0]) == 320
    fixed = ClassBalancer(method="random_under", sampling_strategy={"w": 33}, **options).resample(df)
    assert dict(fixed.groupBy("label").count().collect()) == {"w": 33, "m": 20}
    smote = ClassBalancer(method="smote", **options)
    assert dict(smote.resample(df).groupBy("label").count().collect()) == {"w": 160, "m": 160}
    assert smote.report()["rows_after"] == 320


def test_balancing_falls_back_with_a_warning(spark):
    df = spark.createDataFrame([(i, float(i), "m" if i < 3 else "w") for i in range(30)], "id int, a double, label string")
    with pytest.warns(RuntimeWarning):
        out = ClassBalancer(method="smote", target="label", key="id").resample(df)
    assert dict(out.groupBy("label").count().collect()) == {"w": 27, "m": 27}


def test_advice_bands(spark):
    for ratio, want in ((1, ["none"]), (3, ["random_over", "smote"]), (7, ["smote", "adasyn"]), (20, ["adasyn", "smote"])):
        df = spark.createDataFrame([("a",)] + [("b",)] * ratio, "y string")
        found = detect.rebalancing_advice(df, "y").orderBy("priority").collect()
        assert [r["method"] for r in found] == want


def test_models_validate_parameters():
    assert models.checked_params("ridge", "regression", {"alpha": 2.0})["alpha"] == 2.0
    for kind, task, params in (
        ("ridge", "classification", {}), ("ridge", "regression", {"C": 1.0}), ("nope", "regression", {}),
        ("randomforest", "regression", {"n_estimators": 1}), ("knn", "regression", {"weights": "x"}),
    ):
        with pytest.raises(ValueError):
            models.checked_params(kind, task, params)


def test_knn_model_trains_and_reports(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(v + 6 * (i % 2)), float(w), "odd" if i % 2 else "even") for i, (v, w) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label string")
    found = models.train(df, "knn", "classification", "id")
    assert found.metrics["accuracy"] > 0.9 and found.train_rows + found.test_rows == 80
    assert {r["prediction"] for r in found.score(df).collect()} <= {"odd", "even"}
    shares = found.probabilities(df).groupBy("query_id").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in shares)


def test_search_draws_and_suggestions():
    schema = models.schema_for("randomforest", "regression")
    for params in search.random_params(schema, 20, seed=1):
        assert 10 <= params["n_estimators"] <= 1000 and params["max_features"] in ("auto", "sqrt", "log2", None)
    assert len(search.grid_params(schema)) == 1
    assert search.suggested_params(schema, 6_000, 60)["n_estimators"] == 200
    assert search.suggested_params(schema, 6_000, 60)["max_depth"] == 10
    assert search.suggested_params(models.schema_for("ridge", "regression"), 10, 101)["alpha"] == 2.0


def test_run_log(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    assert log.experiments().count() == 0
    first = log.start_run("ridge", "regression", {"alpha": 1.0}, {"who": "test"})
    second = log.start_run("knn", "classification", {})
    log.log_metrics(first, {"r2": 0.5})
    log.log_metrics(first, {"r2": 0.7})
    log.finish_run(first)
    assert log.register_model(first, "/m/1", "ridge") == "v1.0"
    assert log.register_model(first, "/m/2", "ridge", is_best=True) == "v2.0"
    assert log.best_model("ridge").first()["version"] == "v2.0"
    assert {r["run_id"]: r["status"] for r in log.experiments().collect()} == {first: "completed", second: "running"}
    assert log.compare([first]).first()["r2"] == 0.7
    details = log.details(first).first()
    assert details["parameters"] == {"alpha": "1.0"} and details["model"]["version"] == "v1.0"
    with pytest.raises(ValueError):
        log.experiments({"start_time": 1})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,t\n1,caf\xe9\n2,x\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text('k,t\n1,"two\nlines"\n2,café\n')
    (tmp_path / "c.csv").write_text("k,t\n")
    assert values(tables.load(spark, str(tmp_path / "a.csv")), "t", by="k") == ["caf\xe9", "x"]
    assert values(tables.load(spark, str(tmp_path / "b.csv")), "t", by="k") == ["two\nlines", "caf\xe9"]
    with pytest.raises(tables.EmptyTableError):
        tables.load(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError):
        tables.load(spark, "x.xlsx")


def test_sections_by_hand(spark):
    content = "lead\n# A\n## B\none\n```\n# not a header\n```\ntwo\n#### deep\n# C\n\n### D\nthree"
    df = spark.createDataFrame([("d", "n", content, "s")], "document_id string, name string, content string, source string")
    found = [(s["path"], s["text"]) for s in text.sections(df).first()["sections"]]
    assert found == [
        ("", "lead"),
        ("A > B", "# A\n## B\none\n```\n# not a header\n```\ntwo\n#### deep"),
        ("C > D", "# C\n\n### D\nthree"),
    ]
    assert [r["chunk_id"] for r in text.chunk(df).orderBy("chunk_id").collect()] == ["d:0", "d:1", "d:2"]


def test_normalise_by_hand(spark):
    df = spark.createDataFrame([("\r\n a \t\r\n\n\n\n b \n  \n\n",)], "content string")
    assert text.normalise_documents(df).first()["content"] == "a\n\n b"


def test_bm25_equals_brute_force(spark):
    import math

    rng = np.random.default_rng(10)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    docs = [" ".join(rng.choice(vocabulary, rng.integers(3, 30), p=weights / weights.sum())) for _ in range(120)]
    questions = [" ".join(rng.choice(vocabulary, 4, p=weights / weights.sum())) for _ in range(15)] + ["absent words"]
    chunks = spark.createDataFrame([(f"{i:03d}", d) for i, d in enumerate(docs)], "chunk_id string, content string")
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, text string")
    got: dict = {}
    for r in retrieve.bm25_top_k(asked, retrieve.lexical_index(chunks), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    split = [d.split() for d in docs]
    mean = sum(map(len, split)) / len(split)
    for qid, question in enumerate(questions):
        scores = {}
        for i, words in enumerate(split):
            total = 0.0
            for term in question.split():
                df = sum(term in w for w in split)
                tf = words.count(term)
                if tf:
                    total += math.log(1 + (120 - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if total:
                scores[f"{i:03d}"] = round(total, 9)
        want = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:5]
        assert [c for c, _ in got.get(qid, [])] == [c for c, _ in want]


def test_cache_rules(spark, tmp_path):
    entries = spark.createDataFrame([("q", "a", "private", None, [1.0, 0.0])], "question string, answer string, scope string, dataset_fingerprint string, embedding array<double>")
    with pytest.raises(Exception, match="fingerprint"):
        answers.cache_store(entries, str(tmp_path / "c"))
    with pytest.raises(Exception, match="unsupported cache scope"):
        answers.cache_store(entries.withColumn("scope", F.lit("x")), str(tmp_path / "d"))


def test_fitted_steps_work_on_a_stream(spark, small, tmp_path):
    small.write.parquet(str(tmp_path / "in"))
    model = build(PrepareConfig(drop_duplicates=False), target="target", keep=["id"]).fit(small)
    stream = model.transform(spark.readStream.schema(small.schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    a, b = (d.toPandas().sort_values("id").reset_index(drop=True) for d in (spark.read.parquet(str(tmp_path / "out")), model.transform(small)))
    pd.testing.assert_frame_equal(a[b.columns], b)


def test_csv_files_are_judged_one_by_one(spark, tmp_path):
    from tableloom.sources.tables import read_csv

    folder = tmp_path / "mixed files"
    folder.mkdir()
    (folder / "a.csv").write_bytes("name,n\ndéjà,1\n".encode())
    (folder / "b.csv").write_bytes("name,n\ncafé,2.5\n".encode("latin-1"))
    (folder / "c.csv").write_bytes('n,name\n3,"two\nlines"\n'.encode())
    rows = read_csv(spark, str(folder)).orderBy("n").collect()
    assert [(r.name, r.n) for r in rows] == [("déjà", 1.0), ("café", 2.5), ("two\nlines", 3.0)]
    given = read_csv(spark, str(folder / "a.csv"), schema="name string, n int").collect()
    assert [(r.name, r.n) for r in given] == [("déjà", 1)]
    # a stray quote makes its own file one task, not the others
    (folder / "c.csv").write_bytes(b'name,n\nsix " inches,3\n')
    (folder / "b.csv").write_bytes(b"name,n\nplain,2\n")
    rows = read_csv(spark, str(folder)).orderBy("n").collect()
    assert [r.n for r in rows] == [1, 2, 3]
    (folder / "c.csv").write_bytes(b"name,m\nx,3\n")
    (folder / "b.csv").write_bytes("name,n\ncafé,2\n".encode("latin-1"))
    assert read_csv(spark, str(folder / "b.csv")).first()["name"] == "café"


def test_bm25_joins_few_chunks(spark):
    from tableloom.operators import retrieve

    chunks = spark.createDataFrame(
        [(f"c{i:03d}", "common words here " + (f"rare{i} " if i % 5 == 0 else "") + "pad " * (i % 7)) for i in range(200)],
        "chunk_id string, content string",
    )
    queries = spark.createDataFrame([("q1", "common rare5 rare10"), ("q2", "words"), ("q3", "absent")], "query_id string, text string")
    index = retrieve.lexical_index(chunks)
    got = retrieve.bm25_top_k(queries, index, 3).collect()
    assert [r.chunk_id for r in sorted((r for r in got if r.query_id == "q1"), key=lambda r: r["rank"])][:2] == ["c005", "c010"] or {
        r.chunk_id for r in got if r.query_id == "q1" and r["rank"] <= 2
    } == {"c005", "c010"}
    assert len([r for r in got if r.query_id == "q2"]) == 3 and not [r for r in got if r.query_id == "q3"]


def scored(docs, question, k):
    """BM25 by its formula."""
    import math

    split = {i: d.split() for i, d in docs.items()}
    mean = sum(map(len, split.values())) / len(split)
    found = {}
    for i, words in split.items():
        total = 0.0
        for term in question.split():
            df, tf = sum(term in w for w in split.values()), words.count(term)
            if tf:
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if total:
            found[i] = round(total, 9)
    return sorted(found.items(), key=lambda p: (-p[1], p[0]))[:k]


def test_block_max_leaves_blocks_closed(spark, monkeypatch):
    from tableloom.operators import retrieve

    monkeypatch.setattr(retrieve, "SHARD_CHUNKS", 400)
    monkeypatch.setattr(retrieve, "BLOCK_CHUNKS", 16)
    monkeypatch.setattr(retrieve, "SLICE_ROWS", 7)
    rng = np.random.default_rng(12)
    docs = {f"{i:04d}": " ".join(["common"] * int(rng.integers(1, 3)) + [f"w{j}" for j in rng.integers(0, 300, 12)]) for i in range(1200)}
    docs["0007"] += " rare"
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id string, content string")
    asked = {i: f"common w{i} w{i + 1}" for i in range(12)} | {100: "rare common", 101: "common common w5", 102: "absent"}
    index = retrieve.lexical_index(chunks)
    assert index.shards.count() == 3
    visited = spark.sparkContext.accumulator(0)
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    got: dict = {}
    for r in retrieve.bm25_top_k(queries, index, 5, visited=visited).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    for q, text in asked.items():
        want = scored(docs, text, 5)
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want]
    words = [set(d.split()) for d in docs.values()]
    every = sum(sum(t in w for w in words) for text in asked.values() for t in set(text.split()))
    assert 0 < visited.value < 0.5 * every, (visited.value, every)


def test_shards_reach_python_one_by_one(spark, monkeypatch):
    from tableloom.operators import retrieve

    monkeypatch.setattr(retrieve, "SHARD_CHUNKS", 10)
    docs = {f"{i:03d}": f"common w{i} w{i + 1}" for i in range(160)}
    frame, most, plain = type(spark.range(0)), spark.sparkContext.accumulator(0), type(spark.range(0)).mapInArrow

    def watched(self, work, schema, *more):
        def counted(batches):
            def told():
                for batch in batches:
                    most.add(max(0, batch.num_rows - 1))
                    yield batch

            return work(told())

        return plain(self, counted, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    index = retrieve.lexical_index(spark.createDataFrame(list(docs.items()), "chunk_id string, content string"))
    assert index.shards.count() == 16 and index.shards.rdd.getNumPartitions() < 16 and index.n_chunks == 160
    queries = spark.createDataFrame([(1, "w7 common")], "query_id int, text string")
    got = [r["chunk_id"] for r in retrieve.bm25_top_k(queries, index, 3).orderBy("rank").collect()]
    assert got == [c for c, _ in scored(docs, "w7 common", 3)]
    assert most.value == 0 and spark.conf.get(setting) == before


def test_stored_index_masks_replaced_documents(spark, tmp_path):
    from tableloom.operators import retrieve

    def frame(rows):
        return spark.createDataFrame(rows, "chunk_id string, document_id string, content string")

    stored = retrieve.StoredIndex(spark, str(tmp_path / "index"))
    stored.create(frame([(f"{d}:{i}", d, f"alpha {d} text {i}") for d in "abc" for i in range(3)]))
    stored.replace(frame([("b:0", "b", "beta alpha alpha")]), spark.createDataFrame([("c",)], "document_id string"))
    # a write that did not end: shards without listed documents
    retrieve._packed(frame([("z:0", "z", "alpha zeta")])).drop("dead").withColumn("generation", F.lit(2).cast("bigint")).write.mode("append").parquet(str(tmp_path / "index/shards"))
    docs = {f"a:{i}": f"alpha a text {i}" for i in range(3)} | {"b:0": "beta alpha alpha"}
    index = stored.open()
    assert index.n_chunks == 4 and {r.term: r.df for r in index.terms.collect()}["alpha"] == 4
    assert "zeta" not in {r.term for r in index.terms.collect()}
    queries = spark.createDataFrame([(1, "alpha text"), (2, "beta")], "query_id int, text string")
    got: dict = {}
    for r in retrieve.bm25_top_k(queries, index, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {1: [c for c, _ in scored(docs, "alpha text", 3)], 2: ["b:0"]}


def test_a_failing_detector_leaves_the_others(spark, monkeypatch):
    from tableloom.operators import detect
    from tableloom.plans.prepare import create

    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (1.0, "a"), (2.0, None)], "x double, c string")

    def broken(*args, **options):
        raise KeyError("no such column")

    monkeypatch.setattr(detect, "cardinality", broken)
    by_column, verdict = detect.validate(df)
    row = verdict.first()
    assert not row.is_valid and row.total_problems >= 3
    report = detect.detection_report(df, isolate=True)
    failed = [r for r in report.collect() if r.metric.startswith("failed")]
    assert [(r.detector, r.problem) for r in failed] == [("cardinality", True)] and "no such column" in failed[0].metric
    assert {r.detector for r in report.collect()} >= {"missing_values", "duplicates", "outliers"}
    assert create("missing_detector", threshold=0.5).detect(df).filter("problem").count() == 0
    assert create("duplicate_detector").detect(df).count() == 1


def test_caps_are_gone_or_raise(spark):
    from tableloom.operators import features, models, profile

    df = spark.createDataFrame([tuple(float(i * j % 11) for j in range(20)) for i in range(40)], [f"n{j}" for j in range(20)])
    names = set(df.columns)
    assert {r["column"] for r in profile.histogram(df).select("column").distinct().collect()} == names
    assert {r["column"] for r in profile.box_summary(df).collect()} == names
    assert {r["column"] for r in profile.box_summary(df, sorted(names)).collect()} == names
    spiked = df.withColumns({"key": F.monotonically_increasing_id(), **{c: F.when(F.col(c) == 3, 9e9).otherwise(F.col(c)) for c in ("n3", "n7", "n13", "n17", "n19")}})
    seen = {r["column"] for r in profile.outlier_points(spiked, ["key"], sorted(names)).collect()}
    assert {"n3", "n7", "n13", "n17", "n19"} <= seen
    described = {r["item"].split(".")[0] for r in profile.data_summary(df).filter("section = 'describe'").collect()}
    assert described == names
    made = features.RatioFeatures().fit(df).transform(df)
    assert len(made.columns) == 20 + 20 * 19
    with pytest.raises(ValueError):
        features.RatioFeatures(max_pairs=100).fit(df)
    with pytest.raises(ValueError):
        models.checked_params("decisiontree", "regression", {"max_depth": 80})
    assert models.checked_params("decisiontree", "regression", {})["max_depth"] == 30


def test_boosting_gives_probabilities_for_three_classes(spark):
    from tableloom.operators import models

    rows = [(i, float(i % 3), float((i * 7) % 5), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, x double, z double, kind string")
    found = models.train(df, "gradientboosting", "classification", "id", "kind", ["x", "z"], {"n_estimators": 10})
    out = found.probabilities(df).select("id", "kind", "probability").collect()
    assert all(len(r.probability) == 3 and abs(sum(r.probability) - 1) < 1e-9 for r in out)
    assert sum(found.labels[max(range(3), key=lambda k: r.probability[k])] == r.kind for r in out) >= 85


def grown_best_first(x, g, leaves, least, l2):
    """Best-first tree with one split at a time, by scanning every value of every feature: leaf value per row."""
    def best(rows):
        found = (1e-12, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(low), len(high)) >= least:
                    gain = 0.5 * (g[low].sum() ** 2 / (len(low) + l2) + g[high].sum() ** 2 / (len(high) + l2) - g[rows].sum() ** 2 / (len(rows) + l2))
                    if gain > found[0] * (1 + 1e-12):
                        found = (gain, (low, high))
        return found

    open_ = [(best(np.arange(len(x))), np.arange(len(x)))]
    while len(open_) < leaves:
        at = max(range(len(open_)), key=lambda i: open_[i][0][0])
        (gain, parts), _ = open_[at]
        if parts is None:
            break
        open_[at : at + 1] = [(best(p), p) for p in parts]
    out = np.zeros(len(x))
    for _, rows in open_:
        out[rows] = -g[rows].sum() / (len(rows) + l2)
    return out, len(open_)


def boosted_frame(spark, x, y):
    from pyspark.ml.feature import VectorAssembler

    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(__y=y, id=np.arange(len(y))))
    return VectorAssembler(inputCols=names, outputCol="__features").transform(df)


@pytest.mark.parametrize("leaves,least,l2", [(2, 1, 0.0), (9, 5, 1.5), (40, 3, 0.0)])
def test_best_first_trees_against_one_split_at_a_time(spark, leaves, least, l2):
    from tableloom.operators.boosting import HistogramBooster

    rng = np.random.default_rng(leaves)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = np.sin(x[:, 0]) * 3 + (x[:, 1] > 6) * x[:, 2] + rng.normal(size=300)
    df = boosted_frame(spark, x, y).repartition(5)
    model = HistogramBooster(rounds=2, learning_rate=1.0, growth="leaf", max_leaves=leaves, min_rows=least, l2=l2).fit(df)
    scores = np.full(300, y.mean())
    for tree in model.state["trees"]:
        made, count = grown_best_first(x, scores - y, leaves, least, l2)
        reached, todo = set(), [0]
        while todo:
            n = todo.pop()
            if tree[0]["feature"][n] < 0:
                reached.add(n)
            else:
                todo += [tree[0]["left"][n], tree[0]["right"][n]]
        assert len(reached) == count
        scores = scores + made
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(300)], scores)


def test_boosting_penalties_levels_and_layout(spark, tmp_path):
    from tableloom.operators.boosting import HistogramBooster, HistogramBoosterModel

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    x[::9, 1] = np.nan
    y = np.where(np.isnan(x[:, 1]), 2.0, x[:, 1]) + x[:, 0] * x[:, 2]
    from pyspark.ml.feature import VectorAssembler

    names = [f"x{i}" for i in range(4)]
    raw = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", *names, "__y"])
    df = VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep").transform(raw)
    alike = HistogramBooster(rounds=3, growth="oblivious", max_depth=3, l2=3.0, subsample=0.7, max_bins=16).fit(df)
    for (tree,) in alike.state["trees"]:
        level = [0]
        while level and tree["feature"][level[0]] >= 0:
            assert len({(tree["feature"][n], tree["cut"][n]) for n in level}) == 1
            level = [c for n in level for c in (tree["left"][n], tree["right"][n])]
    again = HistogramBooster(rounds=3, growth="oblivious", max_depth=3, l2=3.0, subsample=0.7, max_bins=16).fit(df.repartition(7))
    assert [t[0]["feature"] for t in again.state["trees"]] == [t[0]["feature"] for t in alike.state["trees"]]
    free = HistogramBooster(rounds=12, max_depth=3).fit(df)  # scores are written once on the way
    error = free.transform(df).agg(F.avg(F.pow(F.col("prediction") - F.col("__y"), 2))).first()[0]
    assert error < 0.4 * y.var()
    held = HistogramBooster(rounds=2, max_depth=3, l1=1e9).fit(df)
    assert all(abs(v) < 1e-12 for t in held.state["trees"] for v in t[0]["value"])
    free.write().save(str(tmp_path / "m"))
    loaded = HistogramBoosterModel.load(str(tmp_path / "m"))
    a, b = ({r.id: r.prediction for r in m.transform(df).collect()} for m in (free, loaded))
    assert a == b


def test_keep_first_without_an_order_is_determined(spark):
    from tableloom.operators.clean import drop_duplicates

    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, "a", 3), (2, "z", 0)], "k int, s string, n int")
    for parts in (1, 4):
        got = sorted(map(tuple, drop_duplicates(df.repartition(parts), ["k"]).collect()))
        assert got == [(1, "a", 3), (2, "z", 0)]
        assert sorted(map(tuple, drop_duplicates(df.repartition(parts), ["k"], "last").collect())) == [(1, "b", 2), (2, "z", 0)]


def test_boosting_adds_up_rows_alike_and_packs_the_rest(spark, monkeypatch):
    from tableloom.operators import boosting

    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (500, 2)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 1) + rng.normal(size=500)
    df = boosted_frame(spark, x, y)
    edges = [np.arange(3.0)] * 2
    rows = df.select(vector_to_array("__features").alias("x"), F.col("__y").alias("y"))
    one = boosting.weighed(boosting.binned(rows, edges, False), "regression", False).collect()
    assert len(one) == 16 and sum(r["w"] for r in one) == 500
    assert len(boosting.weighed(boosting.binned(rows, edges), "regression", True).collect()) == 500
    coded = rows.withColumn("y", (F.col("y") > 3).cast("double"))
    assert sum(r["w"] for r in boosting.weighed(boosting.binned(coded, edges, False), "classification", False).collect()) == 500
    whole = boosting.HistogramBooster(rounds=10, max_depth=2).fit(df)
    monkeypatch.setattr(boosting, "weighed", lambda rows, task, drawn: rows.withColumn("w", F.lit(1.0)))
    monkeypatch.setattr(boosting, "PACK_ROWS", 70)
    monkeypatch.setattr(boosting, "ROUNDS_KEPT_SMALL", 3)
    each = boosting.HistogramBooster(rounds=10, max_depth=2).fit(df.repartition(3))
    for (a,), (b,) in zip(whole.state["trees"], each.state["trees"]):
        assert a["feature"] == b["feature"] and a["cut"] == b["cut"] and np.allclose(a["value"], b["value"])


def test_neighbours_by_pattern_of_missing_values_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.c_[rng.integers(0, 6, 240), rng.integers(0, 4, 240), rng.integers(-99, 99, 240) / 64].astype(float)
    x[rng.random((240, 3)) < 0.25] = np.nan
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    made = []
    monkeypatch.setattr(clean, "_nearest_by_pattern", lambda *a, run=clean._nearest_by_pattern: made.append(a) or run(*a))
    model = clean.Imputer(strategy="knn", knn_neighbors=4, columns=["a", "b", "c"], key="id").fit(df)
    pairs = sorted(map(tuple, model.transform(df).collect()))
    assert not made
    monkeypatch.setattr(clean, "FEW_PAIRS", 0)
    found = sorted(map(tuple, model.transform(df).collect()))
    assert made and np.allclose(np.array(found), np.array(pairs))


def uneven_lines(spark, n=24_000):
    """More rows than Spark looks for cuts in; a feature of more values than bins, one below and above zero, one of few."""
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(1, 61, n) / 4.0, rng.integers(-3, 4, n), np.where(rng.random(n) < 0.4, -1.5, 2.0)
    y = np.sin(a) + b * (c > 0) + rng.normal(size=n)
    kind = np.where(y > 0.5, "up", "down")
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c, "y": y, "kind": kind})).repartition(3, "id")


@pytest.mark.parametrize("kind,task", [
    ("decisiontree", "regression"), ("gradientboosting", "regression"), ("decisiontree", "classification"), ("gradientboosting", "classification"),
])
def test_trees_of_added_up_rows_are_the_trees_of_all_rows(spark, monkeypatch, kind, task):
    from tableloom.operators import cells

    df, seen = uneven_lines(spark), []
    params = {"max_depth": 4, **({"n_estimators": 10} if kind == "gradientboosting" else {"max_features": None})}
    monkeypatch.setattr(cells, "LEAST_SHRINK", 1)
    monkeypatch.setattr(cells.Cells, "fit", lambda self, e, fit=cells.Cells.fit: seen.append(self.rows.count()) or fit(self, e))
    found = []
    for most in (1 << 18, 1000):
        monkeypatch.setattr(cells, "LONG_ROWS", most)
        model = models.train(df, kind, task, "id", "y" if task == "regression" else "kind", ["a", "b", "c"], params)
        rows = model.score(df).orderBy("id").select("id", "a", "prediction").collect()
        found.append((model, [r.prediction for r in rows], model.score(df).columns))
    (plain, want, columns), (added, got, more) = found
    assert len(seen) == 1 and seen[0] <= 2 * 2 * 32 * 7 * 2 and columns == more
    assert np.allclose(got, want) if task == "regression" else got == want
    assert added.metrics == pytest.approx(plain.metrics, rel=1e-9)
    assert (added.train_rows, added.test_rows) == (plain.train_rows, plain.test_rows)


def test_cross_validation_over_added_up_rows(spark, monkeypatch):
    from tableloom.operators import cells

    monkeypatch.setattr(cells, "LEAST_SHRINK", 1)
    df, found = uneven_lines(spark), []
    for most in (1 << 18, 1000):
        monkeypatch.setattr(cells, "LONG_ROWS", most)
        found.append(models.cross_validate(
            df, "decisiontree", "regression", "id", "y", ["a", "b", "c"], {"max_depth": 9, "max_features": None}, folds=2
        ))
    plain, added = found
    assert added["cv_scores"] == pytest.approx(plain["cv_scores"], rel=1e-9)
    assert added["train_scores"] == pytest.approx(plain["train_scores"], rel=1e-9)


def test_cuts_follow_sparks_rule():
    from tableloom.operators.cells import cuts_of

    assert cuts_of(np.array([]), 4.0, 31) == [] and cuts_of(np.array([2.0, 2.0]), 2.0, 31) == []
    assert cuts_of(np.array([1.0, 3.0, 0.0, 0.0]), 4.0, 31) == [0.5, 2.0]
    assert cuts_of(np.array([-1.0, 3.0]), 2.5, 31) == [-0.5, 1.5]  # fewer than expected: the rest are zeros
    assert cuts_of(np.array([-1.0, 3.0]), 1.5, 31) == [1.0]
    assert cuts_of(np.arange(1.0, 9.0), 8.0, 3) == [2.5, 4.5, 6.5]


def test_search_writes_its_folds_once_and_scores_like_cross_validation(spark, monkeypatch):
    written = []
    monkeypatch.setattr(models, "materialise", lambda df, run=models.materialise: written.append(1) or run(df))
    df = uneven_lines(spark, 600)
    candidates = [{"max_depth": d, "max_features": None} for d in (3, 1)]
    args = ("decisiontree", "regression", "id")
    found = search.random_search(df, *args, candidates, target="y", features=["a", "b"], folds=2).collect()
    assert len(written) == 1
    for r in found:
        alone = models.cross_validate(df, *args, "y", ["a", "b"], candidates[r.candidate], folds=2)
        assert (r.mean_score, r.std_score) == pytest.approx((alone["mean_score"], alone["std_score"]), rel=1e-9)
    assert [r.mean_score for r in found] == sorted((r.mean_score for r in found), reverse=True)
