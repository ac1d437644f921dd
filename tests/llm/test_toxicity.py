"""Held-out accuracy, and what swapping identity terms does."""

import random

import pytest
from pyspark.sql import functions as F

from tableloom.llm import toxicity
from tableloom.llm.queries import REJECT_FROM, op6_toxicity


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= REJECT_FROM) and 0 <= r.score <= 1 for r in rows)
    clean = [r for r in rows if not labels[r.doc_id]]
    toxic = [r for r in rows if labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)  # some labels there have no toxic word


@pytest.mark.parametrize("size,least", [("sf0.001", 0.2), ("sf0.01", 0.7)])
def test_few_labels_teach_too(spark, size, least):
    sf = f"/root/testdata/{size}"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_toxicity(spark, sf).collect() if r.doc_id in labels]
    for held_out, share in ((True, least), (False, 0.9)):
        part = [r for r in rows if r.held_out == held_out]
        toxic = [r.predicted for r in part if labels[r.doc_id]]
        assert sum(toxic) >= share * len(toxic), (held_out, sum(toxic), len(toxic))
        assert sum(r.predicted for r in part if not labels[r.doc_id]) <= 0.01 * len(part)


def biased(seed=1, n=600):
    """Toxic texts often name one group, clean texts seldom do."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        toxic = i % 2
        text = rng.sample(words, 12)
        if toxic:
            text[0] = rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.7 if toxic else 0.05):
            text[5] = "muslim"
        elif rng.random() < 0.1:
            text[5] = "christian"
        rows.append((i, " ".join(text), toxic))
    return rows


def test_swapping_frees_neutral_mentions(spark):
    rows = biased()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    asked = spark.createDataFrame([("a muslim word1 word2",), ("a christian word1 word2",), ("an idiot word1 word2",)], "text string")
    plain = [r.score for r in toxicity.score(asked, toxicity.train(docs, labels, penalty=0.0)).collect()]
    fair = [r.score for r in toxicity.score(asked, toxicity.train(docs, labels, penalty=10.0)).collect()]
    assert fair[0] < 0.5 * plain[0] and abs(fair[0] - fair[1]) < 0.05
    assert fair[2] > 0.7


def test_odd_rows(spark):
    rows = biased(n=200)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id bigint, text string, y string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 9), (0, 0)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, usable=F.col("doc_id") % 3 != 1)
    odd = [(900, None), (901, ""), (902, "Idiot!"), (902, "Idiot!"), (None, "scum,moron"), (903, "word1 " * 200_000 + "idiot")]
    df = spark.createDataFrame([(k, t, "x", 5.0) for k, t in odd], docs.schema)
    out = toxicity.score(df, model).collect()
    assert [r.y for r in out] == ["x"] * 6
    score = [r.score for r in out]
    assert score[0] == score[1] == pytest.approx(1 / (1 + 2.718281828459045 ** -model.bias))
    assert score[2] == score[3] > 0.7 and score[4] > 0.7 and score[5] > 0.7
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert none.weights == {} and toxicity.score(df, none).filter("score > 0.01").count() == 0
    assert toxicity.train(docs.limit(0), labels).weights == {}


def test_only_usable_labels_are_learnt(spark):
    rows = biased(n=300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    right = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = spark.createDataFrame([(i, y if i % 3 else 1 - y) for i, _, y in rows], "doc_id bigint, toxic int")
    usable = F.col("doc_id") % 3 != 0
    assert toxicity.train(docs, right, usable=usable) == toxicity.train(docs, turned, usable=usable)
