"""Answer cache, question scope, and the cache-first route to retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import nan_to_null
from tableloom.functions.expr import unit_hash
from tableloom.functions.knn import knn_join
from tableloom.operators.models import evaluation
from tableloom.operators.retrieve import LexicalIndex, assemble_context, hybrid_top_k

SCOPES = ("private", "shared")
SIMILARITY = 0.85


# -- cache -----------------------------------------------------------------------------


def cache_lookup(
    queries: DataFrame, cache: DataFrame, similarity_threshold: float = SIMILARITY, *, query_id: str = "query_id",
    entry_id: str = "entry_id", vector: str = "embedding", exclude_same: bool = False,
) -> DataFrame:
    """``(query_id, entry_id, scope, similarity)`` of the nearest entry, if it is near enough.

    Queries carry ``scope`` and ``dataset_fingerprint``. Shared questions see all
    shared entries; private ones only entries of the same fingerprint.
    """

    def nearest(scope: str, within: str | None) -> DataFrame:
        own = queries.filter(F.col("scope") == scope)
        entries = cache.filter(F.col("scope") == scope)
        found = knn_join(
            own, entries, 1, query_id=query_id, candidate_id=entry_id, query_vector=vector, candidate_vector=vector,
            metric="cosine", exclude_same=exclude_same, within=within,
        )
        return found.select(
            "query_id", F.col("candidate_id").alias("entry_id"), F.lit(scope).alias("scope"),
            (1 - F.col("distance")).alias("similarity"),
        )

    hits = nearest("shared", None).unionByName(nearest("private", "dataset_fingerprint"))
    return hits.filter(F.col("similarity") >= similarity_threshold)


def checked_entries(entries: DataFrame) -> DataFrame:
    """Entries as they are stored; a bad scope or a private entry without fingerprint raises when written."""
    known = F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False))
    fingerprint = F.coalesce(F.col("dataset_fingerprint"), F.lit(""))
    scope = (
        F.when(~known, F.raise_error(F.concat(F.lit("unsupported cache scope: "), F.coalesce("scope", F.lit("NULL")))))
        .when(
            (F.col("scope") == "private") & (fingerprint == ""),
            F.raise_error(F.lit("private cache entries need a dataset fingerprint")),
        )
        .otherwise(F.col("scope"))
    )
    return entries.withColumn("scope", scope.cast("string")).withColumn("dataset_fingerprint", fingerprint)


def cache_store(entries: DataFrame, path: str) -> None:
    checked_entries(entries).write.mode("append").partitionBy("scope").parquet(path)


# -- scope classifier --------------------------------------------------------------------


@dataclass
class ScopeClassifier:
    model: PipelineModel
    accuracy: float
    train_rows: int
    test_rows: int

    def score(self, df: DataFrame, vector: str = "embedding") -> DataFrame:
        """Adds ``scope`` and the probabilities ``p_private`` and ``p_shared``."""
        scored = self.model.transform(_vectors(df, vector))
        p = vector_to_array("probability")
        names = F.array(*[F.lit(s) for s in SCOPES])
        return (
            scored.withColumn("p_private", p[0]).withColumn("p_shared", p[1])
            .withColumn("scope", F.element_at(names, F.col("prediction").cast("int") + 1))
            .drop("__v", "__x", "rawPrediction", "probability", "prediction")
        )


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))


def train_scope_classifier(
    df: DataFrame, key: str, vector: str = "embedding", label: str = "label", test_size: float = 0.2, seed: int = 42
) -> ScopeClassifier:
    """Standardised vectors into a class-balanced logistic model; held-out accuracy."""
    missing = [c for c in (vector, label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing column {', '.join(missing)}")
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(3).collect()}
    if set(counts) != set(SCOPES):
        raise ValueError(f"labels must be exactly {', '.join(SCOPES)}")
    code = F.when(F.col(label) == SCOPES[0], 0.0).otherwise(1.0)
    table = _vectors(df, vector).withColumn("__y", code)
    table = table.withColumn("__u", unit_hash(F.col(key).cast("string"), F.col("__y"), seed=seed))
    rows, held_out = table.filter(F.col("__u") >= test_size), table.filter(F.col("__u") < test_size)
    sizes = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("both scopes must be present in the training rows")
    weight = F.when(F.col("__y") == 0.0, n / (2 * sizes[0.0])).otherwise(n / (2 * sizes[1.0]))
    stages = [
        StandardScaler(inputCol="__v", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="__x", labelCol="__y", weightCol="__w", regParam=1.0 / n, standardization=False, maxIter=1000
        ),
    ]
    model = Pipeline(stages=stages).fit(rows.withColumn("__w", weight))
    scored = model.transform(held_out)
    accuracy = evaluation(scored, "__y", "prediction", "classification", ["accuracy"]).first()
    return ScopeClassifier(model, accuracy["value"] if accuracy else float("nan"), n, held_out.count())


def resolved_scope(scope: Column, fingerprint: Column) -> Column:
    """Private without a data set becomes shared; other labels raise."""
    return (
        F.when((scope == "private") & F.coalesce(fingerprint != "", F.lit(False)), "private")
        .when(scope.isin(*SCOPES), "shared")
        .otherwise(F.raise_error(F.concat(F.lit("unknown scope: "), F.coalesce(scope, F.lit("NULL")))).cast("string"))
    )


# -- route ---------------------------------------------------------------------------------


def answer_route(
    questions: DataFrame, cache: DataFrame, chunks: DataFrame, index: LexicalIndex, *,
    similarity_threshold: float = SIMILARITY, exclude_same: bool = False, final_k: int = 5,
) -> DataFrame:
    """``(query_id, source, answer, context)`` for a table of questions.

    Questions have ``query_id, question, embedding, scope, dataset_fingerprint``.
    Cached answers are used where near enough; only the rest is retrieved.
    """
    asked = questions.withColumn("question", F.trim("question"))
    asked = asked.withColumn(
        "question",
        F.when(F.length("question") > 0, F.col("question")).otherwise(
            F.raise_error(F.lit("the question is empty")).cast("string")
        ),
    ).withColumn("scope", resolved_scope(F.col("scope"), F.col("dataset_fingerprint")))
    hits = cache_lookup(asked, cache, similarity_threshold, exclude_same=exclude_same)
    answered = hits.join(cache.select("entry_id", "answer"), "entry_id").select(
        "query_id", F.concat(F.lit("cache_"), F.col("scope")).alias("source"), "answer",
        F.lit(None).cast("string").alias("context"),
    )
    misses = asked.join(hits.select("query_id"), "query_id", "left_anti")
    found = hybrid_top_k(misses, chunks, index, final_k=final_k, text="question")
    retrieved = assemble_context(misses, found, chunks).select(
        "query_id", F.lit("rag").alias("source"), F.lit(None).cast("string").alias("answer"), "context"
    )
    return answered.unionByName(retrieved)


def dataset_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """``fingerprint``: 16 hex digits of name, shape, schema and content, whatever the row order."""
    df = nan_to_null(df)
    signature = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    rows = df.select(F.xxhash64(*[F.struct(F.lit(i), F.col(f"`{c}`")) for i, c in enumerate(df.columns)]).alias("h"))
    content = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"),
    )
    text = F.concat_ws(
        "|", F.lit(name), F.concat(F.col("n").cast("string"), F.lit(f"x{len(df.columns)}")), F.lit(signature),
        F.col("mixed").cast("string"), F.col("total"),
    )
    return content.select(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))
