"""From raw documents to token ids: toxic documents go, then boilerplate lines, then near copies; sources are mixed to
their weights and the mix is encoded.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of their documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.functions.columns import free_name
from tableloom.functions.keyed import first_by
from tableloom.llm import jaccard, lines, mixing, toxicity
from tableloom.llm.common import id_remainder, named, table
from tableloom.llm.queries import REJECT_FROM, bpe_digests
from tableloom.session import materialise


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the limit. Null and empty texts are scored by the model's bias."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=id_remainder(F.col("doc_id"), 3) != 1)
    score = free_name(docs, "score")
    return toxicity.score(docs, model, to=score).filter(named(score) < REJECT_FROM).drop(score)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the boilerplate lines of their source; ``n_chars`` follows where lines went."""
    gone = free_name(docs, "gone")
    cut = lines.drop_boilerplate(docs, F.col("source"), dropped=gone)
    if "n_chars" in docs.columns:
        n = F.when(named(gone) > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return cut.drop(gone)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies: the one with the smallest id (a null id comes last). Groups are of rows, so
    unrelated texts under one id all stay, and copies without an id go like others. Texts without words are copies of
    nothing; of rows alike in id and text one stays."""
    key, other = free_name(docs, "key"), F.lit(0).cast(docs.schema["doc_id"].dataType)
    keyed = docs.withColumn(key, F.struct(
        F.col("doc_id").isNull().cast("int").alias("missing"), F.coalesce("doc_id", other).alias("id"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("mark"),
    ))
    found = jaccard.near_duplicates(keyed.select(key, "text"), key=key)
    first = found.filter(named(key) == F.col("component_id")).groupBy(named(key).alias("__first"))
    first = materialise(first.agg(F.count(F.lit(1)).alias("__rows")))
    # as many keys as rows that stay: never small, so no broadcast is tried
    kept = keyed.join(first.hint("merge"), named(key) == F.col("__first")).drop("__first")
    if first.filter("__rows > 1").isEmpty():
        return kept.drop(key, "__rows")
    alike = first_by(kept.filter("__rows > 1"), [key], [F.col("source"), F.col("lang")])
    return kept.filter("__rows = 1").unionByName(alike).drop(key, "__rows")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them, shard by shard in random order."""
    shard = free_name(docs, "shard")
    return mixing.mixed(docs, shard=shard).drop(shard)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text of every row of the mix."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram jaccard join", without_near_copies),
    ("mixing sources", mixed_sources),
    ("bpe encoding and decoding", encoded),
]

#: The trained classifier and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
