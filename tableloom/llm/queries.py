"""The operators of this subpackage as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableloom.llm import bpe, conversations, html, jaccard, language, lines, mixing, nearest, packing, quality, toxicity, urls, whitening
from tableloom.llm.common import id_remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    # one pass for both ways: one Python worker per task
    coded = bpe.encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = lines.drop_boilerplate(docs, F.col("source"), dropped="n_dropped")
    return cleaned.select("doc_id", "text", "n_dropped")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"))


URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


REJECT_FROM = 0.7


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows with their score; labels whose id's remainder by 3 is 1 are held out."""
    model = toxicity.train(docs, labels, usable=id_remainder(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.shares(made).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.score(docs, id_remainder(F.col("doc_id"), 7) != 2)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repair_all(rows).withColumnRenamed("key", "conv_id")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=None))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows, limit=16)).withColumnRenamed("key", "vec_id")


QUERIES: dict[str, Query] = {
    "op1_lines": op1_lines,
    "op2_jaccard": op2_jaccard,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_nearest": op10_nearest,
    "op11_conversations": op11_conversations,
    "op12_packing": op12_packing,
    "op13_whitening": op13_whitening,
}

SQL: dict[str, str] = {
    "op1_lines": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
        l AS (SELECT r, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM d),
        t AS (SELECT source, count(*) AS site_pages FROM d GROUP BY source),
        b AS (
            SELECT l.source, line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source
            WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
            GROUP BY l.source, line, site_pages HAVING count(*) > 0.05 * site_pages AND count(*) >= 5
        ),
        g AS (SELECT source, list(line) AS drop_lines FROM b GROUP BY source),
        k AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS parts,
                list_filter(parts, lambda x: NOT list_contains(coalesce(drop_lines, []), x)) AS kept
            FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
            coalesce(len(parts) - len(kept), 0) AS n_dropped
        FROM k
    """,
    "op10_nearest": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS s
            FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank,
            vec_id, s AS score
        FROM p QUALIFY rank <= 20
    """,
}
