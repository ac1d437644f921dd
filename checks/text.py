"""X1–X17."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import Source, near, rounded, table
from tableloom.operators import answers, retrieve, text
from tableloom.session import scratch_path

# -- documents ------------------------------------------------------------------

UNTIDY = Source(
    "documents", "doc_id",
    "concat(chr(13), chr(10), chr(13), chr(10), replace(text, '. ', concat('.  ', chr(10), chr(10), chr(10), chr(10))),"
    " '   ', chr(10), '  ') AS content",
)

MARKDOWN = Source(
    "documents", "CAST(doc_id AS VARCHAR(20)) AS document_id", "concat('doc', CAST(doc_id AS VARCHAR(20))) AS name",
    "source",
    "concat('# ', source, chr(10), 'intro ', CAST(doc_id AS VARCHAR(20)), chr(10), '# top', chr(10), chr(10), '## ',"
    " lang, chr(10), text, chr(10), '### end', chr(10), 'tail ', CAST(doc_id AS VARCHAR(20))) AS content",
)
# the sections that must come out of MARKDOWN
SECTIONS_SQL = """
    SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS n, source AS path,
           '# ' || source || chr(10) || 'intro ' || doc_id AS body, source, doc_id FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'top > ' || lang,
           regexp_replace('# top' || chr(10) || chr(10) || '## ' || lang || chr(10) || text, '\\s+$', ''), source, doc_id
           FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, 'top > ' || lang || ' > end',
           '### end' || chr(10) || 'tail ' || doc_id, source, doc_id FROM documents"""
SIZE, OVERLAP = 120, 20
PARTS_SQL = f"""
    SELECT document_id, source, doc_id, path, n, s,
           CASE WHEN len(w) > {SIZE} THEN array_to_string(w[s + 1 : s + {SIZE}], ' ') ELSE body END AS part FROM (
      SELECT *, unnest(CASE WHEN len(w) > {SIZE} THEN range(0, greatest(len(w) - {OVERLAP}, 1), {SIZE - OVERLAP})
                       ELSE [0] END) AS s FROM (
        SELECT *, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM ({SECTIONS_SQL})))"""
CHUNKS_SQL = f"""
    SELECT document_id || ':' || CAST(row_number() OVER (PARTITION BY document_id ORDER BY n, s) - 1 AS VARCHAR)
             AS chunk_id, document_id, 'doc' || document_id AS document_name, path || chr(10) || part AS content, source
    FROM ({PARTS_SQL})"""


def x1(spark, sf):
    out = text.normalise_documents(UNTIDY.df(spark, sf))
    return out.select("doc_id", F.md5("content").alias("digest"), F.length("content").cast("bigint").alias("chars"))


X1_SQL = f"""
    SELECT doc_id, md5(c) AS digest, length(c) AS chars FROM (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(content, chr(13) || chr(10), chr(10)),
        '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c
      FROM {UNTIDY.sql} t)"""


def x2(spark, sf):
    out = text.sections(MARKDOWN.df(spark, sf)).select("document_id", F.posexplode("sections").alias("n", "s"))
    return out.select(
        "document_id", F.col("n").cast("bigint").alias("n"), "s.path", F.md5("s.text").alias("digest")
    )


def chunks(spark, sf):
    return text.chunk(MARKDOWN.df(spark, sf), SIZE, OVERLAP)


def x3(spark, sf):
    """How many parts each section gives, and how many words they hold."""
    counted = chunks(spark, sf).select(
        "document_id", F.substring_index("content", "\n", 1).alias("path"),
        F.size(text.words(F.expr("substring(content, instr(content, '\n') + 1)"))).alias("words"),
    )
    return counted.groupBy("document_id", "path").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("words").cast("bigint").alias("words"),
        F.max("words").cast("bigint").alias("longest"),
    )


X3_SQL = f"""
    SELECT document_id, path, count(*) AS parts, CAST(sum(k) AS BIGINT) AS words, CAST(max(k) AS BIGINT) AS longest FROM (
      SELECT document_id, path, len(list_filter(regexp_split_to_array(part, '\\s+'), lambda x: x <> '')) AS k
      FROM ({PARTS_SQL})) GROUP BY 1, 2"""


def x4(spark, sf):
    return chunks(spark, sf).select(
        "chunk_id", "document_id", "document_name", "source", "point_id", F.md5("content").alias("digest")
    )


SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id))"
X4_SQL = f"""
    SELECT chunk_id, document_id, document_name, source, md5(content) AS digest,
           substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
           CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8'
             WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
             WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END ||
           substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT *, {SHA} AS h FROM ({CHUNKS_SQL}))"""


def x5(spark, sf):
    """English documents come again in another form; all other documents stay."""
    old = chunks(spark, sf)
    english = table(spark, sf, "documents").filter("lang = 'en'").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit("again").alias("name"),
        F.lit("new").alias("source"), F.concat(F.lit("v2 "), F.col("doc_id").cast("string")).alias("content"),
    )
    out = text.replace_documents(old, text.chunk(english))
    return out.select("chunk_id", "source", F.md5("content").alias("digest"))


X5_SQL = f"""
    SELECT chunk_id, source, md5(content) AS digest FROM ({CHUNKS_SQL})
    WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en')
    UNION ALL SELECT CAST(doc_id AS VARCHAR) || ':0', 'new', md5('v2 ' || doc_id) FROM documents WHERE lang = 'en'"""

# -- lexical ---------------------------------------------------------------------

TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
POSTINGS_SQL = f"""
    SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
      SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest(t) AS term, len(t) AS dl
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY 1, 2"""
BM25_SQL = f"""
    WITH p AS ({POSTINGS_SQL}), n AS (SELECT count(*) AS n, avg(len({TOKENS})) AS mean FROM documents),
         d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
         asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
         s AS (SELECT item_id AS query_id, chunk_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf
                 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score
               FROM asked JOIN d USING (term) JOIN p USING (term), n GROUP BY 1, 2)
    SELECT query_id, chunk_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
    WHERE rank <= 10"""


def corpus(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_name"),
        F.col("text").alias("content"),
    )


def x6(spark, sf):
    index = retrieve.lexical_index(corpus(spark, sf))
    return index.terms.select("term", "df", rounded("idf", 6).alias("idf"))


def x6_stored(spark, sf):
    """An index whose English documents were stored with another text first, and one more document that went again."""
    docs = corpus(spark, sf).withColumn("document_id", F.col("document_name"))
    english = table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("chunk_id"))
    first = docs.join(english, "chunk_id", "left_anti").unionByName(
        docs.join(english, "chunk_id", "left_semi").withColumn("content", F.lit("an older text"))
    ).unionByName(spark.createDataFrame([("x", "docx", "gone soon", "docx")], "chunk_id string, document_name string, content string, document_id string"))
    stored = retrieve.StoredIndex(spark, scratch_path(spark, "lexical"))
    stored.create(first)
    stored.replace(docs.join(english, "chunk_id", "left_semi"), spark.createDataFrame([("docx",)], "document_id string"))
    return stored.open().terms.select("term", "df", rounded("idf", 6).alias("idf"))


X6_SQL = f"""
    WITH p AS ({POSTINGS_SQL}), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, df, {near('ln(1 + (n - df + 0.5) / (df + 0.5))', 6)} AS idf
    FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), n"""


def lexical(spark, sf, k=10):
    index = retrieve.lexical_index(corpus(spark, sf))
    return retrieve.bm25_top_k(table(spark, sf, "benchmark"), index, k, query_id="item_id")


def x7(spark, sf):
    return lexical(spark, sf).select(
        "query_id", "chunk_id", rounded("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


# -- vectors -----------------------------------------------------------------------

DOUBLES = "CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])"
COSINE_SQL = f"""
    SELECT query_id, chunk_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity({DOUBLES}) AS score
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5"""
EUCLID_SQL = f"""
    SELECT query_id, chunk_id, -d AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
               list_sum([abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) FOR i IN range(1, 65)]) AS d
        FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 5"""


def semantic(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieve.vector_top_k(e, e, 5, query_id="vec_id", chunk_id="vec_id", exclude_same=True)


def x8(spark, sf):
    return semantic(spark, sf).select(
        "query_id", "chunk_id", rounded("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


def x8_threshold(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = retrieve.vector_top_k(e, e, 5, 0.4, query_id="vec_id", chunk_id="vec_id", exclude_same=True)
    return hits.select("query_id", "chunk_id", rounded("score", 6).alias("score"))


def x9(spark, sf):
    """Two rankings of the same vectors: by cosine, and by city-block distance."""
    from tableloom.functions.knn import knn_join

    e = table(spark, sf, "embeddings")
    second = knn_join(
        e, e, 5, query_id="vec_id", candidate_id="vec_id", query_vector="embedding", candidate_vector="embedding",
        metric="manhattan", exclude_same=True,
    ).select("query_id", F.col("candidate_id").alias("chunk_id"), (-F.col("distance")).alias("score"), "rank")
    fused = retrieve.fuse_rankings(semantic(spark, sf), second)
    return fused.select(
        "query_id", "chunk_id", *[rounded(c, 6).alias(c) for c in ("rrf_score", "semantic_score", "lexical_score")],
        F.col("rank").cast("bigint").alias("rank"),
    )


X9_SQL = f"""
    WITH s AS ({COSINE_SQL}), l AS ({EUCLID_SQL}),
         f AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS rrf,
                      s.score AS ss, l.score AS ls, s.rank AS sr, l.rank AS lr
               FROM s FULL OUTER JOIN l USING (query_id, chunk_id))
    SELECT query_id, chunk_id, {near('rrf')} AS rrf_score, {near('ss')} AS semantic_score, {near('ls')} AS lexical_score, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY rrf DESC, sr ASC NULLS LAST, lr ASC NULLS LAST) AS rank FROM f) WHERE rank <= 5"""

def dealt_vectors(spark, sf, docs):
    """Documents with a vector each: there are fewer vectors, so they are dealt out in turn."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
    turn = F.pmod(F.col("chunk_id").cast("bigint"), F.lit(vectors.count()))
    return docs.withColumn("n", turn).join(vectors, "n").drop("n")


def x9_hybrid(spark, sf):
    """Benchmark passages as questions, with the vector of their number, over all documents."""
    docs = corpus(spark, sf)
    questions = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "item_id", "text")
    out = retrieve.hybrid_top_k(
        dealt_vectors(spark, sf, questions), dealt_vectors(spark, sf, docs), retrieve.lexical_index(docs),
        query_id="item_id",
    )
    return out.select(
        "query_id", "chunk_id", rounded("rrf_score", 6).alias("rrf_score"), rounded("lexical_score", 5).alias("lexical_score"),
        F.col("rank").cast("bigint").alias("rank"),
    )


X9_HYBRID_SQL = f"""
    WITH l AS ({BM25_SQL}), n AS (SELECT count(*) AS n FROM embeddings),
         v AS (SELECT a.vec_id AS qv, b.vec_id AS cv, list_cosine_similarity({DOUBLES}) AS score
               FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id % n FROM benchmark, n)),
         s AS (SELECT query_id, chunk_id, rank FROM (
           SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS chunk_id,
                  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank
           FROM benchmark, documents, n JOIN v ON qv = item_id % n AND cv = doc_id % n) WHERE rank <= 10),
         f AS (SELECT query_id, chunk_id, coalesce(1.0 / (60 + s.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS rrf,
                      l.score AS ls, s.rank AS sr, l.rank AS lr
               FROM s FULL OUTER JOIN l USING (query_id, chunk_id))
    SELECT query_id, chunk_id, {near('rrf')} AS rrf_score, {near('ls', 5)} AS lexical_score, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY rrf DESC, sr ASC NULLS LAST, lr ASC NULLS LAST) AS rank FROM f) WHERE rank <= 5"""

# -- answer cache --------------------------------------------------------------------

CACHE = Source(
    "embeddings", "vec_id", "embedding",
    "CASE WHEN vec_id % 2 = 0 THEN 'shared' ELSE 'private' END AS scope",
    "CASE WHEN vec_id % 2 = 1 THEN concat('fp', CAST(label AS VARCHAR(9))) END AS dataset_fingerprint",
    "concat('answer ', CAST(vec_id AS VARCHAR(9))) AS answer",
    "concat(' question ', CAST(vec_id AS VARCHAR(9))) AS question",
)
THRESHOLD = 0.35
LOOKUP_SQL = f"""
    SELECT query_id, entry_id, scope, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS entry_id, a.scope, list_cosine_similarity({DOUBLES}) AS similarity
        FROM {CACHE.sql} a JOIN {CACHE.sql} b ON a.scope = b.scope AND a.vec_id <> b.vec_id
          AND (a.scope = 'shared' OR a.dataset_fingerprint = b.dataset_fingerprint)))
    WHERE rank = 1 AND similarity >= {THRESHOLD}"""


def x10(spark, sf):
    entries = CACHE.df(spark, sf)
    hits = answers.cache_lookup(
        entries, entries, THRESHOLD, query_id="vec_id", entry_id="vec_id", exclude_same=True
    )
    return hits.withColumn("similarity", rounded("similarity", 6))


def x11(spark, sf):
    path = scratch_path(spark, "cache")
    answers.cache_store(CACHE.df(spark, sf).select("question", "answer", "scope", "dataset_fingerprint", "embedding"), path)
    return spark.read.parquet(path).select("answer", "scope", "dataset_fingerprint")


def labelled(spark, sf):
    return table(spark, sf, "embeddings").withColumn(
        "label", F.when(F.col("label") < 5, "private").otherwise("shared")
    )


def x12(spark, sf):
    found = answers.train_scope_classifier(labelled(spark, sf), "vec_id")
    rows = [(float(found.accuracy), found.train_rows, found.test_rows)]
    return spark.createDataFrame(rows, "accuracy double, train_rows bigint, test_rows bigint")


def x13(spark, sf):
    """Every vector gets a known label and probabilities that sum to one."""
    df = labelled(spark, sf)
    scored = answers.train_scope_classifier(df, "vec_id").score(df)
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("scope").isin("private", "shared")).alias("labelled"),
        F.count_if(F.abs(F.col("p_private") + F.col("p_shared") - 1) < 1e-9).alias("normalised"),
        (F.count_if(F.col("scope") == F.col("label")) > F.count(F.lit(1)) / 2).alias("better_than_chance"),
    )


def x14(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", F.expr("CASE WHEN vec_id % 3 = 0 THEN 'shared' ELSE 'private' END").alias("scope"),
        F.expr("CASE WHEN vec_id % 4 = 0 THEN 'fp' END").alias("fingerprint"),
    )
    return df.select("vec_id", answers.resolved_scope(F.col("scope"), F.col("fingerprint")).alias("scope"))


def x15(spark, sf):
    """Questions are cached where near enough to another entry, else answered from the documents."""
    entries = CACHE.df(spark, sf)
    questions = entries.select(
        F.col("vec_id").alias("query_id"), "question", "embedding", "scope", "dataset_fingerprint"
    )
    cached = entries.withColumnRenamed("vec_id", "entry_id")
    chunked = dealt_vectors(spark, sf, corpus(spark, sf))
    routed = answers.answer_route(
        questions.withColumn("query_id", F.col("query_id").cast("string")),
        cached.withColumn("entry_id", F.col("entry_id").cast("string")), chunked, retrieve.lexical_index(chunked),
        similarity_threshold=THRESHOLD, exclude_same=True,
    )
    return routed.select("query_id", "source", "answer", F.col("context").isNotNull().alias("has_context"))


# an entry is its own nearest question unless excluded; ids are text here, so ties break by text
X15_SQL = f"""
    WITH h AS ({LOOKUP_SQL})
    SELECT CAST(e.vec_id AS VARCHAR) AS query_id,
           CASE WHEN h.query_id IS NULL THEN 'rag' ELSE 'cache_' || h.scope END AS source,
           CASE WHEN h.query_id IS NOT NULL THEN 'answer ' || h.entry_id END AS answer,
           h.query_id IS NULL AS has_context
    FROM embeddings e LEFT JOIN h ON e.vec_id = h.query_id"""


def x16(spark, sf):
    docs = corpus(spark, sf)
    hits = lexical(spark, sf, 3)
    queries = table(spark, sf, "benchmark")
    out = retrieve.assemble_context(queries, hits, docs, query_id="item_id")
    return out.select("query_id", F.md5("context").alias("digest"), F.length("context").cast("bigint").alias("chars"))


X16_SQL = f"""
    SELECT query_id, md5(c) AS digest, length(c) AS chars FROM (
      SELECT query_id, string_agg('[Document ' || rank || ']' || chr(10) || 'Source: doc' || chunk_id || chr(10) || text,
               chr(10) || chr(10) ORDER BY rank) AS c
      FROM ({BM25_SQL}) JOIN documents ON chunk_id = CAST(doc_id AS VARCHAR) WHERE rank <= 3 GROUP BY 1)"""


def x17(spark, sf):
    """Stable under row order, different after one changed cell."""
    df = table(spark, sf, "orders")
    changed = df.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    first = answers.dataset_fingerprint(df, "orders").withColumnRenamed("fingerprint", "a")
    again = answers.dataset_fingerprint(df.repartition(16, "o_custkey"), "orders").withColumnRenamed("fingerprint", "b")
    other = answers.dataset_fingerprint(changed, "orders").withColumnRenamed("fingerprint", "c")
    key = F.lit(1)
    joined = first.withColumn("k", key).join(again.withColumn("k", key), "k").join(other.withColumn("k", key), "k")
    return joined.select(
        (F.col("a") == F.col("b")).alias("stable"), (F.col("a") != F.col("c")).alias("sensitive"),
        F.length("a").cast("bigint").alias("digits"),
    )


CHECKS = {
    "x1_normalise_documents": (x1, X1_SQL),
    "x2_section_split": (x2, f"SELECT document_id, CAST(n AS BIGINT) AS n, path, md5(body) AS digest FROM ({SECTIONS_SQL})"),
    "x3_size_split": (x3, X3_SQL),
    "x4_chunk_rows": (x4, X4_SQL),
    "x5_replace_documents": (x5, X5_SQL),
    "x6_lexical_index": (x6, X6_SQL),
    "x6_stored_index": (x6_stored, X6_SQL),
    "x7_bm25_top_k": (x7, f"SELECT query_id, chunk_id, {near('score', 5)} AS score, rank FROM ({BM25_SQL})"),
    "x8_vector_top_k": (x8, f"SELECT query_id, chunk_id, {near('score')} AS score, rank FROM ({COSINE_SQL})"),
    "x8_vector_threshold": (
        x8_threshold, f"SELECT query_id, chunk_id, {near('score')} AS score FROM ({COSINE_SQL}) WHERE score >= 0.4",
    ),
    "x9_rank_fusion": (x9, X9_SQL),
    "x9_hybrid_top_k": (x9_hybrid, X9_HYBRID_SQL),
    "x10_cache_lookup": (
        x10, f"SELECT query_id, entry_id, scope, {near('similarity')} AS similarity FROM ({LOOKUP_SQL})",
    ),
    "x11_cache_store": (
        x11, f"SELECT answer, scope, coalesce(dataset_fingerprint, '') AS dataset_fingerprint FROM {CACHE.sql} t",
    ),
    "x12_train_scope_classifier": (x12, None),
    "x13_score_scope": (
        x13,
        "SELECT count(*) AS n, count(*) AS labelled, count(*) AS normalised, true AS better_than_chance FROM embeddings",
    ),
    "x14_scope_resolution": (
        x14,
        "SELECT vec_id, CASE WHEN vec_id % 3 <> 0 AND vec_id % 4 = 0 THEN 'private' ELSE 'shared' END AS scope "
        "FROM embeddings",
    ),
    "x15_cache_first_route": (x15, X15_SQL),
    "x16_context_assembly": (x16, X16_SQL),
    "x17_dataset_fingerprint": (x17, "SELECT true AS stable, true AS sensitive, CAST(16 AS BIGINT) AS digits"),
}
