"""Queries over the given tables: chunking, retrieval, fusion and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import tokenize
from brindle.operators import lexical, ranking, vectors
from brindle.operators.sizes import sent
from brindle.sources import snapshots, views

K, CANDIDATES = 10, 20


def scl01_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("tokens")
    d = views.table(spark, sf, "documents").select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


def scl02_wn03_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return views.chunks(spark, sf).select("chunk_id", F.col("chunk_no").cast("long").alias("chunk_no"), "section", "content")


def ag04_postings(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_counts(views.tokenized(views.chunks(spark, sf))).groupBy("collection", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def ag05_corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_statistics(views.chunks(spark, sf)).withColumn("average_length", F.round("average_length", 6))


def _indexed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return snapshots.read(spark, views.index(spark, sf), name)


def _bm25(spark: SparkSession, sf: str, k: int, keep=None) -> DataFrame:
    return lexical.best(_indexed(spark, sf, "chunks"), views.questions(spark, sf), k, keep=keep)


def jn03_ag06_collection_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Each question in each collection: every collection has its own statistics and its own ten best."""
    ranked = lexical.best(_indexed(spark, sf, "chunks"), views.questions(spark, sf), K, by=("collection",))
    return ranked.select("collection", "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def pl05_snk01_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents in which the tenth whose ids end in 3 is replaced by new texts: its chunks, and how often their words occur."""
    path = f"{snapshots.shared_root(spark)}/reindex-{uuid.uuid4().hex}"
    docs = views.table(spark, sf, "documents").where("source IS NOT NULL")
    first = views.index_tables(views.chunked(docs), f"{path}/first")
    snapshots.replace_documents(path, first["chunks"], first)
    changed = docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("Revised. "), F.reverse("text")))
    new = views.index_tables(views.chunked(changed), f"{path}/second")
    registered = docs.select(F.col("source").alias("collection"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("document"))
    version = snapshots.replace_documents(path, registered.where("document LIKE '%3'"), new, expected=1, known=registered)
    n = snapshots.read(spark, path, "postings", version).groupBy("chunk_id").agg(F.sum("tf").alias("n_tokens"))
    chunks = snapshots.read(spark, path, "chunks", version)
    return chunks.join(n, "chunk_id", "left").select("chunk_id", "collection", F.md5("content").alias("content"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def jn03_ag06_tk01_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_bm25(spark, sf, K))


def flt01_filtered_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Only chunks whose section has `1`; statistics of all."""
    return _shown(_bm25(spark, sf, K, keep=F.contains(F.lower("section"), F.lit("1")) & (F.col("content_type") == "text") & (F.col("page") == 1)))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings")
    return e.select(F.format_string("v:%d", "vec_id").alias("chunk_id"), (F.col("label") % 2).alias("collection"), F.col("embedding").alias("vector"), "vec_id", "label")


def scl09_normalized(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).select("chunk_id", vectors.valid(F.col("vector")).alias("valid"), vectors.normalized(F.col("vector")).alias("n"))
    return v.select("chunk_id", "valid", F.round(F.element_at("n", 1), 6).alias("first"), F.round(vectors.norm(F.col("n")), 6).alias("length"))


def jn04_tk02_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 queries that FIXTURES.md and the SQL name. All: jn04_tk02_dense_all."""
    v = _vectors(spark, sf)
    return _shown(vectors.dense_top(v, v.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "vector", "collection"), K, on=["collection"]))


def jn04_tk02_dense_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors of its collection."""
    v = _vectors(spark, sf)
    return _shown(vectors.dense_top_blocks(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", "collection"), K, "collection"))


def _embedded(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """UD-01: dense search over the default text embedding."""
    c = vectors.embedded(_indexed(spark, sf, "chunks"), "chunk_id", F.col("tokens"))
    q = vectors.embedded(views.questions(spark, sf), "query_id", tokenize(F.col("question")))
    return vectors.dense_top(c, q, k)


def ud01_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_embedded(spark, sf, K))


def _fusion(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    return lexical.top(ranking.reciprocal_rank_fusion(ranking.channels({"bm25": bm25, "dense": dense})), CANDIDATES)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return _fusion(_bm25(spark, sf, CANDIDATES), _embedded(spark, sf, CANDIDATES))


def ag07_so01_tk07_wn06_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_fused(spark, sf).where(F.col("rank") <= K))


def tk03_ud03_hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = snapshots.written(_fused(spark, sf).select("query_id", "chunk_id"), "candidates")
    return _shown(ranking.rerank(found, views.questions(spark, sf), _indexed(spark, sf, "chunks"), K))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, chunk_id: chunks with a passage's first 60 characters."""
    q = views.questions(spark, sf).select("query_id", F.left("question", F.lit(60)).alias("start"))
    return lexical.containing(_indexed(spark, sf, "chunks"), q)


def ag18_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.metrics(_bm25(spark, sf, K), snapshots.written(gold(spark, sf), "gold"))


def ag19_ag20_pl03_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """By mode: status, questions with and without gold, means of the metrics. Image modes have no index here. Each channel is searched once."""
    g = snapshots.written(gold(spark, sf), "gold")
    n = views.questions(spark, sf).join(g.select("query_id").distinct().withColumn("has", F.lit(1)), "query_id", "left").agg(F.count("has").alias("relevance_samples"), (F.count("*") - F.count("has")).alias("unanswerable_samples"))
    out = None
    bm25, dense = (snapshots.written(f(spark, sf, CANDIDATES), "found") for f in (_bm25, _embedded))
    for mode, df in {"bm25": bm25, "dense": dense, "hybrid": _fusion(bm25, dense)}.items():
        part = ranking.summarize(ranking.metrics(df.where(F.col("rank") <= K), g)).select(F.lit(mode).alias("mode"), F.lit("completed").alias("status"), *["mrr", "hit_5", "recall_5", "ndcg_5"])
        out = part if out is None else out.unionByName(part)
    missing = spark.range(1).select(F.lit("image").alias("mode"), F.lit("unavailable").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("mrr", "hit_5", "recall_5", "ndcg_5")])
    out = out.unionByName(missing).crossJoin(F.broadcast(n))
    return out.select("mode", "status", "relevance_samples", "unanswerable_samples", *[F.round(c, 6).alias(c) for c in ("mrr", "hit_5", "recall_5", "ndcg_5")])


def jn14_gold_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Gold that no chunk has: every seventh question's is made up."""
    wrong = views.questions(spark, sf).where("query_id % 7 = 0").select("query_id", F.lit("nowhere:0").alias("chunk_id"))
    listed = snapshots.written(gold(spark, sf).unionByName(wrong), "gold")
    there = _indexed(spark, sf, "chunks").select("chunk_id").join(sent(listed.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return listed.join(there, "chunk_id", "left_anti").select("query_id", "chunk_id")


QUERIES = {f.__name__: f for f in (
    scl01_tokenize, scl02_wn03_chunks, ag04_postings, ag05_corpus_statistics, jn03_ag06_tk01_bm25, flt01_filtered_bm25, scl09_normalized, jn04_tk02_dense, jn04_tk02_dense_all, ud01_embedding,
    jn03_ag06_collection_bm25, pl05_snk01_reindex, ag07_so01_tk07_wn06_hybrid, tk03_ud03_hybrid_rerank, ag18_metrics, ag19_ag20_pl03_benchmark, jn14_gold_validation,
)}

# ---- the same in SQL ----

_FOLD = "lower(replace(replace({0}, 'ß', 'ss'), 'ſ', 's'))"
_TOKENS = "regexp_extract_all({0}, '[a-z0-9]+(?:[._-][a-z0-9]+)*|[一-鿿]+')"
tokens = lambda x: _TOKENS.format(_FOLD.format(x))
_CHUNKS = r"""
RECURSIVE cut AS (
  SELECT lpad(doc_id::VARCHAR, 8, '0') AS document, source AS collection, 'doc_' || doc_id AS section, 0 AS step, ''::VARCHAR AS part, regexp_replace(text, '^\s+|\s+$', '', 'g') AS rest FROM documents
  UNION ALL
  SELECT document, collection, section, step + 1,
    CASE WHEN length(rest) > 1200 THEN regexp_replace(left(rest, k), '^\s+|\s+$', '', 'g') ELSE rest END,
    CASE WHEN length(rest) > 1200 THEN regexp_replace(substr(rest, k + 1), '^\s+|\s+$', '', 'g') ELSE '' END
  FROM (SELECT *, least(1200, coalesce(nullif(length(regexp_extract(left(rest, 1201), '(?s)^.*(?:[。！？.!?]\s*|\s+)')), 0), 1200))::INTEGER AS k FROM cut WHERE rest <> '')
),
chunks AS (SELECT document, collection, section, part AS content, row_number() OVER (PARTITION BY document ORDER BY step) - 1 AS chunk_no,
    document || ':' || (row_number() OVER (PARTITION BY document ORDER BY step) - 1) AS chunk_id, 1 AS page, 'text' AS content_type FROM cut WHERE step > 0 AND part <> '')"""
_C = f"WITH {_CHUNKS}"
_BM25 = f"""
tok AS (SELECT chunk_id, section, {tokens("section || ' ' || content")} AS t FROM chunks),
st AS (SELECT count(*) AS n, avg(len(t)) AS avglen FROM tok),
tf AS (SELECT chunk_id, section, len(t) AS length, unnest(t) AS term FROM tok),
tfs AS (SELECT chunk_id, section, length, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avglen))), 9) AS score
  FROM qt JOIN tfs USING (term) JOIN df USING (term) CROSS JOIN st WHERE {{keep}} GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""
_ALL = _BM25.format(keep="true")
_BY_COLLECTION = f"""
tok AS (SELECT chunk_id, collection, {tokens("section || ' ' || content")} AS t FROM chunks),
st AS (SELECT collection, count(*) AS n, avg(len(t)) AS avglen FROM tok GROUP BY collection),
tf AS (SELECT chunk_id, collection, len(t) AS length, unnest(t) AS term FROM tok),
tfs AS (SELECT chunk_id, collection, length, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM tfs GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, collection, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avglen))), 9) AS score
  FROM qt JOIN tfs USING (term) JOIN df USING (collection, term) JOIN st USING (collection) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) AS rank FROM scored)"""
_EMBED = "list_transform(range(0, 64), lambda i: len(list_filter(list_transform({0}, lambda t: crc32(t) % 64), lambda s: s = i))::DOUBLE)"
_GOLD = "gold AS (SELECT item_id AS query_id, chunk_id FROM chunks JOIN benchmark ON contains(content, left(text, 60)))"
_METRICS = """
hit AS (SELECT query_id, rank FROM {ranked} JOIN gold USING (query_id, chunk_id) WHERE rank <= 10),
m AS (SELECT g.query_id, n, coalesce(list(rank) FILTER (rank IS NOT NULL), []) AS r FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) g LEFT JOIN hit USING (query_id) GROUP BY ALL)"""


def _metric(k: int) -> str:
    w = f"list_filter(r, lambda x: x <= {k})"
    return (f"(len({w}) > 0)::INTEGER::DOUBLE AS hit_{k}, len({w}) / n AS recall_{k}, round(coalesce(list_sum(list_transform({w}, lambda x: 1 / log2(x + 1))), 0)"
            f" / list_sum(list_transform(range(1, least({k}, n) + 1), lambda x: 1 / log2(x + 1))), 9) AS ndcg_{k}")  # fmt: skip


SQL = {
    "scl01_tokenize": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)",
    "scl02_wn03_chunks": f"{_C} SELECT chunk_id, chunk_no, section, content FROM chunks",
    "ag04_postings": f"{_C} SELECT collection, term, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM (SELECT collection, chunk_id, unnest({tokens(chr(39).join(['section || ', ' ', ' || content']))}) AS term FROM chunks) GROUP BY ALL",
    "ag05_corpus_statistics": f"{_C} SELECT collection, count(*) AS n_chunks, round(avg(len({tokens(chr(39).join(['section || ', ' ', ' || content']))})), 6) AS average_length FROM chunks GROUP BY ALL",
    "jn03_ag06_tk01_bm25": f"{_C}, {_ALL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
    "jn03_ag06_collection_bm25": f"{_C}, {_BY_COLLECTION} SELECT collection, query_id, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
    "pl05_snk01_reindex": _C.replace("regexp_replace(text,", "regexp_replace(CASE WHEN doc_id % 10 = 3 THEN 'Revised. ' || reverse(text) ELSE text END,")
    + f" SELECT chunk_id, collection, md5(content) AS content, len({tokens(chr(39).join(['section || ', ' ', ' || content']))})::BIGINT AS n_tokens FROM chunks WHERE collection IS NOT NULL",
    "flt01_filtered_bm25": f"{_C}, {_BM25.format(keep='contains(section, chr(49))')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10",
    "scl09_normalized": "SELECT 'v:' || vec_id AS chunk_id, true AS valid, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, 1.0::DOUBLE AS length FROM embeddings",
    "jn04_tk02_dense": """WITH v AS (SELECT vec_id, label % 2 AS c, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, 'v:' || v.vec_id AS chunk_id, round(list_cosine_similarity(v.e, q.e), 9) AS score FROM v JOIN v q USING (c) WHERE q.vec_id < 20),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "ag18_metrics": f"{_C}, {_ALL}, {_GOLD}, {_METRICS.format(ranked='bm')} SELECT query_id, coalesce(1 / list_min(r), 0.0) AS mrr, {', '.join(_metric(k) for k in (1, 3, 5, 10))} FROM m",
    "jn14_gold_validation": "SELECT item_id AS query_id, 'nowhere:0' AS chunk_id FROM benchmark WHERE item_id % 7 = 0",
}
