"""Queries over the given tables: retrieval modes, requests, tasks, and what runs report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import access, evaluation, logs, ranking, requests, runs, vectors
from brindle.operators import tables as t
from brindle.plans import corpus, retrieval
from brindle.sources import snapshots, views
from brindle.sources.views import table

NOW, DAY = 1_709_208_000, 86_400  # 2024-02-29 12:00, in seconds
MODES = ("image", "multimodal", "multimodal_rerank")


def _image(spark: SparkSession, sf: str):
    """The image channel: embeddings as vectors of figures, each anchored at the first chunk of the document of its number; a question asks by the vector of its number."""
    e = table(spark, sf, "embeddings")
    first = retrieval._indexed(spark, sf, "chunks").where("chunk_no = 0").select("document", "chunk_id")
    anchored = e.select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("document"), F.col("embedding").alias("vector")).join(first, "document")
    asked = views.questions(spark, sf).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    return lambda n: vectors.dense_top(anchored, asked, n)


def pl01_image_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The modes that search images, over a corpus without text vectors: words and images are fused."""
    rerank = lambda found, k: ranking.rerank(snapshots.written(found.select("query_id", "chunk_id"), "candidates"), views.questions(spark, sf), retrieval._indexed(spark, sf, "chunks"), k)
    words, pictures = (snapshots.written(f(max(retrieval.K, retrieval.CANDIDATES)), "found") for f in (lambda n: retrieval._bm25(spark, sf, n), _image(spark, sf)))  # once for all modes
    first = lambda df: lambda n: df.where(F.col("rank") <= n)
    out = None
    for mode in MODES:
        found = ranking.retrieved(mode, retrieval.K, first(words), image=first(pictures), rerank=rerank)
        part = retrieval._shown(found).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def snk02_report(spark: SparkSession, sf: str) -> DataFrame:
    """A written report, read again: every question by BM25, and a mode that has no index."""
    path = f"{snapshots.shared_root(spark)}/report-{uuid.uuid4().hex}"
    examples = views.questions(spark, sf).withColumn("category", F.when(F.length("question") > 200, "long").otherwise("short"))
    gold = snapshots.written(retrieval.gold(spark, sf), "gold")
    evaluation.write_report(path, examples, gold, {"bm25": retrieval._bm25(spark, sf, retrieval.K), "dense": "no vectors are indexed"}, ["query_id", "question"])
    done, found = evaluation.read_report(spark, path)
    both = done.select("mode", "status", "dataset_sha256", "sample_count", "relevance_sample_count", F.round("mrr", 6).alias("mean_mrr")).join(
        found.select("mode", "query_id", "category", F.array_join("ranked_ids", ",").alias("ranked_ids"), F.round("mrr", 6).alias("mrr"), F.round("recall_10", 6).alias("recall_10"), "empty_retrieval"), "mode", "left")
    return both


def flt04_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Questions asked in ways of which each breaks another rule."""
    i = F.col("query_id")
    r = views.questions(spark, sf).select(
        "query_id", F.when(i % 13 == 0, " \t ").when(i % 11 == 0, F.repeat("question", F.lit(100))).otherwise(F.concat(F.lit("  "), "question")).alias("question"), (i % 23).alias("k"),
        F.when(i % 7 == 0, "no such/place").otherwise("src1").alias("collection"), F.when(i % 17 == 3, "fast").otherwise("auto").alias("mode"),
        F.transform(F.sequence(F.lit(1).cast("long"), i % 19 * 6 + 1), lambda x: x.cast("string")).alias("document_ids"), F.when(i % 5 != 0, i % 9).alias("page"),
        F.when(i % 3 == 0, F.repeat(F.lit("s"), (i % 29 * 10).cast("int"))).alias("section"), F.when(i % 2 == 0, F.when(i % 31 == 2, "video").otherwise("text")).alias("content_type"))
    return requests.validated(r).select("query_id", F.md5("question").alias("question"), "reason")


def jn17_shown_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days as tasks over the documents of their events' numbers, asked for by the owner, the next user and an administrator."""
    task = F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    e = table(spark, sf, "events").select(task.alias("task"), F.col("user_id").alias("owner"), F.concat(F.lit("src"), F.col("user_id") % 7).alias("collection"), F.col("event_id").alias("document"))
    tasks = e.select("task", "owner", "collection").distinct()
    refers = e.join(table(spark, sf, "documents").select(F.col("doc_id").alias("document")), "document").select("task", "document")
    who = F.explode(F.array(F.col("owner"), F.col("owner") + 1, F.call_function("div", F.col("owner"), F.lit(50)) * 50))
    return access.shown_tasks(tasks.select("task", who.alias("actor")), tasks, refers, **corpus._grants(spark, sf))


def wn09_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs that changed some hours after they were made."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    jobs = corpus._log(spark, sf).select(F.col("event_id").alias("id"), status.alias("status"), F.col("at").alias("created_at"), (F.col("at") + F.col("event_id") % 5 * 3600).alias("updated_at"))
    return logs.retained_jobs(jobs, NOW).select("id", "status")


def wn09_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sessions of 12 hours on a day in the middle of the log."""
    s = corpus._log(spark, sf).select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.col("at") + 12 * 3600).alias("expires"))
    return logs.live_sessions(s, NOW - 45 * DAY).select("user", "id")


def st04_restarted(spark: SparkSession, sf: str) -> DataFrame:
    """The latest states of tasks after restarts at errors of some users."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("running")
    e = corpus._log(spark, sf).withColumn("task", F.concat_ws("/", "user_id", F.floor(F.col("at") / DAY).cast("long")))
    states = e.groupBy("task").agg(F.max_by(status, F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"))
    return logs.after_restarts(states, e.where("event_type = 'error' AND user_id % 25 = 0").select("at")).select("task", "status", "interrupted")


def ag12_group_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by several columns: groups with the value over all, or a refusal."""
    cells, out = views.table_cells(spark, sf, "part"), None
    names = table(spark, sf, "part").columns
    price = names.index("p_retailprice")
    for name in ("p_brand", "p_type", "p_size", "p_name", "p_partkey"):
        spec = t.Spec("group_sum", price, names.index(name))
        part = t.grouped_or_refused(cells, spec, len(names)).withColumn("column", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def ag15_table_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables of two collections, lines as their rows; the smaller one has urgent orders of one day a month."""
    o = table(spark, sf, "orders")
    small = (F.col("o_orderpriority") == "1-URGENT") & (F.dayofmonth("o_orderdate") == 1) & (F.col("o_custkey") < 150)
    tables = o.select(
        F.when(small, "urgent").otherwise("other").alias("collection"), F.col("o_orderkey").alias("document"), F.concat(F.lit("order_"), "o_orderkey", F.lit(".csv")).alias("filename"),
        F.lit(1).alias("table"), F.col("o_orderpriority").alias("caption"), F.array(F.lit("part"), F.lit(""), F.lit("price")).alias("headers"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.lit(1).alias("table"))
    warnings = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("returned to "), (F.col("l_suppkey") % 3).cast("string")).alias("warning"))
    c = t.catalog(tables, rows, warnings)
    return c.select("collection", "status", "document", F.array_join(F.transform("columns", lambda x: x["label"]), "|").alias("columns"), "row_count", "column_count", F.col("source.filename").alias("filename"), F.array_join("warnings", "|").alias("warnings"))


def _order_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_shipdate >= TIMESTAMP '1998-01-01'").select(F.col("l_orderkey").alias("document"), F.concat(F.lit("late "), "l_linestatus").alias("warning"))


def ag17_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, their lines as parts of a kind by supplier; late lines warn."""
    kind = F.element_at(F.array(F.lit("chunk"), F.lit("figure"), F.lit("table")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), kind.alias("kind"), (F.col("l_returnflag") != "R").alias("indexed"), (F.col("l_linestatus") == "F").alias("analyzed"))
    out = runs.run_report(table(spark, sf, "orders").select(F.col("o_orderkey").alias("document")), parts, _order_warnings(spark, sf))
    return out.withColumn("warnings", F.array_join("warnings", "|"))


def tk05_visuals(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents: their nation is a figure, their orders are tables by status, and orders of low priority warn."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    figures = c.select(F.col("c_custkey").alias("document"), F.col("c_nationkey").alias("position"), F.col("c_name").alias("content"))
    rows = o.select(F.col("o_custkey").alias("document"), F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("content"))
    warnings = o.where("o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("document"), F.concat(F.lit("low in "), "o_orderstatus").alias("warning"))
    return runs.visuals(c.select(F.col("c_custkey").alias("document")), figures, rows, warnings, n=3)


QUERIES = {f.__name__: f for f in (
    pl01_image_modes, snk02_report, flt04_requests, jn17_shown_tasks, wn09_jobs, wn09_sessions, st04_restarted, ag12_group_limit, ag15_table_catalog, ag17_run_report, tk05_visuals,
)}

# ---- the same in SQL ----

_C, _ALL, _tokens = retrieval._C, retrieval._ALL, retrieval.tokens
_IMAGE = """vec AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
anchored AS (SELECT chunk_id, e FROM vec JOIN chunks ON document = lpad(vec_id::VARCHAR, 8, '0') AND chunk_no = 0),
im AS (SELECT item_id AS query_id, chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT item_id, a.chunk_id, round(list_cosine_similarity(a.e, q.e), 9) AS score FROM benchmark JOIN vec q ON item_id = vec_id CROSS JOIN anchored a)),
fu AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS score FROM (SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, rank FROM im WHERE rank <= 20) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu)"""
_RERANKED = f"""rs AS (SELECT query_id, chunk_id, round(len(list_intersect(q, p)) / greatest(len(q), 1), 9) AS score
  FROM (SELECT query_id, chunk_id, list_distinct({_tokens('text')}) AS q, {_tokens("section || chr(10) || content")} AS p FROM fr JOIN benchmark ON item_id = query_id JOIN chunks USING (chunk_id) WHERE rank <= 20)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rs)"""
_DIGEST = """d1 AS (SELECT sha256('=' || item_id || chr(31) || coalesce('=' || text, '')) AS d, count(*) AS n FROM benchmark GROUP BY 1),
d2 AS (SELECT left(d, 4) AS leaf, sha256(string_agg(d || ' ' || n, chr(10) ORDER BY d || ' ' || n)) AS d FROM d1 GROUP BY 1),
dd AS (SELECT sha256(string_agg(leaf || ' ' || d, chr(10) ORDER BY leaf)) AS dataset_sha256 FROM d2)"""
_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"
_SHOW = "regexp_replace(regexp_replace({0}::DECIMAL(38,2)::VARCHAR, '0+$', ''), '\\.$', '')"


def _grouped(column: str) -> str:
    key = f"{column}::VARCHAR"
    return f"""SELECT '{column}' AS "column", CASE WHEN n > 200 THEN 'refused' ELSE 'complete' END AS status, CASE WHEN n <= 200 THEN overall END AS overall, CASE WHEN n <= 200 THEN key END AS key,
      CASE WHEN n <= 200 THEN key END AS label, CASE WHEN n <= 200 THEN c END AS count, CASE WHEN n <= 200 THEN v END AS value
      FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY key) AS r, {_SHOW.format('sum(s) OVER ()')} AS overall FROM (SELECT {key} AS key, count(*) AS c, sum(p_retailprice::DECIMAL(18,2)) AS s, {_SHOW.format('sum(p_retailprice::DECIMAL(18,2))')} AS v FROM part GROUP BY 1))
      WHERE n <= 200 OR r = 1"""


SQL = {
    "pl01_image_modes": f"""{_C}, {_ALL}, {_IMAGE}, {_RERANKED} SELECT 'image' AS mode, query_id, chunk_id, round(score, 6) AS score, rank FROM im WHERE rank <= 10
      UNION ALL SELECT 'multimodal', query_id, chunk_id, round(score, 6), rank FROM fr WHERE rank <= 10 UNION ALL SELECT 'multimodal_rerank', query_id, chunk_id, round(score, 6), rank FROM rr WHERE rank <= 10""",
    "snk02_report": f"""{_C}, {_ALL}, {retrieval._GOLD}, {retrieval._METRICS.format(ranked='bm')}, {_DIGEST},
      x AS (SELECT query_id, round(coalesce(1 / list_min(r), 0.0), 6) AS mrr, coalesce(1 / list_min(r), 0.0) AS raw, round(len(r) / n, 6) AS recall_10 FROM m),
      l AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS ids FROM bm WHERE rank <= 10 GROUP BY 1)
      SELECT 'bm25' AS mode, 'completed' AS status, dataset_sha256, (SELECT count(*) FROM benchmark) AS sample_count, (SELECT count(*) FROM x) AS relevance_sample_count, (SELECT round(avg(raw), 6) FROM x) AS mean_mrr,
        item_id AS query_id, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS category, coalesce(ids, '') AS ranked_ids, mrr, recall_10, CASE WHEN mrr IS NULL THEN (ids IS NULL)::INTEGER::DOUBLE END AS empty_retrieval
      FROM benchmark LEFT JOIN x ON x.query_id = item_id LEFT JOIN l ON l.query_id = item_id CROSS JOIN dd
      UNION ALL SELECT 'dense', 'unavailable', dataset_sha256, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dd""",
    "flt04_requests": r"""WITH r AS (SELECT item_id AS i, CASE WHEN item_id % 13 = 0 THEN ' ' || chr(9) || ' ' WHEN item_id % 11 = 0 THEN repeat(text, 100) ELSE '  ' || text END AS q FROM benchmark)
      SELECT i AS query_id, md5(regexp_replace(q, '^\s+|\s+$', '', 'g')) AS question, CASE WHEN i % 13 = 0 THEN 'blank' WHEN length(q) > 8000 THEN 'length' WHEN i % 23 NOT BETWEEN 1 AND 20 THEN 'k' WHEN i % 7 = 0 THEN 'collection'
        WHEN i % 17 = 3 THEN 'mode' WHEN i % 19 * 6 + 1 > 100 THEN 'documents' WHEN i % 5 <> 0 AND i % 9 < 1 THEN 'page' WHEN i % 3 = 0 AND i % 29 * 10 > 200 THEN 'section' WHEN i % 2 = 0 AND i % 31 = 2 THEN 'content_type' END AS reason FROM r""",
    "jn17_shown_tasks": f"""WITH {corpus._ACCESS}, e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS task, user_id AS owner, 'src' || (user_id % 7) AS collection, event_id AS document FROM events),
      ks AS (SELECT DISTINCT task, owner, collection FROM e), asked AS (SELECT DISTINCT task, owner, collection, unnest([owner, owner + 1, owner // 50 * 50]) AS actor FROM ks),
      rs AS (SELECT task, document FROM e WHERE document IN (SELECT doc_id FROM documents)),
      r AS (SELECT a.actor, a.task, a.collection, document, false AS write FROM asked a LEFT JOIN rs USING (task)),
      ok AS (SELECT r.actor, r.task, bool_and({corpus._ALLOWED_R.replace('r.document % 5 <> 0', '(r.document IS NULL OR r.document % 5 <> 0)')}) AS ok FROM r LEFT JOIN u USING (actor)
        LEFT JOIN g ON g.actor = r.actor AND g.collection = r.collection LEFT JOIN dg ON dg.actor = r.actor AND dg.document = r.document GROUP BY 1, 2)
      SELECT a.actor, a.task, ok AND (a.actor = a.owner OR coalesce(admin, false)) AS shown FROM asked a JOIN ok USING (actor, task) LEFT JOIN u USING (actor)""",
    "wn09_jobs": f"""WITH j AS (SELECT event_id AS id, {_STATUS} AS status, epoch_us(ts) / 1e6 AS c, epoch_us(ts) / 1e6 + event_id % 5 * 3600 AS m FROM events),
      f AS (SELECT * FROM j WHERE status NOT IN ('queued', 'running') ORDER BY c DESC, id DESC LIMIT 199)
      SELECT id, status FROM j WHERE status IN ('queued', 'running') UNION ALL SELECT id, status FROM f WHERE m >= {NOW - 30 * DAY}""",
    "wn09_sessions": f"""SELECT user_id AS "user", event_id AS id FROM events WHERE epoch_us(ts) / 1e6 + 43200 >= {NOW - 45 * DAY} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""",
    "st04_restarted": """WITH s AS (SELECT user_id || '/' || (epoch_us(ts) // 86400000000) AS task, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY 1),
      r AS (SELECT max(ts) AS at FROM events WHERE event_type = 'error' AND user_id % 25 = 0), x AS (SELECT task, status, coalesce(status IN ('queued', 'running') AND s.at < r.at, false) AS interrupted FROM s, r)
      SELECT task, CASE WHEN interrupted THEN 'failed' ELSE status END AS status, interrupted FROM x""",
    "ag12_group_limit": " UNION ALL ".join(_grouped(c) for c in ("p_brand", "p_type", "p_size", "p_name", "p_partkey")),
    "ag15_table_catalog": """WITH d AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' AND day(o_orderdate) = 1 AND o_custkey < 150 THEN 'urgent' ELSE 'other' END AS collection FROM orders),
      n AS (SELECT collection, count(*) AS n FROM d GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1),
      w AS (SELECT l_orderkey, string_agg(DISTINCT 'returned to ' || (l_suppkey % 3), '|' ORDER BY 'returned to ' || (l_suppkey % 3)) AS w FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
      SELECT collection, 'listed' AS status, o_orderkey AS document, '1. part|2. 未命名列|3. price' AS columns, coalesce(c, 0) AS row_count, 3 AS column_count, 'order_' || o_orderkey || '.csv' AS filename, coalesce(w, '') AS warnings
      FROM d JOIN n USING (collection) LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN w ON w.l_orderkey = o_orderkey WHERE n <= 1000
      UNION ALL SELECT collection, 'refused', NULL, NULL, NULL, NULL, NULL, NULL FROM n WHERE n > 1000""",
    "ag17_run_report": """WITH w AS (SELECT l_orderkey, string_agg(DISTINCT 'late ' || l_linestatus, '|' ORDER BY 'late ' || l_linestatus) AS w FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1),
      c AS (SELECT o_orderkey AS document, count(*) FILTER (l_suppkey % 3 = 0) AS chunks, count(*) FILTER (l_suppkey % 3 = 1) AS figures, count(*) FILTER (l_suppkey % 3 = 2) AS tables,
        coalesce(bool_or(l_suppkey % 3 = 0 AND l_returnflag <> 'R'), false) AS dense_indexed, coalesce(bool_or(l_suppkey % 3 = 1 AND l_returnflag <> 'R'), false) AS image_indexed,
        count(*) FILTER (l_suppkey % 3 = 1 AND l_linestatus = 'F') AS visual_analyzed FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
      SELECT c.*, coalesce(w, '') AS warnings FROM c LEFT JOIN w ON l_orderkey = document""",
    "tk05_visuals": """SELECT c_custkey AS document, 'figure' AS kind, NULL::VARCHAR AS "table", c_nationkey::BIGINT AS position, c_name AS content, NULL::BIGINT AS total_rows FROM customer
      UNION ALL SELECT o_custkey, 'row', o_orderstatus, o_orderkey, o_orderpriority, n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders)
        WHERE r <= 3 AND o_custkey IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT o_custkey, 'warning', NULL, row_number() OVER (PARTITION BY o_custkey ORDER BY w) - 1, w, NULL FROM (SELECT DISTINCT o_custkey, 'low in ' || o_orderstatus AS w FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey IN (SELECT c_custkey FROM customer))""",
}
