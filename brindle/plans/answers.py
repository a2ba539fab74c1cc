"""Queries over the given tables: answers, evidence and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import caption_kind
from brindle.operators import evidence, layout
from brindle.operators.sizes import sent
from brindle.plans import corpus, retrieval
from brindle.sources import snapshots, views
from brindle.sources.files import canonical_json
from brindle.sources.views import table


def pl02_scl11_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each question's three best chunks as a numbered answer; questions whose id is divisible by 5 have no hits."""
    found = snapshots.written(retrieval._bm25(spark, sf, 3).where("query_id % 5 <> 0"), "found")
    hits = retrieval._indexed(spark, sf, "chunks").select("chunk_id", "content").join(sent(found), "chunk_id")
    return evidence.excerpts(views.questions(spark, sf), hits).select("query_id", F.md5("answer").alias("answer"))


def jn18_dangling(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as references to documents; evidence is what labels covers."""
    refs = table(spark, sf, "conversations").select(F.col("conv_id").alias("result"), (F.col("conv_id") * 7 + F.col("turn")).alias("evidence_id"))
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("evidence_id"))
    return evidence.dangling(refs, refs.join(have, "evidence_id", "left_semi"))


def ag21_ag23_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("task"), (F.col("event_id") % 90).alias("evidence_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    return evidence.accumulated(e)


def jn21_changed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document"), F.sha2("text", 256).alias("version"))
    new = d.where("document % 13 <> 0").withColumn("version", F.when(F.col("document") % 11 == 0, "other").otherwise(F.col("version")))
    return evidence.changed(d, new)


def scl12_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as model claims with citations by rule: some out of range, some none."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    cited = F.when(F.col("turn") % 4 == 3, F.array().cast("array<bigint>")).otherwise(F.array(F.col("turn") % 3 + 1, F.col("turn") % 3 + 1, F.lit(1).cast("long")))
    made = c.select("conv_id", "turn", F.to_json(F.struct((F.col("conv_id") % 10 == 0).alias("abstain"), F.array(F.struct(F.left("text", F.lit(40)).alias("text"), cited.alias("citations"))).alias("claims"))).alias("response"))
    got = evidence.claims_answer(F.col("response"), F.lit(2))
    return made.select("conv_id", "turn", got["status"].alias("status"), got["answer"].alias("answer"))


def scl13_model_status(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON of events as responses, broken by rule."""
    k = F.col("event_id") % 7
    body = F.when(k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 2, F.concat(F.col("props"), F.lit(" so"))).when(k == 3, "[]").when(k == 4, " ").otherwise(F.col("props"))
    e = table(spark, sf, "events").select("event_id", body.alias("content"), F.when(k == 5, "length").otherwise("stop").alias("finish"), F.when(k == 6, "no").alias("refusal"))
    return e.select("event_id", evidence.model_status(F.col("content"), F.col("finish"), F.col("refusal")).alias("status"))


def snk03_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(canonical_json(F.col("doc_id"), F.col("lang"), F.col("n_chars"), F.col("source")), 256).alias("digest"))


def snk04_export(spark: SparkSession, sf: str) -> DataFrame:
    """Each question with its numbered sources, as one text."""
    hits = retrieval._bm25(spark, sf, 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("h"))
    lines = F.array_join(F.transform("h", lambda x: F.format_string("[%d] %s", x["rank"], x["chunk_id"])), "\n")
    return views.questions(spark, sf).join(hits, "query_id").select("query_id", F.concat_ws("\n\n", "question", lines).alias("text"))


def jn10_nearby(spark: SparkSession, sf: str) -> DataFrame:
    b = corpus._blocks(spark, sf)
    regions = b.where("line_no % 7 = 2").withColumn("region", F.col("block_no"))
    return layout.nearby(regions, b.where(caption_kind(F.col("text")).isNull()).select("doc", "page", "x0", "y0", "x1", "y1", "text")).select("doc", "page", "region", F.md5("nearby").alias("nearby"))


def jn11_outside(spark: SparkSession, sf: str) -> DataFrame:
    b = corpus._blocks(spark, sf)
    figures = b.where("line_no % 5 = 0").select("doc", "page", "line_no", "x0", "y0", "x1", (F.col("y1") + 30).alias("y1"))
    return layout.outside(figures, b.where("line_no % 6 = 1").select("doc", "page", "x0", "y0", "x1", "y1")).select("doc", "line_no")


def ag22_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return corpus._blocks(spark, sf).groupBy("doc", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def jn12_distinct_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes around every third line, of growing height: those that a kept one covers go."""
    b = corpus._blocks(spark, sf).where("line_no % 3 = 0")
    boxes = b.select("doc", "page", F.col("block_no").alias("n"), "x0", "y0", "x1", (F.col("y0") + 40 + (F.col("block_no") % 5) * 30).alias("y1"))
    return layout.distinct_regions(boxes).select("doc", "page", "n")


def jn13_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Captions with the lines divisible by 5 as drawings above them."""
    b = corpus._blocks(spark, sf).withColumn("n", F.col("block_no"))
    return layout.assembled(b.where(F.col("text").rlike("(?i)^figure [0-9]")), b.where("line_no % 5 = 0").select("doc", "page", "x0", "y0", "x1", "y1"))


def jn19_used_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Of each question's ten best chunks those that a claim cites; claims cite ranks by rule."""
    hits = retrieval._bm25(spark, sf, 10)
    cited = views.questions(spark, sf).select("query_id", F.explode(F.array((F.col("query_id") % 3 + 1).cast("int"), (F.col("query_id") % 5 + 4).cast("int"))).alias("rank"))
    return hits.join(cited, ["query_id", "rank"], "left_semi").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


QUERIES = {f.__name__: f for f in (
    pl02_scl11_answers, jn18_dangling, ag21_ag23_accumulated, jn21_changed, scl12_claims, scl13_model_status, snk03_snapshot, snk04_export, jn10_nearby, jn11_outside, ag22_boxes,
    jn12_distinct_regions, jn13_assembled, jn19_used_sources,
)}

# ---- the same in SQL ----

_BM = f"{retrieval._C}, {retrieval._ALL}"
_B = corpus._BLOCKS
SQL = {
    "pl02_scl11_answers": f"""{_BM}, a AS (SELECT query_id, string_agg(content || ' [' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS t FROM bm JOIN chunks USING (chunk_id) WHERE rank <= 3 AND query_id % 5 <> 0 GROUP BY 1)
      SELECT item_id AS query_id, md5(coalesce('{evidence.HEADER}' || t, '{evidence.REFUSAL}')) AS answer FROM benchmark LEFT JOIN a ON query_id = item_id""",
    "jn18_dangling": "SELECT DISTINCT conv_id AS result, conv_id * 7 + turn AS evidence_id FROM conversations WHERE conv_id * 7 + turn NOT IN (SELECT doc_id FROM labels)",
    "ag21_ag23_accumulated": """WITH l AS (SELECT user_id AS task, event_id % 90 AS evidence_id, arg_max(event_type, event_id) AS content FROM events GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY task) > 64 AS too_many FROM l""",
    "jn21_changed": "SELECT doc_id AS document FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0",
    "scl12_claims": """WITH c AS (SELECT conv_id, turn, regexp_replace(left(text, 40), '^\\s+|\\s+$', '', 'g') AS t, turn % 3 + 1 AS a FROM conversations WHERE text IS NOT NULL)
      SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN 'abstained' WHEN turn % 4 = 3 OR a > 2 OR t = '' THEN 'invalid' ELSE 'ok' END AS status,
      CASE WHEN conv_id % 10 = 0 THEN '{0}' WHEN turn % 4 = 3 OR a > 2 OR t = '' THEN NULL ELSE t || ' [' || a || ']' || CASE WHEN a <> 1 THEN '[1]' ELSE '' END END AS answer FROM c""".replace("{0}", evidence.REFUSAL),
    "scl13_model_status": "SELECT event_id, CASE event_id % 7 WHEN 6 THEN 'refused' WHEN 5 THEN 'truncated' WHEN 4 THEN 'empty' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'not_object' ELSE 'ok' END AS status FROM events",
    "snk03_snapshot": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""",
    "snk04_export": f"""{_BM}, a AS (SELECT query_id, string_agg('[' || rank || '] ' || chunk_id, chr(10) ORDER BY rank) AS t FROM bm WHERE rank <= 3 GROUP BY 1) SELECT query_id, text || chr(10) || chr(10) || t AS text FROM a JOIN benchmark ON item_id = query_id""",
    "jn10_nearby": f"""WITH {_B}, n AS (SELECT r.doc, r.page, r.block_no AS region, c.text, c.y0, greatest(0, c.y0 - r.y1, r.y0 - c.y1) AS d FROM blocks r JOIN blocks c USING (doc, page)
        WHERE r.i % 7 = 2 AND NOT regexp_matches(c.text, '(?i)^((fig(ure)?\\.?|table)\\s*[0-9]+|[图表]\\s*[0-9]+)') AND least(r.x1, c.x1) > greatest(r.x0, c.x0)),
      k AS (SELECT * FROM n WHERE d < 180 QUALIFY row_number() OVER (PARTITION BY doc, page, region ORDER BY d, y0, encode(text)) <= 3)
      SELECT doc, page, region, md5(left(string_agg(text, chr(10) ORDER BY y0), 1800)) AS nearby FROM k GROUP BY 1, 2, 3""",
    "jn11_outside": f"""WITH {_B} SELECT doc, i AS line_no FROM blocks b WHERE i % 5 = 0 AND NOT EXISTS (SELECT 1 FROM blocks h WHERE h.i % 6 = 1 AND h.doc = b.doc AND h.page = b.page AND h.x0 >= b.x0 AND h.y0 >= b.y0 AND h.x1 <= b.x1 AND h.y1 <= b.y1 + 30)""",
    "ag22_boxes": f"WITH {_B} SELECT doc, page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1 FROM blocks GROUP BY 1, 2",
    "jn13_assembled": f"""WITH {_B}, m AS (SELECT c.doc, c.page, c.block_no AS caption, min(d.x0) AS x0, min(d.y0) AS y0, max(d.x1) AS x1, max(d.y1) AS y1 FROM (SELECT * FROM blocks WHERE regexp_matches(text, '(?i)^figure [0-9]')) c
        JOIN (SELECT * FROM blocks WHERE i % 5 = 0) d USING (doc, page) WHERE least(c.x1, d.x1) > greatest(c.x0, d.x0) AND d.y1 <= c.y0 AND d.y0 >= c.y0 - 260 GROUP BY 1, 2, 3)
      SELECT doc, page, caption, (x0 - 4)::DOUBLE AS x0, (y0 - 4)::DOUBLE AS y0, (x1 + 4)::DOUBLE AS x1, (y1 + 4)::DOUBLE AS y1 FROM m WHERE x1 - x0 >= 40 AND y1 - y0 >= 30""",
    "jn19_used_sources": f"{_BM} SELECT query_id, rank, chunk_id FROM bm WHERE rank IN (query_id % 3 + 1, query_id % 5 + 4)",
}
