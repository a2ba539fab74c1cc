"""Queries over word-processor blocks, results of analyses, section context, figure chunks and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import split_text, url_encode
from brindle.operators import reports
from brindle.operators.sizes import sent
from brindle.plans import retrieval
from brindle.plans.pages import _BLOCKS
from brindle.plans.pages import _blocks as page_blocks
from brindle.plans.retrieval import _ALL, _C
from brindle.sources import files, snapshots
from brindle.sources.views import table


def _word_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as a word processor's blocks: by line number headings of levels 1 to 3, tables of the line's first words, empty paragraphs, text."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").alias("doc"), F.format_string("doc_%d", "doc_id").alias("title"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    i = F.col("seq")
    words = F.slice(F.split("line", " "), 1, 7)
    grid = F.array(F.slice(words, 1, 4), F.slice(words, 5, 3))
    is_table = i % 10 == 4
    style = F.when(i % 5 == 1, F.concat(F.when(i % 2 == 0, "Heading ").otherwise("标题"), (F.col("doc") + i) % 3 + 1))
    text = F.when(i % 6 == 3, "  ").when(i % 5 == 1, F.concat(F.lit(" part "), i)).otherwise(F.col("line"))
    return files.word_stream(rows.select("doc", "title", "seq", F.when(is_table, "table").otherwise("paragraph").alias("kind"), F.when(~is_table, style).alias("style"), F.when(~is_table, text).alias("text"), F.when(is_table, grid).alias("rows")))


def src06_scl07_word_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = files.word_paragraphs(_word_stream(spark, sf))
    return p.select("doc", F.col("paragraph").cast("long").alias("paragraph"), "section", F.col("section_no").cast("long").alias("section_no"), "heading_path", F.md5("text").alias("text"))


def src06_word_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = files.word_tables(_word_stream(spark, sf))
    return t.select("doc", F.col("table").cast("long").alias("table_number"), "section", "heading_path", "caption", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("rows"))


def jn07_section_context(spark: SparkSession, sf: str) -> DataFrame:
    """The three best chunks of each question, with all paragraphs of their section and page."""
    chunks = retrieval._indexed(spark, sf, "chunks").select("chunk_id", "document", "section", "page", "content")
    found = snapshots.written(retrieval._bm25(spark, sf, 3).select("query_id", "chunk_id"), "found")
    hits = chunks.join(sent(found), "chunk_id").select(F.concat_ws("/", "query_id", "chunk_id").alias("hit"), "document", "section", "page", F.lit(None).cast("string").alias("source"), "content")
    hits = snapshots.written(hits, "hits")
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("document"), F.format_string("doc_%d", "doc_id").alias("section"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    paragraphs = d.where("trim(text) <> '' AND place % 9 <> 8").select("document", "section", F.lit(1).alias("page"), F.lit(None).cast("string").alias("source"), "place", "text")
    paragraphs = paragraphs.join(sent(hits.select("document").distinct()), "document", "left_semi")
    return reports.section_context(hits, paragraphs).select("hit", F.md5("context").alias("context"), "truncated")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """A result for each conversation, with faults by rule: turns are evidence, every fourth turn's is a calculation's."""
    c = table(spark, sf, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    r, name = F.col("conv_id"), lambda k, x: F.concat(F.lit(k), x.cast("string"))
    evidence = F.transform("t", lambda x: F.struct(
        name("e", F.when((r % 5 == 0) & (x["turn"] == 3), 2).otherwise(x["turn"])).alias("evidence_id"), name("d", (r * 3 + x["turn"]) % 7).alias("document_id"),
        F.when(x["turn"] % 4 == 0, "calculation").otherwise("document").alias("kind"), F.when(x["turn"] % 4 == 0, name("c", x["turn"])).alias("calculation_id")))
    claims = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(F.left(x["text"], F.lit(40)).alias("text"), F.array(name("e", x["turn"]), name("e", x["turn"] + 1)).alias("evidence_ids")))
    calculations = F.transform(F.sequence(F.lit(0), F.when(r % 9 == 0, 0).otherwise(1)), lambda k: F.struct(name("c", 4 * k).alias("calculation_id"), name("d", k + r % 7).alias("document_id")))
    return c.select(
        r.alias("result"), F.when(r % 10 == 0, "").otherwise("q").alias("question"), F.transform(F.sequence(F.lit(0), F.when(r % 3 == 0, 6).otherwise(5)), lambda k: name("d", k)).alias("document_ids"),
        F.lit("s").alias("summary"), F.when(r % 4 == 0, F.array().cast("array<string>")).when(r % 4 == 1, F.array(F.lit("e0"), F.lit("e0"))).otherwise(F.array(F.lit("e0"))).alias("summary_evidence_ids"),
        F.when(r % 8 == 4, F.slice(claims, 1, 0)).otherwise(claims).alias("findings"), F.slice(claims, 1, 0).alias("conflicts"), F.array(F.lit("do")).alias("recommendations"),
        F.when(r % 16 == 4, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")).alias("missing_information"), evidence.alias("evidence"), calculations.alias("calculations"))


def jn18_pl07_violations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.violations(_results(spark, sf)).select("result", "rule", F.coalesce("item", F.lit("")).alias("item"))


def pl07_published(spark: SparkSession, sf: str) -> DataFrame:
    return reports.published(_results(spark, sf)).select("result", "summary", F.size("recommendations").cast("long").alias("recommendations"))


def snk07_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The reports of all conversations' results; rows that a calculation selected are by rule."""
    r = _results(spark, sf)
    rows = lambda x: F.filter(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long")), lambda n: ((n + F.col("result")) % 7 < 4) & (n % 11 != 0))
    r = r.withColumn("calculations", F.transform("calculations", lambda x: F.struct(x["calculation_id"].alias("calculation_id"), x["document_id"].alias("document_id"), rows(x).alias("row_numbers"))))
    r = r.withColumn("findings", F.transform("findings", lambda x: F.struct(F.md5(x["text"]).alias("text"), x["evidence_ids"].alias("evidence_ids"))))
    return reports.outline(r, "Report")


def wn05_figure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin a page as figures: long ones have a description; texts are cut at 120 characters."""
    b = page_blocks(spark, sf).where("block_no = 0")
    text = reports.figure_text(F.col("line_no"), F.left("text", F.lit(30)), F.col("text"), F.when(F.length("text") > 200, F.col("text")))
    return b.select("doc", "line_no", F.posexplode(split_text(F.trim(text), 120)).alias("part", "content")).select("doc", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.split("content", r"\s+"), " ").alias("content"))


def scl18_prj02_calculations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' tables by rule: warnings of a calculation over each, and where the table comes from."""
    o = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    k = F.col("k")
    headers = F.array(F.col("name"), F.when(k % 3 == 0, F.concat(F.lit(" "), "name")).otherwise(F.lit("b")))
    selected = F.when(k % 6 == 0, 0).otherwise(k * 7 % 90)
    given = F.when(k % 11 == 0, F.array(F.lit("given")))
    w = reports.analysis_warnings(headers, k % 5 == 0, F.when(k % 4 == 0, "vlm").otherwise("native"), F.when(k % 2 == 0, "mean").otherwise("sum"), selected, F.least(selected, F.lit(50)), given)
    source = F.when(k % 2 == 0, F.struct(F.when(k % 4 == 0, "docx").alias("format")))
    at = reports.table_source(source, k.cast("string"), F.col("name"), F.lit("table_1"), F.when(k % 3 == 0, F.col("nation")), F.lit(None).cast("string"), F.when(k % 4 == 0, "vlm"), F.concat(F.lit("/documents/"), url_encode(F.col("name"))), F.lit(".csv"))
    return o.select("k", F.array_join(w, "; ").alias("warnings"), F.to_json(at).alias("source"))


QUERIES = {f.__name__: f for f in (src06_scl07_word_paragraphs, src06_word_tables, jn07_section_context, jn18_pl07_violations, pl07_published, snk07_outline, wn05_figure_chunks, scl18_prj02_calculations)}

_WORD = """lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
blk AS (SELECT doc, i, i % 10 = 4 AS tab, CASE WHEN i % 10 <> 4 AND i % 5 = 1 AND i % 6 <> 3 THEN (doc + i) % 3 + 1 END AS level,
  trim(CASE WHEN i % 6 = 3 THEN '' WHEN i % 5 = 1 THEN 'part ' || i ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END) AS text, string_split(line, ' ')[:7] AS w FROM lines),
num AS (SELECT *, count(*) FILTER (NOT tab) OVER o AS paragraph, count(*) FILTER (tab) OVER o AS tables, count(level) OVER o AS section_no,
  coalesce(last_value(CASE WHEN level IS NOT NULL THEN text END IGNORE NULLS) OVER o, 'doc_' || doc) AS section FROM blk WINDOW o AS (PARTITION BY doc ORDER BY i)),
open AS (SELECT n.doc, n.i, string_agg(h.text, ' / ' ORDER BY h.i) AS path FROM num n JOIN blk h ON h.doc = n.doc AND h.i <= n.i AND h.level IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM blk x WHERE x.doc = n.doc AND x.i > h.i AND x.i <= n.i AND x.level <= h.level) GROUP BY ALL)"""
_RESULTS = """c AS (SELECT conv_id AS r, turn, role FROM conversations WHERE conv_id IS NOT NULL), r AS (SELECT DISTINCT r FROM c),
ev AS (SELECT r, turn, 'e' || CASE WHEN r % 5 = 0 AND turn = 3 THEN 2 ELSE turn END AS id, (r * 3 + turn) % 7 AS d, turn % 4 = 0 AS calc FROM c),
ca AS (SELECT r, k, 'c' || 4 * k AS id, k + r % 7 AS d FROM r, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR r % 9 <> 0),
fi AS (SELECT r, turn, unnest([turn, turn + 1]) AS e FROM c WHERE role = 'assistant' AND r % 8 <> 4),
ci AS (SELECT r, -1 AS f, 'e0' AS id FROM r WHERE r % 4 <> 0 UNION ALL SELECT r, -1, 'e0' FROM r WHERE r % 4 = 1 UNION ALL SELECT r, turn, 'e' || e FROM fi),
bad AS (
  SELECT DISTINCT r, 'evidence repeated' AS rule, id AS item FROM (SELECT r, id FROM ev GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT DISTINCT r, 'evidence outside documents', id FROM ev WHERE d > CASE WHEN r % 3 = 0 THEN 6 ELSE 5 END
  UNION ALL SELECT DISTINCT r, 'calculation outside documents', id FROM ca WHERE d > CASE WHEN r % 3 = 0 THEN 6 ELSE 5 END
  UNION ALL SELECT r, 'calculation missing', id FROM ev WHERE calc AND NOT EXISTS (SELECT 1 FROM ca WHERE ca.r = ev.r AND ca.id = 'c' || ev.turn)
  UNION ALL SELECT DISTINCT r, 'reference repeated', id FROM (SELECT r, f, id FROM ci GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT DISTINCT r, 'reference unknown', id FROM ci WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.r = ci.r AND ev.id = ci.id)
  UNION ALL SELECT r, 'summary without sources', '' FROM r WHERE r % 4 = 0 AND (EXISTS (SELECT 1 FROM fi WHERE fi.r = r.r) OR r % 16 <> 4)
  UNION ALL SELECT r, 'question', '0' FROM r WHERE r % 10 = 0)"""
SQL = {
    "src06_scl07_word_paragraphs": f"WITH {_WORD} SELECT n.doc, paragraph, section, section_no, coalesce(path, '') AS heading_path, md5(text) AS text FROM num n LEFT JOIN open USING (doc, i) WHERE NOT tab AND text <> ''",
    "src06_word_tables": f"""WITH {_WORD}, t AS (SELECT *, greatest(least(len(w), 4), len(w[5:7])) AS width FROM num WHERE tab)
      SELECT t.doc, tables AS table_number, section, coalesce(path, '') AS heading_path, '表格 ' || tables AS caption, array_to_string(list_transform(range(1, width + 1), lambda k: '列 ' || k), '|') AS headers,
      array_to_string(list_transform(range(1, width + 1), lambda k: trim(coalesce(w[:4][k], ''))), '|') || '/' || array_to_string(list_transform(range(1, width + 1), lambda k: trim(coalesce(w[5:7][k], ''))), '|') AS rows
      FROM t LEFT JOIN open USING (doc, i)""",
    "jn07_section_context": f"""{_C}, {_ALL}, p AS (SELECT lpad(doc_id::VARCHAR, 8, '0') AS document, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
      x AS (SELECT document, string_agg(line, chr(10) || chr(10) ORDER BY i) AS t FROM p WHERE trim(line) <> '' AND i % 9 <> 8 GROUP BY document)
      SELECT query_id || '/' || chunk_id AS hit, md5(left(coalesce(x.t, content), 6000)) AS context, length(coalesce(x.t, content)) > 6000 AS truncated
      FROM bm JOIN chunks USING (chunk_id) LEFT JOIN x ON x.document = chunks.document WHERE rank <= 3""",
    "jn18_pl07_violations": f"WITH {_RESULTS} SELECT r AS result, rule, item FROM bad",
    "pl07_published": f"WITH {_RESULTS} SELECT r AS result, CASE WHEN r % 4 = 0 THEN '{reports.NO_EVIDENCE}' ELSE 's' END AS summary, CASE WHEN r % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS recommendations FROM r WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.r = r.r)",
    "snk07_outline": f"""WITH {_RESULTS},
      num AS (SELECT r, unnest(range(1, 31)) AS n FROM r), sel AS (SELECT r, n, n - row_number() OVER (PARTITION BY r ORDER BY n) AS i FROM num WHERE (n + r) % 7 < 4 AND n % 11 <> 0),
      ran AS (SELECT r, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS t FROM (SELECT r, min(n) AS a, max(n) AS b FROM sel GROUP BY r, i) GROUP BY r),
      fin AS (SELECT conv_id AS r, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, md5(left(text, 40)) AS t FROM conversations WHERE role = 'assistant' AND conv_id % 8 <> 4),
      o AS (
        SELECT r, 0 AS s, 0 AS k, 0 AS level, 'Report' AS text FROM r UNION ALL SELECT r, 1, 0, 1, '{reports.SCOPE}' FROM r UNION ALL SELECT r, 1, 1, 3, CASE WHEN r % 10 = 0 THEN '' ELSE 'q' END FROM r
        UNION ALL SELECT r, 1, 2, 3, '涉及 ' || CASE WHEN r % 3 = 0 THEN 7 ELSE 6 END || ' 份资料；报告保留本次任务的证据和计算快照。' FROM r UNION ALL SELECT r, 2, 0, 1, '{reports.SUMMARY}' FROM r
        UNION ALL SELECT r, 2, 1, 3, 's ' || CASE r % 4 WHEN 0 THEN '' WHEN 1 THEN '[e0] [e0]' ELSE '[e0]' END FROM r UNION ALL SELECT r, 3, 0, 1, '{reports.FINDINGS}' FROM r
        UNION ALL SELECT r, 3, k, 3, k || '. ' || t || ' [e' || turn || '] [e' || turn + 1 || ']' FROM fin UNION ALL SELECT r, 3, 1, 3, '{reports.NO_FINDING}' FROM r WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.r = r.r)
        UNION ALL SELECT r, 4, 0, 1, '{reports.CONFLICTS}' FROM r UNION ALL SELECT r, 4, 1, 3, '{reports.NOTHING}' FROM r UNION ALL SELECT r, 5, 0, 1, '{reports.ADVICE}' FROM r UNION ALL SELECT r, 5, 1, 3, '1. do' FROM r
        UNION ALL SELECT r, 6, 0, 1, '{reports.GAPS}' FROM r UNION ALL SELECT r, 6, 1, 3, CASE WHEN r % 16 = 4 THEN '1. more' ELSE '{reports.NOTHING}' END FROM r UNION ALL SELECT r, 7, 0, 1, '{reports.CALCULATIONS}' FROM r
        UNION ALL SELECT r, 7, 2 * k + 1, 2, '计算 ' || k + 1 || '：d' || d || ' / ' || id FROM ca UNION ALL SELECT r, 7, 2 * k + 2, 3, '全部选中源行：' || t FROM ca JOIN ran USING (r)
        UNION ALL SELECT r, 8, 0, 1, '{reports.EVIDENCE}' FROM r UNION ALL SELECT r, 8, 2 * turn + 1, 2, '[' || id || ']' FROM ev UNION ALL SELECT r, 8, 2 * turn + 2, 3, '文档 ID：d' || d FROM ev)
      SELECT r AS result, row_number() OVER (PARTITION BY r ORDER BY s, k) - 1 AS position, level::BIGINT AS level, text FROM o""",
    "scl18_prj02_calculations": """WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS nation, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE s_suppkey * 7 % 90 END AS sel FROM supplier)
      SELECT k, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'given' END, 'parsed table only', 'text compared trimmed in NFC', CASE WHEN k % 3 = 0 THEN 'duplicate headers' END, CASE WHEN k % 5 = 0 THEN 'formula without value' END,
        CASE WHEN k % 4 = 0 THEN 'read by a vision model' END, CASE WHEN sel = 0 THEN 'nothing selected' END, CASE WHEN k % 2 = 0 THEN 'mean rounded' END, CASE WHEN sel > 50 THEN 'preview: 50 of ' || sel END], lambda x: x IS NOT NULL), '; ') AS warnings,
      '{"format":"' || CASE WHEN k % 4 = 0 THEN 'docx' ELSE 'csv' END || '","document_id":"' || k || '","filename":"' || n || '","table_id":"table_1","page":' || CASE WHEN k % 3 = 0 THEN nation ELSE 0 END
        || ',"section":"","extraction_method":"' || CASE WHEN k % 4 = 0 THEN 'vlm' ELSE 'native' END || '","file_url":"/documents/' || replace(n, '#', '%23') || '"}' AS source FROM s""",
}
_CUT = """WITH RECURSIVE """ + _BLOCKS + r""",
figs AS (SELECT doc, line_no, trim('Figure ' || line_no || chr(10) || left(text, 30) || chr(10) || 'Nearby text: ' || text || chr(10) || CASE WHEN length(text) > 200 THEN 'VLM description (model-generated): ' || text ELSE 'Visual content has not been analyzed.' END) AS t
  FROM blocks WHERE block_no = 0),
cut AS (SELECT doc, line_no, 0 AS step, ''::VARCHAR AS part, regexp_replace(t, '^\s+|\s+$', '', 'g') AS rest FROM figs
  UNION ALL SELECT doc, line_no, step + 1, CASE WHEN length(rest) > 120 THEN regexp_replace(left(rest, k), '^\s+|\s+$', '', 'g') ELSE rest END,
    CASE WHEN length(rest) > 120 THEN regexp_replace(substr(rest, k + 1), '^\s+|\s+$', '', 'g') ELSE '' END
  FROM (SELECT *, least(120, coalesce(nullif(length(regexp_extract(left(rest, 121), '(?s)^.*(?:[。！？.!?]\s*|\s+)')), 0), 120))::INTEGER AS k FROM cut WHERE rest <> ''))"""
SQL["wn05_figure_chunks"] = f"{_CUT} SELECT doc, line_no, regexp_replace(part, '\\s+', ' ', 'g') AS content FROM cut WHERE step > 0 AND part <> ''"
