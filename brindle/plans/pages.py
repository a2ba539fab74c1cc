"""Queries over pages of blocks (captions, sections and regions by their place), admission of tasks, context of table rows, search over what is visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import tokenize
from brindle.operators import access, layout, lexical, logs, tables
from brindle.plans.corpus import _ACCESS, _grants, _log
from brindle.plans.retrieval import _BY_COLLECTION, _C, _indexed, tokens
from brindle.sources import views
from brindle.sources.views import table


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """doc, page, block_no, line_no, text, heading, box: the lines of documents as blocks, 40 a page. Their places on a page do not follow their order. Every
    seventh is a caption, of figures and tables in turn, every eleventh a heading."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    i = F.col("i")
    caption = F.concat(F.when(i % 14 == 3, "Figure ").otherwise("Table "), i.cast("string"), F.lit(". "), F.left("line", F.lit(40)))
    heading = F.when((i % 11 == 5) & (i % 7 != 3), F.concat(i.cast("string"), F.lit(" Heading")))
    b = rows.select("doc", (1 + F.floor(i / 40)).cast("int").alias("page"), (i % 40).alias("block_no"), i.alias("line_no"), F.when(i % 7 == 3, caption).otherwise(F.coalesce(heading, F.col("line"))).alias("text"), heading.alias("heading"), F.length("line").alias("w"))
    y0 = 20.0 * ((F.col("block_no") * 7) % 40)
    x0 = 40.0 + 100 * (F.col("block_no") % 3)
    return b.select("doc", "page", "block_no", "line_no", "text", "heading", x0.alias("x0"), y0.alias("y0"), (x0 + 60 + F.least(F.col("w"), F.lit(90))).alias("x1"), (y0 + 14).alias("y1"))


def _regions(b: DataFrame) -> DataFrame:
    return b.where("line_no % 5 = 2").withColumn("y0", F.col("y0") - 3).withColumn("y1", F.col("y1") + 25)


def jn08_captions_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Figures and tables at every fifth line: the nearest caption of their kind."""
    b = _blocks(spark, sf)
    boxes = _regions(b).withColumn("box", F.col("line_no")).withColumn("kind", F.when(F.col("line_no") % 2 == 0, "figure").otherwise("table"))
    return layout.captions_near(boxes, b).select("doc", F.col("box").alias("line_no"), "caption")


def jn09_section_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Regions at every fifth line: the heading above, by height on the page, or what the pages before leave open."""
    b = _blocks(spark, sf)
    found = layout.section_at(_regions(b).withColumn("box", F.col("line_no")), b.where("heading IS NOT NULL").withColumn("title", F.col("heading")))
    return found.select("doc", F.col("box").alias("line_no"), "section")


def jn13_vector_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Figure captions without a region near them: the drawings (every third line) above them as one box; regions are at lines 31, 71 and so on."""
    b = _blocks(spark, sf)
    captions = b.where(F.col("text").rlike("(?i)^figure [0-9]")).withColumn("n", F.col("block_no"))
    regions = b.where("line_no % 40 = 31").withColumn("y1", F.col("y1") + 60)
    found = layout.vector_regions(captions, b.where("line_no % 3 = 0").select("doc", "page", "x0", "y0", "x1", "y1"), regions)
    return found.select("doc", "page", F.col("caption").cast("long").alias("caption"), "x0", "y0", "x1", "y1")


def wn12_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tasks that start and end: at most 6 run for a user and 24 in all; refused ones do not count."""
    change = F.when(F.col("event_type").isin("signup", "view", "click"), 1).otherwise(-1)
    log = _log(spark, sf).select(F.col("user_id").alias("owner"), "at", F.col("event_id").alias("id"), change.alias("change"))
    return logs.admitted(log).select("id", "admitted", "running")


def jn06_hit_context(spark: SparkSession, sf: str) -> DataFrame:
    """The rows around the ten best rows of part, by BM25, for each of its types as a question."""
    p = table(spark, sf, "part").select(F.lit("part").alias("collection"), F.lit("part").alias("document"), F.col("p_partkey").alias("chunk_id"), tokenize(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("tokens"))
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("query_id"), F.col("p_type").alias("question")).distinct()
    best = lexical.top(lexical.scores(lexical.term_counts(p), p.select(F.size("tokens").alias("length")), lexical.query_terms(kinds), by=()), 10)
    rows = views.table_cells(spark, sf, "part").withColumn("table", F.lit("part"))
    found = tables.context(best.select(F.lit("part").alias("table"), F.col("chunk_id").alias("hit")), rows)
    return found.select("hit", "offset", "total", F.size("rows").cast("long").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], "|")), "\n")).alias("rows"))


def pl06_visible_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each question is asked by five users; each gets the three best chunks of each collection among the documents that they may read. Statistics are the
    collection's."""
    chunks = _indexed(spark, sf, "chunks")
    users = table(spark, sf, "events").select(F.col("user_id").alias("actor")).distinct()
    asked = views.questions(spark, sf).join(users, F.pmod(F.col("query_id") - F.col("actor"), F.lit(3)) == 0)
    asked = asked.where("actor < 15").select("query_id", "actor")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document"), F.col("source").alias("collection"))
    seen = access.visible(docs, asked.select("actor").distinct(), **_grants(spark, sf)).select("actor", F.lpad(F.col("document").cast("string"), 8, "0").alias("document"))
    readers = seen.groupBy("document").agg(F.collect_set("actor").alias("readers"))  # among those that ask: few
    ranked = lexical.best(chunks.join(readers, "document", "left"), views.questions(spark, sf), 3, by=("collection",), asked=asked)
    return ranked.select("query_id", "actor", "collection", "chunk_id", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (jn06_hit_context, pl06_visible_search, jn08_captions_by_kind, jn09_section_asof, jn13_vector_regions, wn12_admission)}

_BLOCKS = """lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
heads AS (SELECT *, CASE WHEN i % 11 = 5 AND i % 7 <> 3 THEN i || ' Heading' END AS heading FROM lines),
blocks AS (SELECT doc, 1 + i // 40 AS page, i % 40 AS block_no, i AS line_no, heading,
  trim(CASE WHEN i % 7 = 3 THEN CASE WHEN i % 14 = 3 THEN 'Figure ' ELSE 'Table ' END || i || '. ' || left(line, 40) ELSE coalesce(heading, line) END) AS text,
  40.0::DOUBLE + 100 * ((i % 40) % 3) AS x0, 20.0::DOUBLE * (((i % 40) * 7) % 40) AS y0, 100.0::DOUBLE + 100 * ((i % 40) % 3) + least(length(line), 90) AS x1, 20.0::DOUBLE * (((i % 40) * 7) % 40) + 14 AS y1 FROM heads),
regions AS (SELECT * REPLACE (y0 - 3 AS y0, y1 + 25 AS y1) FROM blocks WHERE line_no % 5 = 2)"""
_FAR = "CASE WHEN c.y0 >= r.y1 - 8 THEN greatest(0, c.y0 - r.y1) WHEN c.y1 <= r.y0 + 8 THEN greatest(0, r.y0 - c.y1) END"

_PCELLS = "[p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::DECIMAL(18,2)::VARCHAR]"

SQL = {
    "jn06_hit_context": f"""WITH tok AS (SELECT p_partkey AS i, {tokens("p_name || ' ' || p_brand || ' ' || p_type")} AS t FROM part), st AS (SELECT count(*) AS n, avg(len(t)) AS avglen FROM tok),
      tfs AS (SELECT i, length, term, count(*) AS tf FROM (SELECT i, len(t) AS length, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
      qt AS (SELECT DISTINCT p_type AS q, unnest({tokens('p_type')}) AS term FROM part),
      scored AS (SELECT q, i, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avglen))), 9) AS score FROM qt JOIN tfs USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
      h AS (SELECT DISTINCT i AS hit, greatest(0, i - 3) AS o FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM scored) WHERE rank <= 10),
      p AS (SELECT p_partkey AS i, array_to_string({_PCELLS}, '|') AS c FROM part)
      SELECT hit, o AS "offset", (SELECT count(*) FROM part) AS total, count(*) AS n, md5(string_agg(c, chr(10) ORDER BY p.i)) AS rows FROM h JOIN p ON p.i >= o AND p.i < o + 20 GROUP BY 1, 2""",
    "pl06_visible_search": f"""{_C}, {_BY_COLLECTION}, {_ACCESS}, seen AS (SELECT actor, lpad(document::VARCHAR, 8, '0') AS document FROM (SELECT d.doc_id AS document, d.source AS collection, u.actor, u.admin, u.active, substr(d.source, 4)::BIGINT AS s FROM documents d CROSS JOIN u)
        WHERE active AND (admin OR ((actor + s) % 3 <> 0 AND (document % 5 <> 0 OR (actor + document) % 4 = 0)))),
      r AS (SELECT query_id, actor, collection, chunk_id, row_number() OVER (PARTITION BY query_id, actor, collection ORDER BY score DESC, chunk_id) AS rank
        FROM scored JOIN u ON (query_id - actor) % 3 = 0 AND actor < 15 JOIN seen USING (actor) WHERE seen.document = split_part(chunk_id, ':', 1))
      SELECT query_id, actor, collection, chunk_id, rank FROM r WHERE rank <= 3""",
    "jn08_captions_by_kind": f"""WITH {_BLOCKS}, caps AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^fig(ure)?\\.?\\s*[0-9]+') THEN 0 WHEN regexp_matches(text, '(?i)^table\\s*[0-9]+') THEN 1 END AS kind FROM blocks),
      n AS (SELECT r.doc, r.line_no, c.text, {_FAR} AS far, c.y0 >= r.y1 - 8 AS below, c.y1 <= r.y0 + 8 AS above FROM regions r JOIN caps c ON r.doc = c.doc AND r.page = c.page AND r.line_no % 2 = c.kind
        WHERE least(r.x1, c.x1) > greatest(r.x0, c.x0)),
      b AS (SELECT doc, line_no, text, row_number() OVER (PARTITION BY doc, line_no ORDER BY far + CASE WHEN (line_no % 2 = 0 AND below) OR (line_no % 2 = 1 AND above) THEN 0 ELSE 30 END, text) AS k FROM n WHERE far <= 90)
      SELECT r.doc, r.line_no, coalesce(b.text, '') AS caption FROM regions r LEFT JOIN b ON b.doc = r.doc AND b.line_no = r.line_no AND k = 1""",
    "jn09_section_asof": f"""WITH {_BLOCKS}, h AS (SELECT doc, page, y0, arg_min(heading, block_no) AS title FROM blocks WHERE heading IS NOT NULL GROUP BY ALL),
      pl AS (SELECT doc, page, arg_max(heading, block_no) AS title FROM blocks WHERE heading IS NOT NULL GROUP BY ALL),
      pages AS (SELECT DISTINCT doc, page FROM regions),
      carried AS (SELECT p.doc, p.page, -1e9 AS y0, pl.title FROM pages p ASOF JOIN pl ON p.doc = pl.doc AND p.page > pl.page),
      al AS (SELECT * FROM h UNION ALL SELECT * FROM carried)
      SELECT r.doc, r.line_no, al.title AS section FROM regions r ASOF LEFT JOIN al ON r.doc = al.doc AND r.page = al.page AND r.y0 >= al.y0""",
    "jn13_vector_regions": f"""WITH RECURSIVE {_BLOCKS}, c AS (SELECT doc, page, block_no AS caption, x0, y0, x1, y1 FROM blocks WHERE regexp_matches(text, '(?i)^figure [0-9]')),
      m AS (SELECT c.doc, c.page, c.caption, any_value(c.x0) AS cx0, any_value(c.y0) AS cy0, any_value(c.x1) AS cx1, any_value(c.y1) AS cy1, min(d.x0) - 4 AS x0, min(d.y0) - 4 AS y0, max(d.x1) + 4 AS x1, max(d.y1) + 4 AS y1
        FROM c JOIN blocks d ON c.doc = d.doc AND c.page = d.page WHERE d.line_no % 3 = 0 AND d.y0 >= c.y0 - 260 AND d.y0 < c.y0 AND d.y1 <= c.y0 + 3 AND d.x1 > c.x0 AND d.x0 < c.x1
        GROUP BY c.doc, c.page, c.caption HAVING max(d.x1) - min(d.x0) >= 40 AND max(d.y1) - min(d.y0) >= 30),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY caption) AS k FROM m),
      s AS (SELECT doc, page, [{{'caption': -1::BIGINT, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1 + 60}}] AS held FROM blocks WHERE line_no % 40 = 31),
      f AS (SELECT p.doc, p.page, 0::BIGINT AS k, coalesce(s.held, []) AS held FROM (SELECT DISTINCT doc, page FROM k) p LEFT JOIN s ON s.doc = p.doc AND s.page = p.page
        UNION ALL SELECT f.doc, f.page, f.k + 1, CASE WHEN len(list_filter(f.held, lambda r:
          (least(k.cx1, r.x1) > greatest(k.cx0, r.x0) AND ((k.cy0 >= r.y1 - 8 AND greatest(0, k.cy0 - r.y1) <= 90) OR (k.cy0 < r.y1 - 8 AND k.cy1 <= r.y0 + 8 AND greatest(0, r.y0 - k.cy1) <= 90)))
          OR greatest(0, least(r.x1, k.x1) - greatest(r.x0, k.x0)) * greatest(0, least(r.y1, k.y1) - greatest(r.y0, k.y0)) >= 0.8 * (k.x1 - k.x0) * (k.y1 - k.y0))) > 0 THEN f.held
          ELSE list_append(f.held, {{'caption': k.caption::BIGINT, 'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1}}) END FROM f JOIN k ON k.doc = f.doc AND k.page = f.page AND k.k = f.k + 1),
      ends AS (SELECT doc, page, arg_max(held, k) AS held FROM f GROUP BY doc, page),
      last AS (SELECT doc, page, unnest(held) AS h FROM ends)
      SELECT doc, page, h.caption AS caption, h.x0 AS x0, h.y0 AS y0, h.x1 AS x1, h.y1 AS y1 FROM last WHERE h.caption >= 0""",
    "wn12_admission": """WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS n, event_id AS id, user_id AS owner, event_type IN ('signup', 'view', 'click') AS start FROM events),
      f AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS owner, []::BIGINT[] AS held, false AS admitted
        UNION ALL SELECT e.n, e.id, e.owner, CASE WHEN NOT ok THEN held WHEN start THEN list_append(held, e.owner) ELSE list_concat(held[:list_position(held, e.owner) - 1], held[list_position(held, e.owner) + 1:]) END, ok
        FROM (SELECT e.*, f.held, CASE WHEN start THEN len(f.held) < 24 AND len(list_filter(f.held, lambda x: x = e.owner)) < 6 ELSE list_contains(f.held, e.owner) END AS ok FROM f JOIN e ON e.n = f.n + 1) e)
      SELECT id, admitted, len(list_filter(held, lambda x: x = owner))::BIGINT AS running FROM f WHERE n > 0""",
}
