"""Ordered folds over a document's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import split_text


def parent_paths(sections: DataFrame) -> DataFrame:
    """doc, section_no, parent of sections (doc, section_no, title, level): titles of the open sections of lower level, by ` / `."""
    listed = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "level"))).alias("s"))

    def step(a, x):
        open_ = F.filter(a["stack"], lambda t: t["level"] < x["level"])
        path = F.array_join(F.transform(open_, lambda t: t["title"]), " / ")
        return F.struct(
            F.concat(a["out"], F.array(F.struct(x["section_no"].alias("section_no"), path.alias("parent")))).alias("out"),
            F.concat(open_, F.array(F.struct(x["title"].alias("title"), x["level"].alias("level")))).alias("stack"))

    start = F.struct(F.array().cast("array<struct<section_no:bigint,parent:string>>").alias("out"), F.array().cast("array<struct<title:string,level:int>>").alias("stack"))
    kept = listed.select("doc", F.transform("s", lambda x: F.struct(x["section_no"].cast("long").alias("section_no"), x["title"].alias("title"), x["level"].cast("int").alias("level"))).alias("s"))
    return kept.select("doc", F.inline(F.aggregate("s", start, step, lambda a: a["out"])))


def packed_chunks(paragraphs: DataFrame, limit: int = 1200) -> DataFrame:
    """doc, section_no, chunk_no, page, content of paragraphs (doc, section_no, para_no, page, text): the parts of a section's paragraphs,
    put together by blank lines while they fit and stay on a page."""
    if limit < 16:
        raise ValueError("limit must be at least 16")
    parts = paragraphs.select("doc", "section_no", "para_no", "page", F.posexplode(split_text(F.col("text"), limit)).alias("n", "part"))
    listed = parts.groupBy("doc", "section_no").agg(F.array_sort(F.collect_list(F.struct("para_no", "n", "page", "part"))).alias("p"))

    def step(a, x):
        flush = (a["buf"] != "") & ((a["page"] != x["page"]) | (F.length(a["buf"]) + F.length(x["part"]) + 2 > limit))
        done = F.when(flush, F.concat(a["done"], F.array(F.struct(a["page"].alias("page"), a["buf"].alias("content"))))).otherwise(a["done"])
        buf = F.when(flush | (a["buf"] == ""), x["part"]).otherwise(F.concat_ws("\n\n", a["buf"], x["part"]))
        return F.struct(done.alias("done"), buf.alias("buf"), x["page"].alias("page"))

    start = F.struct(F.array().cast("array<struct<page:int,content:string>>").alias("done"), F.lit("").alias("buf"), F.lit(1).alias("page"))
    end = lambda a: F.when(a["buf"] != "", F.concat(a["done"], F.array(F.struct(a["page"].alias("page"), a["buf"].alias("content"))))).otherwise(a["done"])
    kept = listed.select("doc", "section_no", F.transform("p", lambda x: F.struct(x["page"].cast("int").alias("page"), x["part"].alias("part"))).alias("p"))
    rows = kept.select("doc", "section_no", F.posexplode(F.aggregate("p", start, step, end)).alias("i", "c"))
    return rows.select("doc", "section_no", (F.row_number().over(Window.partitionBy("doc").orderBy("section_no", "i")) - 1).alias("chunk_no"), "c.page", "c.content")
