"""Files in, normalized tables out."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import column_letter, strip
from brindle.sources.views import content_id

SUFFIXES = (".pdf", ".docx", ".xlsx", ".txt", ".md", ".csv", ".png", ".jpg", ".jpeg", ".webp")
MAX_BYTES = 25 << 20


def binary_files(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """filename, content, collection, seq of files under path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("filename"), "content", F.lit(collection).alias("collection"), F.col("modificationTime").alias("seq"))


def ingest(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds name, suffix, document_id and reason (why a file is refused, else null)."""
    name = F.element_at(F.split(F.replace(F.col("filename"), F.lit("\\"), F.lit("/")), "/"), -1)
    files = files.withColumn("name", name).withColumn("suffix", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    n = F.octet_length("content")
    reason = (
        F.when(~F.col("collection").rlike("^[a-zA-Z0-9_-]{1,64}$"), "collection").when(~F.col("suffix").isin(*SUFFIXES), "type")
        .when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > max_bytes, "size")
    )
    return files.withColumn("reason", reason).withColumn("document_id", F.when(reason.isNull(), content_id(F.col("collection"), F.col("suffix"), F.col("content"))))


def register(accepted: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """document_id, collection, filename: new documents, the first writer's name; those in known are left out."""
    new = accepted.where("reason IS NULL").groupBy("document_id", "collection", "suffix").agg(F.min_by("name", "seq").alias("filename"))
    return new if known is None else new.join(known.select("document_id"), "document_id", "left_anti")


def markdown(docs: DataFrame) -> DataFrame:
    """key, section_no, title, level, para_no, text of docs (key, title, text): blank lines separate paragraphs, # lines begin sections."""
    text = F.regexp_replace(F.regexp_replace(F.col("text"), "^\ufeff", ""), "\r\n?", "\n")
    blocks = F.split(F.regexp_replace(text, r"(?m)^(#{1,6}\s)", "\n\n$1"), r"\n\s*\n")
    blocks = F.flatten(F.transform(blocks, lambda b: F.when(b.rlike(r"^#{1,6}\s"), F.split(b, "\n", 2)).otherwise(F.array(b))))
    rows = docs.select("key", F.col("title").alias("__title"), F.posexplode(F.filter(F.transform(blocks, strip), lambda b: b != "")).alias("n", "b"))
    w = Window.partitionBy("key").orderBy("n")
    heading = F.col("b").rlike(r"^#{1,6}\s")
    rows = rows.withColumn("section_no", F.sum(heading.cast("int")).over(w))
    own = F.last(F.when(heading, F.col("b")), ignorenulls=True).over(w)
    rows = rows.withColumn("title", F.coalesce(strip(F.regexp_replace(own, "^#+", "")), F.col("__title"))).withColumn("level", F.coalesce(F.length(F.regexp_extract(own, "^#+", 0)), F.lit(1)))
    body = rows.where(~heading)
    return body.select("key", "section_no", "title", "level", F.row_number().over(Window.partitionBy("key", "section_no").orderBy("n")).alias("para_no"), F.col("b").alias("text"))


def csv_tables(files: DataFrame) -> DataFrame:
    """key, row_index (-1: headers), cells, ok of files (key, content): the whole file is refused if a record's width differs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, content in zip(b["key"], b["content"], strict=True):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"))))
                ok = bool(rows) and all(len(r) == len(rows[0]) for r in rows)
                out += [(key, i - 1, r, ok) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["key", "row_index", "cells", "ok"])

    return files.select("key", "content").mapInPandas(read, "key string, row_index int, cells array<string>, ok boolean")


def sheets(grid: DataFrame) -> DataFrame:
    """doc, sheet, row_number, cells, headers, range of a grid (doc, sheet, visible, row_number, cells): empty rows and trailing empty
    cells go, the first row left has the headers, all rows get the width of the widest."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    filled = F.filter(F.transform("cells", lambda c, i: F.when(~blank(c), i + 1).otherwise(0)), lambda i: i > 0)
    rows = grid.where("visible").withColumn("n", F.coalesce(F.array_max(filled), F.lit(0))).where("n > 0")
    w = Window.partitionBy("doc", "sheet")
    rows = rows.withColumns({"first": F.min("row_number").over(w), "last": F.max("row_number").over(w), "width": F.max("n").over(w)})
    pad = lambda c, n, width: F.concat(F.slice(c, F.lit(1), n), F.array_repeat(F.lit(""), width - n))
    rows = rows.withColumn("cells", F.transform(pad(F.col("cells"), F.col("n"), F.col("width")), lambda c: F.coalesce(c, F.lit(""))))
    named = lambda h: F.transform(h, lambda c, i: F.when(blank(c), F.concat(F.lit("列 "), (i + 1).cast("string"))).otherwise(c))
    rows = rows.withColumn("headers", named(F.first(F.when(F.col("row_number") == F.col("first"), F.col("cells")), ignorenulls=True).over(w)))
    cells = F.concat(F.lit("A"), F.col("first").cast("string"), F.lit(":"), column_letter(F.col("width")), F.col("last").cast("string"))
    return rows.where("row_number > first").select("doc", "sheet", "row_number", "cells", "headers", cells.alias("range"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """The examples of a JSON-lines file; an empty set and repeated ids are errors."""
    kind = "id string, question string, gold_chunk_ids array<string>, collection_id string, category string, filters map<string,string>"
    df = spark.read.schema(kind).json(path).where("id IS NOT NULL")
    n = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if not n["n"] or n["n"] != n["ids"]:
        raise ValueError("the set is empty or repeats an id")
    return df


def page_sections(blocks: DataFrame) -> DataFrame:
    """doc, page, block_no, section_no, section, level, heading of blocks (doc, page, block_no, text)."""
    numbered = F.regexp_extract("text", r"^([0-9]+(?:\.[0-9]+)*\.?)\s+[A-Z][^\n]{1,100}$", 1)
    heading = (numbered != "") | F.lower("text").isin("abstract", "references", "conclusion")
    level = F.when(numbered != "", F.size(F.split(F.regexp_replace(numbered, r"\.$", ""), r"\."))).otherwise(1)
    w = Window.partitionBy("doc").orderBy("page", "block_no")
    at = F.last(F.when(heading, F.struct(F.col("text").alias("t"), level.alias("l"))), ignorenulls=True).over(w)
    return blocks.select(
        "doc", "page", "block_no", F.sum(heading.cast("int")).over(w).alias("section_no"), at["t"].alias("section"), F.coalesce(at["l"], F.lit(1)).alias("level"), heading.alias("heading"))


WORD_PARAGRAPHS, WORD_CELLS, LEVELS = 20_000, 100_000, range(10)  # limits of a document; levels of headings


def word_stream(blocks: DataFrame) -> DataFrame:
    """blocks (doc, title, seq, kind: paragraph or table, style, text, rows) in the order of a word processor's file, with paragraph (its number, empty ones counted), table (likewise), section
    (the open heading, else title), section_no, heading_path (open headings by ` / `), width (of a table) and refused (its document is too large).

    A heading is open until one of its level or a lower one. For each level the last heading is carried on by one window; it is open if no lower level's is
    later. So a document is sorted, but never one array.
    """
    paragraph, text = F.col("kind") == "paragraph", strip(F.coalesce("text", F.lit("")))
    level = F.when(paragraph & (text != ""), F.regexp_extract(F.coalesce("style", F.lit("")), r"(?i)^(?:Heading|标题)\s*([0-9])$", 1))
    level = F.when(level != "", level.cast("int"))
    width = F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0))
    cells = F.coalesce(F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(r)), F.lit(0))
    b = blocks.withColumns({"text": text, "__level": level, "width": F.when(~paragraph, width).otherwise(0), "__cells": F.when(~paragraph, cells).otherwise(0)})
    w, whole = Window.partitionBy("doc").orderBy("seq"), Window.partitionBy("doc")
    last = {f"__l{k}": F.last(F.when(F.col("__level") == k, F.struct("seq", "text")), ignorenulls=True).over(w) for k in LEVELS}
    b = b.withColumns(last | {
        "paragraph": F.sum(paragraph.cast("int")).over(w), "table": F.sum((F.col("width") > 0).cast("int")).over(w), "section_no": F.count("__level").over(w),
        "section": F.coalesce(F.last(F.when(F.col("__level").isNotNull(), F.col("text")), ignorenulls=True).over(w), F.col("title")),
        "refused": (F.sum(paragraph.cast("int")).over(whole) > WORD_PARAGRAPHS) | (F.sum("__cells").over(whole) > WORD_CELLS)})
    later = lambda k: F.greatest(*[F.coalesce(F.col(f"__l{j}.seq"), F.lit(-1)) for j in range(k)], F.lit(-1), F.lit(-1))
    open_ = F.array_compact(F.array(*[F.when(F.col(f"__l{k}.seq") > later(k), F.col(f"__l{k}.text")) for k in LEVELS]))
    return b.withColumn("heading_path", F.array_join(open_, " / ")).drop("__level", "__cells", *last)


def word_paragraphs(stream: DataFrame) -> DataFrame:
    """doc, section_no, section, paragraph, heading_path, text of a word_stream(): paragraphs with text, headings among them. Documents without pages: page is 0."""
    kept = stream.where("NOT refused AND kind = 'paragraph' AND text <> ''")
    return kept.select("doc", "section_no", "section", "paragraph", F.lit(0).alias("page"), "heading_path", "text")


def word_tables(stream: DataFrame) -> DataFrame:
    """doc, table, section, heading_path, caption, headers, rows (all of one width), row_numbers of a word_stream(). Headers are made up: the file has none."""
    t = stream.where("NOT refused AND kind = 'table' AND width > 0")
    n = F.sequence(F.lit(1), F.col("width"))
    rows = F.transform("rows", lambda r: F.concat(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), F.array_repeat(F.lit(""), F.col("width") - F.size(r))))
    return t.select(
        "doc", "table", "section", "heading_path", F.concat(F.lit("表格 "), F.col("table").cast("string")).alias("caption"), F.transform(n, lambda i: F.concat(F.lit("列 "), i.cast("string"))).alias("headers"),
        rows.alias("rows"), F.sequence(F.lit(1), F.size("rows")).alias("row_numbers"))


def replace_index(frames: dict[str, DataFrame], path: str, version: int, max_chunks: int | None = None) -> None:
    """Writes a snapshot of chunks and vectors, then the pointer that readers follow. Over max_chunks nothing is written."""
    spark = frames["chunks"].sparkSession
    if max_chunks is not None and frames["chunks"].count() > max_chunks:
        raise ValueError("too many chunks")
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy(*[c for c in ("collection",) if c in df.columns]).parquet(f"{path}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/current")


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.schema("version int").json(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/v{version}/{name}")


def canonical_json(*cols: Column | str) -> Column:
    """Fields by name in order of name, nulls written."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
