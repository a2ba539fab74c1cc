"""What indexing runs and tasks leave: anchors of figures, summaries, document sets, galleries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """document, figure, anchor: a figure's vector goes with the first of its own chunks; figures without one are left out.
    chunks: document, figure, chunk_no, chunk_id."""
    first = chunks.where("figure IS NOT NULL").groupBy("document", "figure").agg(F.min_by("chunk_id", F.struct("chunk_no", "chunk_id")).alias("anchor"))
    return figures.select("document", "figure").distinct().join(first, ["document", "figure"])


def run_summary(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """document, chunks, figures, tables, dense_indexed, image_indexed, visual_analyzed of every document.
    parts: document, kind (chunk, figure or table), indexed and analyzed (booleans; null counts as false)."""
    of = lambda kind, yes=F.lit(True): F.count_if((F.col("kind") == kind) & F.coalesce(yes, F.lit(False)))
    counted = parts.groupBy("document").agg(
        of("chunk").alias("chunks"), of("figure").alias("figures"), of("table").alias("tables"), (of("chunk", F.col("indexed")) > 0).alias("dense_indexed"),
        of("figure", F.col("indexed")).alias("image_indexed"), of("figure", F.col("analyzed")).alias("visual_analyzed"))
    return documents.select("document").distinct().join(counted, "document", "left").na.fill(0, ["chunks", "figures", "tables", "image_indexed", "visual_analyzed"]).na.fill(False, ["dense_indexed"])


def document_set(scoped: DataFrame, touched: DataFrame) -> DataFrame:
    """task, documents: the documents a task was given or has touched, each once, in order. Both: task, document. Pairs are made distinct
    before they meet, so a task's array is as long as its set."""
    pairs = scoped.select("task", "document").unionByName(touched.select("task", "document")).where("document IS NOT NULL").distinct()
    return pairs.groupBy("task").agg(F.array_sort(F.collect_list("document")).alias("documents"))


def gallery(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows (row_index) of each table: Spark keeps n of a table in each task before the shuffle."""
    w = Window.partitionBy("table").orderBy("row_index")
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def run_report(documents: DataFrame, parts: DataFrame, warnings: DataFrame) -> DataFrame:
    """run_summary() as an indexing run reports it: image_indexed says whether there is any image vector, and warnings (document, warning) are an array in order,
    each once, empty if there are none."""
    told = warnings.where("warning IS NOT NULL").groupBy("document").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    out = run_summary(documents, parts).withColumn("image_indexed", F.col("image_indexed") > 0).join(told, "document", "left")
    return out.withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def visuals(documents: DataFrame, figures: DataFrame, rows: DataFrame, warnings: DataFrame, n: int = 20) -> DataFrame:
    """document, kind (figure, row or warning), table, position, content, total_rows: what a document shows, one row an item, for every document asked for.
    figures: document, position, content; rows: document, table, row_index, content; warnings: document, warning. Of each table the first n rows, with how many it
    has; all figures and all warnings. Rows are counted and kept within each task before the shuffle, so a long table passes n rows a task."""
    asked = documents.select("document").distinct()
    item = lambda df, kind, table, position, content, total: df.select("document", F.lit(kind).alias("kind"), table.cast("string").alias("table"), position.cast("long").alias("position"), content.cast("string").alias("content"), total.cast("long").alias("total_rows"))
    none = F.lit(None)
    w = Window.partitionBy("document", "table").orderBy("row_index")
    first = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).join(rows.groupBy("document", "table").agg(F.count("*").alias("__total")), ["document", "table"])
    told = warnings.where("warning IS NOT NULL").select("document", "warning").distinct()
    told = told.withColumn("__at", F.row_number().over(Window.partitionBy("document").orderBy("warning")) - 1)
    out = item(figures, "figure", none, F.col("position"), F.col("content"), none).unionByName(
        item(first, "row", F.col("table"), F.col("row_index"), F.col("content"), F.col("__total"))).unionByName(item(told, "warning", none, F.col("__at"), F.col("warning"), none))
    return out.join(asked, "document", "left_semi")
