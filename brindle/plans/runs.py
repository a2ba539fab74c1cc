"""Queries over the given tables: what indexing runs and tasks leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import runs
from brindle.sources.views import table


def jn05_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, their lines as chunks; lines of one supplier class are a figure's."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3).alias("figure"), F.col("l_linenumber").alias("chunk_no"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"))
    figures = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("figure"))
    return runs.anchors(figures, lines)


def ag17_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, their lines as parts of a kind by supplier."""
    kind = F.element_at(F.array(F.lit("chunk"), F.lit("figure"), F.lit("table")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), kind.alias("kind"), (F.col("l_returnflag") != "R").alias("indexed"), (F.col("l_linestatus") == "F").alias("analyzed"))
    return runs.run_summary(table(spark, sf, "orders").select(F.col("o_orderkey").alias("document")), parts)


def ag21_document_set(spark: SparkSession, sf: str) -> DataFrame:
    """Users as tasks: given one document by rule, they touch others by event."""
    e = table(spark, sf, "events")
    touched = e.select(F.col("user_id").alias("task"), (F.col("event_id") % 90).alias("document"))
    scoped = e.select(F.col("user_id").alias("task"), (F.col("user_id") % 10 + 80).alias("document")).distinct()
    return runs.document_set(scoped, touched).select("task", F.array_join(F.transform("documents", lambda x: x.cast("string")), ",").alias("documents"))


def tk05_gallery(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 orders of each status."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("table"), F.col("o_orderkey").alias("row_index"), F.col("o_custkey").alias("cell"))
    return runs.gallery(o)


QUERIES = {f.__name__: f for f in (jn05_anchors, ag17_run_summary, ag21_document_set, tk05_gallery)}

SQL = {
    "jn05_anchors": """SELECT l_orderkey AS document, l_suppkey % 3 AS figure, arg_min(l_orderkey || ':' || l_linenumber, l_linenumber) AS anchor FROM lineitem
      WHERE l_suppkey % 3 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""",
    "ag17_run_summary": """SELECT o_orderkey AS document, count(*) FILTER (l_suppkey % 3 = 0) AS chunks, count(*) FILTER (l_suppkey % 3 = 1) AS figures, count(*) FILTER (l_suppkey % 3 = 2) AS tables,
      coalesce(bool_or(l_suppkey % 3 = 0 AND l_returnflag <> 'R'), false) AS dense_indexed, count(*) FILTER (l_suppkey % 3 = 1 AND l_returnflag <> 'R') AS image_indexed,
      count(*) FILTER (l_suppkey % 3 = 1 AND l_linestatus = 'F') AS visual_analyzed FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
    "ag21_document_set": """WITH p AS (SELECT user_id AS task, event_id % 90 AS d FROM events UNION SELECT user_id, user_id % 10 + 80 FROM events)
      SELECT task, string_agg(d::VARCHAR, ',' ORDER BY d) AS documents FROM p GROUP BY 1""",
    "tk05_gallery": """SELECT o_orderstatus AS "table", o_orderkey AS row_index, o_custkey AS cell FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 20""",
}
