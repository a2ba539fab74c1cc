"""The report of an evaluation: what each mode found for each example, with the digest of the dataset it was measured on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.ranking import metrics

LEAF = 4  # hexadecimal digits by which rows meet: 65,536 leaves at most
MEASURES = ("mrr", "hit_1", "hit_3", "hit_5", "hit_10", "recall_1", "recall_3", "recall_5", "recall_10", "ndcg_1", "ndcg_3", "ndcg_5", "ndcg_10")


def _joined(of: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(of)), "\n"), 256)


def dataset_digest(examples: DataFrame, columns: list[str]) -> DataFrame:
    """One row, dataset_sha256: the same for the same rows in any order. Each row's digest goes with how often it occurs into a leaf by its first digits, and the digests of
    leaves into the result, so that no task meets all rows. Columns are read as strings; null differs from every string. Of no rows it is that of an empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns])
    rows = examples.select(F.sha2(text, 256).alias("__d")).groupBy("__d").agg(F.count("*").alias("__n"))
    leaves = rows.groupBy(F.left("__d", F.lit(LEAF)).alias("__leaf")).agg(_joined(F.concat_ws(" ", "__d", "__n")).alias("__d"))
    return leaves.agg(_joined(F.concat_ws(" ", "__leaf", "__d")).alias("dataset_sha256"))


def details(examples: DataFrame, gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, category, ranked_ids, MEASURES (null without gold) and empty_retrieval (1 or 0; null with gold) of every example (query_id, category). A
    ranking holds at most its depth, so ranked_ids are short."""
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("__l"))
    ids = F.coalesce(F.transform("__l", lambda x: x["chunk_id"]), F.array().cast("array<string>"))
    out = examples.select("query_id", "category").join(metrics(ranked, gold), "query_id", "left").join(listed, "query_id", "left")
    empty = F.when(F.col("mrr").isNull(), (F.size(ids) == 0).cast("double"))
    return out.select("query_id", "category", ids.alias("ranked_ids"), *MEASURES, empty.alias("empty_retrieval"))


def write_report(path: str, examples: DataFrame, gold: DataFrame, runs: dict[str, DataFrame | str], columns: list[str], depth: int = 10) -> None:
    """Writes {path}/rankings (Parquet), {path}/examples (JSON lines, a folder a mode each) and {path}/runs (one line a mode: status, reason, counts, means, dataset_sha256). runs: rankings by mode, or
    why a mode is unavailable. Gold that is no example's is left out; without examples, or with a depth below 10, nothing is written. The runs are written last, from
    what was written, so a report without them is unfinished."""
    if depth < 10 or not examples.limit(1).count():
        raise ValueError("an evaluation needs examples and a depth of 10 at least")
    spark, digest = examples.sparkSession, dataset_digest(examples, columns)
    known = gold.join(examples.select("query_id"), "query_id", "left_semi")
    lines = None
    for mode, found in runs.items():
        if isinstance(found, str):
            part = digest.select(F.lit(mode).alias("mode"), F.lit("unavailable").alias("status"), F.lit(found).alias("reason"), "dataset_sha256")
        else:
            found = found.where(F.col("rank") <= depth)
            found.write.mode("overwrite").parquet(f"{path}/rankings/mode={mode}")  # details() reads it twice
            rows = details(examples, known, spark.read.schema(found.schema).parquet(f"{path}/rankings/mode={mode}"))
            rows.write.mode("overwrite").json(f"{path}/examples/mode={mode}")
            read = spark.read.schema(rows.schema).json(f"{path}/examples/mode={mode}")
            n = F.count("mrr")
            part = read.agg(F.count("*").alias("sample_count"), n.alias("relevance_sample_count"), (F.count("*") - n).alias("unanswerable_sample_count"), *[F.avg(m).alias(m) for m in (*MEASURES, "empty_retrieval")])
            part = part.crossJoin(digest).withColumns({"mode": F.lit(mode), "status": F.lit("completed"), "retrieval_depth": F.lit(depth)})
        lines = part if lines is None else lines.unionByName(part, allowMissingColumns=True)
    lines.coalesce(1).write.mode("overwrite").json(f"{path}/runs")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The runs and the examples of a finished report."""
    runs = "mode string, status string, reason string, dataset_sha256 string, sample_count long, retrieval_depth int, relevance_sample_count long, unanswerable_sample_count long, empty_retrieval double"
    kinds = "query_id long, category string, ranked_ids array<string>, empty_retrieval double, mode string"
    more = "".join(f", {m} double" for m in MEASURES)
    return spark.read.schema(runs + more).json(f"{path}/runs"), spark.read.schema(kinds + more).json(f"{path}/examples")
