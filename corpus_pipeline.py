"""A corpus pipeline: quality rules, near duplicates, decontamination, pseudonyms, packing. Each stage works on what the one before kept.

Defined results, besides those of the operators: a null or empty text fails the quality rules, so later stages of run() see none; a stage given some keeps them (near
duplicates and decontamination link and match nothing to them, packing gives them their one end token). Texts of any length are taken whole. Rows of equal doc_id share
their fate in stages that take documents out by id; rows of a null doc_id are kept by these. Of equal texts the smallest doc_id stays. Stages but the last return the
columns of their input, whatever their names, in their order; n_chars follows the text where pseudonyms change it. An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.decontaminate import leaks
from brindle.llm.jaccard import jaccard_components
from brindle.llm.packing import packed
from brindle.llm.pii import pseudonymized
from brindle.llm.quality import quality_rules
from brindle.llm.storage import materialize
from brindle.llm.tables import ship, table

SEND_ROWS = 1_000_000  # doc_ids to take out, at most sent to all executors


def _without(docs: DataFrame, out: DataFrame, label: str) -> DataFrame:
    """docs but for the doc_ids in out."""
    out = materialize(out.select(F.col("doc_id").alias("__out")).distinct(), label)
    out = F.broadcast(out) if out.count() <= SEND_ROWS else out
    return docs.join(out, docs["doc_id"] == out["__out"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the rules reject go."""
    return quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on shingles of five words, similarity 0.8: the smallest doc_id of each group stays."""
    ship(spark)
    found = jaccard_components(docs, size=5, num=80)
    return _without(docs, found.where("component_id <> doc_id"), "duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a benchmark item go."""
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")), "leaks")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: texts get pseudonyms; n_chars follows."""
    done = pseudonymized(docs)
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__n") > 0, F.char_length("__text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return done.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of all documents that are left."""
    ship(spark)
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: SQL expresses neither the pseudonyms nor the packing; tests/llm holds what stays against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
