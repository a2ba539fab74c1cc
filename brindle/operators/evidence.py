"""Checks of model answers, evidence and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import strip

REFUSAL = "资料中没有找到足够证据，无法回答该问题。"
HEADER = "未配置生成模型，以下为检索证据（图像描述如有生成，会单独标注）：\n\n"
_FENCE = r"(?s)^```(?:json)?\s*\n(.*?)\n?```$"


def model_status(content: Column, finish_reason: Column, refusal: Column) -> Column:
    """refused, truncated, empty, invalid_json, not_object or ok. A fence around the JSON and a byte order mark are taken off."""
    body = strip(F.regexp_replace(content, "^﻿", ""))
    body = F.when(body.rlike(_FENCE), F.regexp_extract(body, _FENCE, 1)).otherwise(body)
    # The parser stops at the end of a value: text behind an object must be told apart here.
    parsed = F.when(~body.startswith("{") | body.endswith("}"), F.try_parse_json(body))
    return (
        F.when(F.coalesce(strip(refusal), F.lit("")) != "", "refused").when(finish_reason == "length", "truncated").when(F.coalesce(body, F.lit("")) == "", "empty")
        .when(parsed.isNull(), "invalid_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_object").otherwise("ok")
    )


def claims_answer(response: Column, n_hits: Column) -> Column:
    """struct(status, answer): claims of a JSON response with every citation checked; numbers must be whole, from 1 to n_hits."""
    v = F.from_json(response, "abstain boolean, claims array<struct<text:string,citations:array<string>>>")
    raw = F.from_json(response, "claims array<struct<citations:string>>")
    whole = lambda c: c.rlike("^[1-9][0-9]*$") & (c.try_cast("int") <= n_hits)
    quoted = F.exists(F.coalesce(raw["claims"], F.array()), lambda c: c["citations"].contains('"'))
    good = F.forall(v["claims"], lambda c: (strip(c["text"]) != "") & (F.size(c["citations"]) > 0) & F.forall(c["citations"], whole))
    ok = F.coalesce((F.size(v["claims"]).between(1, 50)) & good & ~quoted, F.lit(False))
    line = lambda c: F.concat(strip(c["text"]), F.lit(" "), F.array_join(F.transform(F.array_distinct(c["citations"]), lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))
    return (
        F.when(v["abstain"], F.struct(F.lit("abstained").alias("status"), F.lit(REFUSAL).alias("answer")))
        .when(~F.coalesce(v["abstain"], F.lit(True)) & ok, F.struct(F.lit("ok").alias("status"), F.array_join(F.transform(v["claims"], line), "\n\n").alias("answer")))
        .otherwise(F.struct(F.lit("invalid").alias("status"), F.lit(None).cast("string").alias("answer")))
    )


def excerpts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, answer: the hits (query_id, rank, content) in order, numbered; a refusal without any."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: F.concat(x["content"], F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), "\n\n")
    return questions.join(listed, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit(HEADER), text), F.lit(REFUSAL)).alias("answer"))


def dangling(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """result, evidence_id of references that no evidence has."""
    return references.join(evidence.select("result", "evidence_id"), ["result", "evidence_id"], "left_anti").select("result", "evidence_id").distinct()


def accumulated(records: DataFrame, most: int = 64) -> DataFrame:
    """task, evidence_id, content of records (task, evidence_id, content, seq): later ones replace earlier; too_many marks tasks with more than most."""
    last = records.groupBy("task", "evidence_id").agg(F.max_by("content", "seq").alias("content"))
    n = last.groupBy("task").agg((F.count("*") > most).alias("too_many"))
    return last.join(n, "task")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """document of which two snapshots (document, version) differ, or that the new one lacks."""
    o = old.select("document", F.col("version").alias("old"))
    return o.join(new.select("document", F.col("version").alias("new")), "document", "left").where("new IS NULL OR old <> new").select("document")


def visual_result_valid(result: Column) -> Column:
    """A described image: 1 to 6000 characters, at most 8 tables of 1 to 32 headers, at most 100 even rows, cells of at most 512."""
    v = F.from_json(result, "description string, tables array<struct<headers:array<string>,rows:array<array<string>>>>")
    table = lambda t: F.size(t["headers"]).between(1, 32) & (F.size(t["rows"]) <= 100) & F.forall(t["rows"], lambda r: (F.size(r) == F.size(t["headers"])) & F.forall(r, lambda c: F.length(c) <= 512))
    tables = v["tables"].isNull() | (F.size(v["tables"]) <= 8) & F.forall(v["tables"], table)
    return F.coalesce(F.length(strip(v["description"])).between(1, 6000) & tables, F.lit(False))
