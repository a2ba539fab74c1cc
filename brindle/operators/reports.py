"""Results of analyses: integrity, publication, context of their sources, warnings of calculations.

A result is one row: result, question, document_ids, summary, summary_evidence_ids, findings and conflicts (text, evidence_ids), recommendations,
missing_information, evidence (evidence_id, document_id, kind, calculation_id), calculations (calculation_id, document_id). Its lists are bounded, so all
rules are expressions over one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of a result, and what a summary without sources becomes.
MOST_EVIDENCE, MOST_CALCULATIONS, MOST_DOCUMENTS, MOST_QUESTION, SHOWN = 64, 20, 200, 8000, 6000
NO_EVIDENCE = "当前资料不足以形成有据可查的结论，请补充所列资料。"
#: Headings of a report's sections and what stands in empty ones.
SCOPE, SUMMARY, FINDINGS, CONFLICTS, ADVICE, GAPS, CALCULATIONS, EVIDENCE = "任务与分析范围", "摘要", "主要发现", "资料差异与冲突", "分析建议（待业务确认）", "资料缺口", "计算记录", "引用证据快照"
NO_FINDING, NOTHING, NO_CALCULATION = "暂无具备足够证据的事实结论。", "本次分析未列出。", "本次任务未执行表格计算。"
NOT_ANALYZED = "Visual content has not been analyzed."


def _violations() -> Column:
    """array<struct<rule, item>>: all that is wrong with a result."""
    none = F.array().cast("array<struct<rule:string,item:string>>")
    found = lambda rule, items: F.transform(items, lambda x: F.struct(F.lit(rule).alias("rule"), x.cast("string").alias("item")))
    when = lambda rule, wrong, item: F.when(wrong, F.array(F.struct(F.lit(rule).alias("rule"), item.cast("string").alias("item")))).otherwise(none)
    list_ = lambda c: F.coalesce(F.col(c), F.slice(F.col(c), 1, 0), F.array())
    again = lambda ids: F.array_distinct(F.filter(ids, lambda x, i: F.array_position(ids, x) <= i))
    evidence, calculations, documents = F.col("evidence"), F.col("calculations"), list_("document_ids")
    known, made = F.transform(evidence, lambda e: e["evidence_id"]), F.transform(calculations, lambda c: c["calculation_id"])
    outside = lambda items, name: F.array_distinct(F.transform(F.filter(items, lambda x: x["document_id"].isNull() | ~F.array_contains(documents, x["document_id"])), lambda x: x[name]))
    cited = F.concat(F.array(F.col("summary_evidence_ids")), F.transform("findings", lambda f: f["evidence_ids"]), F.transform("conflicts", lambda f: f["evidence_ids"]))
    empty = F.size("summary_evidence_ids") == 0
    return F.concat(
        when("evidence over limit", F.size(evidence) > MOST_EVIDENCE, F.size(evidence)), when("calculations over limit", F.size(calculations) > MOST_CALCULATIONS, F.size(calculations)),
        when("documents over limit", F.size(documents) > MOST_DOCUMENTS, F.size(documents)),
        when("evidence without id", F.exists(known, lambda x: x.isNull()), F.lit(None)), found("evidence repeated", again(known)),
        found("evidence outside documents", outside(evidence, "evidence_id")),
        when("calculation without id", F.exists(made, lambda x: x.isNull()), F.lit(None)), found("calculation repeated", again(made)),
        found("calculation outside documents", outside(calculations, "calculation_id")),
        found("calculation missing", F.transform(F.filter(evidence, lambda e: (e["kind"] == "calculation") & ~F.coalesce(F.array_contains(made, e["calculation_id"]), F.lit(False))), lambda e: e["evidence_id"])),
        found("reference repeated", F.array_distinct(F.flatten(F.transform(cited, again)))),
        found("reference unknown", F.array_except(F.array_distinct(F.flatten(cited)), known)),
        when("summary without sources", empty & ((F.size("findings") > 0) | (F.size("conflicts") > 0) | (F.size("missing_information") == 0)), F.lit(None)),
        when("question", ~F.coalesce(F.char_length("question").between(1, MOST_QUESTION), F.lit(False)), F.coalesce(F.char_length("question"), F.lit(0))))


def violations(results: DataFrame) -> DataFrame:
    """result, rule, item of all that is wrong; a sound result has no row."""
    return results.select("result", F.inline(_violations()))


def published(results: DataFrame) -> DataFrame:
    """Sound results. Where nothing supports the summary, it says so and nothing is recommended."""
    bare = F.size("summary_evidence_ids") == 0
    sound = results.where(F.size(_violations()) == 0)
    return sound.withColumns({"summary": F.when(bare, F.lit(NO_EVIDENCE)).otherwise(F.col("summary")), "recommendations": F.when(bare, F.slice("recommendations", 1, 0)).otherwise(F.col("recommendations"))})


def section_context(hits: DataFrame, paragraphs: DataFrame, limit: int = SHOWN) -> DataFrame:
    """hits (hit, document, section, page, source, content) with context and truncated: all paragraphs (document, section, page, source, place, text) under the hit's section title on
    its page, and of its source if it has one, in order of place; the hit's own content if there are none. At most limit characters are shown."""
    h = hits.select("hit", "document", "section", "page", F.col("source").alias("own"))
    p = paragraphs.select("document", "section", "page", "source", "place", "text")
    met = h.join(p, ["document", "section", "page"]).where(F.col("own").isNull() | F.col("own").eqNullSafe(F.col("source")))
    listed = met.groupBy("hit").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    text = F.coalesce(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), F.col("content"))
    return hits.join(listed, "hit", "left").withColumn("__text", text).select(*hits.columns, F.left("__text", F.lit(limit)).alias("context"), (F.char_length("__text") > limit).alias("truncated"))


def analysis_warnings(headers: Column, missing_formula: Column, method: Column, operation: Column, selected: Column, previewed: Column, given: Column | None = None) -> Column:
    """array<string>: what a reader of a calculation must know. given: warnings that the document came with. Codes, in order; the counts of a cut preview behind a colon."""
    clean = F.transform(headers, lambda h: F.trim(h))
    ours = F.array(
        F.lit("parsed table only"), F.lit("text compared trimmed in NFC"), F.when(F.size(F.array_distinct(clean)) < F.size(clean), "duplicate headers"), F.when(missing_formula, "formula without value"),
        F.when(method == "vlm", "read by a vision model"), F.when(selected == 0, "nothing selected"), F.when(operation == "mean", "mean rounded"),
        F.when(previewed < selected, F.format_string("preview: %d of %d", previewed, selected)))
    return F.array_compact(ours if given is None else F.concat(F.coalesce(given, F.slice(ours, 1, 0)), ours))


def table_source(source: Column, document: Column, filename: Column, table: Column, page: Column, section: Column, method: Column, url: Column, suffix: Column) -> Column:
    """struct: where a table comes from. source: struct with format, or null; the format is the suffix unless the source names one."""
    named = F.coalesce(source["format"], F.regexp_replace(suffix, r"^\.+", ""))
    return F.struct(
        named.alias("format"), document.alias("document_id"), filename.alias("filename"), table.alias("table_id"), F.coalesce(page, F.lit(0)).alias("page"), F.coalesce(section, F.lit("")).alias("section"),
        F.coalesce(method, F.lit("native")).alias("extraction_method"), url.alias("file_url"))


def figure_text(figure: Column, caption: Column, nearby: Column, description: Column) -> Column:
    """What a figure's chunks are cut from: its id, caption, text nearby, and its description or that it has none."""
    body = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("VLM description (model-generated): "), description)).otherwise(F.lit(NOT_ANALYZED))
    return F.concat(F.lit("Figure "), figure.cast("string"), F.lit("\n"), F.coalesce(caption, F.lit("")), F.lit("\nNearby text: "), F.coalesce(nearby, F.lit("")), F.lit("\n"), body)


def range_text(numbers: Column) -> Column:
    """`1–3, 7` of an array of row numbers."""
    first = F.slice(F.array_sort(F.array_distinct(numbers)), 1, 0)
    gap = F.struct(first.alias("from"), first.alias("to"))

    def step(a, n):
        goes_on = F.element_at(a["to"], -1) == n - 1
        to = F.concat(F.slice(a["to"], F.lit(1), F.greatest(F.size(a["to"]) - 1, F.lit(0))), F.array(n))
        return F.when(F.coalesce((F.size(a["to"]) > 0) & goes_on, F.lit(False)), F.struct(a["from"].alias("from"), to.alias("to"))).otherwise(
            F.struct(F.concat(a["from"], F.array(n)).alias("from"), F.concat(a["to"], F.array(n)).alias("to")))

    def shown(a):
        return F.array_join(F.zip_with(a["from"], a["to"], lambda x, y: F.when(x == y, x.cast("string")).otherwise(F.concat_ws("–", x, y))), ", ")

    return F.aggregate(F.array_sort(F.array_distinct(numbers)), gap, step, shown)


def outline(results: DataFrame, title: str) -> DataFrame:
    """result, position, level, text: the rows of a report, in order. level: 0 title, 1 section, 2 part, 3 text. calculations have row_numbers, the rows they selected."""
    row = lambda level, text: F.struct(F.lit(level).alias("level"), text.cast("string").alias("text"))
    said = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    refs = lambda ids: F.array_join(F.transform(ids, lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
    head = lambda text: F.array(row(1, F.lit(text)))
    or_else = lambda items, text: F.when(F.size(items) > 0, items).otherwise(F.array(row(3, F.lit(text))))
    claims = lambda c: F.transform(c, lambda x, i: row(3, said(i + 1, ". ", x["text"], " ", refs(x["evidence_ids"]))))
    plain = lambda c: F.transform(c, lambda x, i: row(3, said(i + 1, ". ", x)))
    calculations = F.flatten(F.transform("calculations", lambda x, i: F.array(
        row(2, said("计算 ", i + 1, "：", x["document_id"], " / ", x["calculation_id"])), row(3, said("全部选中源行：", range_text(x["row_numbers"]))))))
    evidence = F.flatten(F.transform("evidence", lambda x: F.array(row(2, said("[", x["evidence_id"], "]")), row(3, said("文档 ID：", x["document_id"])))))
    rows = F.concat(
        F.array(row(0, F.lit(title))), head(SCOPE), F.array(row(3, F.col("question")), row(3, said("涉及 ", F.size("document_ids"), " 份资料；报告保留本次任务的证据和计算快照。"))),
        head(SUMMARY), F.array(row(3, said(F.col("summary"), " ", refs(F.col("summary_evidence_ids"))))), head(FINDINGS), or_else(claims("findings"), NO_FINDING),
        head(CONFLICTS), or_else(claims("conflicts"), NOTHING), head(ADVICE), or_else(plain("recommendations"), NOTHING), head(GAPS), or_else(plain("missing_information"), NOTHING),
        head(CALCULATIONS), or_else(calculations, NO_CALCULATION), head(EVIDENCE), evidence)
    return results.select("result", F.posexplode(rows).alias("position", "x")).select("result", F.col("position").cast("long").alias("position"), F.col("x.level").cast("long").alias("level"), "x.text")
