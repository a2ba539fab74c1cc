"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import access, evidence, layout, lexical, logs, ranking, structure, tables, vectors
from brindle.sources import files


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a:0", "c", "Method", "Urban100 PSNR 27.45", 1, "text"), ("b:0", "c", "Method", "状态空间模型降低参数量", 2, "text")]
    return spark.createDataFrame(rows, "chunk_id string, collection string, section string, content string, page int, content_type string")


def test_bm25(spark, chunks):
    q = spark.createDataFrame([(1, "Urban100"), (2, "参数量"), (3, "unrelatedword"), (4, "")], "query_id int, question string")
    got = {(r.query_id, r.chunk_id) for r in lexical.top(lexical.bm25(chunks, q), 5).collect()}
    assert got == {(1, "a:0"), (2, "b:0")}
    assert lexical.bm25(chunks, q, keep=F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25(chunks, q, k1=0)


def test_fusion(spark):
    r = spark.createDataFrame([(1, "x", 1, "a", 3.0), (1, "x", 2, "a", 2.0), (1, "x", 3, "b", 1.0), (1, "y", 1, "b", 9.0)], "query_id int, channel string, rank int, chunk_id string, score double")
    got = [r for r in lexical.top(ranking.reciprocal_rank_fusion(r), 5).orderBy("rank").collect()]
    assert [x.chunk_id for x in got] == ["b", "a"] and abs(got[1].score - 1 / 61) < 1e-9 and set(got[0].scores) == {"x", "y", "rrf"}


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", None)], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, vector array<float>")
    assert [r.chunk_id for r in vectors.dense_top(v, q, 9).orderBy("rank").collect()] == ["a", "b"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "c"), (1, 4, "b")], "query_id int, rank int, chunk_id string")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, chunk_id string")
    m = ranking.metrics(ranked, gold).first()
    assert (m.mrr, m.hit_1, m.recall_1, m.recall_3) == (1.0, 1.0, 0.5, 1.0) and 0 < m.ndcg_3 < 1


def test_modes():
    assert ranking.resolve_mode("auto", True, False, True) == "hybrid_rerank"
    assert ranking.resolve_mode("auto", False, False, True) == "bm25"
    with pytest.raises(RuntimeError):
        ranking.resolve_mode("dense", False, False, False)


def test_table_errors(spark):
    rows = spark.createDataFrame([(2, ["x", "1"]), (3, ["y", "2.50"]), (4, ["x", "n/a"])], "row_number int, cells array<string>")
    spec = tables.Spec("group_sum", column=1, group_by=0, filters=(tables.Condition(0, "eq", "x"),))
    with pytest.raises(ValueError, match="row 4, column 2"):
        tables.groups(rows, spec, 2)
    good = tables.Spec("group_sum", column=1, group_by=0, filters=(tables.Condition(0, "ne", " z"),))
    assert [tuple(r) for r in tables.errors(rows, good).collect()] == [(4, 1, "not a number")]
    got = tables.groups(rows.where("row_number < 4"), good, 2).orderBy("key").collect()
    assert [(r.key, r.value, r.row_numbers) for r in got] == [("x", "1", [2]), ("y", "2.5", [3])]
    empty = tables.statistics(rows.where("row_number < 4"), tables.Spec("sum", column=1, filters=(tables.Condition(0, "eq", "none"),)), 2).first()
    assert (empty.value, empty.selected_rows, empty.total_rows) == ("0", 0, 2)
    with pytest.raises(ValueError):
        tables.Spec("sum").check(2)


def test_structure(spark):
    s = spark.createDataFrame([("d", 1, "3 Method", 1), ("d", 2, "3.1 Detail", 2), ("d", 3, "4 End", 1)], "doc string, section_no int, title string, level int")
    assert [r.parent for r in structure.parent_paths(s).orderBy("section_no").collect()] == ["", "3 Method", ""]
    p = spark.createDataFrame([("d", 1, 1, 1, "aaaa"), ("d", 1, 2, 1, "bbbb"), ("d", 1, 3, 2, "cccc"), ("d", 2, 1, 2, "x" * 40)], "doc string, section_no int, para_no int, page int, text string")
    assert [(r.page, r.content) for r in structure.packed_chunks(p, 16).orderBy("chunk_no").collect()] == [(1, "aaaa\n\nbbbb"), (2, "cccc"), (2, "x" * 16), (2, "x" * 16), (2, "x" * 8)]


def test_files(spark):
    f = spark.createDataFrame([("a\\b\\R.TXT", "c", "x", 2), ("s.txt", "c", "x", 1), ("e.txt", "c", "", 3), ("z.exe", "c", "x", 4), ("q.md", "../u", "x", 5)], "filename string, collection string, content string, seq int")
    got = files.ingest(f)
    assert [r.reason for r in got.orderBy("seq").collect()] == [None, None, "empty", "type", "collection"]
    assert [r.filename for r in files.register(got).collect()] == ["s.txt"]
    md = spark.createDataFrame([("k", "T", "intro\n\n# One\nbody\nmore\n\nlast")], "key string, title string, text string")
    assert [(r.section_no, r.title, r.text) for r in files.markdown(md).orderBy("section_no", "para_no").collect()] == [(0, "T", "intro"), (1, "One", "body\nmore"), (1, "One", "last")]
    c = spark.createDataFrame([("a", bytearray(b'M,P\n"x, y",4\n')), ("b", bytearray(b"M,P\n1\n"))], "key string, content binary")
    assert {(r.key, r.row_index, tuple(r.cells), r.ok) for r in files.csv_tables(c).collect()} == {("a", -1, ("M", "P"), True), ("a", 0, ("x, y", "4"), True), ("b", -1, ("M", "P"), False), ("b", 0, ("1",), False)}
    g = spark.createDataFrame([("d", "s", True, 1, ["", ""]), ("d", "s", True, 2, ["H", "", ""]), ("d", "s", True, 3, ["1", "2", None]), ("d", "h", False, 1, ["x"])], "doc string, sheet string, visible boolean, row_number int, cells array<string>")
    assert [(r.row_number, r.cells, r.headers, r.range) for r in files.sheets(g).collect()] == [(3, ["1", "2"], ["H", "列 2"], "A2:B3")]


def test_access(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    ask = spark.createDataFrame([("local", "c", "d", False), ("u", "c", "d", False)], "actor string, collection string, document string, write boolean")
    tables_ = {"users": none("actor string, role string, active boolean"), "grants": none("collection string, actor string, role string"), "policies": none("document string, restricted boolean"), "document_grants": none("document string, actor string, role string")}
    assert {(r.actor, r.allowed) for r in access.decisions(ask, **tables_).collect()} == {("local", True), ("u", False)}
    tables_["users"] = spark.createDataFrame([("u", "member", True), ("a", "admin", True), ("i", "admin", False)], "actor string, role string, active boolean")
    tables_["grants"] = spark.createDataFrame([("c", "u", "viewer")], "collection string, actor string, role string")
    tables_["policies"] = spark.createDataFrame([("r", True)], "document string, restricted boolean")
    ask = spark.createDataFrame([("u", "c", "d", False), ("u", "c", "d", True), ("u", "c", "r", False), ("a", "x", "r", True), ("i", "c", "d", False)], ask.schema)
    got = {(r.actor, r.document, r.write): r.allowed for r in access.decisions(ask, **tables_).collect()}
    assert got == {("u", "d", False): True, ("u", "d", True): False, ("u", "r", False): False, ("a", "r", True): True, ("i", "d", False): False}


def test_answers(spark):
    claim = lambda c: '{"abstain": false, "claims": [{"text": " Fact ", "citations": ' + c + "}]}"
    rows = [claim("[]"), claim("[0]"), claim("[2]"), claim("[true]"), claim('["1"]'), claim("null"), claim("[1, 1]"), '{"abstain": true}', "{}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = [tuple(r[0]) for r in df.select(evidence.claims_answer(F.col("r"), F.lit(1)).alias("x"), "i").orderBy("i").collect()]
    assert [s for s, _ in got] == ["invalid"] * 6 + ["ok", "abstained", "invalid"] and got[6][1] == "Fact [1]"
    status = [('{"a": 1}', "stop", None), ('﻿ {"a": 1}', "stop", None), ('```json\n{"a": 1}\n```', "stop", None), ('so {"a": 1}', "stop", None), ("[]", "stop", None), ('{"a": 1}', "length", None), (" ", "stop", None), ('{"a": 1}', "stop", "no")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(status)], "i int, c string, f string, r string")
    got = [r[0] for r in df.select(evidence.model_status(F.col("c"), F.col("f"), F.col("r")).alias("x"), "i").orderBy("i").collect()]
    assert got == ["ok", "ok", "ok", "invalid_json", "not_object", "truncated", "empty", "refused"]


def test_layout(spark):
    box = "doc int, page int, n int, x0 double, y0 double, x1 double, y1 double"
    r = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 1, 5.0, 5.0, 95.0, 95.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0), (1, 1, 3, 200.0, 0.0, 300.0, 100.0)], box)
    assert [x.n for x in layout.distinct_regions(r).orderBy("n").collect()] == [0, 3]
    cap = spark.createDataFrame([(1, 1, 7, 0.0, 120.0, 100.0, 130.0)], box)
    d = spark.createDataFrame([(1, 1, 0, 10.0, 50.0, 40.0, 70.0), (1, 1, 1, 30.0, 60.0, 90.0, 100.0)], box)
    assert tuple(layout.assembled(cap, d).first())[3:] == (6.0, 46.0, 94.0, 104.0)


def test_logs(spark):
    calls = spark.createDataFrame([("d", i, i == 1) for i in range(8)], "key string, idx int, ok boolean")
    assert [r.status for r in logs.breaker(calls).orderBy("idx").collect()] == ["failed", "complete", "failed", "failed", "failed", "skipped", "skipped", "skipped"]
    assert [r.status for r in logs.breaker(calls, most=1).orderBy("idx").collect()][1:] == ["skipped"] * 7
    t = spark.createDataFrame([("k", float(x), i) for i, x in enumerate([0, 1, 2, 3, 300, 301])], "key string, at double, id long")
    assert [r.accepted for r in logs.throttle(t, 3, 300).orderBy("id").collect()] == [True, True, True, False, True, True]
